"""Connected components over tables of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm._spark import stash, unstash


def contracted(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links (a, b) -> (steps: node, to; the links left between the nodes that steps lead to).

    A node steps to the node of least hash among those at most two links away, and from there once more. The order of
    hashes has no long falling runs whatever the order of ids is, so that each round leaves a fraction of the nodes:
    chains take a number of rounds in the logarithm of their length.
    """
    both = live.select(F.col("a").alias("node"), F.col("b").alias("next")).union(live.select("b", "a"))
    least = F.min_by("next", F.xxhash64("next"))
    near = both.groupBy("node").agg(least.alias("next")).select("node", F.when(F.xxhash64("next") < F.xxhash64("node"), F.col("next")).otherwise(F.col("node")).alias("to"))
    seen = both.join(near.select(F.col("node").alias("next"), "to"), "next").select("node", F.col("to").alias("next")).union(near.select("node", F.col("to").alias("next")))
    wide = seen.groupBy("node").agg(least.alias("to"))
    step = stash(wide.alias("x").join(wide.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to")))
    moved = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("p")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("q")), "b")
    left = stash(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct())
    return step, left


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node, root: the smallest node that it reaches. Nodes without links have no row.

    All rounds are joins and partial sums over tables in the shared folder; only their row counts reach the driver.
    """
    live = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps = []
    while live.count():
        step, left = contracted(live)
        unstash(live)
        steps.append(step)
        live = left
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round, which has the fewest nodes, back to the first
    at = steps.pop()
    while steps:
        step = steps.pop()
        after = stash(step.join(at.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to")))
        unstash(step, at)
        at = after
    names = at.groupBy("to").agg(F.min("node").alias("root"))
    return stash(at.join(names, "to").select("node", "root"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """components() of more links, given those of the links before: only roots are contracted again."""
    if links.isEmpty():
        return labels
    root = labels.select("node", "root")
    ends = links.join(root.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left")
    more = components(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
    moved = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stash(moved.union(more.join(labels, "node", "left_anti").select("node", "root")))
