"""Scripts inside scripts, as relations: a bounded fixpoint over distinct texts.

A command reaches more scripts than itself: what its wrappers run, here-bodies, piped scripts, options that hold commands,
substitutions. `Scripts` finds them in rounds. A round lexes the distinct texts that no round before it met, judges
their pipelines, derives the texts inside them by Column rules, and puts what a wrapper runs in the wrapper's place, which makes a
spliced script of the next round. So a text that a million commands share is lexed and judged once. Each round
is written to the shared folder, so that plans don't grow with depth and a lost executor costs tasks only. A lexed text says why it was lexed,
so a round takes its parsed texts from those it has just written; only ids of all texts are shuffled in each round, not what was parsed of them.

The result is a graph: scripts, and edges that say where in a script another one stands. Commands are joined down along
the edges, at most max_depth deep, and every place has a key that sorts like the order in which it is judged:
pipelines first, in turn (0, number), with the policies of each (ordinal), then substitutions (1, pipeline, stage, number).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import let
from tidewall.functions.shell import STAGE, lex
from tidewall.functions.unwrap import inner_texts, wrapped
from tidewall.operators.policies import POLICIES
from tidewall.scratch import Pile, small, written

UNPARSABLE, TOO_DEEP = "unparsable", "nested too deep"
UNWRAP = 22


def script_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fired(stages: Column, policy: Policy, only: set[int] | None = None) -> Column:
    """Struct ordinal, policy, reason of the first policy that holds; null: none."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<ordinal:int,policy:string,reason:string>"))
    for ordinal, name, test, reason in POLICIES:
        if only is None or ordinal in only:
            hit = F.struct(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("policy"), F.lit(reason).alias("reason"))
            cond = F.coalesce(test(stages, policy), F.lit(False))
            out = out.when(cond, hit)
    return out


def _first_hit(pipelines: Column, policy: Policy, only: set[int] | None) -> Column:
    """Struct key, policy, reason of the first denial among a script's own pipelines."""

    def one(stages: Column, p: Column) -> Column:
        key = lambda hit: F.array(F.lit(0), p, hit["ordinal"]).alias("key")
        return let(fired(stages, policy, only), lambda hit: F.when(hit.isNotNull(), F.struct(key(hit), hit["policy"].alias("policy"), hit["reason"].alias("reason"))))

    return F.array_min(F.filter(F.transform(pipelines, one), lambda x: x.isNotNull()))


def _inside(pipelines: Column) -> Column:
    """Array of struct suffix, origin, text: the texts that run inside a script's pipelines."""

    def texts(stages: Column, p: Column) -> Column:
        return F.transform(inner_texts(stages), lambda x, n: F.struct(F.array(F.lit(0), p, x["policy"], n).alias("suffix"), x["origin"].alias("origin"), x["text"].alias("text")))

    def subs(stages: Column, p: Column) -> Column:
        of = lambda s, k: F.transform(s["subs"], lambda x, n: F.struct(F.array(F.lit(1), p, k, n).alias("suffix"), F.lit("subst").alias("origin"), x.alias("text")))
        return F.flatten(F.transform(stages, of))

    return F.concat(F.flatten(F.transform(pipelines, texts)), F.flatten(F.transform(pipelines, subs)))


def _wrappers(pipelines: Column) -> Column:
    """Array of struct p, items (stage, text, refused): the pipelines with a stage that runs another command."""

    def item(s: Column) -> Column:
        return let(wrapped(s), lambda w: F.struct(s.alias("stage"), F.when(w["text"].rlike(r"\S"), w["text"]).alias("text"), w["refused"].alias("refused")))

    of = F.transform(pipelines, lambda stages, p: F.struct(p.alias("p"), F.transform(stages, item).alias("items")))
    return F.filter(of, lambda x: F.exists(x["items"], lambda i: i["text"].isNotNull() | i["refused"].isNotNull()))


def _spliced(items: Column) -> Column:
    """The script that has a pipeline's wrapped commands in their wrappers' place. What a wrapper redirects, its command's last stage does."""
    runs = lambda i: i["asks"] & (F.coalesce(F.size(i["inner"]), F.lit(0)) > 0)

    def grafted(i: Column) -> Column:
        last = lambda s: s.withField("redirects", F.concat(s["redirects"], i["stage"]["redirects"]))
        return F.transform(i["inner"], lambda pipeline: F.transform(pipeline, lambda s, k: F.when(k == F.size(pipeline) - 1, last(s)).otherwise(s)))

    before = F.flatten(F.transform(F.filter(items, runs), lambda i: F.slice(grafted(i), F.lit(1), F.size(i["inner"]) - 1)))
    stages = F.flatten(F.transform(items, lambda i: F.when(~i["asks"], F.array(i["stage"])).when(runs(i), F.element_at(grafted(i), -1)).otherwise(F.array().cast(f"array<{STAGE}>"))))
    return F.when(F.exists(items, runs), F.array_append(before, stages))


class Scripts:
    """All scripts that the texts (column text) reach.

    scripts: sid, readable, pipelines, first (one of the texts themselves).
    edges: sid, suffix, origin, child, reason (of edges that lead to no script), first (from one of the texts).
    """

    def __init__(self, texts: DataFrame, policy: Policy = Policy()):  # noqa: B008
        self.policy = policy
        self._derived = [_inside(F.col("pipelines")).alias("inside"), _wrappers(F.col("pipelines")).alias("wraps")]
        self.lexed, self.rounds, self.spliced = Pile(), Pile(), Pile()
        tops = texts.where("text is not null").select("text").distinct()
        found = self._as_scripts(self._lexed_now(tops.select(script_id(F.col("text")).alias("sid"), "text", F.lit(True).alias("kid"), F.lit(False).alias("item"))))
        for depth in range(policy.max_depth + 1):
            facts = self._round(found, depth == 0)
            inside, wraps = facts.agg(F.sum(F.size("inside")), F.sum(F.size("wraps"))).first()
            if not (inside or wraps):
                break
            items = self._items(facts)
            met = self._met(facts, items)
            late, again = met.agg(F.max(F.col("known") & F.col("kid") & ~F.col("was_kid")), F.max(F.col("known") & F.col("item"))).first()
            earlier = self.lexed.all()
            new = self._lexed_now(met.where("not known"))
            found = self._as_scripts(new.where("kid"))
            if late:  # lexed before for a wrapper, now a script of its own
                ids = self._unmet(met.where("known and kid and not was_kid").select("sid"))
                found = found.unionByName(self._as_scripts(earlier.join(small(written(ids)), "sid", "left_semi")))
            if wraps:
                inner = new.where("item")
                if again:
                    inner = inner.unionByName(earlier.join(small(written(met.where("known and item").select("sid"))), "sid", "left_semi"))
                spliced = self.spliced.add(self._unwrapped(items, inner).withColumn("first", F.lit(depth == 0))).where("pipelines is not null")
                # a spliced script's id comes from the script that it is made of, which no other round has
                found = found.unionByName(spliced.select(F.col("child").alias("sid"), F.lit(True).alias("readable"), "pipelines"))
        self.scripts = self.rounds.all().select("sid", "readable", "pipelines", "first")
        self.edges = written(self._edges())

    def _round(self, found: DataFrame, first: bool) -> DataFrame:
        pipelines = F.coalesce("pipelines", F.array().cast(f"array<array<{STAGE}>>"))
        return self.rounds.add(found.select("sid", "readable", pipelines.alias("pipelines"), F.lit(first).alias("first")).select("*", *self._derived))

    def _met(self, facts: DataFrame, items: DataFrame) -> DataFrame:
        """sid, text, kid, item, known, was_kid of a round's distinct texts: whether they are scripts or in a wrapper, were lexed, and as what."""
        kids = self._kids(facts).select(F.col("child").alias("sid"), "text", F.lit(True).alias("kid"), F.lit(False).alias("item"))
        asked = items.where("asks").select(F.col("inner_id").alias("sid"), "text", F.lit(False).alias("kid"), F.lit(True).alias("item"))
        texts = kids.unionByName(asked).groupBy("text").agg(F.max("kid").alias("kid"), F.max("item").alias("item"))
        known = self.lexed.all().select("sid", F.col("kid").alias("was_kid"))
        joined = texts.select(script_id(F.col("text")).alias("sid"), "text", "kid", "item").join(known, "sid", "left")
        return written(joined.select("sid", "text", "kid", "item", F.col("was_kid").isNotNull().alias("known"), F.coalesce("was_kid", F.lit(False)).alias("was_kid")))

    def _unmet(self, rows: DataFrame) -> DataFrame:
        """Rows of scripts that no round has."""
        return rows.join(self.rounds.all().select("sid"), "sid", "left_anti")

    def _lexed_now(self, texts: DataFrame) -> DataFrame:
        """sid, text, kid, item of texts not lexed before -> sid, kid, item, x."""
        return self.lexed.add(texts.select("sid", "kid", "item", lex(F.col("text")).alias("x")))

    @staticmethod
    def _as_scripts(lexed: DataFrame) -> DataFrame:
        return lexed.select("sid", (F.col("x.whole") & F.col("x.pipelines").isNotNull()).alias("readable"), F.when(F.col("x.whole"), F.col("x.pipelines")).alias("pipelines"))

    @staticmethod
    def _kids(facts: DataFrame) -> DataFrame:
        """sid, first, suffix, origin, child, text of the texts that run inside scripts."""
        return facts.select("sid", "first", F.explode("inside").alias("x")).select("sid", "first", "x.suffix", "x.origin", script_id(F.col("x.text")).alias("child"), "x.text")

    @staticmethod
    def _items(facts: DataFrame) -> DataFrame:
        """sid, p, k, stage, text, refused, asks, inner_id of the stages of pipelines with wrappers. asks: it runs a text."""
        items = facts.select("sid", F.explode("wraps").alias("w")).select("sid", "w.p", F.posexplode("w.items").alias("k", "i"))
        return items.select("sid", "p", "k", "i.*", F.col("i.text").isNotNull().alias("asks"), script_id(F.col("i.text")).alias("inner_id"))

    @staticmethod
    def _unwrapped(items: DataFrame, lexed: DataFrame) -> DataFrame:
        """sid, p, child, pipelines (null: nothing runs), reason of the pipelines with wrappers."""
        known = lexed.select(F.col("sid").alias("inner_id"), F.col("x.pipelines").alias("inner"))
        # without a text there is nothing to look up, and no key that all those rows would share
        asking, plain = items.where("asks").join(known, "inner_id", "left"), items.where("not asks").withColumn("inner", F.lit(None).cast(known.schema["inner"].dataType))
        parts = asking.drop("text").unionByName(plain.drop("text"))
        of = parts.groupBy("sid", "p").agg(F.sort_array(F.collect_list(F.struct("k", "stage", "asks", "refused", "inner"))).alias("items"))
        unread = F.exists("items", lambda i: i["asks"] & i["inner"].isNull())
        refused = F.get(F.filter(F.transform("items", lambda i: i["refused"]), lambda r: r.isNotNull()), F.lit(0))
        child = F.unhex(F.sha2(F.concat(F.col("sid"), F.encode(F.col("p").cast("string"), "UTF-8")), 256))
        return of.select("sid", "p", child.alias("child"), _spliced(F.col("items")).alias("pipelines"), F.coalesce(refused, F.when(unread, UNPARSABLE)).alias("reason"))

    def _edges(self) -> DataFrame:
        none = F.lit(None).cast("string").alias("reason")
        edges = self._kids(self.rounds.all()).select("sid", "suffix", "origin", "child", none, "first")
        if not self.spliced.paths:
            return edges
        ways = self.spliced.all().select("sid", F.array(F.lit(0), "p", F.lit(UNWRAP)).alias("suffix"), F.lit("unwrap").alias("origin"), "child", "reason", F.col("pipelines").isNotNull().alias("runs"), "first")
        leads = ways.where("runs").select("sid", "suffix", "origin", "child", none, "first")
        return edges.unionByName(leads).unionByName(ways.where("reason is not null").select("sid", "suffix", "origin", F.lit(None).cast("binary").alias("child"), "reason", "first"))

    def places(self) -> DataFrame:
        """root (the sid of a text), key, depth, origin, sid, reason: every place that a script has below a text. reason: nothing is there."""
        none = F.lit(None).cast("string").alias("reason")
        at = self.scripts.where("first").select(F.col("sid").alias("root"), F.array().cast("array<int>").alias("key"), F.lit(0).alias("depth"), F.lit("top").alias("origin"), "sid", none)
        return reduce(DataFrame.unionByName, self._below(), at)

    def _below(self) -> list[DataFrame]:
        """The places at each depth from 1 on. Those at depth 1 are the edges from the texts, deeper ones are joined to edges."""
        levels, top = [], self.policy.max_depth
        edges = small(self.edges)
        for depth in range(top + 1):
            # scripts of options and here-bodies end where substitutions and wrappers are denied
            ways = (edges if depth else self.edges.where("first")).where(F.lit(depth < top) | F.col("origin").isin("subst", "unwrap")).withColumnRenamed("reason", "why").withColumnRenamed("origin", "how")
            below = levels[-1].where("reason is null").select("root", "key", "sid").join(ways, "sid") if depth else ways.select("*", F.col("sid").alias("root"), F.array().cast("array<int>").alias("key"))
            why = F.coalesce("why", F.lit(TOO_DEEP if depth == top else None).cast("string"))
            at = below.select("root", F.concat("key", "suffix").alias("key"), F.lit(depth + 1).alias("depth"), F.col("how").alias("origin"), F.col("child").alias("sid"), why.alias("reason"))
            at = written(at) if depth else at
            if at.isEmpty():
                break
            levels.append(at)
        return levels

    def denials(self, only: set[int] | None = None) -> DataFrame:
        """root -> denial (policy, reason, depth, origin): the first of each text (by sid) that has one. only: the ordinals that judge."""
        hit = _first_hit(F.col("pipelines"), self.policy, only)
        facts = written(self.scripts.select("sid", "readable", "first", hit.alias("hit")).where("hit is not null or not readable"))
        none = F.lit(None).cast("string").alias("reason")
        at = facts.where("first").select(F.col("sid").alias("root"), F.array().cast("array<int>").alias("key"), F.lit(0).alias("depth"), F.lit("top").alias("origin"), none, "readable", "hit")
        columns, ways = at.columns, self._below()
        if ways:
            deep = reduce(DataFrame.unionByName, ways)
            ends = deep.where("reason is not null").withColumn("readable", F.lit(None).cast("boolean")).withColumn("hit", F.lit(None).cast(facts.schema["hit"].dataType))
            judged = deep.where("reason is null").join(small(facts).drop("first"), "sid")
            at = at.unionByName(ends.select(columns)).unionByName(judged.select(columns))
        bad = F.coalesce("reason", F.when(~F.col("readable") & (F.col("origin") != "stdin"), UNPARSABLE))
        name = F.when(bad.isNull(), F.col("hit.policy")).when(bad.isin(UNPARSABLE, TOO_DEEP), "malformed").otherwise("foreign_config")
        key = F.concat("key", F.when(bad.isNull(), F.col("hit.key")).otherwise(F.array(F.lit(-1))))
        what = F.struct(name.alias("policy"), F.coalesce(bad, F.col("hit.reason")).alias("reason"), "depth", "origin")
        return at.where(bad.isNotNull() | F.col("hit").isNotNull()).groupBy("root").agg(F.min_by(what, key).alias("denial"))
