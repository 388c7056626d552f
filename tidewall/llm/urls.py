"""Block and allow lists of URLs: a blocked Bloom filter of the listed canonical URLs, then an exact join.

A list entry (host, path, verdict) fits its host and every subdomain of it, if the URL's path starts with its path. Of
the entries that fit a URL the longest (host and path together) decides; at equal length the one with the longer host.
An entry that is listed with both verdicts blocks. URLs that no entry fits get `default`.

A URL's host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path goes from there to `?`, `#`
or the end. Null URLs and those without `://` have an empty host and path. A URL asks for few canonical forms: its host's
last labels, as many as some entry has, with the starts of its path that are as long as some entry's path. The
filter (blocks of 512 bits, one bit in each of 8 words) tells which of these may be listed. Only they go on, once for each distinct
(host, path), to the join with the list that drops the filter's false positives.

The filter takes 10 bits an entry and at most FILTER_BLOCKS blocks (64 MB), which is all that is broadcast
unseen. A longer list shares these bits, so that more URLs reach the exact join: slower, with the same result. The list itself is
broadcast only if it was counted and is small; else both sides are shuffled, with the asking side salted, as a short
entry such as a top-level domain may be asked for by a third of all URLs.

Columns of the input stay, but those named host, path, rule or verdict, which the results replace. Repeated rows are
judged each. An empty list fits nothing; empty tables give no rows; very long URLs and hosts of many labels are judged whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm._spark import small_side, stash

ENTRY_BITS, BLOCK_BITS, WORDS = 10, 512, 8
FILTER_BLOCKS = 1 << 20
#: Shares into which the asking side of a shuffled join is dealt
SALT = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _place(host: Column, path: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a canonical URL, and a hash whose six-bit parts choose a bit of each word."""
    return F.pmod(F.xxhash64(host, path), F.lit(blocks)), F.xxhash64(path, host, F.lit(1))


def bloom_words(entries: DataFrame, blocks: int) -> np.ndarray:
    """The filter of entries (host, path): blocks x WORDS words, put together by partial bitwise ors."""
    block, bits = _place(F.col("host"), F.col("path"), blocks)
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("bits", 6 * w).bitwiseAND(63).cast("int")) for w in range(WORDS)]
    placed = entries.select(block.alias("block"), bits.alias("bits")).select("block", *[w.alias(f"w{k}") for k, w in enumerate(words)])
    found = placed.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).toArrow()
    out = np.zeros((blocks, WORDS), np.uint64)
    for k in range(WORDS):
        out[found["block"].to_numpy(), k] = found[f"w{k}"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the places may be in the filter; none that was put in is missed."""
    yes = np.ones(len(block), bool)
    bits = bits.view(np.uint64)
    for k in range(WORDS):
        yes &= words[block, k] >> ((bits >> np.uint64(6 * k)) & np.uint64(63)) & np.uint64(1) != 0
    return yes


def _asked(words):
    """Adds to each row the numbers (from 0) of those of its canonical forms that the filter passes."""

    def run(batches):
        for batch in batches:
            block, bits = (batch.column(batch.schema.get_field_index(c)) for c in ("_block", "_bits"))
            yes = may_hold(words.value, block.flatten().to_numpy(), bits.flatten().to_numpy(zero_copy_only=False))
            first = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(block).to_numpy(zero_copy_only=False)))).astype(np.int64)
            hits = np.flatnonzero(yes)
            of = np.searchsorted(first, hits, "right") - 1
            ends = np.searchsorted(hits, first).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array((hits - first[of]).astype(np.int32)))
            kept = [c for c in batch.schema.names if c not in ("_block", "_bits")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), numbers], names=[*kept, "_numbers"])

    return run


def judge(urls: DataFrame, entries: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (host and path of the entry that decides, or null) and verdict.

    entries: host, path, verdict (allow or block), hosts in lower case; null hosts and paths are empty. All columns of urls
    travel through a task's memory, so pass only what is needed.
    """
    spark = urls.sparkSession
    listed = entries.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    listed = stash(listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    count, labels, lengths = listed.agg(F.count("*"), F.collect_set(F.size(F.split("host", "[.]"))), F.collect_set(F.length("path"))).first()
    labels, lengths = sorted(labels) or [1], sorted(lengths) or [0]
    blocks = min(max(1, -(-count * ENTRY_BITS // BLOCK_BITS)), FILTER_BLOCKS)
    words = spark.sparkContext.broadcast(bloom_words(listed, blocks))

    host, path = host_and_path(F.col(url))
    kept = [c for c in urls.columns if c.lower() not in RESULTS]
    rows = urls.select(F.struct(*kept).alias("_row") if kept else F.struct(F.lit(0).alias("_")).alias("_row"), host.alias("host"), path.alias("path"))
    split = F.split("host", "[.]")
    hosts = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size("_labels")), lambda n: F.array_join(F.slice("_labels", -n, n), "."))
    sizes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))

    def form(n: Column) -> tuple[Column, Column]:
        of = F.size("_sizes")
        return F.get("_hosts", F.floor(n / of).cast("int")), F.substring("path", F.lit(1), F.get("_sizes", n % of))

    rows = rows.withColumn("_labels", split).withColumn("_hosts", hosts).withColumn("_sizes", sizes)
    total = F.size("_hosts") * F.size("_sizes")
    numbers = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    block, bits = F.transform(numbers, lambda n: _place(*form(n), blocks)[0]), F.transform(numbers, lambda n: _place(*form(n), blocks)[1])
    rows = rows.select("_row", "host", "path", "_hosts", "_sizes", block.alias("_block"), bits.alias("_bits"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    asked = stash(rows.mapInArrow(_asked(words), ", ".join(f"{c} {kind[c]}" for c in ("_row", "host", "path", "_hosts", "_sizes")) + ", _numbers array<int>"))

    once = asked.where(F.size("_numbers") > 0).groupBy("host", "path").agg(*[F.first(c).alias(c) for c in ("_hosts", "_sizes", "_numbers")])
    may = once.select("host", "path", "_hosts", "_sizes", F.explode("_numbers").alias("_n"))
    may = may.select("host", "path", form(F.col("_n"))[0].alias("_host"), form(F.col("_n"))[1].alias("_path"))
    side = listed.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    bounded = small_side(side)
    if bounded is side:
        may = may.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int"))
        bounded = side.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    fits = may.join(bounded, [c for c in ("_host", "_path", "_salt") if c in may.columns])
    best = F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict")), F.struct(F.length("_host") + F.length("_path"), F.length("_host")))
    found = stash(fits.groupBy("host", "path").agg(best.alias("_best")))
    out = asked.select("_row", "host", "path").join(small_side(found), ["host", "path"], "left")
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
