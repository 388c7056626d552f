"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over at most SPAN words: it hashes the words at its marked positions and ignores the others,
so that a substituted word spoils only the seeds that mark it. The masks are complete for the default rule: wherever
the substitutions lie that 75 % of 11, 12 or 13 aligned words allow (2, 3 and 3), some mask at some place misses all
of them. Seeds of documents are joined with seeds of benchmark items; a hit says at which shift a document and an
item lie on each other. Around each hit the two are compared word by word at that shift, and the pair counts as a leak
if some `least_words` aligned words (the whole item, if it is shorter) hold at least `percent` equal ones.

Words are lower-cased runs of letters and digits; in scripts without spaces each letter with its marks is a word. Null
and empty texts have none. An item of fewer words than SPAN has masks of its own over all its words, joined with equally long runs
of every document: whatever substitutions the rule allows (1 of 4 to 7 words, 2 of 8 to 10, none of fewer), one mask misses them.
Texts of any length are read whole. Documents and items with a null id
are not reported. Repeated rows of a document or an item give one row; so do different texts under one id, with the
best of their matches. Other columns are ignored, whatever their names. Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm._spark import small_side, stash

#: Marked positions, found by search
MASKS = ["1101011", "1110000011", "10011101", "11010000011"]
SPAN = max(map(len, MASKS))
#: Scripts that put no spaces between words
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Ranges that hold all of them; texts without a character of these are spared the slower patterns
MAY_BE_UNSPACED = r"[\x{0E00}-\x{19FF}\x{2E80}-\x{3FFFF}]"


def words(text: Column) -> Column:
    """A hash of each word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.regexp_replace(low, rf"([{UNSPACED}&&\p{{L}}]\p{{M}}*+)", " $1 ")
    split = F.when(low.rlike(MAY_BE_UNSPACED), F.split(apart, rf"[^\p{{L}}\p{{N}}[{UNSPACED}&&\p{{M}}]]+")).otherwise(F.split(low, r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: str) -> DataFrame:
    """rows (keep, words) -> keep, at (the span's first word), seed: every mask at every place."""
    marked = sorted({k for mask in MASKS for k, c in enumerate(mask) if c == "1"})
    ahead = F.arrays_zip(*[F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in marked])
    placed = rows.select(keep, F.posexplode(ahead).alias("at", "w"))
    # what lies beyond the end is null
    hashed = [F.when(F.col(f"w.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"w.w{k}") for k, c in enumerate(mask) if c == "1"])) for m, mask in enumerate(MASKS)]
    return placed.select(keep, "at", F.explode(F.array(*hashed)).alias("seed")).where("seed is not null")


def short_masks(n: int, percent: int) -> list[str]:
    """Masks over a whole item of n words, one of which misses all substitutions that percent allows, wherever they are.

    The places fall into two more blocks than there may be substitutions; each mask ignores as many blocks as there may be.
    """
    wrong = n - -(-n * percent // 100)
    blocks = [k * (wrong + 2) // n for k in range(n)]
    return ["".join("0" if b in gone else "1" for b in blocks) for gone in combinations(range(wrong + 2), wrong)]


def runs(rows: DataFrame, keep: str, lengths: list[int], percent: int) -> DataFrame:
    """rows (keep, words) -> keep, at, n, seed: every short mask at every run of n words, for each of the lengths."""
    ahead = [F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(max(lengths))]
    placed = rows.select(keep, F.posexplode(F.arrays_zip(*ahead)).alias("at", "w"))
    # what lies beyond the end is null
    hashed = []
    for n in lengths:
        for m, mask in enumerate(short_masks(n, percent)):
            seed = F.xxhash64(F.lit(m), *[F.col(f"w.w{k}") for k, c in enumerate(mask) if c == "1"])
            hashed.append(F.when(F.col(f"w.w{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), seed.alias("seed"))))
    return placed.select(keep, "at", F.explode(F.array(*hashed)).alias("run")).where("run is not null").select(keep, "at", "run.n", "run.seed")


def leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, percent: int = 75) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row for each leaked pair.

    doc_id, item_id, first_word (of the alignment in the document, from 0), n_aligned and n_equal words of the
    best alignment, n_item words of the item.
    """
    items = stash(benchmark.select("item_id", words(F.col("text")).alias("item")).where("item_id is not null").distinct())
    marks = stash(seeds(items.where(F.size("item") >= SPAN).select("item_id", F.col("item").alias("words")), "item_id").withColumnRenamed("at", "item_at").distinct())
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    of_words = texts.select("doc_id", words(F.col("text")).alias("words"))
    of_docs = seeds(of_words, "doc_id")
    hits = of_docs.join(small_side(marks), "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    short = items.where(F.size("item").between(1, SPAN - 1)).select("item_id", F.col("item").alias("words"), F.size("item").alias("size"))
    lengths = sorted(r["size"] for r in short.select("size").distinct().collect())
    if lengths:
        whole = short.select(F.struct("item_id", "size").alias("of"), "words")
        wanted = stash(runs(whole, "of", lengths, percent).where("n = of.size").select("of.item_id", "n", "seed").distinct())
        found = runs(of_words, "doc_id", lengths, percent).join(small_side(wanted), ["n", "seed"]).select("doc_id", "item_id", F.col("at").alias("shift"))
        hits = hits.union(found).distinct()
    hits = stash(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift")).alias("hits")))
    near = texts.join(small_side(hits, 200_000), "doc_id").select("doc_id", words(F.col("text")).alias("doc"), "hits")
    each = near.select("doc_id", "doc", F.explode("hits").alias("hit")).select("doc_id", "doc", "hit.item_id", "hit.shift")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item"), F.size("doc") - F.col("shift"))
    # only the document's aligned words go on
    pairs = each.join(small_side(items, 100_000), "item_id").where(last > first).select(
        "doc_id", "item_id", (first + F.col("shift")).alias("first_word"), F.size("item").alias("n_item"),
        F.zip_with(F.slice("doc", first + F.col("shift") + 1, last - first), F.slice("item", first + 1, last - first), lambda x, y: (x == y).cast("int")).alias("equal"),
    )
    width = F.least(F.lit(least_words), "n_item")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("equal") - width + 1))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    dense = F.exists(places, lambda p: 100 * total(F.slice("equal", p, width)) >= percent * width)
    found = pairs.where((F.size("equal") >= width) & dense).select("doc_id", "item_id", F.struct(total(F.col("equal")).alias("n_equal"), F.size("equal").alias("n_aligned"), (-F.col("first_word")).alias("back"), "n_item").alias("best"))
    best = found.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("first_word"), "best.n_aligned", "best.n_equal", "best.n_item")
