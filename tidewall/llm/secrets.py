"""Secret scan over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger says which rules, each in which version,
have gone over a blob, and what they found. Only pairs of a blob and a rule version that it lacks are scanned, once each
however many rows hold the blob; findings are then joined back to every row. A rule that changes gets a new version, and
goes over all blobs again by itself. Spans are code points, end exclusive. A null text is the empty blob. Null ids and
repeated rows keep their rows. Other columns are ignored, whatever their names. Only DataFrame functions are used.

Positions: splitting a text by a pattern gives the pieces between its matches, so that a running sum of the
lengths of pieces and matches, in a window over one blob's matches, gives each match's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm._spark import small_side, stash

#: Fixed values: (kind, pattern, group whose length counts, least length). The first three are the base kinds.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
]
BASE = 3
#: To be raised with any change of a rule
VERSIONS = {kind: 1 for kind, *_ in RULES}
LEDGER = "blob binary, seen array<string>, spans array<struct<start:int,rule:string,version:int,end:int>>"


def rule_version(kind: str) -> str:
    return f"{kind}@{VERSIONS[kind]}"


def _hits(text: Column, rule: int, missing: Column) -> Column:
    """Array of a rule's matches in order, if it is missing: rule, nth, chars between the last match and this, chars, kept."""
    kind, pattern, group, least = RULES[rule]
    pat = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pat, F.lit(0)).alias("hit"), F.regexp_extract_all(text, pat, F.lit(group)).alias("value"))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), i.alias("nth"), F.length(x.getField("gap")).alias("gap"),
            F.length(x.getField("hit")).alias("chars"), (F.length(x.getField("value")) >= least).alias("kept"),
        )

    none = F.array().cast("array<struct<rule:int,nth:int,gap:int,chars:int,kept:boolean>>")
    return F.when(F.array_contains(missing, rule_version(kind)) & text.rlike(pattern), F.filter(F.transform(zipped, one), lambda x: x.getField("chars").isNotNull())).otherwise(none)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blobs (blob, text, missing: rule versions) -> blob, spans: array<struct<start, rule, end>> in order, for blobs with findings."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = F.concat(*[_hits(text, k, F.col("missing")) for k in range(len(RULES))])
    rows = blobs.select("blob", F.inline(each))
    # repeated rows of one blob give the same matches again
    rows = rows.groupBy("blob", "rule", "nth").agg(*[F.first(c).alias(c) for c in ("gap", "chars", "kept")])
    end = F.sum(F.col("gap") + F.col("chars")).over(Window.partitionBy("blob", "rule").orderBy("nth"))
    kept = rows.withColumn("end", end).where("kept").select("blob", F.struct((F.col("end") - F.col("chars")).alias("start"), "rule", "end").alias("span"))
    return kept.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, kinds: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every row: doc_id, blob, spans; the ledger's new rows).

    kinds: the rules to go by (all). ledger: rows of earlier runs. A blob without findings has its row there too, with no
    spans. Findings hold the spans of this run's rules, found now or before; spans of other versions are left out.
    """
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    chosen = [kind for kind, *_ in RULES if kinds is None or kind in kinds]
    wanted = F.array(*[F.lit(rule_version(kind)) for kind in chosen])
    paths = stash(docs.select(doc_id.alias("doc_id"), blob.alias("blob")))
    # a table of its own: a blob that many rows hold can then be split in the join
    firsts = stash(paths.groupBy("blob").agg(F.min("doc_id").alias("first")))
    repeats = paths.join(firsts, "blob").where(F.col("doc_id") > F.col("first")).select("blob", "doc_id")
    fresh = docs.select(doc_id.alias("doc_id"), blob.alias("blob"), text.alias("text"))
    fresh = fresh.join(small_side(stash(repeats)), ["blob", "doc_id"], "left_anti").select("blob", "text")
    new = firsts.select("blob")
    if ledger is None:
        fresh, new = fresh.withColumn("missing", wanted), new.withColumn("missing", wanted)
    else:
        # blobs that some of this run's rules have gone over
        done = ledger.select("blob", F.explode("seen").alias("one")).where(F.col("one").isin([rule_version(k) for k in chosen])).groupBy("blob").agg(F.collect_set("one").alias("done"))
        done = stash(done)
        left = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        fresh, new = (t.join(small_side(done), "blob", "left").withColumn("missing", left).drop("done").where(F.size("missing") > 0) for t in (fresh, new))
    found = stash(scan_blobs(fresh.select("blob", "text", "missing")))
    kind_of = F.array(*[F.lit(kind) for kind, *_ in RULES])
    known = found
    if ledger is not None:
        old = ledger.where(F.size("spans") > 0).select("blob", F.inline("spans"))
        old = old.where(F.concat_ws("@", "rule", "version").isin([rule_version(k) for k in chosen]))
        old = old.select("blob", F.struct("start", (F.array_position(kind_of, F.col("rule")) - 1).cast("int").alias("rule"), "end").cast(found.schema["spans"].dataType.elementType).alias("span"))
        every = found.select("blob", F.explode("spans").alias("span")).unionByName(old)
        known = stash(every.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans")))
    none = F.array().cast(found.schema["spans"].dataType)
    findings = paths.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))
    versions = F.map_from_arrays(kind_of, F.array(*[F.lit(VERSIONS[kind]) for kind, *_ in RULES]))
    named = F.transform(F.coalesce("spans", none), lambda x: F.struct(x["start"].cast("int").alias("start"), F.get(kind_of, x["rule"]).alias("rule"), F.element_at(versions, F.get(kind_of, x["rule"])).alias("version"), x["end"].cast("int").alias("end")))
    entries = new.join(found, "blob", "left").select("blob", F.col("missing").alias("seen"), named.alias("spans"))
    return findings, entries


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span, and what overlapping spans cover together, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        at, out = acc["at"], acc["out"]
        fresh = F.concat(out, F.array(F.substring(text, at + 1, s["start"].cast("int") - at), F.lit(mark)))
        return F.struct(F.greatest(at, s["end"].cast("int")).alias("at"), F.when(s["start"] >= at, fresh).otherwise(out).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def digest(findings: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the hash of the base spans, all spans."""
    base = F.filter("spans", lambda s: s["rule"] < BASE)

    def of(rule: int) -> Column:
        # not a default argument: a second parameter would be the element's index
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{RULES[rule][0]}")

    counts = [of(k) for k in range(BASE)]
    return findings.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
