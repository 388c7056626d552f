"""Sanitized text: the inspection report, and the envelopes of read files and fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import html, let, net, paths, scan
from tidewall.functions import text as T


def _present(*notes: Column) -> Column:
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


def _note(cond: Column, *parts: Column | str) -> Column:
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _hits_note(findings: Column) -> Column:
    return let(findings, lambda f: F.when(F.size(f) > 0, F.concat(F.lit("suspected injection, kept as it is: "), F.array_join(f, " | "))))


def inspect(df: DataFrame, text: str) -> DataFrame:
    """df with clean, findings and report. Invisible characters go first, then markup, then look-alikes."""
    n, x = F.octet_length, F.col(text)
    # one struct for what is removed, so that no later use repeats a pattern
    steps = df.withColumn("_html", let(T.strip_invisible(x), lambda v: F.struct(n(v).alias("visible"), html.strip_html_hits(v).alias("hits"))))
    steps = steps.withColumn("clean", T.normalize_for_scan(F.col("_html.hits.clean"))).withColumn("_again", T.normalize_for_scan(F.col("clean")))
    h, clean = F.col("_html.hits"), F.col("clean")
    grown = n(clean) - n(h["clean"])
    findings = _present(
        _note(n(x) > F.col("_html.visible"), n(x) - F.col("_html.visible"), " bytes of invisible characters taken out"),
        _note(h["removed_script"], "scripts taken out"),
        _note(h["removed_style"], "style sheets taken out"),
        _note(h["removed_comment"], "comments taken out"),
        _note(h["removed_executable"], "frames, objects and other loaders taken out"),
        F.when(clean != h["clean"], F.when(grown > 0, F.concat(F.lit("normalizing added "), grown.cast("string"), F.lit(" bytes"))).otherwise("look-alike or compatibility characters replaced")),
        _hits_note(scan.injection_findings(clean, F.col("_again"))),
    )
    listed = let(F.col("findings"), lambda f: F.when(F.size(f) == 0, "nothing found\n").otherwise(F.array_join(F.transform(f, lambda one: F.concat(F.lit("* "), one, F.lit("\n"))), "")))
    report = F.concat(F.lit("size: "), n(x).cast("string"), F.lit(" -> "), n(clean).cast("string"), F.lit(" bytes\n"), listed)
    return steps.withColumn("findings", findings).withColumn("report", report).drop("_html", "_again")


def _sanitized(df: DataFrame, body: str, markup: Column, first: list[Column], again: Column | None) -> DataFrame:
    """df with clean and notes. again: what else, after normalization, calls for a second removal of markup."""
    n, x = F.octet_length, F.col(body)

    def stripped(when: Column, t: Column) -> Column:
        return let(t, lambda t: F.when(when, html.strip_html(t)).otherwise(t))

    out = df.withColumn("_markup", F.coalesce(markup, F.lit(False))).withColumn("_once", stripped(F.col("_markup"), x))
    out = out.withColumn("_normal", T.normalize_for_scan(F.col("_once")))
    second = F.col("_markup") if again is None else F.col("_markup") | again
    out = out.withColumn("clean", stripped(second, F.col("_normal"))).withColumn("_again", T.normalize_for_scan(F.col("clean")))
    notes = _present(
        *first,
        _note(n("_once") != n(x), "markup taken out: ", n(x) - n("_once"), " bytes"),
        _note(n("_normal") != n("_once"), "invisible or look-alike characters taken out"),
        _note(n("clean") != n("_normal"), "hidden markup taken out: ", n("_normal") - n("clean"), " bytes"),
        _hits_note(scan.injection_findings(F.col("clean"), F.col("_again"))),
    )
    return out.withColumn("notes", notes).drop("_markup", "_once", "_normal", "_again")


def read_files(df: DataFrame, path: str, body: str, policy: Policy = Policy(), canonical: str | None = None, has_symlink: Column | None = None) -> DataFrame:  # noqa: B008
    """df with verdict, clean, notes and envelope of file bodies; a denied path has an error envelope."""
    x, p = F.col(body), F.col(path)
    verdict = paths.read_verdict(p, F.col(canonical or path), F.lit(False) if has_symlink is None else has_symlink, policy)
    out = df.withColumn("verdict", verdict).withColumn("_cut", T.is_truncated(x, policy.read_cap)).withColumn("_body", T.truncate_bytes(x, policy.read_cap)).withColumn("_size", F.octet_length("_body"))
    markup = html.is_markup_path(p) | html.read_looks_like_markup(F.col("_body"))
    out = _sanitized(out, "_body", markup, [_note(F.col("_cut"), "cut at the size limit")], html.read_looks_like_markup(F.col("_normal")))
    good = T.wrap_untrusted(F.col("clean"), p, size=F.col("_size"), truncated=F.col("_cut"), notes=F.col("notes"))
    return out.withColumn("envelope", F.when(F.col("verdict") == "allow", good).otherwise(T.render_error(p, F.lit("path cannot be read")))).drop("_cut", "_body", "_size")


#: Every refused fetch says the same
FETCH_ERROR = "target cannot be fetched"


def fetched_pages(df: DataFrame, url: str, body: str, content_type: str | None = None, status: str | None = None, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """df with url_ok, url_reason, clean, notes and envelope of fetched bodies; a refused URL has an error envelope."""
    x = F.col(body)
    kind = F.lit("") if content_type is None else F.coalesce(F.col(content_type), F.lit(""))
    out = df.withColumn("_url", net.validate_url(F.col(url), policy.allow_ip_literals, policy.strict_quirks))
    out = out.withColumn("url_ok", F.col("_url.ok")).withColumn("url_reason", F.col("_url.reason")).drop("_url")
    out = out.withColumn("_cut", T.is_truncated(x, policy.fetch_cap)).withColumn("_body", T.truncate_bytes(x, policy.fetch_cap))
    first = [_note(kind != "", "content-type: ", kind), _note(F.col("_cut"), "cut at the size limit")]
    out = _sanitized(out, "_body", html.is_markup_type(kind) | html.fetch_looks_like_markup(F.col("_body")), first, None)
    good = T.wrap_untrusted(F.col("clean"), net.redact_url(F.col(url)), status=None if status is None else F.col(status), truncated=F.col("_cut"), notes=F.col("notes"))
    return out.withColumn("envelope", F.when(F.col("url_ok"), good).otherwise(T.render_error(F.col(url), F.lit(FETCH_ERROR)))).drop("_cut", "_body")
