"""Redaction of well-known tokens in one left-to-right pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall.functions import let

#: Kinds and patterns of tokens, in the order in which they are tried at a place
TOKENS = {
    "anthropic-key": r"sk-ant-[a-z0-9]+-[A-Za-z0-9_-]{40,200}",
    "openai-key": r"sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,200}",
    "github-token": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82}",
    "gitlab-pat": r"glpat-[A-Za-z0-9_-]{20}",
    "aws-access-key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "slack-token": r"xox[abprs]-[A-Za-z0-9-]{10,200}",
    "atlassian-token": r"ATATT3x[A-Za-z0-9_-]{200,400}[A-Fa-f0-9]{8}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
ANY = "|".join(f"(?:{p})" for p in TOKENS.values())


def _kind(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(TOKENS.items()):
        out = F.when(token.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


#: Fixed value: bytes after which a line without an end is cut and each piece redacted by itself
LINE_BYTES = (1 << 20) + 1


def redact(x: Column) -> Column:
    """Each token as <redacted:kind>. The pieces between tokens are joined with what stands for the tokens."""

    def joined(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))
        marks = F.transform(tokens, lambda k: F.concat(F.lit("<redacted:"), _kind(k), F.lit(">")))
        zipped = F.arrays_zip(F.split(t, ANY, -1).alias("piece"), marks.alias("mark"))
        return F.array_join(F.transform(zipped, lambda z: F.concat(z["piece"], F.coalesce(z["mark"], F.lit("")))), "")

    # most texts have no token: one search tells
    return let(x, lambda t: F.when(t.rlike(ANY), joined(t)).otherwise(t))


def redact_line(x: Column, cap: int = LINE_BYTES) -> Column:
    """A line, redacted in pieces of at most cap bytes; a token across two pieces stays."""

    def pieces(raw: Column) -> Column:
        n = F.greatest(F.ceil(F.length(raw) / cap), F.lit(1)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: redact(F.substring(raw, k * cap + 1, F.lit(cap)))), "")

    # one character for each byte, so that cuts within a character heal when the pieces are joined
    by_bytes = F.decode(F.encode(let(F.decode(F.encode(x, "UTF-8"), "ISO-8859-1"), pieces), "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(x) > cap, by_bytes).otherwise(redact(x))
