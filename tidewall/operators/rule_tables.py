"""Rules that are tables: address ranges, path rules, links and redirects. Ranges are merged in order, the others are equi-joins on what a record asks for.

Ranges: addresses and networks are sorted together, in parts of the address space of nearly equal numbers of rows (their starts are found among
positions chosen by hash). Networks nest, so those around an address make a stack, and the best of the stack decides: a row is shuffled
once, however many networks hold it. Path rules: a path asks for its ancestors of the depths that occur, and
the first rule in order decides. Links and redirects: each round joins what is not at its end yet to the table of links.

Records are made distinct first, so a hot address or path is looked up once. A table is broadcast only if it was counted and is small;
else both sides are shuffled and the asking side is salted, as a short prefix may hold a third of all records.
"""

from __future__ import annotations

from functools import cache
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import let, net, paths
from tidewall.scratch import small, written

SALT = 16
#: Rows of a part of the address space, and those whose hash chooses them as its starts
PART_ROWS, STARTS = 16_384, 8


def _looked_up(asking: DataFrame, table: DataFrame, on: list[str], times: int = 1) -> DataFrame:
    """asking joined to a written table of distinct keys. times: how many joins may send such a table."""
    side = small(table, times)
    if side is table:
        asking = asking.withColumn("_salt", F.pmod(F.xxhash64(*asking.columns), F.lit(SALT)).cast("int"))
        # a size guessed from the file, which doesn't know of the salt, must not broadcast it after all
        side, on = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge"), [*on, "_salt"]
    return asking.join(side, on)


# addresses


def _hextets(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))


def v6_halves(text: Column) -> Column:
    """Struct hi, lo (the two halves as BIGINT bits) of an IPv6 address in text; null if it isn't one."""
    dotted = r"^(.*:)((?:\d{1,3}\.){3}\d{1,3})\z"
    number = net.v4_number(F.regexp_extract(text, dotted, 2))
    hex_of = lambda x: F.lower(F.hex(x))
    tail = F.concat(F.regexp_extract(text, dotted, 1), hex_of(F.shiftright(number, 16)), F.lit(":"), hex_of(number.bitwiseAND(0xFFFF)))
    plain = F.when(text.rlike(dotted), tail).otherwise(F.lower(text))

    def all_eight(x: Column) -> Column:
        sides = F.split(x, "::", -1)
        left, right = _hextets(F.get(sides, F.lit(0))), _hextets(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        gap = F.lit(8) - F.size(left) - F.size(right)
        fits = F.when(F.size(sides) == 2, gap >= 1).otherwise((F.size(sides) == 1) & (gap == 0))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right))

    def halves(h: Column) -> Column:
        good = F.forall(h, lambda p: p.rlike(r"^[0-9a-f]{1,4}\z"))
        part = lambda k: F.conv(F.get(h, F.lit(k)), 16, 10).cast("bigint")
        half = lambda k: F.shiftleft(part(k), 48).bitwiseOR(F.shiftleft(part(k + 1), 32)).bitwiseOR(F.shiftleft(part(k + 2), 16)).bitwiseOR(part(k + 3))
        return F.when(good, F.struct(half(0).alias("hi"), half(4).alias("lo")))

    return let(let(plain, all_eight), halves)


def address(text: Column) -> Column:
    """Struct family (4 or 6), hi, lo; null if the text is no address. IPv6 addresses that hold an IPv4 address count as that one."""

    def of(four: Column, six: Column) -> Column:
        low32 = six["lo"].bitwiseAND(0xFFFFFFFF)
        mapped = (six["hi"] == 0) & (F.shiftrightunsigned(six["lo"], 32) == 0xFFFF)
        compatible = (six["hi"] == 0) & (F.shiftrightunsigned(six["lo"], 32) == 0) & ~low32.isin(0, 1)
        as_four = lambda n: F.struct(F.lit(4).alias("family"), F.shiftleft(n, 32).alias("hi"), F.lit(0).cast("bigint").alias("lo"))
        return F.when(four.isNotNull(), as_four(four)).when(mapped | compatible, as_four(low32)).when(six.isNotNull(), F.struct(F.lit(6).alias("family"), six["hi"].alias("hi"), six["lo"].alias("lo")))

    return let(net.v4_number(text), lambda four: let(v6_halves(text), lambda six: of(four, six)))


def _cut(half: Column, bits: Column) -> Column:
    """The first bits (0 to 64) of a half; the others are 0."""
    drop = F.lit(64) - bits
    return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, half).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", half, drop), drop))


def _prefix(at: Column, bits: Column) -> list[Column]:
    return [at["family"].alias("family"), bits.alias("bits"), _cut(at["hi"], bits).alias("hi"), _cut(at["lo"], bits - 64).alias("lo")]


KEY = ["family", "bits", "hi", "lo"]


def range_table(ranges: DataFrame) -> DataFrame:
    """ranges (cidr, label, priority) -> family, bits, hi, lo, label, priority, cidr: one row for each distinct network, the least priority wins.

    A network that is no valid CIDR text gives no row. Host bits are cut off.
    """
    parts = ranges.select("cidr", "label", F.col("priority").cast("long").alias("priority"), F.split("cidr", "/", -1).alias("_p"))
    text, bits = F.get("_p", F.lit(0)), F.get("_p", F.lit(1)).try_cast("int")
    four = net.v4_number(text)
    six = v6_halves(text)
    plain = F.when(four.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(four, 32).alias("hi"), F.lit(0).cast("bigint").alias("lo"))).when(six.isNotNull(), F.struct(F.lit(6).alias("family"), six["hi"].alias("hi"), six["lo"].alias("lo")))
    rows = parts.withColumn("_at", plain).withColumn("_bits", bits).where((F.size("_p") == 2) & F.col("_at").isNotNull() & (F.col("_bits") >= 0) & (F.col("_bits") <= F.when(F.col("_at.family") == 4, 32).otherwise(128)))
    rows = rows.select(*_prefix(F.col("_at"), F.col("_bits")), "label", "priority", "cidr")
    best = F.min(F.struct("priority", "cidr", "label"))
    return rows.groupBy(*KEY).agg(best.alias("b")).select(*KEY, "b.label", "b.priority", "b.cidr")


def _position(at: Column) -> Column:
    """17 bytes that sort like addresses: the family, then its 128 bits. A network stands where its first address does."""
    bits = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    return F.concat(bits(at["family"], 2), bits(at["hi"], 16), bits(at["lo"], 16))


def _part_of(starts: list[bytes]):
    """Column function: the number of the starts that are not after a position."""
    sorted_ = np.array(starts, "S17")

    def part(positions: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sorted_, positions.to_numpy().astype("S17"), side="right"), dtype="int32")

    return F.pandas_udf(part, "int")


def _merged(rows: pa.Table) -> pa.Table:
    """Addresses of a part (bits null) with the best of the networks around them: networks nest, so those that are open make a stack."""
    rows = rows.sort_by([("pos", "ascending"), ("bits", "ascending")])  # nulls, which are addresses, come last
    open_, out = [], ([], [], [])
    for pos, bits, priority, cidr, label, ip in zip(*(rows[c].to_pylist() for c in MERGED), strict=True):
        at = int.from_bytes(pos)
        while open_ and open_[-1][0] < at:
            open_.pop()
        if bits is None:
            best = open_[-1][1] if open_ else (None, None, None, None)
            for column, value in zip(out, (ip, best[3], best[2]), strict=True):
                column.append(value)
        else:
            own = (priority is not None, priority or 0, cidr, label)
            open_.append((at | (1 << (128 - bits)) - 1, min(own, open_[-1][1], key=lambda b: b[:3]) if open_ else own))
    return pa.table(dict(zip(("_ip", "label", "cidr"), (pa.array(column, pa.string()) for column in out), strict=True)))


MERGED = ["pos", "bits", "priority", "cidr", "label", "ip"]


def label_addresses(df: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """df with valid, label, cidr of the range of least priority that holds the address (null: none); ties go by cidr.

    ranges: cidr, label, priority, of any number of IPv4 and IPv6 networks.
    """
    table = written(range_table(ranges).withColumn("pos", _position(F.struct("family", "hi", "lo"))))
    asked = written(df.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().select("_ip", _position(address(F.col("_ip"))).alias("pos")))
    seen = table.select("pos").unionByName(asked.where("pos is not null").select("pos"))
    chosen = seen.where(F.pmod(F.xxhash64("pos"), F.lit(PART_ROWS // STARTS)) == 0).orderBy("pos").collect()
    starts = sorted({bytes(r["pos"]) for r in chosen[STARTS - 1 :: STARTS]})
    part = _part_of(starts)
    # a network is merged in the part where it begins, and in those that begin within it
    begins = df.sparkSession.createDataFrame([(k + 1, bytearray(p), p[0], int.from_bytes(p[1:9], signed=True), int.from_bytes(p[9:], signed=True)) for k, p in enumerate(starts)], "part int, start binary, family int, hi bigint, lo bigint")
    lengths = table.select("family", "bits").distinct()  # at most 162 rows
    at = F.struct("family", "hi", "lo")
    around = begins.join(F.broadcast(lengths), "family").select("part", "start", *_prefix(at, F.col("bits")))
    within = table.join(small(written(around)), KEY).where("pos < start")
    nets = ["pos", "bits", "priority", "cidr", "label", F.lit(None).cast("string").alias("ip")]
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("bits", "int"), ("priority", "long"), ("cidr", "string"), ("label", "string"))]
    rows = table.select(*nets).unionByName(asked.where("pos is not null").select("pos", *none, F.col("_ip").alias("ip"))).withColumn("part", part("pos"))
    best = rows.unionByName(within.select(*nets, "part")).groupBy("part").applyInArrow(_merged, "_ip string, label string, cidr string")
    known = best.withColumn("valid", F.lit(True)).unionByName(asked.where("pos is null").select("_ip", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("cidr"), F.lit(False).alias("valid")))
    found = small(written(known))
    kept = [c for c in df.columns if c not in ("valid", "label", "cidr")]
    out = df.select(*kept, F.col(ip).alias("_ip")).join(found, "_ip", "left")
    return out.select(*kept, F.coalesce("valid", F.lit(False)).alias("valid"), "label", "cidr")


def own_ranges(spark, strict: bool = True) -> DataFrame:
    """The built-in IPv4 ranges as a table, in their order."""
    rows = [(f"{cidr}/{4 if label.startswith('reserved') and not strict else bits}", label, k) for k, (cidr, bits, label) in enumerate(net.V4_RANGES)]
    return spark.createDataFrame(rows, "cidr string, label string, priority long")


# paths


def _ancestors(path: Column, depths: list[int]) -> Column:
    """The path's starts with these numbers of components."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return let(parts, lambda p: F.transform(F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= F.size(p)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), n), "/"))))


def judge_paths(df: DataFrame, rules: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """df (path, canonical, has_symlink) with verdict (allow, deny_symlink, deny_rule) and rule, the first deny rule that holds.

    rules: rule, action (deny or allow), rank. They come after the built-in ones. A deny rule of one component holds every file of that name,
    a longer one a path and all below it; either form of the path may hold. An allow rule lets the very path pass,
    if that is its real path too. Symlinks are denied first, then the override of the settings applies.
    """
    kept = [c for c in df.columns if c not in ("verdict", "rule")]
    linked = F.coalesce(F.col("has_symlink"), F.lit(False))
    if policy.allow_sensitive:
        return df.select(*kept, F.when(linked, "deny_symlink").otherwise("allow").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    name = F.regexp_replace("rule", "/+$", "")
    deny = rules.where("action = 'deny' and rule is not null").groupBy(name.alias("key")).agg(F.min("rank").cast("long").alias("rank"))
    deny = written(deny.where("key != ''").withColumn("depth", F.when(F.contains("key", F.lit("/")), F.size(F.filter(F.split("key", "/", -1), lambda s: s != ""))).otherwise(0)))
    depths = sorted(r["depth"] for r in deny.select("depth").distinct().collect() if r["depth"])  # numbers of components
    forms = df.select(F.explode(F.array("path", "canonical")).alias("form")).where("form is not null").distinct()
    keys = F.concat(_ancestors(F.col("form"), depths), F.array(F.substring_index("form", "/", -1)))
    hits = _looked_up(forms.select("form", F.explode(keys).alias("key")), deny.select("key", "rank"), ["key"])
    first = small(written(hits.groupBy("form").agg(F.min(F.struct("rank", "key")).alias("hit"))))
    side = lambda c: first.select(F.col("form").alias(c), F.col("hit").alias(f"_{c}"))
    let_pass = written(rules.where("action = 'allow' and rule is not null").select(F.col("rule").alias("path"), F.lit(True).alias("_pass")).distinct())
    out = df.join(side("path"), "path", "left").join(side("canonical"), "canonical", "left").join(small(let_pass), "path", "left")
    own = F.coalesce(paths.denied_rule(F.col("canonical"), policy), paths.denied_rule(F.col("path"), policy))
    given = F.least("_path", "_canonical")
    rule = F.coalesce(own, given["key"])
    excepted = F.coalesce(F.col("_pass"), F.col("path").isin(list(policy.allow_paths))) & (F.col("path") == F.col("canonical"))
    verdict = F.when(linked, "deny_symlink").when(rule.isNull() | F.coalesce(excepted, F.lit(False)), "allow").otherwise("deny_rule")
    return out.select(*kept, verdict.alias("verdict"), rule.alias("rule"))


# links


def real_paths(df: DataFrame, links: DataFrame, path: str = "path", max_hops: int = 40) -> DataFrame:
    """df with canonical, has_symlink, hops, looped: paths with all links in them and in their ancestors followed.

    links: link, target (absolute, or relative to the link's folder). Of several targets the least one counts. Every round replaces a path's first
    component that is a link. A path that comes back to where it was, or has more than max_hops links, is looped and has no canonical form.
    """
    norm = lambda c: paths.normalize(c)
    parent = F.regexp_replace("link", "/[^/]*$", "")
    ends = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(parent, F.lit("/"), F.col("target")))
    table = written(links.where("link is not null and target is not null").groupBy(norm(F.col("link")).alias("link")).agg(F.min("target").alias("target")).select("link", norm(ends).alias("end")))
    depths = sorted(r["n"] for r in table.select((F.size(F.split("link", "/")) - 1).alias("n")).distinct().collect())
    start = df.select(F.col(path).alias("_from")).where("_from is not null").distinct()
    at = written(start.select("_from", norm(F.col("_from")).alias("now"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("looped")))
    done = []
    for _ in range(max_hops + 1):
        asked = at.select("now").distinct().select("now", F.explode(_ancestors(F.col("now"), depths)).alias("link"))
        hits = _looked_up(asked, table, ["link"], max_hops).groupBy("now").agg(F.min_by(F.struct("link", "end"), F.length("link")).alias("hit"))
        hits = written(hits)
        near = small(hits, max_hops)
        step = written(at.join(hits.hint("merge") if near is hits else near, "now", "left"))
        done.append(step.where("hit is null").select("_from", F.col("now").alias("canonical"), F.size("seen").alias("hops"), "looped"))
        moved = norm(F.concat(F.col("hit.end"), F.expr("substring(now, length(hit.link) + 1)")))
        more = step.where("hit is not null").select("_from", moved.alias("now"), F.array_append("seen", F.col("now")).alias("seen"))
        again = F.array_contains("seen", F.col("now")) | (F.size("seen") > max_hops)
        done.append(more.where(again).select("_from", F.lit(None).cast("string").alias("canonical"), F.size("seen").alias("hops"), F.lit(True).alias("looped")))
        at = written(more.where(~again).withColumn("looped", F.lit(False)))
        if at.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    kept = [c for c in df.columns if c not in ("canonical", "has_symlink", "hops", "looped")]
    found = small(written(out))
    joined = df.select(*kept, F.col(path).alias("_from")).join(found, "_from", "left")
    return joined.select(*kept, "canonical", (F.coalesce("hops", F.lit(0)) > 0).alias("has_symlink"), F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce("looped", F.lit(False)).alias("looped"))


@cache
def _joined_url():
    def joined(bases: pd.Series, more: pd.Series) -> pd.Series:
        def one(base, location):
            try:
                return urljoin(base, location)
            except ValueError:
                return None

        return pd.Series([one(b, m) for b, m in zip(bases, more, strict=True)])

    return F.pandas_udf(joined, "string")


def follow_links(df: DataFrame, redirects: DataFrame, url: str = "url", policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """df with final_url, hops, reason: URLs followed along a table of redirects, every hop validated like the first URL.

    redirects: source (absolute), location (absolute or relative). Of several locations the least one counts. reason: why the first bad hop is rejected,
    Loop if a URL comes again, TooManyRedirects beyond the settings' number; null: the chain ends at final_url.
    """
    table = written(redirects.where("source is not null and location is not null").groupBy("source").agg(F.min("location").alias("location")))
    check = lambda c: net.validate_url(c, policy.allow_ip_literals, policy.strict_quirks)["reason"]
    start = df.select(F.col(url).alias("_from")).where("_from is not null").distinct()
    at = written(start.select("_from", F.col("_from").alias("now"), F.array().cast("array<string>").alias("seen")).withColumn("reason", check(F.col("now"))))
    done = []
    for hop in range(policy.max_redirects + 1):
        open_ = at.where("reason is null").drop("reason")
        done.append(at.where("reason is not null"))
        asked = _looked_up(open_.select(F.col("now").alias("source")).distinct(), table, ["source"])
        hits = small(written(asked.select(F.col("source").alias("now"), _joined_url()("source", "location").alias("next"))))
        step = written(open_.join(hits, "now", "left"))
        done.append(step.where("next is null").select("_from", "now", "seen", F.lit(None).cast("string").alias("reason")))
        more = step.where("next is not null").select("_from", F.col("next").alias("now"), F.array_append("seen", F.col("now")).alias("seen"))
        looped = F.array_contains("seen", F.col("now"))
        over = F.lit("TooManyRedirects" if hop == policy.max_redirects else None).cast("string")
        at = written(more.withColumn("reason", F.coalesce(check(F.col("now")), F.when(looped, "Loop"), over)))
        if at.isEmpty():
            break
    done.append(at)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    kept = [c for c in df.columns if c not in ("final_url", "hops", "reason")]
    found = small(written(out.select("_from", F.col("now").alias("final_url"), F.size("seen").alias("hops"), "reason")))
    joined = df.select(*kept, F.col(url).alias("_from")).join(found, "_from", "left")
    no_url = F.when(F.col("_from").isNull(), "NoHost")
    return joined.select(*kept, "final_url", F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce(no_url, "reason").alias("reason"))
