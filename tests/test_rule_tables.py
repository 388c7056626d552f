"""Rules in tables against brute force over Python's own libraries."""

import ipaddress
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import net, paths
from tidewall.operators import rule_tables as R


def test_addresses_in_text(spark):
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:DB8::a:1", "::ffff:1.2.3.4", "1::1.2.3.4", "fe80::1%eth0", "1::2::3", "1:2", "12345::", ":::", "", ":", "1.2.3.4", "1.2.3.256", "::1.2.3", "g::", "1:2:3:4:5:6:7:8:9", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", None]
    for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", R.v6_halves(F.col("ip")).alias("h")).collect():
        try:
            want = int(ipaddress.IPv6Address(r["ip"])) if r["ip"] and "%" not in r["ip"] else None
        except ValueError:
            want = None
        got = None if r["h"] is None else ((r["h"]["hi"] % 2**64) << 64) | r["h"]["lo"] % 2**64
        assert got == want, r["ip"]


def as_four(ip):
    if ip.version == 6 and (ip.ipv4_mapped or (int(ip) >> 32 == 0 and int(ip) > 1)):
        return ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)
    return ip


def test_ranges_against_brute_force(spark):
    rng = random.Random(3)
    nets = [("0.0.0.0/0", "all", 900), ("::/0", "all6", 900), ("10.0.0.0/8", "a", 5), ("10.1.0.0/16", "b", 3), ("10.1.2.3/32", "c", 9), ("fe80::/10", "l", 1), ("2001:db8::/32", "d", 4), ("2001:db8::/33", "e", 4), ("bad", "x", 0), ("1.2.3.4/33", "x", 0), ("1.2.3.4", "x", 0), (None, "x", 0), ("10.0.0.0/8", "later", 6)]
    for k in range(300):
        base = rng.choice([0x0A010000, 0xC0A80000, rng.getrandbits(32)]) | rng.getrandbits(12)
        nets.append((f"{ipaddress.IPv4Address(base)}/{rng.randrange(12, 33)}", f"v4-{k}", rng.randrange(50)))
        six = (0x20010DB8 << 96) | (rng.getrandbits(8) << rng.randrange(0, 90))
        nets.append((f"{ipaddress.IPv6Address(six)}/{rng.randrange(20, 129)}", f"v6-{k}", rng.randrange(50)))
    ips = ["10.1.2.3", "10.9.9.9", "::ffff:10.1.2.3", "::a01:203", "::", "::1", "fe80::1", "bad", "", None, "10.1.2.3"]
    ips += [str(ipaddress.IPv4Address(rng.choice([0x0A010000, 0xC0A80000]) | rng.getrandbits(12))) for _ in range(200)]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) | (rng.getrandbits(8) << rng.randrange(0, 90)))) for _ in range(200)]
    known = []
    for cidr, label, priority in nets:
        try:
            assert cidr and "/" in cidr
            known.append((priority, cidr, label, ipaddress.ip_network(cidr, strict=False)))
        except (ValueError, AssertionError):
            pass

    def want(ip):
        try:
            at = as_four(ipaddress.ip_address(ip))
        except ValueError:
            return False, None, None
        best = {}
        for p, c, label, n in known:
            if n.version == at.version and at in n:
                best[n] = min(best.get(n, (p, c, label)), (p, c, label))
        return (True, *(min(best.values())[2:0:-1] if best else (None, None)))

    table = spark.createDataFrame(nets, "cidr string, label string, priority int").repartition(3)
    rows = spark.createDataFrame(list(enumerate(ips)), "k int, ip string").withColumn("label", F.lit("clash"))
    before = R.small
    for small in (before, lambda t: t):
        R.small = small
        try:
            got = R.label_addresses(rows, table).collect()
        finally:
            R.small = before
        assert len(got) == len(ips) and all((r["valid"], r["label"], r["cidr"]) == want(ips[r["k"]]) for r in got)
    plan = R.label_addresses(rows, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["label"] for r in R.label_addresses(rows, table.limit(0)).collect()} == {None}


def test_built_in_ranges_as_a_table(spark):
    ips = [f"{a}.{b}.0.1" for a in (0, 1, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 241, 255) for b in (0, 15, 16, 31, 32, 51, 64, 113, 168, 254)] + ["255.255.255.255"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = R.label_addresses(df, R.own_ranges(spark)).withColumn("want", net.blocked_v4(net.v4_number(F.col("ip"))))
    assert all(r["label"] == r["want"] for r in got.collect())


def test_path_rules_against_columns(spark):
    rules = ["/srv/secret", "/etc/app/keys/", "token.txt", "/a/b/c/d", "/x"]
    policy = Policy(extra_deny=("/srv/secret", "/etc/app/keys", "/a/b/c/d", "/x"), allow_paths=("/srv/secret/ok", "/x/y"))
    rows = [(p, c, s) for p in ("/srv/secret", "/srv/secret/ok", "/srv/secretive", "/a/b/c/d/e", "/a/b/c", "/x/y", "/home/u/.ssh/id", "/p/.env", "/q", None) for c in (None, "/srv/secret/ok", "/x/y", "/w") for s in (True, False, None)]
    rows = [(p, p if c is None else c, s) for p, c, s in rows] + [("/" + "x/" * 5000, "/y", False)]
    df = spark.createDataFrame(rows, "path string, canonical string, has_symlink boolean").withColumn("key", F.lit("clash"))
    table = spark.createDataFrame([(r, "deny", k) for k, r in enumerate(rules)] + [(p, "allow", 0) for p in policy.allow_paths] + [(None, "deny", 0)], "rule string, action string, rank int")
    want = df.select("*", paths.read_verdict(F.col("path"), F.col("canonical"), F.coalesce("has_symlink", F.lit(False)), policy).alias("verdict"))
    key = lambda r: (str(r["path"]), str(r["canonical"]), str(r["has_symlink"]), r["verdict"])
    assert sorted(map(key, R.judge_paths(df, table).collect())) == sorted(map(key, want.collect()))
    named = R.judge_paths(spark.createDataFrame([("/m/token.txt", "/n", False), ("/m/token.txt/z", "/n", False), ("/srv/secret/x", "/x", False)], df.drop("key").schema), table).collect()
    assert {(r["path"], r["verdict"], r["rule"]) for r in named} == {("/m/token.txt", "deny_rule", "token.txt"), ("/m/token.txt/z", "allow", None), ("/srv/secret/x", "deny_rule", "/srv/secret")}
    assert {r["verdict"] for r in R.judge_paths(df, table, Policy(allow_sensitive=True)).collect()} == {"allow", "deny_symlink"}


def test_links_are_followed(spark):
    links = [("/a", "/b"), ("/b/c", "d"), ("/b/d", "../e/f"), ("/loop", "/loop2/x"), ("/loop2", "/loop"), ("/self", "/self"), ("/twice", "/z2"), ("/twice", "/z1"), (None, "/x"), *[(f"/n{k}", f"/n{k + 1}") for k in range(60)]]
    rows = ["/a", "/a/c/x", "/b/d", "/plain/../q", "/loop/k", "/self/s", "/twice/y", "/n30", "/n5", None, "/", "/ab", "/a", "rel/a"]
    got = {r["path"]: tuple(r)[1:] for r in R.real_paths(spark.createDataFrame([(r,) for r in rows], "path string"), spark.createDataFrame(links, "link string, target string")).collect()}
    assert got == {
        "/a": ("/b", True, 1, False), "/a/c/x": ("/e/f/x", True, 3, False), "/b/d": ("/e/f", True, 1, False), "/plain/../q": ("/q", False, 0, False), "/loop/k": (None, True, got["/loop/k"][2], True),
        "/self/s": (None, True, 1, True), "/twice/y": ("/z1/y", True, 1, False), "/n30": ("/n60", True, 30, False), "/n5": (None, True, 41, True), None: (None, False, 0, False), "/": ("/", False, 0, False), "/ab": ("/ab", False, 0, False), "rel/a": ("rel/a", False, 0, False),
    }


def test_redirects_are_followed(spark):
    start = "https://h.example/0"
    table = {f"https://h.example/{k}": f"/{k + 1}" for k in range(12)} | {"https://l.example/": "https://m.example/", "https://m.example/": "https://l.example/", "https://b.example/": "http://10.0.0.1/x", "https://f.example/": "file:///etc/passwd", "https://r.example/a/b": "../c?d"}
    rows = [start, "https://h.example/7", "https://h.example/6", "https://l.example/", "https://b.example/", "https://f.example/", "https://r.example/a/b", "https://alone.example/", "nonsense", None, "https://b.example/"]
    got = R.follow_links(spark.createDataFrame([(r,) for r in rows], "url string"), spark.createDataFrame(list(table.items()), "source string, location string")).collect()
    assert len(got) == len(rows)
    seen = {r["url"]: (r["final_url"], r["hops"], r["reason"]) for r in got}
    assert seen[start] == ("https://h.example/6", 6, "TooManyRedirects") and seen["https://h.example/7"] == ("https://h.example/12", 5, None) and seen["https://h.example/6"][2] == "TooManyRedirects"
    assert seen["https://l.example/"] == ("https://l.example/", 2, "Loop") and seen["https://b.example/"] == ("http://10.0.0.1/x", 1, "RawIpLiteral") and seen["https://f.example/"][1:] == (1, "BadScheme")
    assert seen["https://r.example/a/b"] == (urljoin("https://r.example/a/b", "../c?d"), 1, None) and seen["https://alone.example/"] == ("https://alone.example/", 0, None)
    assert seen["nonsense"] == ("nonsense", 0, "NoHost") and seen[None] == (None, 0, "NoHost")


def test_addresses_are_merged_in_parts(spark, monkeypatch):
    # an address is one row however many networks hold it, and networks go on over the parts of the address space
    plans, written = [], R.written
    monkeypatch.setattr(R, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    nets = [(f"10.0.0.0/{bits}", f"n{bits}", 40 - bits if bits % 2 else 90) for bits in range(8, 33)] + [(f"2001:db8::/{bits}", f"s{bits}", None if bits == 40 else bits) for bits in range(16, 120, 8)]
    table = spark.createDataFrame(nets, "cidr string, label string, priority long")
    ips = [str(ipaddress.IPv4Address(0x0A000000 + (1 << k % 24) + k)) for k in range(150)] + [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (1 << k))) for k in range(96)]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string")
    for size in (16_384, 4):
        monkeypatch.setattr(R, "PART_ROWS", size, raising=False)
        monkeypatch.setattr(R, "STARTS", 2, raising=False)
        for r in R.label_addresses(rows, table).collect():
            held = [((p is not None, p or 0, c), label) for c, label, p in nets if ipaddress.ip_address(r["ip"]) in ipaddress.ip_network(c, strict=False)]
            assert r["label"] == (min(held)[1] if held else None)
    assert not any("explode(" in plan and "_ip" in plan for plan in plans)


def test_links_of_many_rounds_share_one_broadcast(spark, monkeypatch):
    from tidewall import scratch

    monkeypatch.setattr(scratch, "SMALL_ROWS", 100)
    links = spark.range(90).selectExpr("concat('/c/', id) as link", "concat('/c/', id + 1) as target").where("link not like '%9'")
    table = scratch.written(links)
    assert scratch.small(table) is not table and scratch.small(table, 40) is table
    rows = spark.range(90).selectExpr("id", "concat('/c/', id, '/f') as path")
    found = R.real_paths(rows, links).collect()
    assert {(r["id"], r["canonical"], r["hops"], r["looped"]) for r in found} == {(k, f"/c/{k // 10 * 10 + 9}/f", 9 - k % 10, False) for k in range(90)}
