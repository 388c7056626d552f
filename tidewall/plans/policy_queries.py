"""Queries of the URL, address and path rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import net, paths
from tidewall.functions import text as T
from tidewall.plans.common import Parts, Query, matches, table

#: An address from a key, alike in both engines
IP = "(o_orderkey * 2654435761 % 4294967296)"


def ipv4_block(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(IP).alias("ip"))
    return o.select("o_orderkey", "ip", net.blocked_v4(F.col("ip")).alias("label"))


def _v4_case(ip: str) -> str:
    """The label of an address by its octets, written from the registries and not from the code's table."""
    one, two, three = f"(({ip}) // 16777216)", f"((({ip}) // 65536) % 256)", f"((({ip}) // 256) % 256)"
    return f"""CASE WHEN {one} = 0 THEN 'this network' WHEN {one} = 127 THEN 'loopback' WHEN ({ip}) = 4294967295 THEN 'broadcast' WHEN {one} BETWEEN 224 AND 239 THEN 'multicast'
WHEN {one} = 169 AND {two} = 254 THEN 'link-local' WHEN {one} = 10 THEN 'private 10/8' WHEN {one} = 172 AND {two} BETWEEN 16 AND 31 THEN 'private 172.16/12'
WHEN {one} = 192 AND {two} = 168 THEN 'private 192.168/16' WHEN {one} = 100 AND {two} BETWEEN 64 AND 127 THEN 'shared by carriers' WHEN {one} = 192 AND {two} = 0 AND {three} = 0 THEN 'protocol assignments'
WHEN ({one} = 192 AND {two} = 0 AND {three} = 2) OR ({one} = 198 AND {two} = 51 AND {three} = 100) OR ({one} = 203 AND {two} = 0 AND {three} = 113) THEN 'for documentation'
WHEN {one} = 198 AND {two} IN (18, 19) THEN 'for benchmarks' WHEN {one} = 240 THEN 'reserved' END"""


#: An IPv6 address: its first hextets are chosen, the last two are counted
V6 = Parts("orders", "o_orderkey", {
    "a": ["0", "65282", "65152", "65216", "64768", "64513", "256", "8193", "8194", "100", "9734"], "b": ["0", "3778", "3512", "65435", "32512", "2056"],
    "c": ["0", "1"], "last": ["counted", "0", "1"], "f": ["0", "65535"],
})
V6_LAST = "CASE last WHEN 'counted' THEN o_orderkey * 2654435761 % 4294967296 ELSE CAST(last AS BIGINT) END"


def ipv6_block(spark, d):
    o = V6.rows(spark, d).withColumn("low", F.expr(V6_LAST.replace("ELSE CAST(", "ELSE TRY_CAST(")))
    number = lambda c: F.col(c).cast("int")
    hextets = F.array(number("a"), number("b"), number("c"), F.lit(0), F.lit(0), number("f"), F.expr("CAST(low DIV 65536 AS INT)"), F.expr("CAST(low % 65536 AS INT)"))
    return o.select("o_orderkey", net.blocked_v6(hextets).alias("label"))


def _v6_sql() -> str:
    rest = "c = 0 AND f = 0"
    return f"""SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 AND c = 0 AND (f = 65535 OR low > 1) THEN {_v4_case('low')}
WHEN a = 0 AND b = 0 AND {rest} AND low = 0 THEN 'v6 unspecified' WHEN a = 0 AND b = 0 AND {rest} AND low = 1 THEN 'v6 loopback'
WHEN a // 256 = 255 THEN 'v6 multicast' WHEN a // 64 = 1018 THEN 'v6 link-local' WHEN a // 64 = 1019 THEN 'v6 site-local'
WHEN a = 64768 AND b = 3778 THEN 'v6 cloud metadata' WHEN a // 512 = 126 THEN 'v6 private' WHEN a = 256 AND b = 0 AND c = 0 THEN 'v6 discarded'
WHEN a = 8193 AND b = 0 THEN 'v6 Teredo' WHEN a = 8194 AND ({_v4_case('b * 65536 + c')}) IS NOT NULL THEN '6to4 to a blocked address'
WHEN a = 8194 THEN '6to4' WHEN a = 100 AND b = 65435 AND {rest} THEN 'NAT64'
WHEN a = 100 AND b = 65435 AND c = 1 THEN 'NAT64 for local use' WHEN a = 100 AND b = 65435 THEN 'beside NAT64'
WHEN a = 8193 AND b = 3512 THEN 'v6 for documentation' END AS label
FROM (SELECT o_orderkey, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(f AS BIGINT) AS f, {V6_LAST.replace("CAST(last", "TRY_CAST(last")} AS low FROM {V6.sql()})"""


def resolver_filter(spark, d):
    """Hosts with up to two IPv4 and one IPv6 addresses each."""
    o = table(spark, d, "orders").withColumn("ip", F.expr(IP))
    four = F.filter(F.array(F.when(F.col("o_orderkey") % 3 > 0, F.col("ip")), F.when(F.col("o_orderkey") % 3 > 1, (F.col("ip") + 4096 * F.col("o_custkey")) % 4294967296)), lambda x: x.isNotNull())
    six = F.when(F.col("o_custkey") % 4 > 0, F.array(F.array(*[F.lit(0x2606), F.lit(0x4700), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(1)]))).otherwise(F.array().cast("array<array<int>>"))
    six = F.when(F.col("o_custkey") % 4 == 3, F.array(F.array(*[F.lit(x) for x in (0xFE80, 0, 0, 0, 0, 0, 0, 1)]))).otherwise(six)
    return o.select("o_orderkey", net.resolved_verdict(four, six).alias("verdict"))


RESOLVER = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 4 = 0 THEN 'DnsError' WHEN o_custkey % 4 = 3 THEN 'BlockedIp'
WHEN o_orderkey % 3 > 0 AND ({_v4_case('ip')}) IS NOT NULL THEN 'BlockedIp' WHEN o_orderkey % 3 > 1 AND ({_v4_case('(ip + 4096 * o_custkey) % 4294967296')}) IS NOT NULL THEN 'BlockedIp' ELSE 'ok' END AS verdict
FROM (SELECT *, {IP} AS ip FROM orders)"""

URLS = Parts("pages", "page_id", {
    "scheme": ["https://", "HTTP://", "ftp://", "javascript:", "", "http:/"], "login": ["", "u:p@", "a@b@"],
    "named": ["page", "127.0.0.1", "8.8.8.8", "[::1]", "[2606:4700:4700::1111]", "2130706433", "0x7f.1", "256.1.1.1", "exa mple.com", ""], "port": ["", ":8080", ":99999", ":x"],
})
#: The page's own host and path stand where no other host is named
_URL = "«scheme»«login»«CASE named WHEN 'page' THEN split_part(url, '/', 3) ELSE named END»«port»/x?«split_part(url, '?', 2)»#y"


def url_validate(spark, d):
    p = URLS.rows(spark, d, u=_URL)
    strict, open_ = net.validate_url(F.col("u")), net.validate_url(F.col("u"), allow_ip_literals=True)
    return p.select("page_id", "u", F.coalesce(strict["reason"], F.lit("ok")).alias("strict"), F.coalesce(open_["reason"], F.lit("ok")).alias("literals_allowed"))


# what stands before the first colon is a scheme; with nothing named, the path after further slashes is the host
_AS_SCHEME = "(scheme = '' AND (login = 'u:p@' OR (login = '' AND named = 'page' AND port <> '')))"
_BAD_URL = f"((scheme = '' AND NOT {_AS_SCHEME}) OR (scheme NOT IN ('', 'javascript:') AND (named IN ('256.1.1.1', 'exa mple.com') OR (named = '' AND login || port <> '') OR port IN (':99999', ':x'))))"
_IP_HOST = "named IN ('127.0.0.1', '8.8.8.8', '[::1]', '[2606:4700:4700::1111]', '2130706433', '0x7f.1')"
_OWN_HOST = "named IN ('127.0.0.1', '[::1]', '2130706433', '0x7f.1')"
URL_VALIDATE = f"""SELECT page_id, u, CASE WHEN {_BAD_URL} THEN 'NoHost' WHEN scheme IN ('ftp://', 'javascript:') OR {_AS_SCHEME} THEN 'BadScheme' WHEN {_IP_HOST} THEN 'RawIpLiteral' ELSE 'ok' END AS strict,
CASE WHEN {_BAD_URL} THEN 'NoHost' WHEN scheme IN ('ftp://', 'javascript:') OR {_AS_SCHEME} THEN 'BadScheme' WHEN {_OWN_HOST} THEN 'BlockedIp' ELSE 'ok' END AS literals_allowed FROM {URLS.sql(u=_URL)}"""


def url_hosts(spark, d):
    p = table(spark, d, "pages")
    v = net.validate_url(F.col("url"))
    return p.select("page_id", v["ok"].alias("ok"), net.redact_url(F.concat(F.regexp_replace("url", "://", "://u:p@"), F.lit("#x"))).alias("redacted"))


CHAINS = Parts("pages", "page_id", {"hop": ["/p%", "p%", "//h%.example/x", "http://127.0.0.1/%", "ftp://h/%", "https://h.example/%#f", "?q=%"], "n": ["0", "1", "2", "5", "6", "7"]})


def redirect_chain(spark, d):
    p = CHAINS.rows(spark, d).withColumn("n", F.col("n").cast("int"))
    hops = F.when(F.col("n") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda k: F.replace("hop", F.lit("%"), k.cast("string"))))
    chain = p.withColumn("chain", net.follow_redirects(F.concat(F.lit("https://"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/d/a")), hops))
    return chain.select("page_id", F.array_join("chain.urls", " ").alias("urls"), "chain.ok", "chain.reason", F.coalesce("chain.at", F.lit(-1)).alias("at"))


# what a hop joined to a page of the same host gives
_JOINED = """CASE WHEN hop LIKE '/p%' THEN 'https://' || host || replace(hop, '%', CAST(k AS VARCHAR)) WHEN hop LIKE 'p%' THEN 'https://' || host || '/d/' || replace(hop, '%', CAST(k AS VARCHAR))
WHEN hop LIKE '//%' THEN 'https:' || replace(hop, '%', CAST(k AS VARCHAR)) WHEN hop LIKE '?%' THEN 'https://' || host || '/d/a' || replace(hop, '%', CAST(k AS VARCHAR)) ELSE replace(hop, '%', CAST(k AS VARCHAR)) END"""
_HOP_REASON = "CASE WHEN n > 0 AND hop LIKE 'http://127%' THEN 'RawIpLiteral' WHEN n > 0 AND hop LIKE 'ftp%' THEN 'BadScheme' WHEN n > 5 THEN 'TooManyRedirects' END"
REDIRECTS = f"""SELECT page_id, array_to_string(list_concat(['https://' || host || '/d/a'], list_transform(range(1, n + 1), lambda k: {_JOINED})), ' ') AS urls,
{_HOP_REASON} IS NULL AS ok, {_HOP_REASON} AS reason, CAST(CASE {_HOP_REASON} WHEN 'TooManyRedirects' THEN 6 ELSE CASE WHEN {_HOP_REASON} IS NOT NULL THEN 1 ELSE -1 END END AS INTEGER) AS at
FROM (SELECT page_id, hop, CAST(n AS INTEGER) AS n, split_part(url, '/', 3) AS host FROM {CHAINS.sql()})"""

FILES = Parts("part", "p_partkey", {
    "folder": ["/home/u/", "/home/u/.ssh/", "/home/u/.sshx/", "/home/u/.aws/", "/srv/app/", "/etc/", "/etc/sudoers.d/", "/home/u/.config/gh/", "/etc/ssh/"],
    "name": ["%", ".env", ".envrc", ".env.%", ".env.example", "%.env", "shadow", "hosts", ".npmrc", "id_rsa"], "link": ["", "x", "", ""],
})
_FILE = "«folder»«replace(replace(name, '%', replace(p_name, ' ', '.')), ' ', '.')»"


def dotenv_policy(spark, d):
    rows = FILES.rows(spark, d, path=_FILE)
    return rows.select("p_partkey", "path", paths.is_dotenv(F.substring_index("path", "/", -1)).alias("hit"))


_IS_DOTENV = "(regexp_matches(path, '/[.]env(rc|[.][^/]*)?$') AND NOT path LIKE '%.example')"


def read_policy(spark, d):
    p = FILES.rows(spark, d, path=_FILE)
    excepted = Policy(allow_paths=("/home/u/.ssh/id_rsa", "/etc/shadow"), extra_deny=("/srv/app/hosts",))
    verdicts = [paths.read_verdict(F.col("path"), F.col("path"), F.col("link") == "x", policy) for policy in (Policy(), excepted, Policy(allow_sensitive=True))]
    return p.select("p_partkey", *[v.alias(n) for v, n in zip(verdicts, ("verdict", "with_exceptions", "unguarded"), strict=True)])


_DENIED = f"(regexp_matches(path, '^/home/u/([.]ssh/|[.]aws/|[.]config/gh/|[.]npmrc$)|^/etc/(ssh/|sudoers[.]d/|shadow$)') OR {_IS_DOTENV})"
READ_POLICY = f"""SELECT p_partkey, CASE WHEN link = 'x' THEN 'deny_symlink' WHEN {_DENIED} THEN 'deny_rule' ELSE 'allow' END AS verdict,
CASE WHEN link = 'x' THEN 'deny_symlink' WHEN path IN ('/home/u/.ssh/id_rsa', '/etc/shadow') THEN 'allow' WHEN {_DENIED} OR path = '/srv/app/hosts' THEN 'deny_rule' ELSE 'allow' END AS with_exceptions,
CASE WHEN link = 'x' THEN 'deny_symlink' ELSE 'allow' END AS unguarded FROM {FILES.sql(path=_FILE)}"""

TARGETS = Parts("part", "p_partkey", {
    "folder": ["/tmp/", "/home/u/", "repo/.git/hooks/", "/etc/profile.d/", "/dev/", "~/.config/autostart/", " ./x/../", "~/.local/share/systemd/user/"],
    "name": ["%.sh", "%.json", "%", "%.PY", "%.", ".%", ".bashrc", ".zshrc/", "config.fish"],
})
_TARGET = "«folder»«replace(name, '%', split_part(p_name, ' ', 1))»"


def exec_target(spark, d):
    rows = TARGETS.rows(spark, d, path=_TARGET)
    return rows.select("p_partkey", "path", paths.is_exec_target(F.col("path")).alias("runs"), paths.is_persistence_target(F.col("path")).alias("persists"))


EXEC_TARGET = f"""SELECT p_partkey, path, folder <> '/dev/' AND (regexp_matches(lower(name), '[.](sh|py)$|rc/?$|config[.]fish|[.]$') OR name = '%') AS runs,
regexp_matches(folder, '[.]git/hooks|profile[.]d|autostart|systemd/user') OR regexp_matches(name, 'rc/?$|config[.]fish') AS persists FROM {TARGETS.sql(path=_TARGET)}"""

MODES = Parts("part", "p_partkey", {"who": ["", "u", "a", "go"], "sign": ["+", "-", "=", ""], "bits": ["x", "w", "rX", "755", "644", "0711", "7", "600,u+x"]})


def chmod_mode(spark, d):
    rows = MODES.rows(spark, d, mode="«who»«sign»«bits»")
    return rows.select("p_partkey", "mode", paths.grants_execute(F.col("mode")).alias("grants"))


CHMOD = f"""SELECT p_partkey, mode, (sign IN ('+', '=') AND bits IN ('x', 'rX')) OR bits = '600,u+x' OR (who = '' AND sign = '' AND bits IN ('755', '0711')) AS grants FROM {MODES.sql(mode="«who»«sign»«bits»")}"""

DIRS = Parts("part", "p_partkey", {
    "root": ["/tmp", "/TMP", "/var//tmp", "~/Downloads", "/home/u/.cache", "/usr/bin", "./tmp", "/srv/../run/user", "/tmp/../etc", "/Dev/Shm", "/home/u", "/var/folders/./a"], "more": ["/%", "", "/%/%", "x/%"],
})
_DIR = "«root»«replace(replace(more, '%', p_name), ' ', '_')»"


def writable_dir(spark, d):
    rows = DIRS.rows(spark, d, path=_DIR)
    return rows.select("p_partkey", "path", paths.in_writable_dir(F.col("path"), "/home/u").alias("writable"), net.normalize_host(F.concat(F.lit("["), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("a.B..]"))).alias("host"))


WRITABLE = f"""SELECT p_partkey, path, (more LIKE '/_%' AND regexp_matches(lower(root), '^(/tmp|/var//tmp|~/downloads|/home/u/[.]cache|/srv/../run/user|/dev/shm|/var/folders/[.]/a)$') ) OR path LIKE '/var/folders/./a%' AS writable,
CASE WHEN path LIKE '~%' THEN '~' WHEN path LIKE '.%' THEN '.' ELSE '' END || 'a.B' AS host FROM {DIRS.sql(path=_DIR)}"""


def basenames(spark, d):
    return table(spark, d, "part").select("p_partkey", T.basename(F.concat(F.lit("/usr/"), F.replace("p_name", F.lit(" "), F.lit("/")))).alias("name"))


QUERIES: dict[str, Query] = {
    "ipv4_block": Query(ipv4_block, f"SELECT o_orderkey, CAST({IP} AS BIGINT) AS ip, {_v4_case(IP)} AS label FROM orders"),
    "ipv6_block": Query(ipv6_block, _v6_sql()),
    "resolver_filter": Query(resolver_filter, RESOLVER),
    "url_validate": Query(url_validate, URL_VALIDATE),
    "url_hosts": Query(url_hosts, f"SELECT page_id, {matches('url', '^https?://[A-Za-z]')} AS ok, regexp_replace(url, '#.*', '') AS redacted FROM pages"),
    "redirect_chain": Query(redirect_chain, REDIRECTS),
    "dotenv_policy": Query(dotenv_policy, f"SELECT p_partkey, path, {_IS_DOTENV} AS hit FROM {FILES.sql(path=_FILE)}"),
    "read_policy": Query(read_policy, READ_POLICY),
    "exec_target": Query(exec_target, EXEC_TARGET),
    "chmod_mode": Query(chmod_mode, CHMOD),
    "writable_dir": Query(writable_dir, WRITABLE),
    "basename": Query(basenames, "SELECT p_partkey, split_part('/usr/' || replace(p_name, ' ', '/'), '/', -1) AS name FROM part"),
}
