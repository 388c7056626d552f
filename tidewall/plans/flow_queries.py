"""Queries of sources, sinks, state and rule tables: their inputs are derived from the driver's tables by expressions that SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall import sqlfunctions
from tidewall.config import Policy
from tidewall.functions import scan
from tidewall.operators import needles, rule_tables
from tidewall.plans.common import Parts, Query, spread, table
from tidewall.plans.rules import BAD_SCRIPT, NUMBER, RULES, SCRIPT, URL
from tidewall.scratch import new_folder
from tidewall.sources import audit, events, sketches, tables
from tidewall.streaming import lines, reports

# lines of a file, some with a byte that is no text

LINES = Parts("events", NUMBER, {**SCRIPT, "mark": ["", "ff", "c3a9", "e9"]})
_LINE = f'{{"event_id":«event_id»,"tool_name":"Bash","tool_input":{{"command":"«a» {URL}«b»"}},"cwd":"'


def event_lines(spark, d):
    """Written as text files with the bytes as they are, and read back by the lines source."""
    raw = F.concat(F.encode("line", "UTF-8"), F.unhex("mark"), F.encode(F.lit('"}'), "UTF-8"))
    path = new_folder(spark)
    LINES.rows(spark, d, line=_LINE).select(raw.cast("string").alias("value")).write.text(path)
    tables.register(spark)
    read = spark.read.format("tidewall_lines").option("path", path).option("rangeBytes", 1 << 20).load()
    number = F.regexp_extract(F.decode("raw", "ISO-8859-1"), '"event_id":([0-9]+)', 1).cast("long").alias("event_id")
    return events.event_verdicts(read.select(number, "raw")).select("event_id", "decoded", "verdict", "exit")


EVENT_LINES = f"""SELECT event_id, CASE WHEN bad THEN 'not_utf8' ELSE 'ok' END AS decoded, CASE WHEN bad OR script THEN 'deny' ELSE 'allow' END AS verdict,
CASE WHEN bad OR script THEN 2 ELSE 0 END AS exit FROM (SELECT event_id, mark IN ('ff', 'e9') AS bad, {BAD_SCRIPT} AS script FROM {LINES.sql()})"""

# payloads in text files, of which some lines are no payload

PAYLOADS = Parts("events", NUMBER, {"head": ['{"tool_name":"Edit",', '{"tool_name":"mcp__@x",', "{", '[{"tool_name":"Edit",'], "tail": ["}", "", "}x", "} {}", "}  "]})
_PAYLOAD = '«replace(head, \'@\', event_type)»"tool_input":{"n":[«event_id»]},"session_id":"s«user_id»","cwd":"/w"«tail»'


def payload_lines(spark, d):
    path = new_folder(spark)
    PAYLOADS.rows(spark, d, line=_PAYLOAD).select("line").write.text(path)
    found = events.read_payloads(spark, path)
    return found.select("tool_name", "tool_input", "session_id", F.col("tool_response").isNull().alias("no_response"), "cwd")


PAYLOAD_LINES = f"""SELECT CASE WHEN head LIKE '%Edit%' THEN 'Edit' ELSE 'mcp__' || event_type || 'x' END AS tool_name, '{{"n":[' || event_id || ']}}' AS tool_input,
's' || user_id AS session_id, true AS no_response, '/w' AS cwd FROM {PAYLOADS.sql()} WHERE head LIKE '{{"tool_name%' AND trim(tail) = '}}'"""

# code that hides its words

HIDDEN = Parts("conversations", "conv_id * 7 + turn", {
    "unit": ["\\x63", "\\u0063", "\\143", "\\N{LATIN SMALL LETTER C}", "chr(99)", "CHR(99)", "fromCharCode(1,", "b64decode(", "Buffer.from(", "plain ", "'cu'", '"wg"', "'ba'"],
    "times": ["1", "2", "3", "4"], "glue": ["+", " . ", "..", "(string-append ", "<>", " & ", ";"], "rest": ["'rl'", '"et"', "'x'", "'sh'", "'SH'"],
})


def obfuscation_marks(spark, d):
    rows = HIDDEN.rows(spark, d, code="say_«role»(«repeat(unit, CAST(times AS INT))»«glue»«rest»)")
    return rows.select("conv_id", "turn", scan.is_obfuscated(F.col("code")).alias("hidden"))


_HALVES = "(unit = '''cu''' AND rest = '''rl''') OR (unit = '\"wg\"' AND rest = '\"et\"') OR (unit = '''ba''' AND lower(rest) = '''sh''')"
OBFUSCATION_MARKS = f"""SELECT conv_id, turn, CASE WHEN unit IN ('b64decode(', 'Buffer.from(') THEN true WHEN unit = 'plain ' THEN false
WHEN unit LIKE '''%' OR unit LIKE '"%' THEN glue NOT IN (' & ', ';') AND ({_HALVES}) ELSE CAST(times AS INT) >= 3 END AS hidden FROM {HIDDEN.sql()}"""

# a conversation's turns as pieces of one stream; every cut goes through a token


def line_chunks(spark, d):
    c = table(spark, d, "conversations")
    data = F.encode(F.concat(F.lit("A" * 12 + "\n"), F.coalesce("text", F.lit("")), F.lit("\nkey AKIAAAAA")), "UTF-8")
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("end"))
    pieces = c.join(ends, "conv_id").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("piece"), data.alias("data"), (F.col("turn") == F.col("end")).alias("last"))
    out = lines.redacted_chunks(pieces).groupBy("stream").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("number", "chunk"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.decode(x["chunk"], "UTF-8")), "")
    return out.select(F.col("stream").cast("long").alias("conv_id"), F.col("n").alias("n_chunks"), F.md5(text).alias("text_md5"))


LINE_CHUNKS = """WITH whole AS (SELECT conv_id, string_agg(repeat('A', 12) || chr(10) || coalesce(text, '') || chr(10) || 'key AKIAAAAA', '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS BIGINT) AS n_chunks, md5(replace(t, 'AKIA' || repeat('A', 16), '<redacted:aws-access-key>')) AS text_md5 FROM whole"""

# an append that runs twice


def trail_appends(spark, d):
    path, e = new_folder(spark), table(spark, d, "events")
    rows = audit.wrapper_rows(e, F.col("ts"), F.lit("shell"), F.when(F.col("user_id") % 3 == 0, "deny").otherwise("allow"), F.col("props"), F.col("event_type"), F.lit(0))
    for _ in range(2):
        tables.append_once(rows, path, "first")
    tables.append_once(rows.where("decision = 'deny'"), path, "second")
    seen = audit.read(spark, path).groupBy(F.to_date("at").cast("string").alias("day"), "decision", "reason")
    return seen.agg(F.count("*").alias("n"), F.countDistinct("body_sha256").alias("bodies"))


TRAIL = "(SELECT *, CASE WHEN user_id % 3 = 0 THEN 'deny' ELSE 'allow' END AS decision FROM events)"
TRAIL_APPENDS = f"""SELECT day, decision, reason, CAST(sum(times) AS BIGINT) AS n, count(DISTINCT props) AS bodies
FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, decision, event_type AS reason, props, CASE decision WHEN 'deny' THEN 2 ELSE 1 END AS times FROM {TRAIL}) GROUP BY day, decision, reason"""

# addresses and networks; N is a 32-bit number made from a key


def _number(key: str) -> str:
    return f"(({key} * 2654435761) % 4294967296)"


def _dotted(n: str, div: str) -> str:
    return f"concat_ws('.', {n} {div} 16777216, ({n} {div} 65536) % 256, ({n} {div} 256) % 256, {n} % 256)"


def _hex(n: str, spark: bool) -> str:
    return f"lower(hex({n}))" if spark else f"printf('%x', {n})"


def _six(n: str, spark: bool) -> str:
    div = "div" if spark else "//"
    return f"concat('2001:db8:', {_hex(f'({n} {div} 65536)', spark)}, ':', {_hex(f'({n} % 65536)', spark)}, '::7')"


N_IP, N_NET = _number("o_orderkey"), "(((c_custkey * 40503) % 65536) * 65536 + (c_custkey * 7919) % 65536)"
BITS_4, BITS_6 = "(6 + c_custkey % 27)", "(33 + c_custkey % 31)"


def _networks(spark: bool) -> list[tuple[str, str]]:
    """(cidr, label) of a customer's IPv4 and IPv6 network."""
    kind = "string" if spark else "VARCHAR"
    four = f"concat({_dotted(N_NET, 'div' if spark else '//')}, '/', cast({BITS_4} as {kind}))"
    six = f"concat({_six(N_NET, spark)}, '/', cast({BITS_6} as {kind}))"
    return [(four, "concat('four-', c_mktsegment)"), (six, "concat('six-', c_mktsegment)")]


def ip_range_table(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    nets = [c.selectExpr(f"{cidr} as cidr", f"{label} as label", "c_custkey % 97 as priority") for cidr, label in _networks(True)]
    ips = o.selectExpr("o_orderkey", f"case o_orderkey % 3 when 0 then {_six(N_IP, True)} when 1 then concat('::ffff:', {_dotted(N_IP, 'div')}) else {_dotted(N_IP, 'div')} end as ip")
    return rule_tables.label_addresses(ips, nets[0].unionByName(nets[1])).select("o_orderkey", "valid", "label", "cidr")


_FOUR, _SIX = _networks(False)
IP_RANGE_TABLE = f"""WITH nets AS (SELECT 4 AS family, {_FOUR[0]} AS cidr, {_FOUR[1]} AS label, c_custkey % 97 AS priority, {N_NET} AS net, 1 << (32 - {BITS_4}) AS width FROM customer
UNION ALL SELECT 6, {_SIX[0]}, {_SIX[1]}, c_custkey % 97, {N_NET}, 1 << (64 - {BITS_6}) FROM customer),
bounds AS (SELECT *, net - net % width AS lo FROM nets),
ips AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 4 END AS family, {N_IP} AS n FROM orders),
best AS (SELECT family, n, min({{'priority': priority, 'cidr': cidr, 'label': label}}) AS b FROM (SELECT DISTINCT family, n FROM ips) i JOIN bounds USING (family) WHERE n >= lo AND n < lo + width GROUP BY family, n)
SELECT o_orderkey, true AS valid, b.label AS label, b.cidr AS cidr FROM ips LEFT JOIN best USING (family, n)"""

# path rules: folders of parts are denied, some files in them are allowed

FILE = "concat('/data/Brand#', {cast}(l_suppkey % 25 + 1 as {kind}), '/', {cast}({cast}(l_quantity as int) as {kind}), '/f', {cast}(l_linenumber as {kind}))"
FOLDER = "CASE WHEN p_partkey % 60 = 0 THEN concat('/data/', p_brand) ELSE concat('/data/', p_brand, '/', {cast}(p_size as {kind})) END"
ALLOWED = "concat('/data/', p_brand, '/', {cast}(p_size as {kind}), '/f', {cast}(p_partkey % 7 + 1 as {kind}))"
_SPARK, _DUCK = {"cast": "cast", "kind": "string"}, {"cast": "cast", "kind": "VARCHAR"}


def path_rule_table(spark, d):
    p, files = table(spark, d, "part"), table(spark, d, "lineitem")
    deny = p.where("p_partkey % 4 <> 1").selectExpr(f"{FOLDER.format(**_SPARK)} as rule", "'deny' as action", "p_partkey as rank")
    allow = p.where("p_partkey % 4 = 1").selectExpr(f"{ALLOWED.format(**_SPARK)} as rule", "'allow' as action", "p_partkey as rank")
    rows = files.selectExpr("l_orderkey", "l_linenumber", f"{FILE.format(**_SPARK)} as path", "l_returnflag = 'R' as has_symlink")
    rows = rows.withColumn("canonical", F.when(F.col("l_orderkey") % 9 == 0, F.concat(F.lit("/mnt"), "path")).otherwise(F.col("path")))
    return rule_tables.judge_paths(rows, deny.unionByName(allow), Policy()).select("l_orderkey", "l_linenumber", "verdict", "rule")


PATH_RULE_TABLE = f"""WITH deny AS (SELECT {FOLDER.format(**_DUCK)} AS rule, p_partkey AS rank FROM part WHERE p_partkey % 4 <> 1),
allowed AS (SELECT DISTINCT {ALLOWED.format(**_DUCK)} AS path FROM part WHERE p_partkey % 4 = 1),
files AS (SELECT *, {FILE.format(**_DUCK)} AS path FROM lineitem),
hits AS (SELECT path, arg_min(rule, rank) AS rule FROM (SELECT DISTINCT path FROM files) f JOIN deny ON starts_with(path, rule || '/') GROUP BY path)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'deny_symlink' WHEN h.rule IS NULL OR (a.path IS NOT NULL AND l_orderkey % 9 <> 0) THEN 'allow' ELSE 'deny_rule' END AS verdict, h.rule AS rule
FROM files f LEFT JOIN hits h ON h.path = f.path LEFT JOIN allowed a ON a.path = f.path"""

# links between customers' folders: chains of up to eight, some of which bite their tail

TARGET = "CASE WHEN c_custkey % 8 = 0 THEN concat('/real/', {cast}(c_custkey as {kind})) WHEN c_custkey % 40 = 21 THEN concat('/c/', {cast}(c_custkey - 3 as {kind})) ELSE concat('/c/', {cast}(c_custkey + 1 as {kind})) END"


def link_table(spark, d):
    links = table(spark, d, "customer").selectExpr("concat('/c/', cast(c_custkey as string)) as link", f"{TARGET.format(**_SPARK)} as target")
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "concat('/c/', cast(o_custkey as string), '/f') as path")
    return rule_tables.real_paths(rows, links).select("o_orderkey", "canonical", "has_symlink", "hops", "looped")


LINK_TABLE = f"""WITH RECURSIVE links AS (SELECT '/c/' || c_custkey AS link, {TARGET.format(**_DUCK)} AS target FROM customer),
walk AS (SELECT link AS start, link AS now_at, 0 AS hops, [link] AS seen, false AS looped FROM (SELECT DISTINCT '/c/' || o_custkey AS link FROM orders)
UNION ALL SELECT start, target, hops + 1, list_append(seen, target), list_contains(seen, target) FROM walk JOIN links ON now_at = link WHERE NOT looped),
ends AS (SELECT start, arg_max(now_at, hops) AS now_at, max(hops) AS hops, bool_or(looped) AS looped FROM walk GROUP BY start)
SELECT o_orderkey, CASE WHEN looped THEN NULL ELSE now_at || '/f' END AS canonical, hops > 0 AS has_symlink, hops::INTEGER AS hops, looped FROM orders JOIN ends ON start = '/c/' || o_custkey"""

# redirects from page to page; some lead to an address or run too long

LOCATION = "CASE WHEN page_id % 28 = 9 THEN 'http://10.0.0.1/' WHEN page_id % 28 = 20 THEN concat('/', {cast}(page_id - 2 as {kind})) WHEN page_id % 12 <> 11 THEN concat('/', {cast}(page_id + 1 as {kind})) END"


def redirect_table(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", "concat('https://r.example/', cast(page_id as string)) as url", f"{LOCATION.format(**_SPARK)} as location")
    return rule_tables.follow_links(rows.select("page_id", "url"), rows.selectExpr("url as source", "location")).select("page_id", "final_url", "hops", "reason")


REDIRECT_TABLE = f"""WITH RECURSIVE moves AS (SELECT 'https://r.example/' || page_id AS source, CASE WHEN {LOCATION.format(**_DUCK)} LIKE '/%' THEN 'https://r.example' || {LOCATION.format(**_DUCK)} ELSE {LOCATION.format(**_DUCK)} END AS target FROM pages),
walk AS (SELECT source AS start, source AS now_at, 0 AS hops, [source] AS seen, CAST(NULL AS VARCHAR) AS reason FROM moves
UNION ALL SELECT start, target, hops + 1, list_append(seen, target), CASE WHEN target LIKE '%10.0.0.1%' THEN 'RawIpLiteral' WHEN list_contains(seen, target) THEN 'Loop' WHEN hops = 5 THEN 'TooManyRedirects' END
  FROM walk JOIN moves ON now_at = source WHERE reason IS NULL AND target IS NOT NULL)
SELECT CAST(split_part(start, '/', 4) AS BIGINT) AS page_id, arg_max(now_at, hops) AS final_url, max(hops)::INTEGER AS hops, max(reason) AS reason FROM walk GROUP BY start"""


# the first policy and two kernels in SQL text


def sql_text_stages(spark, d):
    """Downloads that are piped to a shell, over the stages that a table function gives."""
    options, template, _ = RULES[0]
    sqlfunctions.register(spark)
    commands = spread(Parts("events", NUMBER, options).rows(spark, d, command=template).select("event_id", "command"))
    return spark.sql(
        """WITH stages AS (SELECT c.event_id, s.* FROM {commands} c, LATERAL parse_shell(c.command) s),
        bad AS (SELECT DISTINCT event_id FROM stages GROUP BY event_id, pipeline HAVING min(stage) FILTER (WHERE name IN ('curl', 'wget'))
          < max(stage) FILTER (WHERE name IN ('bash', 'sh', 'zsh', 'dash', 'ksh', 'ash', 'fish', 'tcsh', 'csh', 'source', '.', 'eval')))
        SELECT c.event_id, CASE WHEN b.event_id IS NULL THEN 'allow' ELSE 'deny' END AS verdict, whatwg_url(nfkc(concat('https://h', c.event_id, '.ｅxample/'))).host AS host
        FROM {commands} c LEFT JOIN bad b ON c.event_id = b.event_id""",
        commands=commands,
    )


SQL_TEXT_STAGES = f"SELECT event_id, CASE WHEN {RULES[0][2]} THEN 'deny' ELSE 'allow' END AS verdict, 'h' || event_id || '.example' AS host FROM {Parts('events', NUMBER, RULES[0][0]).sql()}"

# openings of conversations as needles, in another case

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def needle_hits(spark, d):
    c = table(spark, d, "conversations")
    some = c.where("turn = 0").select(F.translate(F.substring("text", 1, 9), SMALL, CAPITALS).alias("needle"))
    hits = needles.needle_hits(c, some)
    return hits.select("conv_id", "turn", F.explode("hits").alias("h")).select("conv_id", "turn", "h.needle", "h.first")


NEEDLE_HITS = f"""WITH needles AS (SELECT DISTINCT translate(substr(text, 1, 9), '{SMALL}', '{CAPITALS}') AS needle FROM conversations WHERE turn = 0),
found AS (SELECT conv_id, turn, needle, strpos(translate(text, '{SMALL}', '{CAPITALS}'), needle) AS place FROM conversations, needles WHERE needle <> '')
SELECT conv_id, turn, needle, CAST(place - 1 AS INTEGER) AS first FROM found WHERE place > 0"""

# reports by event time over whole tables

_JUDGED = "CASE WHEN user_id % 4 = event_id % 4 THEN 'deny' ELSE 'allow' END"


def session_report(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "ts", f"{_JUDGED} as verdict", "event_type as policy")
    out = reports.sessions(e, "user_id", gap="6 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("user", stamp("start"), stamp("end"), "n", "denials", F.array_join("policies", ",").alias("policies"))


SESSION_REPORT = f"""WITH marked AS (SELECT *, {_JUDGED} AS verdict, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true)::INTEGER AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM marked)
SELECT user_id AS "user", strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n, count(*) FILTER (verdict = 'deny') AS denials,
coalesce(string_agg(DISTINCT CASE WHEN verdict = 'deny' THEN event_type END, ',' ORDER BY CASE WHEN verdict = 'deny' THEN event_type END), '') AS policies FROM numbered GROUP BY user_id, nth"""


def advised_denials(spark, d):
    e = table(spark, d, "events").withColumn("session", F.col("user_id").cast("string"))
    verdicts = e.selectExpr("session", "ts", f"{_JUDGED} as verdict", "event_type as policy")
    advice = e.where("event_id % 3 = 0").selectExpr("session", "ts", "props as event")
    out = reports.denials_after_advisories(verdicts, advice, within="2 days")
    return out.groupBy("session", "policy").agg(F.count("*").alias("n"), F.countDistinct("event").alias("events"), F.date_format(F.min("denied_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"))


ADVISED_DENIALS = f"""WITH v AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, event_type AS policy FROM events WHERE {_JUDGED} = 'deny'),
a AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, props AS event FROM events WHERE event_id % 3 = 0)
SELECT session, policy, count(*) AS n, count(DISTINCT event) AS events, strftime(min(v.ts), '%Y-%m-%d %H:%M:%S.%f') AS first FROM a JOIN v USING (session)
WHERE v.ts >= a.ts AND v.ts <= a.ts + INTERVAL 2 DAY GROUP BY session, policy"""

# stored daily sketches, merged, against what is exact


def audit_sketches(spark, d):
    """Whether the merged sketches of all stored months keep their stated errors, by decision."""
    path, o = new_folder(spark), table(spark, d, "orders")
    c = F.col
    days = sketches.daily(o, F.trunc("o_orderdate", "month"), c("o_orderstatus"), c("o_custkey"), c("o_totalprice"), c("o_orderpriority"))
    sketches.append_days(days, path)
    found = sketches.report(sketches.merged(spark.read.parquet(path), "grp"), "grp").withColumnRenamed("n", "merged_n")
    exact = o.groupBy(c("o_orderstatus").alias("grp")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("items"))
    ranks = o.join(found.select(c("grp").alias("o_orderstatus"), "p50", "p90", "p99"), "o_orderstatus").groupBy(c("o_orderstatus").alias("grp"))
    ranks = ranks.agg(*[F.avg((c("o_totalprice") <= c(p)).cast("int")).alias(f"rank_{p}") for p in ("p50", "p90", "p99")])
    near = [(F.abs(c(f"rank_{p}") - q) < 0.03).alias(f"{p}_near") for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    joined = found.withColumnRenamed("items", "guess").join(exact, "grp").join(ranks, "grp")
    return joined.select("grp", (c("merged_n") == c("n")).alias("whole"), "n", (F.abs(c("guess") / c("items") - 1) < 0.06).alias("items_near"), *near, F.array_join(F.transform("top", lambda t: F.concat(t["key"], F.lit(":"), t["n"])), ",").alias("top"))


AUDIT_SKETCHES = """WITH keys AS (SELECT o_orderstatus AS grp, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY ALL)
SELECT grp, true AS whole, CAST(sum(n) AS BIGINT) AS n, true AS items_near, true AS p50_near, true AS p90_near, true AS p99_near, string_agg(key || ':' || n, ',' ORDER BY n DESC, key) AS top FROM keys GROUP BY grp"""


QUERIES: dict[str, Query] = {
    "event_lines": Query(event_lines, EVENT_LINES),
    "payload_lines": Query(payload_lines, PAYLOAD_LINES),
    "obfuscation_marks": Query(obfuscation_marks, OBFUSCATION_MARKS),
    "line_chunks": Query(line_chunks, LINE_CHUNKS),
    "trail_appends": Query(trail_appends, TRAIL_APPENDS),
    "ip_range_table": Query(ip_range_table, IP_RANGE_TABLE),
    "path_rule_table": Query(path_rule_table, PATH_RULE_TABLE),
    "link_table": Query(link_table, LINK_TABLE),
    "redirect_table": Query(redirect_table, REDIRECT_TABLE),
    "sql_text_stages": Query(sql_text_stages, SQL_TEXT_STAGES),
    "needle_hits": Query(needle_hits, NEEDLE_HITS),
    "session_report": Query(session_report, SESSION_REPORT),
    "advised_denials": Query(advised_denials, ADVISED_DENIALS),
    "audit_sketches": Query(audit_sketches, AUDIT_SKETCHES),
}

