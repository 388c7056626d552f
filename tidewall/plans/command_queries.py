"""Queries of the command policies, event decoding and the audit trail, over commands derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.config import Policy
from tidewall.functions import argv
from tidewall.functions import text as T
from tidewall.operators.commands import classify, explain, script_rows
from tidewall.operators.policies import POLICIES
from tidewall.plans.common import Parts, Query, spread, table
from tidewall.plans.rules import BAD_SCRIPT, INERT, MALFORMED, NUMBER, RECURSIVE, RULES, SCRIPT, URL, WRAPPERS, placed
from tidewall.sources import audit, events

def _verdicts(shape, only=None, policy=Policy()):  # noqa: B008
    """Verdicts of commands built from parts, against the shape's rule."""
    options, template, rule = shape

    def run(spark, d):
        return classify(Parts("events", NUMBER, options).rows(spark, d, command=template), policy=policy, only=only).select("event_id", "command", "verdict")

    return Query(run, f"SELECT event_id, command, CASE WHEN {rule} THEN 'deny' ELSE 'allow' END AS verdict FROM {Parts('events', NUMBER, options).sql(command=template)}")


WRAPPED, NESTED = placed(WRAPPERS + INERT[:4]), placed(RECURSIVE + INERT[4:])
FLAGSHIP = placed(WRAPPERS + RECURSIVE + INERT)
_FLAGSHIP_PARTS = Parts("events", NUMBER, FLAGSHIP[0])
_FLAGSHIP_SQL = f"(SELECT *, CASE WHEN {FLAGSHIP[2]} THEN 'deny' ELSE 'allow' END AS decision FROM {_FLAGSHIP_PARTS.sql(command=FLAGSHIP[1])})"

SHAPES = Parts("events", NUMBER, {"p": ["ls", "a x | b", "a | b | c", "a $(b | c)", "x=1", "a `b`"], "sep": ["; ", " && ", "\n", " & ", " || "], "q": ["ls -l", "a | b", "'c;d' \"| e\""], "tail": ["", " > x", " 2>> y > z", " <<< w", " &> x < y"]})


def shell_ir_shape(spark, d):
    rows = script_rows(SHAPES.rows(spark, d, command="«p»«sep»«q» «event_type»«tail»"), "event_id")
    stages = F.coalesce(F.size("stages"), F.lit(0))
    redirects = F.aggregate(F.coalesce(F.transform("stages", lambda s: F.size(s["redirects"])), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)
    return rows.groupBy("event_id").agg(F.count("place").alias("n_pipelines"), F.sum(F.when(F.col("place").isNull(), 0).otherwise(stages)).alias("n_stages"), F.sum(redirects).alias("n_redirects"))


# an assignment runs nothing, a substitution is a script of its own; bars in quotes are text
_PIPELINES = "(CASE WHEN p = 'x=1' THEN 0 WHEN regexp_matches(p, '[$`]') THEN 2 ELSE 1 END + 1)"
SHELL_IR = f"""SELECT event_id, CAST({_PIPELINES} AS BIGINT) AS n_pipelines, CAST({_PIPELINES} + len(regexp_extract_all(p || replace(q, '"| e"', ''), '[|]')) AS BIGINT) AS n_stages,
CAST(len(regexp_extract_all(tail, '<<<|>>|&>|>|<')) AS BIGINT) AS n_redirects FROM {SHAPES.sql()}"""

_PREFIXES = {"shell": "", "python": "python3 -c ", "node": "node -e ", "ruby": "ruby -e ", "perl": "perl -e "}
BODIES = Parts("conversations", "turn + conv_id", {"dialect": list(_PREFIXES)})


def dialect_front(spark, d):
    rows = BODIES.rows(spark, d, body="say('«text»')")
    return rows.select("conv_id", "turn", F.md5(T.classifier_input(F.col("dialect"), F.col("body"))).alias("command_md5"))


_FRONT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PREFIXES.items() if v)
DIALECT_FRONT = f"""SELECT conv_id, turn, md5(CASE dialect WHEN 'shell' THEN body ELSE CASE dialect {_FRONT} END || '''' || replace(body, '''', '''\\''''') || '''' END) AS command_md5
FROM {BODIES.sql(body="say('«text»')")}"""

ARGV = Parts("events", NUMBER, {"dialect": ["shell", "python"], "flag": ["-c", "-xc", "-cz", "-i", "-c1+1", "", "-"], "body": ["ls -l", ""], "more": ["a", ""]})


def argv_gate(spark, d):
    words = F.filter(F.array(F.lit("w"), "flag", "body", "event_type", "more"), lambda a: a != "")
    e = ARGV.rows(spark, d).withColumn("argv", words).drop("body")
    g = F.when(F.col("dialect") == "shell", argv.inline_body(F.col("argv"), "shell")).otherwise(argv.inline_body(F.col("argv"), "python"))
    override = argv.interpreter_ok(F.concat(F.col("flag"), F.lit("/bin/"), F.col("event_type")))
    return e.select("event_id", g["body"].alias("body"), F.array_join(g["rest"], " ").alias("rest"), g["error"].alias("error"), override.alias("absolute"))


# after a flag that takes the next word the body is that word; glued to the flag, what follows the flag
ARGV_GATE = f"""WITH a AS (SELECT *, list_filter([flag, body, event_type, more], lambda x: x <> '') AS args,
CASE WHEN flag = '-c' OR (dialect = 'shell' AND flag IN ('-xc', '-cz')) THEN 'next' WHEN flag LIKE '-c%' THEN 'glued' ELSE 'none' END AS kind FROM {ARGV.sql()})
SELECT event_id, CASE kind WHEN 'next' THEN args[2] WHEN 'glued' THEN substr(args[1], 3) END AS body,
CASE kind WHEN 'next' THEN array_to_string(args[3:], ' ') WHEN 'glued' THEN array_to_string(args[2:], ' ') END AS rest,
CASE kind WHEN 'none' THEN 'unrecognized argument before the flag' END AS error, flag = '' AS absolute FROM a"""

RAW = Parts("events", NUMBER, {"tool": ["Bash", "Read", "bash"], **SCRIPT, "tail": ['"}}', '"}', '"}}}', '"},"cwd":"/w"}'], "lead": ["", "  ", "\n"]})
_RAW = f'«lead»{{"tool_name":"«tool»","tool_input":{{"command":"«a» {URL}«b»«tail»'


def event_decode(spark, d):
    e = RAW.rows(spark, d, raw=_RAW)
    return events.event_verdicts(e.select("event_id", F.encode("raw", "UTF-8").alias("raw"))).select("event_id", "verdict", "exit")


_BAD_EVENT = f"(NOT json_valid(raw) OR (tool = 'Bash' AND {BAD_SCRIPT}))"
EVENT_DECODE = f"SELECT event_id, CASE WHEN {_BAD_EVENT} THEN 'deny' ELSE 'allow' END AS verdict, CASE WHEN {_BAD_EVENT} THEN 2 ELSE 0 END AS exit FROM {RAW.sql(raw=_RAW)}"


def _trail(spark, d):
    judged = classify(_FLAGSHIP_PARTS.rows(spark, d, command=FLAGSHIP[1]))
    return audit.wrapper_rows(judged, F.col("ts"), F.lit("shell"), F.col("verdict"), F.col("command"), F.col("policy"), F.when(F.col("verdict") == "deny", 2).otherwise(0))


def audit_rows(spark, d):
    return _trail(spark, d).groupBy("event", "decision", "exit").agg(F.count("*").alias("n"), F.countDistinct("body_sha256").alias("bodies"))


AUDIT_ROWS = f"SELECT 'wrapper' AS event, decision, CASE decision WHEN 'deny' THEN 2 ELSE 0 END AS exit, count(*) AS n, count(DISTINCT command) AS bodies FROM {_FLAGSHIP_SQL} GROUP BY decision"


def audit_rollup(spark, d):
    trail = _trail(spark, d).withColumn("at", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    return audit.daily_counts(trail).select(F.col("day").cast("string").alias("day"), "event", "decision", "n")


AUDIT_ROLLUP = f"""SELECT CAST(day AS VARCHAR) AS day, event, decision, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, 'wrapper' AS event, decision FROM {_FLAGSHIP_SQL})
GROUP BY ROLLUP (day, event, decision)"""


def hook_audit(spark, d):
    """The cut at 4000 bytes, and nested strings and keys without terminal escapes."""
    e = spread(table(spark, d, "events")).withColumn("text", F.concat(F.lit("\x1b[1m"), "event_type", F.repeat(F.lit("é"), 2500)))
    e = e.withColumn("inputs", F.to_json(F.struct(F.struct(F.concat(F.lit("\x1b[2J"), "props").alias("a\x1b[1m b"), F.array("event_type").alias("list")).alias("nested"))))
    rows = audit.hook_rows(e, F.col("ts"), F.lit("PostToolUse"), F.col("text"), F.col("user_id").cast("string"), F.lit("/w"), F.col("inputs"))
    return rows.select("ts", "session", F.md5("tool").alias("tool_md5"), F.get_json_object("input", "$.nested['a b']").alias("nested"), F.get_json_object("input", "$.nested.list[0]").alias("listed"))


HOOK_AUDIT = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts, CAST(user_id AS VARCHAR) AS session, props AS nested, event_type AS listed,
md5(cut || '...[truncated ' || (strlen(t) - strlen(cut)) || ' bytes]') AS tool_md5
FROM (SELECT *, left(t, CAST(len(event_type) + (4000 - strlen(event_type)) // 2 AS INTEGER)) AS cut FROM (SELECT *, event_type || repeat('é', 2500) AS t FROM events))"""


def top_policies(spark, d):
    return _trail(spark, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


TOP_POLICIES = f"SELECT 'download_to_shell' AS reason, count(*) AS n FROM {_FLAGSHIP_SQL} WHERE decision = 'deny' HAVING count(*) > 0"


def collapse_report(spark, d):
    e = table(spark, d, "events").withColumn("command", F.concat(F.lit("/usr/bin/"), F.col("event_type"), F.lit(" --x")))
    return audit.collapse_suggestions(e)


def denials_by_hour(spark, d):
    out = classify(_FLAGSHIP_PARTS.rows(spark, d, command=FLAGSHIP[1])).groupBy(F.window("ts", "1 hour").alias("w"), "verdict").agg(F.count("*").alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "verdict", "n")


DENIALS = f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, decision AS verdict, count(*) AS n FROM {_FLAGSHIP_SQL} GROUP BY 1, 2"
SCRIPTS = Parts("events", NUMBER, SCRIPT)


def explain_rendering(spark, d):
    rows = SCRIPTS.rows(spark, d, code=f"«a» {URL}«b»")
    out = explain(rows, "shell", "code")
    return out.select("event_id", "verdict", F.get_json_object("json", "$.verdict").alias("in_json"), F.get_json_object("json", "$.reason").isNotNull().alias("has_reason"), "exit")


EXPLAIN = f"""SELECT event_id, v AS verdict, v AS in_json, v = 'deny' AS has_reason, CASE v WHEN 'deny' THEN 2 ELSE 0 END AS exit
FROM (SELECT *, CASE WHEN {BAD_SCRIPT} THEN 'deny' ELSE 'allow' END AS v FROM {SCRIPTS.sql()})"""

QUERIES: dict[str, Query] = {
    "command_verdicts": _verdicts(FLAGSHIP),
    **{f"policy_{o:02d}_{name}": _verdicts(RULES[o], {o}, Policy(git_hard_deny=o == 21)) for o, name, *_ in POLICIES},
    "unwrap_families": _verdicts(WRAPPED),
    "recursive_scripts": _verdicts(NESTED),
    "malformed_commands": _verdicts(MALFORMED),
    "shell_ir_shape": Query(shell_ir_shape, SHELL_IR),
    "dialect_front": Query(dialect_front, DIALECT_FRONT),
    "argv_gate": Query(argv_gate, ARGV_GATE),
    "event_decode": Query(event_decode, EVENT_DECODE),
    "explain_rendering": Query(explain_rendering, EXPLAIN),
    "audit_rows": Query(audit_rows, AUDIT_ROWS),
    "audit_rollup": Query(audit_rollup, AUDIT_ROLLUP),
    "hook_audit": Query(hook_audit, HOOK_AUDIT),
    "top_policies": Query(top_policies, TOP_POLICIES),
    "collapse_report": Query(collapse_report, f"SELECT event_type AS program, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > {3}"),
    "denials_by_hour": Query(denials_by_hour, DENIALS),
}
