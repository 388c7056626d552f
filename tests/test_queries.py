"""Every registered query against its SQL, on the smallest driver tables (skipped where they are absent)."""

import glob
import hashlib
import os
import re
import unicodedata

import duckdb
import pytest

from tidewall.functions import text as T
from tidewall.plans import common, registry, text_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    found = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    assert len(found.columns)
    if sql:
        assert rows(found) == rows(db.execute(sql).fetchdf())


def test_prose_is_cut_by_bytes(spark, db):
    # the cap's branch runs, and the start of a long text stays
    long = db.execute("SELECT count(*) FROM conversations WHERE strlen(text) > 400").fetchone()[0]
    found = registry.queries()["prose_escape"](spark, DATA).toPandas()["prose"]
    assert long and found.str.endswith("…").sum() >= long and found.map(lambda x: len(x.encode())).max() <= 256 + len("…".encode())


def test_whole_texts_against_brute_force(spark, tmp_path):
    long = "Plain words, ﬁve of them. " * 20_000
    texts = [long, None, "", "а\u200bＢ ① x", "short", *(["hot text"] * 40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r[0]: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    fold = str.maketrans(T._FOLD_FROM, T._FOLD_TO)
    hidden = re.compile("[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\u180e]")
    normal, clean = run("normalize_scan"), run("secret_redact_overlap")
    for i, t in enumerate(texts):
        x = (t or "") + text_queries.NORMAL[i % len(text_queries.NORMAL)][0]
        assert normal[i]["normal_md5"] == md5(unicodedata.normalize("NFKC", hidden.sub("", x).translate(fold)))
        assert clean[i]["clean_md5"] == md5(f"{t or ''} {text_queries.OVERLAPS[i % len(text_queries.OVERLAPS)][1]}")


def test_rules_have_commands_on_both_sides(spark, db):
    # each rule of a policy denies some of its commands and allows others
    for name, sql in registry.oracle_sql().items():
        if name.startswith("policy_") or name in ("malformed_commands", "unwrap_families", "recursive_scripts"):
            found = dict(db.execute(f"SELECT verdict, count(*) FROM ({sql}) GROUP BY verdict").fetchall())
            assert found.get("deny", 0) > 20 and found.get("allow", 0) > 20, name


def test_a_large_row_group_is_dealt_to_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(5000).coalesce(1).selectExpr("id as event_id", "timestamp'2024-01-02 03:04:05' as ts", "id as user_id", "'view' as event_type", "concat('p', id) as props").write.parquet(str(tmp_path / "events.parquet"))
    events = common.table(spark, str(tmp_path), "events")
    dealt = common.spread(events)
    assert dealt.rdd.getNumPartitions() == 2 * cores and sorted(dealt.collect()) == sorted(events.collect())
    assert common.spread(events.limit(100)).rdd.getNumPartitions() == 1
    for name in ("hook_audit", "sql_text_stages"):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_sql_text_lexes_each_command_once(spark):
    plan = registry.queries()["sql_text_stages"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_shell") == 1 or plan.count("EvalPythonUDTF") == 1
