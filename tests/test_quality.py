"""Rules on nulls, empty tables and repeated keys; fused against unfused; quarantine and the run log."""
import datetime as dt
import json

import pytest

from plumbline.operators import quality
from plumbline.plans import catalogue
from plumbline.specs import Rule
from pyspark.sql import functions as F


@pytest.fixture
def tables(spark):
    data = [(1, "a", 5, 10), (2, None, 15, 11), (None, "z", None, None), (None, "a", -1, 99), (3, "b", 7, 10)]
    return {"m.t": spark.createDataFrame(data, "id INT, kind STRING, n INT, parent INT"),
            "m.p": spark.createDataFrame([(10,), (10,), (11,), (None,)], "k INT"),
            "m.e": spark.createDataFrame([], "id INT, kind STRING, n INT, parent INT")}


def rule_set(table):
    return [Rule(table, "not_null", ("id",)), Rule(table, "unique", ("id",)), Rule(table, "accepted_values", ("kind",), values=("a", "b")),
            Rule(table, "range", ("n",), min=0, max=10), Rule(table, "expression", name="small", expression="n < 100"),
            Rule(table, "references", ("parent",), to="m.p.k")]


def counts(df):
    return {r.rule_id.rsplit(".", 1)[1]: (r.total_rows, r.failed_rows, r.passed) for r in df.collect()}


def test_nulls_per_rule_type(tables):
    got = counts(quality.evaluate(tables, rule_set("m.t")))
    assert got == {"not_null_id": (5, 2, False), "unique_id": (5, 2, False), "accepted_values_kind": (5, 1, False), "range_n": (5, 2, False),
                   "small": (5, 1, False), "references_parent": (5, 1, False)}


def test_empty_table_passes_all_but_row_count(tables):
    rules = [*rule_set("m.e"), Rule("m.e", "row_count", min=1)]
    got = counts(quality.evaluate(tables, rules))
    assert got.pop("row_count") == (0, 1, False)
    assert set(got.values()) == {(0, 0, True)}


def test_fused_equals_unfused(tables, rows):
    rules = [*rule_set("m.t"), *rule_set("m.e"), Rule("m.t", "row_count", max=4)]
    assert rows(quality.evaluate(tables, rules)) == rows(quality.evaluate(tables, rules, fused=False))


@pytest.mark.parametrize("tolerance,passed", [(None, False), ("0.28", False), ("0.29", True)])
def test_tolerance_is_exact(spark, tolerance, passed):
    # 29 of 100 rows fail; 100 * 0.29 is below 29 in binary floating point.
    df = spark.range(100).select((F.col("id") >= 29).alias("ok"))
    got = quality.evaluate({"m.t": df}, [Rule("m.t", "expression", name="ok", expression="ok", tolerance=tolerance)]).first()
    assert (got.failed_rows, got.passed) == (29, passed)


def test_bad_rows_agree_with_counts(tables):
    rules = rule_set("m.t")
    failed = {r.rule_id: r.failed_rows for r in quality.evaluate(tables, rules).collect()}
    assert {r.id: quality.bad_rows(tables, r).count() for r in rules} == failed


def test_quarantine_hides_before_json_and_is_ordered(tables, rows):
    rules = [Rule("m.t", "range", ("n",), max=6), Rule("m.t", "unique", ("id",))]
    got = quality.quarantine(tables, rules, {"m.t": ("id",)}, {"m.t": ("kind", "parent")}, rows=1)
    assert rows(got, "rule_id", "row_key", "row_json") == [("m.t.range_n", '{"id":2}', '{"id":2,"n":15}'), ("m.t.unique_id", "{}", '{"n":-1}')]


def test_quarantine_ranks_in_groups(spark, rows, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 1500).alias("id"), F.col("id").alias("v"))
    rules = [Rule("m.t", "range", ("v",), max=9), Rule("m.t", "not_null", ("id",))]
    many = rows(quality.quarantine({"m.t": df}, rules, {"m.t": ("id",)}, rows=1200), "row_key")
    assert len(many) == 1200 and len(set(many)) == 605  # two rows of a key, but for the ten that pass
    monkeypatch.setattr(quality, "GROUPS", 1)
    assert rows(quality.quarantine({"m.t": df}, rules, {"m.t": ("id",)}, rows=1200), "row_key") == many


def test_a_run_that_never_finished(spark, rows):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    runs = spark.createDataFrame([("a", t(1), t(2)), ("b", t(3), None)], "check_run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP")
    results = spark.createDataFrame([("a", "r1", True), ("b", "r1", False)], "check_run_id STRING, rule_id STRING, passed BOOLEAN")
    assert rows(quality.latest(results, runs), "check_run_id") == [("a",)]
    assert rows(quality.stamped(results.drop("check_run_id"), runs, F.current_timestamp()), "check_run_id") == [("b",), ("b",)]
    done = quality.finish(runs, F.lit(t(9)))
    assert rows(quality.latest(results, done), "check_run_id") == [("b",)]
    severe = results.withColumn("severity", F.lit("critical"))
    summary = quality.run_summary(runs.union(spark.createDataFrame([("c", t(4), t(5))], runs.schema)), severe)
    assert rows(summary, "check_run_id", "rules", "failing") == [("a", 1, 0), ("b", 1, 1), ("c", 0, 0)]


def test_no_finished_run_gives_no_latest(spark):
    runs = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), None)], "check_run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP")
    results = spark.createDataFrame([("a", "r1")], "check_run_id STRING, rule_id STRING")
    assert quality.latest(results, runs).count() == 0
    assert quality.missing_results(results.select("rule_id"), results, runs).count() == 1
    assert quality.run_too_old(runs, F.current_timestamp()).first().older_than_delivery


def test_alerts_fire_only_with_rows(spark, rows):
    results = spark.createDataFrame([("r", "critical", True), ("s", "warning", False)], "rule_id STRING, severity STRING, passed BOOLEAN")
    fresh = spark.createDataFrame([("t", False), ("u", None)], "table_name STRING, stale BOOLEAN")
    none = spark.createDataFrame([], "alert STRING")
    assert rows(quality.alerts(results, fresh, none)) == [("critical_failures", 0, False), ("stale_data", 0, False)]
    test_row = spark.createDataFrame([("stale_data",)], "alert STRING")
    assert rows(quality.alerts(results, fresh, test_row)) == [("critical_failures", 0, False), ("stale_data", 1, True)]


def test_rule_ids_and_unknown_type():
    assert Rule("main.s.t", "expression", name="Shipped within ordered", expression="a <= b").id == "main.s.t.shipped_within_ordered"
    with pytest.raises(ValueError):
        Rule("t", "guess")


@pytest.mark.parametrize("two_scans", [False, True])
def test_quarantine_keeps_the_first_rows_of_a_rule_whatever_its_keys(spark, two_scans):
    rule = Rule("t", "range", ("v",), max=10)
    spread = [(k * 7 % 1009, k) for k in range(1009)]
    cases = {"spread": spread, "one key": [(5, k) for k in range(300)], "null keys": [(None, k) for k in range(40)] + spread,
             "few": [(k, 11 + k) for k in range(3)], "none": []}
    for name, rows in cases.items():
        df = spark.createDataFrame(rows, "k INT, v INT").repartition(4)
        failing = sorted(((k, v) for k, v in rows if v > 10), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for keys in (("k",), ()):
            want = failing if keys else sorted(failing, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            got = quality.quarantine({"t": df}, [rule], {"t": keys}, rows=20, two_scans=two_scans).collect()
            want = [json.dumps({c: x for c, x in zip("kv", r) if x is not None}, separators=(",", ":")) for r in want[:20]]
            assert sorted(r.row_json for r in got) == sorted(want), name


def test_quarantine_reads_up_to_the_last_key_that_the_results_give(spark, rows):
    """The aggregates of the results name the last key of every rule; joins of quarantine meet only rows up to it, and get the same rows."""
    t = spark.range(6000).selectExpr("nullif(id, 7) AS k", "CAST(id % 3000 AS INT) AS twin", "CAST(id % 2000 AS INT) AS parent", "CAST(id % 5 AS INT) AS v").repartition(4)
    tables = {"t": t, "p": spark.range(500).selectExpr("CAST(id AS INT) AS k"), "odd": t.select(F.col("v").cast("string").alias("k"), "v")}
    rules = [Rule("t", "unique", ("twin",)), Rule("t", "unique", ("k",)), Rule("t", "references", ("parent",), to="p.k"), Rule("t", "range", ("v",), max=2),
             Rule("t", "not_null", ("k",)), Rule("t", "row_count", min=1), Rule("odd", "range", ("v",), max=3)]
    key = {"t": ["k"], "odd": ["k"]}
    found = quality.evaluate(tables, rules, keys=key, rows=20)
    assert rows(found.drop("last_key")) == rows(quality.evaluate(tables, rules))
    assert rows(quality.evaluate(tables, rules, fused=False, keys=key, rows=20)) == rows(found)
    last = {r.rule_id: r.last_key for r in found.collect()}
    assert all(last[r] is not None and last[r] < 3000 for r in ("t.unique_twin", "t.references_parent", "t.range_v"))
    assert [last[r] for r in ("t.unique_k", "t.not_null_k", "t.row_count", "odd.range_v")] == [None] * 4
    plain = rows(quality.quarantine(tables, rules, key, rows=20))
    got = quality.quarantine(tables, rules, key, rows=20, found=found)
    assert rows(got) == plain == rows(quality.quarantine(tables, rules, key, rows=20, two_scans=True)) and len(plain) == 81
    none = quality.evaluate(tables, rules[1:2], keys=key, rows=20)
    assert quality.quarantine(tables, rules[1:2], key, rows=20, found=none).collect() == []


def test_quarantine_scans_hand_on_no_rows_beyond_the_last_key(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = catalogue.queries()["dq_quarantine"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    lines = [line for line in text.split("\n") if "FileScan" in line and "l_linenumber" in line]
    assert sum("LessThanOrEqual(l_orderkey," in line for line in lines) >= 3
