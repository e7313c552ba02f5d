"""Nothing is lost or let through without a word: merges, loads, streams, reconciliation, rules, statements, names."""
import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import freshness, medallion, metrics, profile, quality, statements, textjoin, tools
from plumbline.plans import build, catalogue
from plumbline.session import scratch
from plumbline.sources import catalog, landing, sinks
from plumbline.streaming import landing as landing_stream
from tests.oracle import problems


def test_merge_keeps_columns_of_both_sides(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, old STRING")
    source = spark.createDataFrame([(2, "n")], "k INT, new STRING")
    assert rows(medallion.upsert(target, source, ["k"]), "k", "old", "new") == [(1, "a", None), (2, None, "n")]


def test_merge_folds_or_refuses_repeated_keys(spark, rows):
    target = spark.createDataFrame([(1, 0, "a")], "k INT, at INT, v STRING")
    source = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 1, "n"), (None, 1, "n")], "k INT, at INT, v STRING")
    assert rows(medallion.upsert(target, source.where("k = 1"), ["k"], newest="at"), "v") == [("y",)]
    with pytest.raises(Exception, match="repeats a key"):
        medallion.upsert(target, source, ["k"]).collect()
    assert medallion.upsert(target, source.where("k IS NULL"), ["k"]).count() == 3
    with pytest.raises(Exception, match="repeats a key"):
        sinks.merge_into(spark, scratch(spark, "new"), source, ["k"], buckets=2)


def test_stream_reads_by_header(spark, rows):
    root = scratch(spark, "headers")
    spark.createDataFrame([("2", "1", "3")], "b STRING, a STRING, c STRING").coalesce(1).write.option("header", True).csv(f"{root}/in")
    spark.createDataFrame([("4",)], "a STRING").coalesce(1).write.mode("append").option("header", True).csv(f"{root}/in")
    landing_stream.stream_bronze(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", ["a", "b"], "run")
    assert rows(spark.read.parquet(f"{root}/out"), "a", "b", "c") == [("1", "2", "3"), ("4", None, None)]


def test_blocked_files_end_a_load(spark):
    root = scratch(spark, "blocked")
    spark.createDataFrame([("1",)], "a STRING").coalesce(1).write.option("header", True).csv(f"{root}/in")
    args = (spark, f"{root}/in", "s", f"{root}/table", f"{root}/log", "run")
    with pytest.raises(landing.BlockedFiles, match="lacks b"):
        landing.load_new_files(*args, columns=["a", "b", "_batch_id"])
    assert sinks.table_at(spark, f"{root}/table") is None
    assert landing.load_new_files(*args, columns=["a"]).first().rows_loaded == 1


def test_repeated_groups_are_reported(spark, rows):
    left = spark.createDataFrame([("g", 5.0), ("h", 1.0)], "k STRING, value DOUBLE")
    right = spark.createDataFrame([("g", 1.0), ("g", 5.0), ("h", 1.0)], "k STRING, value DOUBLE")
    assert rows(metrics.reconcile(left, right, ["k"]), "k", "problem") == [("g", "group repeated"), ("h", None)]
    assert rows(metrics.compare_keyed(left, right, ["k"], ["value"]), "k", "problem") == [("g", "group repeated")]


def test_value_lists_are_never_cut(spark):
    with pytest.raises(ValueError):
        profile.value_lists(spark.range(1), ["id"], most=60)
    assert profile.value_lists(spark.range(500), ["id"]).count() == 0


def test_sketch_keeps_unique_columns_out_of_the_shuffle(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("few"))
    text = profile.value_lists(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "5000" in text and "id AS column_name" not in text and "few" in text


def test_composite_keys_of_rules(spark, rows):
    columns = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int")], "table_name STRING, column_name STRING, data_type STRING")
    schema = "rule_id STRING, table_name STRING, rule_type STRING, column_name STRING, n_values INT, min STRING, max STRING, name STRING, expression STRING, target STRING"
    rules = spark.createDataFrame([(i, "t", "unique", c, 0, None, None, None, None, None) for i, c in (("ok", "a, b"), ("bad", "a, z, y"), ("one", "q"))], schema)
    assert rows(quality.rule_problems(rules, columns)) == [("bad", "no such column: y, z"), ("one", "no such column")]


def test_inventory_feeds_the_layers(spark):
    now = dt.datetime(2024, 1, 2)
    changes = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "table_name STRING, last_data_change TIMESTAMP")
    found = catalog.inventory({"a": spark.range(2), "v": spark.range(0)}, {"a": "gold", "v": "gold"}, kinds={"v": "view"}, changes=changes)
    got = freshness.assess_layers(found.unionByName(catalog.unreadable(spark, "gold", "x", "e" * 500)), F.lit(now)).first()
    assert (got.assets, got.unreadable, got.empty, got.age_hours) == (3, 1, 1, 24.0)
    assert len(catalog.unreadable(spark, "gold", "x", "e" * 500).first().error) == 500


def test_freshness_tells_unreadable_tables(spark, rows):
    changes = spark.createDataFrame([], "table_name STRING, operation STRING, changed_at TIMESTAMP")
    limits = spark.createDataFrame([("a", "l", 1.0), ("b", "l", 1.0)], "table_name STRING, layer STRING, max_hours DOUBLE")
    errors = spark.createDataFrame([("b", "denied")], "table_name STRING, error STRING")
    found = freshness.freshness(changes, limits, F.current_timestamp(), errors=errors)
    assert rows(quality.stale_tables(found)) == [("a", "last changed never hours ago (limit 1.0)"), ("b", "denied")]


def test_short_names_in_statements(spark, rows):
    q = spark.createDataFrame([(1, "SELECT * FROM payroll"), (2, "WITH c AS (SELECT 1 FROM a.b.c), d AS (SELECT 2) SELECT * FROM c JOIN d JOIN hr.people"),
                               (3, "SELECT EXTRACT(day FROM ts), 'from x' FROM a.b.c WHERE u IS NOT DISTINCT FROM v"), (4, "SELECT * FROM range(3)")], "query_id INT, sql STRING")
    assert rows(tools.outside_reads(q, spark.createDataFrame([("a.b.c",)], "full_name STRING"))) == [(1, "payroll"), (2, "hr.people")]


def test_repeated_statements_are_walked_once(spark, rows, monkeypatch):
    walked, walk = [], statements.with_reads
    monkeypatch.setattr(statements, "with_reads", lambda df, sql: walked.append(df.count()) or walk(df, sql))
    q = spark.range(500).select(F.col("id").alias("query_id"), F.when(F.col("id") < 400, "SELECT * FROM a.b.c, payroll").when(F.col("id") < 499, "SELECT 1 FROM x.y.z").alias("sql"))
    got = tools.outside_reads(q.union(q.where("query_id = 7")), spark.createDataFrame([("a.b.c",)], "full_name STRING"))
    assert walked == [2]
    assert rows(got.groupBy("object").count()) == [("payroll", 401), ("x.y.z", 99)]


def test_headers_are_found_without_shuffling_records(spark, rows):
    root = scratch(spark, "landing")
    spark.range(100).selectExpr("id", "'a, b' AS note").repartition(3).write.option("header", True).csv(root)
    headers = landing.file_headers(landing.csv_records(spark, root, 4))
    assert "BroadcastHashJoin" in headers._jdf.queryExecution().executedPlan().toString() and "Exchange hashpartitioning" not in headers._jdf.queryExecution().executedPlan().toString()
    assert rows(headers.groupBy("names").agg(F.sum("rows").alias("n"), F.count("*").alias("files"))) == [(["id", "note"], 100, 3)]


def test_retention_drops_run_folders_only(spark, rows):
    root = scratch(spark, "logs")
    for day in (1, 20):
        df = spark.createDataFrame([(f"r{day}", dt.datetime(2024, 1, day), None)], "check_run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP")
        df.write.parquet(f"{root}/dq_runs/run=r-{day}")
    kept = spark.read.parquet(f"{root}/dq_runs/run=r-20").inputFiles()
    build.drop_old(spark, root, 10, dt.datetime(2024, 1, 21))
    assert rows(build.read_log(spark, root, "dq_runs"), "check_run_id") == [("r20",)]
    assert spark.read.parquet(f"{root}/dq_runs/run=r-20").inputFiles() == kept


def test_names_of_one_form_give_no_candidates(spark):
    names = spark.range(2000).select(F.format_string("customer#%09d", "id").alias("n"))
    found = textjoin.contains_pairs(names, "n", names, "n")
    assert found.count() == 2000
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in text and "NestedLoop" not in text


def test_a_zero_with_a_sign_is_no_balance_below_zero(spark, folder):
    here = scratch(spark, "tables")
    odd = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.01), (4, -1e-9), (5, None), (6, 2.5e6)], "c_custkey BIGINT, c_acctbal DOUBLE")
    (spark.read.parquet(f"{folder}/customer.parquet").drop("c_custkey", "c_acctbal").limit(1).crossJoin(odd).write.parquet(f"{here}/customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{here.removeprefix('file:')}/customer.parquet/*.parquet'")
    got = catalogue.queries()["cast_failures"](spark, here)
    assert problems(got, con, catalogue.oracles()["cast_failures"]) == []
    assert {r.column_name: r.failures for r in got.collect()}["balance"] == 2
