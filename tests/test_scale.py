"""What must hold on large tables: plans without quadratic or single-task operators, and a key that holds a third of all rows."""
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import diff, keys, medallion, metrics, quality, salting, statements, textjoin
from plumbline.plans import catalogue, kpis
from plumbline.specs import Rule
from tests.plan_scan import found_in


def test_the_scan_of_plans_finds_what_it_looks_for(spark):
    from pyspark.sql import Window
    df = spark.range(3)
    assert found_in(df.crossJoin(df.toDF("b"))) and found_in(df.orderBy(F.desc("id")))
    assert found_in(df.withColumn("r", F.row_number().over(Window.orderBy("id")))) and found_in(df.select(F.udf(lambda x: x)("id")))
    assert found_in(df.groupBy("id").count()) == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["table_diff", "version_diff", "incremental_plan", "definition_diff", "tool_test", "reconcile_measure"])
def test_versions_are_folded_without_sorting_rows(name, spark, folder):
    assert "SortAggregate" not in plan_of(catalogue.queries()[name](spark, folder))


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan_of(catalogue.queries()["gold_sales_daily"](spark, folder))
    assert "Not(EqualTo(o_orderstatus,P))" in text
    assert "l_tax" not in text and "o_totalprice" not in text and "l_shipdate" not in text


def test_a_rule_set_reads_each_table_once_for_its_row_rules(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet")
    rules = [Rule("t", "not_null", (c,)) for c in df.columns] + [Rule("t", "row_count", min=1)]
    fused, single = quality.evaluate({"t": df}, rules), quality.evaluate({"t": df}, rules, fused=False)
    assert plan_of(fused).count("FileScan") == 1 and plan_of(single).count("FileScan") == len(rules)


def test_metric_query_reads_only_the_tables_its_fields_name(spark, folder):
    from plumbline.sources.tables import Tables
    t = Tables(spark, folder)
    text = plan_of(metrics.query(kpis.CUSTOMERS, kpis.sources(t), ["order_month"], ["revenue"]))
    assert text.count("FileScan") == 1 and "c_custkey" not in text


@pytest.fixture(scope="module")
def hot(spark):
    """Every third row has key 0; other keys have a handful."""
    return spark.range(0, 90000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20000 + 1).alias("k"), F.col("id").alias("v"))


def test_windows_of_texts_are_not_broadcast(spark):
    """A text gives hundreds of windows, which estimates count as one row; few needles are broadcast, many are merged with them."""
    texts = spark.range(3000).select(F.concat(F.lit("select a from b where c = "), "id").alias("t"))
    few = spark.createDataFrame([("c = 17",), ("from b",), ("nowhere",)], "n STRING")
    found = textjoin.contains_pairs(few, "n", texts, "t")
    assert found.groupBy("needle").count().where("needle = 'from b'").first()["count"] == 3000
    broadcast = [part.split("\n")[:6] for part in plan_of(found).split("BroadcastExchange")[1:]]
    assert len(broadcast) == 1 and any("FileScan" in line for line in broadcast[0]) and "Generate" not in str(broadcast[0])
    assert "Broadcast" not in plan_of(textjoin.contains_pairs(spark.range(20000).select(F.col("id").cast("string").alias("n")), "n", texts, "t"))


def test_lookups_broadcast_only_what_is_counted_and_few(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "FEW", 0, raising=False)
    for name in ("ontology_lookup_bulk", "lookup_failures", "measure_coverage"):
        text = plan_of(catalogue.queries()[name](spark, folder))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_definitions_read_a_shared_text_once_and_broadcast_no_definitions(spark, folder, monkeypatch):
    read, names = [], statements.with_columns_named
    monkeypatch.setattr(statements, "with_columns_named", lambda df, expr: read.append(df.count()) or names(df, expr))
    text = plan_of(catalogue.queries()["definition_problems"](spark, folder))
    assert read and read[0] <= 5 and text.count("SortMergeJoin") >= 3


def test_hot_keys_are_folded_before_the_shuffle(spark, hot):
    for df in (medallion.latest_per_key(hot, ["k"], "v"), keys.pk_holds(hot, ["k"]), diff.fingerprint(hot, ["k"], "v", ["v"]),
               keys.fk_orphans(hot, "k", hot.where("k > 5"), "k"), quality.evaluate({"t": hot}, [Rule("t", "unique", ("k",))])):
        text = plan_of(df)
        assert "partial_" in text and "Window" not in text


def test_hot_keys_give_whole_results(spark, hot):
    n_hot = 30000
    assert medallion.latest_per_key(hot, ["k"], "v").where("k = 0").first().v == 89997
    got = quality.evaluate({"t": hot, "p": hot.where("k > 0")}, [Rule("t", "unique", ("k",)), Rule("t", "references", ("k",), to="p.k")]).collect()
    assert [r.failed_rows for r in got] == [90000 - hot.groupBy("k").count().where("count = 1").count(), n_hot]
    many = quality.quarantine({"t": hot}, [Rule("t", "range", ("k",), min=1), Rule("t", "unique", ("k",))], {"t": ("v",)}, rows=100)
    assert {r.rule_id: r["count"] for r in many.groupBy("rule_id").count().collect()} == {"t.range_k": 100, "t.unique_k": 100}
    assert many.where("rule_id = 't.range_k'").agg(F.max(F.get_json_object("row_key", "$.v").cast("int"))).first()[0] == 297


def test_quarantine_keeps_only_the_first_rows_of_each_task(hot):
    rules = [Rule("t", "range", ("k",), min=1), Rule("t", "expression", name="odd", expression="v % 2 = 1")]
    text = plan_of(quality.quarantine({"t": hot}, rules, {"t": ("v",)}))
    assert text.count("WindowGroupLimit") >= 2 and text.count("Range (") == 1


def test_a_hot_role_is_dealt_over_shares(spark):
    """One role holds nine of ten principals; no share of it takes more than a little above the rows one task may take."""
    members = spark.range(40000).select(F.when(F.col("id") % 10 < 9, "all").otherwise(F.concat(F.lit("r"), F.col("id") % 500)).alias("role"),
                                        F.concat(F.lit("p"), "id").alias("principal"))
    scopes = spark.createDataFrame([("all", "s1"), ("all", "s2"), ("r9", "s3"), (None, "s4")], "role STRING, securable STRING")
    joined = salting.salted_join(members, scopes, "role", F.col("principal"), least=4000)
    assert joined.count() == 2 * 36000 + 80 and joined.distinct().count() == joined.count()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, members.join(scopes, "role").collect()))
    assert [tuple(r) for r in salting.frequent(members, "role", least=4000).collect()] == [("all", 9)]
    assert [tuple(r) for r in salting.frequent(members, "role", least=10, most=1).collect()] == [("all", 3600)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        shares = salting.salted_join(members, scopes, "role", F.col("principal"), least=4000).groupBy(F.spark_partition_id()).count()
        assert shares.agg(F.max("count")).first()[0] < 2 * 36000 / 2
        text = plan_of(salting.salted_join(members, scopes, "role", F.col("principal"), least=4000))
        assert "NestedLoop" not in text and "Cartesian" not in text
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_of_differences_are_not_broadcast(spark, folder):
    """Small files may hold many rows; what is as long as a side goes through no driver, even where its estimate is small."""
    assert "BroadcastHashJoin" not in plan_of(catalogue.queries()["definition_diff"](spark, folder))
