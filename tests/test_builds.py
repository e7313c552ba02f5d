"""Landing, silver, gold, profiles, keys and differences on small frames."""
import datetime as dt

import pytest

from plumbline.operators import diff, freshness, keys, medallion, profile, sketches
from plumbline.session import scratch, work_dir
from plumbline.sources import catalog, landing, sinks, versions
from pyspark.sql import functions as F


def test_typed_counts_what_cannot_be_read(spark, rows):
    df = spark.createDataFrame([("1", "2.50", "A@X"), ("x", None, "b"), (None, "1e", None)], "id STRING, price STRING, email STRING")
    columns = {"id": ("id", "bigint"), "price": ("price", "decimal(10,2)"), "email": ("lower(email)", "string")}
    assert rows(medallion.cast_failures(df, columns)) == [("email", 0), ("id", 1), ("price", 1)]
    assert medallion.typed(df, columns).first().email == "a@x"


def test_latest_per_key_breaks_ties_and_groups_null_keys(spark, rows):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, "b"), (1, t, "a"), (None, t, "n"), (None, None, "m")], "k INT, at TIMESTAMP, v STRING")
    assert rows(medallion.latest_per_key(df, ["k"], "at", ["v"]), "k", "v") == [(1, "b"), (None, "n")]


def test_upsert_is_idempotent_and_keeps_null_keys(spark, rows):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k INT, v STRING")
    source = spark.createDataFrame([(1, "x"), (2, "y")], "k INT, v STRING")
    once = medallion.upsert(target, source, ["k"])
    assert rows(once) == [(1, "x"), (2, "y"), (None, "n")]
    assert rows(medallion.upsert(once, source, ["k"])) == rows(once)


def test_null_keys_meet_null_keys_in_a_merge(spark, rows):
    target = spark.createDataFrame([(1, 1, "a"), (1, None, "n"), (2, None, "m"), (None, None, "z")], "k INT, l INT, v STRING")
    source = spark.createDataFrame([(1, None, "x"), (None, None, "y"), (3, None, "p"), (3, None, "q")], "k INT, l INT, v STRING")
    once = medallion.upsert(target, source, ["k", "l"])
    assert rows(once) == sorted([(1, 1, "a"), (2, None, "m"), (1, None, "x"), (None, None, "y"), (3, None, "p"), (3, None, "q")], key=lambda r: [(v is None, str(v)) for v in r])
    assert rows(medallion.upsert(once, source, ["k", "l"])) == rows(once)
    with pytest.raises(Exception, match="repeats a key"):
        medallion.upsert(target, spark.createDataFrame([(1, 1, "x"), (1, 1, "y")], "k INT, l INT, v STRING"), ["k", "l"]).collect()
    assert "Window" not in once._jdf.queryExecution().executedPlan().toString()


def test_a_merged_table_keeps_its_number_of_buckets(spark, rows):
    path, df = scratch(spark, "merged"), spark.range(40).select("id", F.lit("a").alias("v"))
    sinks.merge_into(spark, path, df, ["id"], buckets=8)
    for wrong in ({"buckets": 4}, {"keys": ["v"]}):
        with pytest.raises(ValueError, match="split by"):
            sinks.merge_into(spark, path, df, **{"keys": ["id"], **wrong})
    sinks.merge_into(spark, path, df.withColumn("v", F.lit("b")), ["id"])
    assert rows(spark.read.parquet(path), "id", "v") == sorted([(i, "b") for i in range(40)], key=lambda r: [(False, str(v)) for v in r])
    df.write.parquet(other := scratch(spark, "merged"))
    with pytest.raises(ValueError, match="not written by a merge"):
        sinks.merge_into(spark, other, df, ["id"])


def test_a_merge_does_not_shuffle_a_bucketed_table(spark, rows):
    name, path, df = "merged_in_test", scratch(spark, "merged"), spark.range(100).select("id", F.lit("a").alias("v"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in range(1, 5):
            sinks.merge_table(spark, name, df.where(F.col("id") >= 100 - n).withColumn("v", F.lit(f"v{n}")) if n > 1 else df, ["id"], buckets=8, path=path)
            assert spark.table(name).count() == 100
        with pytest.raises(ValueError, match="into 8 buckets"):
            sinks.merge_table(spark, name, df, ["id"], buckets=4, path=path)
        assert rows(spark.table(name).where("id >= 96"), "id", "v") == [(96, "v4"), (97, "v4"), (98, "v4"), (99, "v4")]
        assert not spark.catalog.tableExists(f"{name}_v2") and spark.catalog.tableExists(f"{name}_v3")
        source = df.where("id < 9").repartition(8, "id")
        plan = medallion.upsert(spark.table(f"{name}_v4"), source, ["id"])._jdf.queryExecution().executedPlan().toString()
        joined = plan[plan.index("SortMergeJoin [id"):]
        joined = joined[:joined.index("Range")]  # from the join down to the source
        assert "FileScan" in joined and "Exchange" not in joined[:joined.index("FileScan")] and "Bucketed: true" in joined
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP VIEW IF EXISTS {name}")
        for n in range(1, 6):
            spark.sql(f"DROP TABLE IF EXISTS {name}_v{n}")


def test_equal_buckets_of_versions_are_not_read(spark, rows):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("name "), "id")).alias("name"), (F.col("id") % 5).alias("n"))
    new = df.where("id <> 3").withColumn("name", F.when(F.col("id") == 10, "other").otherwise(F.col("name"))).unionByName(df.where("id = 20").withColumn("id", F.lit(-1).cast("long")))
    paths = [scratch(spark, "version") for _ in range(3)]
    for frame, path in zip((df, df.repartition(7), new), paths):
        versions.write_version(frame, path, ["id"], buckets=32)
    assert versions.changed_buckets(spark, paths[0], paths[1], ["id"]) == [] and versions.version_diff(spark, *paths[:2], ["id"], ["name", "n"]).count() == 0
    changed = versions.changed_buckets(spark, paths[0], paths[2], ["id"])
    found = versions.version_diff(spark, paths[0], paths[2], ["id"], ["name", "n"])
    assert rows(found, "id", "problem") == [(-1, "extra"), (10, "changed"), (3, "missing")]
    part = versions.read_buckets(spark, paths[0], changed)
    assert 1 <= len(changed) <= 3 and {r["_bucket"] for r in part.collect()} == set(changed)
    scan = part._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == len(changed)
    moved = spark.createDataFrame([(1, None, "a")], "id LONG, x STRING, y STRING")
    for frame, path in zip((moved, moved.select("id", F.col("y").alias("x"), F.col("x").alias("y"))), swapped := [scratch(spark, "version") for _ in range(2)]):
        versions.write_version(frame, path, ["id"], buckets=2)
    assert len(versions.changed_buckets(spark, *swapped, ["id"])) == 1  # a null that changed places with a value
    versions.write_version(df, other := scratch(spark, "version"), ["id"], buckets=16)
    for pair in ((paths[0], other), (paths[0], scratch(spark, "nothing"))):
        with pytest.raises(ValueError):
            versions.changed_buckets(spark, *pair, ["id"])


def test_customers_without_orders_stay(spark, rows):
    customer = spark.createDataFrame([(1, "A", "s", "r"), (2, "B", "s", "r")], "customer_id INT, customer_name STRING, segment STRING, region_code STRING")
    region = spark.createDataFrame([("r", "R")], "region_code STRING, region_name STRING")
    orders = spark.createDataFrame([(1, 2, dt.date(2024, 1, 1), 2, 5.0, "cancelled")], "order_id INT, customer_id INT, order_date DATE, quantity INT, unit_price DOUBLE, status STRING")
    got = medallion.customer_view(customer, region, orders)
    assert rows(got, "customer_id", "lifetime_orders", "lifetime_revenue", "last_order_date") == [(1, 0, 0.0, None), (2, 0, 0.0, None)]


def test_marts_of_the_declared_silver_schema(spark, rows):
    day = dt.date(2024, 1, 1)
    product = spark.createDataFrame([(1, "P", "C")], "product_id INT, product_name STRING, category STRING")
    region = spark.createDataFrame([("r", "R")], "region_code STRING, region_name STRING")
    orders = spark.createDataFrame([(1, 1, day, 2, 3, "r", "shipped"), (2, 1, day, 1, 3, "r", "cancelled")],
                                   "order_id INT, product_id INT, order_date DATE, quantity INT, unit_price INT, region_code STRING, status STRING")
    shipment = spark.createDataFrame([(1, day, 2, 1), (2, day, 0, 0)], "order_id INT, ship_date DATE, units_ordered INT, units_shipped INT")
    returns = spark.createDataFrame([(1, day, 1, "damaged")], "order_id INT, return_date DATE, units_returned INT, reason STRING")
    assert rows(medallion.sales_mart(orders, product, region), "orders", "units", "revenue") == [(1, 2, 6)]
    assert rows(medallion.fill_mart(shipment, orders, product, region), "units_ordered", "fill_rate") == [(2, 0.5)]
    assert rows(medallion.returns_mart(returns, orders, product, region), "reason", "returns", "returned_value") == [("damaged", 1, 3)]
    none = medallion.fill_mart(shipment.where("order_id = 2"), orders, product, region)
    assert none.first().fill_rate is None


def test_landing_loads_each_file_once_and_widens(spark, rows):
    root = scratch(spark, "landing")
    args = (f"{root}/in", "s", f"{root}/table", f"{root}/log")
    spark.createDataFrame([("1", "a")], "id STRING, v STRING").coalesce(1).write.option("header", True).csv(f"{root}/in/one")
    files = landing.load_new_files(spark, f"{root}/in/one", *args[1:], "r1")
    assert rows(files, "source", "rows_loaded") == [("s", 1)]
    assert landing.load_new_files(spark, f"{root}/in/one", *args[1:], "r2").count() == 0
    spark.createDataFrame([("2", "b", "new")], "id STRING, v STRING, w STRING").coalesce(1).write.option("header", True).csv(f"{root}/in/two")
    landing.load_new_files(spark, f"{root}/in/two", *args[1:], "r3")
    landing.load_new_files(spark, f"{root}/in/two", *args[1:], "r3")
    assert rows(landing.bronze(spark, f"{root}/table", f"{root}/log"), "id", "v", "w") == [("1", "a", None), ("2", "b", "new")]


def test_files_with_other_headers_meet_by_name(spark, rows):
    root = scratch(spark, "landing with space")
    spark.createDataFrame([("1", "a")], "id STRING, v STRING").coalesce(1).write.option("header", True).csv(f"{root}/in")
    spark.createDataFrame([("x", "2", "b")], "w STRING, id STRING, v STRING").coalesce(1).write.option("header", True).mode("append").csv(f"{root}/in")
    log = landing.load_new_files(spark, f"{root}/in", "s", f"{root}/table", f"{root}/log", "r1")
    assert rows(log, "rows_loaded") == [(1,), (1,)]
    assert rows(landing.bronze(spark, f"{root}/table", f"{root}/log"), "id", "v", "w") == [("1", "a", None), ("2", "b", "x")]


def test_quoted_cells_hold_commas_quotes_and_line_ends(spark, rows):
    root = scratch(spark, "landing")
    for folder, text in (("a", 'id,"a, name",v\n1,"x, ""y""\nz",2\n\n3,,"4"\n'), ("b", '"v","id"\n"5","6"\n'), ("c", 'id,"a, name",v\n')):
        spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(f"{root}/in/{folder}")
    pending = landing.pending_files(spark, f"{root}/in/*", ["id", "a, name"], landing.read_log(spark, f"{root}/log"))
    assert sorted((r.rows, tuple(r.missing_columns), tuple(r.new_columns), r.blocked) for r in pending.collect()) == [
        (0, (), ("v",), False), (1, ("a, name",), ("v",), True), (2, (), ("v",), False)]
    with pytest.raises(landing.BlockedFiles):
        landing.load_new_files(spark, f"{root}/in/*", "s", f"{root}/table", f"{root}/log", "r0", ["id", "a, name"])
    log = landing.load_new_files(spark, f"{root}/in/*", "s", f"{root}/table", f"{root}/log", "r1")
    assert rows(log, "rows_loaded") == [(1,), (2,)]
    assert rows(landing.bronze(spark, f"{root}/table", f"{root}/log"), "id", "a, name", "v") == [("1", 'x, "y"\nz', "2"), ("3", None, "4"), ("6", None, "5")]
    spark.createDataFrame([("id\n9\n",)], "value STRING").coalesce(1).write.text(f"{root}/in/d")
    with pytest.raises(landing.BlockedFiles):  # the table's own columns count where none are given
        landing.load_new_files(spark, f"{root}/in/*", "s", f"{root}/table", f"{root}/log", "r2")
    wide = ",".join(f"c{i}" for i in range(200))
    spark.createDataFrame([(f"{wide}\n{wide}",)], "value STRING").coalesce(1).write.text(f"{root}/in/z")
    landing.load_new_files(spark, f"{root}/in/[az]", "s", f"{root}/other", f"{root}/other-log", "r3")
    assert rows(landing.bronze(spark, f"{root}/other", f"{root}/other-log"), "id", "c0", "c199") == [("1", None, None), ("3", None, None), (None, "c0", "c199")]


def test_a_load_that_died_before_its_log_is_not_read(spark, rows):
    root = scratch(spark, "landing")
    spark.createDataFrame([("1",)], "id STRING").write.option("header", True).csv(f"{root}/in")
    landing.with_origin(spark.read.csv(f"{root}/in"), "dead").write.parquet(f"{root}/table/load=r-dead")
    landing.load_new_files(spark, f"{root}/in", "s", f"{root}/table", f"{root}/log", "next")
    assert rows(landing.bronze(spark, f"{root}/table", f"{root}/log"), "id", "_batch_id") == [("1", "next")]


def test_work_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    assert work_dir(spark) == work_dir(spark)

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn"})
    with pytest.raises(RuntimeError):
        work_dir(Elsewhere)
    Elsewhere.conf = type("C", (), {"get": staticmethod(lambda *a: "hdfs://shared/")})
    assert work_dir(Elsewhere) == "hdfs://shared"


def test_catalog_tables_and_columns(spark, rows):
    spark.range(3).selectExpr("id", "'x' AS v").write.mode("overwrite").option("path", scratch(spark, "t")).saveAsTable("listed")
    try:
        tables, columns = catalog.catalog_assets(spark, "spark_catalog", ["default"])
        assert rows(tables.where("table_name = 'listed'"), "kind", "has_comment") == [("table", False)]
        assert rows(columns.where("table_name = 'listed'"), "column_name", "data_type") == [("id", "bigint"), ("v", "string")]
    finally:
        spark.sql("DROP TABLE listed")


def test_unreadable_assets_join_the_inventory(spark, rows):
    inv = catalog.inventory({"a": spark.range(2)}, {"a": "gold"}).unionByName(catalog.unreadable(spark, "gold", "b", "denied"), allowMissingColumns=True)
    assert rows(inv, "full_name", "row_count", "readable", "error") == [("a", 2, True, None), ("b", None, False, "denied")]


def test_copy_history_refuses_a_filled_target(spark):
    df = spark.createDataFrame([(1,)], "x INT")
    with pytest.raises(ValueError):
        sinks.copy_into_empty(df, df, "/nowhere")
    with pytest.raises(ValueError):
        sinks.copy_history(df, ["x"], project="p")


# ---------------------------------------------------------------- profiles and keys
def test_profile_of_an_empty_and_a_null_column(spark):
    empty = {r.column_name: r for r in profile.profile(spark.createDataFrame([], "a INT, b STRING")).collect()}
    assert (empty["a"].rows, empty["a"].null_fraction, empty["a"].distinct, empty["a"].min) == (0, None, 0, None)
    df = spark.createDataFrame([(None, "x"), (None, "y"), (None, None)], "a INT, b STRING")
    got = {r.column_name: r for r in profile.profile(df, exact=True, hidden=["b"]).collect()}
    assert (got["a"].nulls, got["a"].null_fraction, got["a"].distinct) == (3, 1.0, 0)
    assert (got["b"].null_fraction, got["b"].distinct, got["b"].min) == (0.3333, 2, None)


def test_profiles_of_loads_add_up(spark):
    root = scratch(spark, "states")
    parts = [spark.createDataFrame([(1, "b", 2.5), (None, "c", 10.0)], "a INT, `b c` STRING, d DOUBLE"), spark.createDataFrame([], "a INT, `b c` STRING"),
             spark.createDataFrame([(10, None, True), (1, "a", None), (2, "b", False)], "a INT, `b c` STRING, e BOOLEAN")]
    for n, df in enumerate(parts):
        df.write.parquet(f"{root}/load={n}")
        sketches.write_state(spark.read.parquet(f"{root}/load={n}"), f"{root}/load={n}", hidden=["e"])
    assert spark.read.option("mergeSchema", True).parquet(root).count() == 5  # states are no rows of the table
    got = {r.column_name: tuple(r)[1:] for r in sketches.profile_of_loads(spark, root).collect()}
    assert got == {"a": (5, 1, 0.2, 3, "1", "10"), "b c": (5, 1, 0.2, 3, "a", "c"), "d": (5, 3, 0.6, 2, "2.5", "10.0"), "e": (5, 3, 0.6, 2, None, None)}
    whole = sketches.merged(sketches.read_states(spark, root))
    assert root.split("/")[-1] + "/load=0/_profile" in whole.inputFiles()[0] or len(whole.inputFiles()) == 3
    many = spark.range(30000).select((F.col("id") % 20000).alias("k"))
    states = sketches.state(many.where("k < 15000")).unionByName(sketches.state(many.where("k >= 5000")))
    assert abs(sketches.profile_of(sketches.merged(states)).first().distinct - 20000) < 600


def test_value_lists_only_for_few_values(spark, rows):
    df = spark.range(13).select(F.col("id").cast("string").alias("many"), (F.col("id") % 2).cast("string").alias("few"))
    assert rows(profile.value_lists(df, df.columns)) == [("few", 2, '["0","1"]')]
    assert rows(profile.top_values(df.select("few"), hidden=[])) == [("few", "0", 7), ("few", "1", 6)]


def test_primary_key_with_nulls_and_copies(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, None)], "a INT, b INT")
    r = keys.pk_holds(df, ["a", "b"]).first()
    assert (r.rows, r.distinct, r.nulls, r.holds) == (3, 2, 2, False)
    assert not keys.pk_holds(df.where("a = 9"), ["a"]).first().holds


def test_infer_key_tries_the_tables_own_name_first(spark, rows):
    df = spark.createDataFrame([(1, 7), (2, 8)], "customer_id INT, order_id INT")
    assert rows(keys.infer_key(df, "main.orders")) == [("main.orders", "order_id")]
    assert keys.infer_key(df.union(df), "main.orders").count() == 0
    assert keys.infer_key(df.toDF("a", "b"), "main.orders").count() == 0


def test_bounds_and_nulls_rule_keys_out(spark):
    df = spark.createDataFrame([(1, "a", -5, 1), (2, "a", 9, None), (1, "b", 0, 3)], "a_id INT, b_id STRING, c_id INT, d_id INT")
    names = ["a_id", "b_id", "c_id", "d_id"]
    assert keys.possible_keys(df, names) == ["b_id", "c_id"]  # two numbers cannot hold three rows; text is not judged by bounds
    assert keys.possible_keys(df.where("false"), names) == []
    assert keys.infer_key(df, "main.t").first().key_column == "c_id"


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "c INT")
    parent = spark.createDataFrame([(1,), (None,)], "p INT")
    assert keys.fk_orphans(child, "c", parent, "p").first().orphans == 2


def test_candidates_of_a_table_share_one_scan(spark, rows, folder):
    df = spark.createDataFrame([(1, "a", None, 1.5), (1, "b", "x", -0.0), (2, "a", "x", 0.0), (2, "a", None, 2.0)], "a INT, b STRING, c STRING, d DOUBLE")
    tries = [("t", k) for k in (("a",), ("a", "b"), ("c",), ("a", "c"), ("d",))] + [("none", ("a",)), ("none", ("a", "b"))]
    got = keys.pk_tests({"t": df, "none": df.where("a = 9")}, tries)
    alone = [("t" if n == "t" else "none", ", ".join(k), *keys.pk_holds(df if n == "t" else df.where("a = 9"), k).first()) for n, k in tries]
    assert rows(got, "table_name", "key_columns", "rows", "distinct", "nulls", "holds") == sorted(alone, key=lambda r: [(v is None, str(v)) for v in r])
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    plan = keys.pk_tests({"orders": orders}, [("orders", ("o_orderkey",)), ("orders", ("o_custkey",))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_orphans_of_all_edges_from_one_scan_of_each_table(spark, rows, folder):
    child = spark.createDataFrame([(1, 5, "1"), (2, None, "x"), (2, 7, None), (None, 7, "1")], "c INT, d BIGINT, s STRING")
    parent = spark.createDataFrame([(1, "x"), (None, None), (7, "x")], "p BIGINT, q STRING")
    frames = {"child": child, "parent": parent, "none": parent.where("p = 9")}
    edges = [("child", "c", "parent", "p"), ("child", "d", "parent", "p"), ("child", "s", "parent", "q"), ("child", "s", "parent", "p"),
             ("child", "d", "child", "c"), ("child", "c", "none", "p"), ("none", "p", "child", "c")]
    alone = [(*e, keys.fk_orphans(frames[e[0]], e[1], frames[e[2]], e[3]).first().orphans) for e in edges if e[:4] != ("child", "s", "parent", "p")]
    got = rows(keys.fk_tests(frames, [e for e in edges if e != ("child", "s", "parent", "p")]))
    assert got == sorted(alone, key=lambda r: [(v is None, str(v)) for v in r])
    numbers = spark.createDataFrame([("1",), ("8",)], "s STRING")  # other types meet as the join of the two would have them
    assert rows(keys.fk_tests({"a": numbers, "b": parent}, [("a", "s", "b", "p")])) == [("a", "s", "b", "p", 1)]
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "orders", "part", "supplier")}
    plan = keys.fk_tests(tables, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
                                  ("lineitem", "l_suppkey", "supplier", "s_suppkey")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4 and plan.count("hashpartitioning") == 1 and "SortAggregate" not in plan and "Join" not in plan


# ---------------------------------------------------------------- differences
def test_diff_of_a_table_with_itself_is_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (None, None, 2.0)], "k INT, v STRING, w DOUBLE")
    assert diff.diff(df, df, ["k"], ["v", "w"]).count() == 0


def test_diff_is_null_safe_and_loose_on_space(spark, rows):
    want = spark.createDataFrame([(1, "a  b"), (2, None), (None, "n"), (4, "x")], "k INT, v STRING")
    have = spark.createDataFrame([(1, "a b "), (2, ""), (5, "e"), (4, "x"), (4, "y")], "k INT, v STRING")
    got = diff.diff(want, have, ["k"], ["v"], loose_text=["v"])
    assert rows(got, "k", "problem") == [(2, "changed"), (4, "duplicated"), (5, "extra"), (None, "missing")]


def test_fingerprint_sees_order_values_and_number(spark):
    def one(parts):
        df = spark.createDataFrame([("t", i, c, d) for i, (c, d) in enumerate(parts)], "t STRING, at INT, c STRING, d STRING")
        return diff.fingerprint(df, ["t"], "at", ["c", "d"]).first().fingerprint
    base = [("a", "int"), ("b", "string")]
    assert one(base) == one(base)
    assert len({one(base), one(base[::-1]), one([("a", "int"), ("b", "bigint")]), one(base + [("c", "int")])}) == 4


def test_freshness_rounds_before_it_compares(spark, rows):
    now = dt.datetime(2024, 1, 3)
    changes = spark.createDataFrame([("a", "WRITE", now - dt.timedelta(hours=48, minutes=2, seconds=24)), ("a", "OPTIMIZE", now),
                                     ("b", "write", now - dt.timedelta(hours=48, minutes=4))], "table_name STRING, operation STRING, changed_at TIMESTAMP")
    limits = spark.createDataFrame([("a", "gold", 48.0), ("b", "gold", 48.0), ("c", "gold", 1.0), ("d", "gold", None)], "table_name STRING, layer STRING, max_hours DOUBLE")
    got = freshness.freshness(changes, limits, F.lit(now))
    assert rows(got, "table_name", "age_hours", "stale") == [("a", 48.0, False), ("b", 48.1, True), ("c", None, True), ("d", None, False)]
