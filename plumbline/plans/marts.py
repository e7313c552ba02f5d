"""Landing, silver and gold."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, freshness, keys, medallion, profile, sketches
from ..session import scratch, written
from ..sources import catalog, landing, sinks
from . import binding as b
from . import build
from .registry import doubles, query, text_list


# ---------------------------------------------------------------- gold
@query("gold_sales_daily", f"SELECT order_date, region_name, product_name, category, orders, units, CAST(revenue AS DOUBLE) AS revenue FROM ({b.SALES_SQL})")
def gold_sales_daily(t):
    return doubles(b.sales_daily(t), "revenue")


@query("gold_fill_daily", f"SELECT *, round(units_shipped / units_ordered, 4) AS fill_rate FROM ({b.FILL_SQL})")
def gold_fill_daily(t):
    return b.fill_daily(t).withColumn("fill_rate", F.round("fill_rate", 4))


@query("gold_customer_360", f"SELECT * REPLACE (CAST(lifetime_revenue AS DOUBLE) AS lifetime_revenue) FROM ({b.CUSTOMER_SQL})")
def gold_customer_360(t):
    return doubles(b.customer_360(t), "lifetime_revenue")


@query("gold_returns_daily", f"SELECT * REPLACE (CAST(returned_value AS DOUBLE) AS returned_value) FROM ({b.RETURNS_SQL})")
def gold_returns_daily(t):
    return doubles(b.returns_daily(t), "returned_value")


# ---------------------------------------------------------------- silver
CUSTOMER_COLUMNS = {"customer_id": ("c_custkey", "bigint"), "customer_name": ("c_name", "string"),
                    "nation": ("c_nationkey", "int"), "balance": ("c_acctbal", "decimal(12,2)"),
                    "segment": ("lower(c_mktsegment)", "string")}


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("silver_typed", """SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation,
  CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS balance, lower(c_mktsegment) AS segment FROM customer""")
def silver_typed(t):
    return doubles(medallion.typed(_as_text(t.customer), CUSTOMER_COLUMNS), "balance")


@query("cast_failures", """SELECT 'customer_id' AS column_name, CAST(0 AS BIGINT) AS failures
  UNION ALL SELECT 'customer_name', 0 UNION ALL SELECT 'nation', 0 UNION ALL SELECT 'segment', 0
  UNION ALL SELECT 'balance', COUNT(*) FILTER (WHERE c_acctbal < 0) FROM customer""")
def cast_failures(t):
    # Balances below zero land as "(12.50)", which is no number; told by the number, since -0.0 has a sign and is not below zero.
    amount = F.col("c_acctbal")
    text = F.when(amount < 0, F.concat(F.lit("("), F.abs(amount).cast("string"), F.lit(")"))).otherwise(amount.cast("string"))
    landed = _as_text(t.customer.withColumn("c_acctbal", text))
    return medallion.cast_failures(landed, CUSTOMER_COLUMNS)


@query("latest_per_key", """SELECT user_id, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(t):
    return medallion.latest_per_key(t.events, ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type", "value")


@query("upsert", """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'second' ELSE 'first' END AS batch FROM customer
  UNION ALL SELECT -1 - c_custkey, c_mktsegment, c_acctbal, 'second' FROM customer WHERE c_acctbal < 0""")
def upsert(t):
    target = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", F.lit("first").alias("batch"))
    changed = target.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    added = target.where("c_acctbal < 0").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return medallion.upsert(target, changed.unionByName(added), ["c_custkey"], F.lit("second"), "batch")


@query("silver_merge", """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'second' ELSE 'first' END AS _updated_at FROM customer""")
def silver_merge(t):
    """A written table merged twice: all customers, then the changed ones, the second merge repeated."""
    path = scratch(t.spark, "silver")
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = rows.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    for batch, stamp in ((rows, "first"), (changed, "second"), (changed, "second")):
        sinks.merge_into(t.spark, path, batch, ["c_custkey"], F.lit(stamp), buckets=4)
    return t.spark.read.parquet(path).drop("_bucket")


@query("merge_table", """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment) END AS note, CASE WHEN c_mktsegment = 'BUILDING' THEN 'second' ELSE 'first' END AS _updated_at
  FROM customer""")
def merge_table(t):
    """A bucketed table of the catalog merged three times, read through its view."""
    name, path = f"merged_{uuid.uuid4().hex}", scratch(t.spark, "merged")
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = (rows.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("note", F.lower("c_mktsegment")))
    for batch, stamp in ((rows, "first"), (changed, "second"), (changed, "second")):
        sinks.merge_table(t.spark, name, batch, ["c_custkey"], F.lit(stamp), buckets=8, path=path)
    found = t.spark.read.parquet(f"{path}/v3")
    t.spark.sql(f"DROP VIEW {name}")
    for version in (2, 3):  # the files stay: tables at a path of their own are only unlisted
        t.spark.sql(f"DROP TABLE IF EXISTS {name}_v{version}")
    return found


@query("merge_other_buckets", """SELECT c_custkey, c_acctbal + 1 AS c_acctbal, 1 AS refused FROM customer""")
def merge_other_buckets(t):
    """A second merge that names another number of buckets is refused; one that names none uses the table's own."""
    path, refused = scratch(t.spark, "silver"), 0
    rows = t.customer.select("c_custkey", "c_acctbal")
    sinks.merge_into(t.spark, path, rows, ["c_custkey"], buckets=8)
    more = rows.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    try:
        sinks.merge_into(t.spark, path, more, ["c_custkey"], buckets=4)
    except ValueError:
        refused = 1
    sinks.merge_into(t.spark, path, more, ["c_custkey"])
    return t.spark.read.parquet(path).select("c_custkey", "c_acctbal", F.lit(refused).alias("refused"))


@query("merge_new_column", """SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment) END AS note FROM customer""")
def merge_new_column(t):
    """A merge that brings a column the table lacks: kept for the merged rows, null for the others."""
    path = scratch(t.spark, "silver")
    rows = t.customer.select("c_custkey", "c_acctbal")
    sinks.merge_into(t.spark, path, rows, ["c_custkey"], buckets=4)
    noted = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal", F.lower("c_mktsegment").alias("note"))
    sinks.merge_into(t.spark, path, noted, ["c_custkey"], buckets=4)
    return t.spark.read.option("mergeSchema", True).parquet(path).drop("_bucket")


@query("merge_repeated_key", """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def merge_repeated_key(t):
    """A source with many rows per key, folded to the newest by the merge itself."""
    target = t.events.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("ts"), F.min("event_id").alias("event_id"), F.lit(0.0).alias("value"))
    return medallion.upsert(target, t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], newest="ts").drop("ts")


# ---------------------------------------------------------------- landing
@query("load_blocked", "SELECT COUNT(*) AS n, 0::BIGINT AS stored_before FROM customer")
def load_blocked(t):
    """A load that meets a file without a column of its table stores nothing; once the file is gone from the folder it loads the rest."""
    root = scratch(t.spark, "blocked")
    t.customer.write.option("header", True).csv(f"{root}/landing/good")
    t.customer.drop("c_acctbal").limit(1).write.option("header", True).csv(f"{root}/landing/bad")
    stored = 0
    try:
        landing.load_new_files(t.spark, f"{root}/landing/*", "customers", f"{root}/table", f"{root}/log", "first", t.customer.columns)
        stored = 1
    except landing.BlockedFiles:
        stored = landing.read_log(t.spark, f"{root}/log").count()
    landing.load_new_files(t.spark, f"{root}/landing/good", "customers", f"{root}/table", f"{root}/log", "second", t.customer.columns)
    return landing.bronze(t.spark, f"{root}/table", f"{root}/log").agg(F.count(F.lit(1)).alias("n"), F.lit(stored).cast("bigint").alias("stored_before"))


_LANDED = {"regions": "region", "products": "part", "customers": "customer", "orders": "orders", "shipments": "lineitem", "returns": "lineitem"}


@query("build_refuses", " UNION ALL ".join(f"SELECT '{s}' AS source, COUNT(*) AS n, 1 AS refused, COUNT(*) AS bronze_rows FROM {of}" for s, of in _LANDED.items()))
def build_refuses(t):
    """The build's own load, twice: the second meets a customer file without a column of bronze, and stores nothing of that source."""
    root, refused = scratch(t.spark, "build"), 0
    names = {raw: [name for name, _ in columns.items()] for raw, _, columns in medallion.SILVER.values()}
    for raw, of in _LANDED.items():
        rows = getattr(t, of)
        rows = rows.select(*[F.col(c).cast("string").alias(n) for c, n in zip(rows.columns, names[raw])], *[F.lit("x").alias(n) for n in names[raw][len(rows.columns):]])
        rows.write.option("header", True).csv(f"{root}/landing/{raw}")
    build.load_bronze(t.spark, f"{root}/landing", root, "one")
    t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")).write.mode("append").option("header", True).csv(f"{root}/landing/customers")
    try:
        build.load_bronze(t.spark, f"{root}/landing", root, "two")
    except landing.BlockedFiles:
        refused = 1
    log = landing.read_log(t.spark, f"{root}/bronze/ingestion_log").groupBy("source").agg(F.sum("rows_loaded").alias("n")).withColumn("refused", F.lit(refused))
    stored = [landing.bronze(t.spark, f"{root}/bronze/raw_{raw}", f"{root}/bronze/ingestion_log").agg(F.lit(raw).alias("source"), F.count(F.lit(1)).alias("bronze_rows"))
              for raw in _LANDED]
    return log.join(reduce(DataFrame.unionByName, stored), "source")


@query("quoted_files", """SELECT doc_id, lang, length(text) AS n_chars, CAST(doc_id % 2 AS INTEGER) AS part FROM documents WHERE text <> ''""")
def quoted_files(t):
    """All documents landed as CSV in two layouts, texts with line ends, commas and quotes in quoted cells, and read by column name."""
    root = scratch(t.spark, "quoted")
    rows = t.documents.select("doc_id", "lang", "text").where("text <> ''")
    csv = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for part, columns in enumerate((["doc_id", "text", "lang"], ["lang", "doc_id", "text"])):
        rows.where(F.col("doc_id") % 2 == part).select(*columns, F.lit(part).alias("the, part")).write.options(**csv).csv(f"{root}/landing/{part}")
    landing.load_new_files(t.spark, f"{root}/landing/*", "documents", f"{root}/table", f"{root}/log", "first")
    found = landing.bronze(t.spark, f"{root}/table", f"{root}/log")
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.char_length("text").cast("bigint").alias("n_chars"), F.col("`the, part`").cast("int").alias("part"))


@query("append_widening", """SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS value FROM events WHERE event_type = 'error'
  UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'""")
def append_widening(t):
    old = t.events.where("event_type = 'error'").select("event_id", "event_type")
    return sinks.append_widening(old, t.events.where("event_type <> 'error'").select("event_id", "event_type", "value"))


@query("ingestion_log", """SELECT 'run' AS run_id, 'events' AS source, CAST(CAST(ts AS DATE) AS VARCHAR) AS source_file,
  COUNT(*) AS rows_loaded FROM events GROUP BY 3""")
def ingestion_log(t):
    loaded = t.events.withColumn("_source_file", F.to_date("ts").cast("string")).withColumn("_ingest_ts", F.col("ts"))
    return landing.log_files(loaded, "events", "run").drop("loaded_at")


@query("bronze_load", """SELECT c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT c_custkey) AS customers, CAST(1 AS BIGINT) AS runs,
  CAST(SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance FROM customer GROUP BY c_mktsegment""")
def bronze_load(t):
    """Land the customers as CSV, load them twice, and read bronze: the second run finds nothing new."""
    root = scratch(t.spark, "bronze")
    t.customer.write.option("header", True).csv(f"{root}/landing")
    for run in ("first", "second"):
        landing.load_new_files(t.spark, f"{root}/landing", "customers", f"{root}/table", f"{root}/log", run)
    rows = landing.bronze(t.spark, f"{root}/table", f"{root}/log")
    return rows.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("customers"), F.count_distinct("_batch_id").alias("runs"),
        F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double").alias("balance"))


@query("pending_files", """SELECT 'c_acctbal' AS missing_columns, 'c_phone' AS new_columns, TRUE AS blocked,
  COUNT(*) AS n FROM customer""")
def pending_files(t):
    root = scratch(t.spark, "pending")
    t.customer.drop("c_acctbal").withColumn("c_phone", F.lit("n/a")).write.option("header", True).csv(root)
    found = landing.pending_files(t.spark, root, t.customer.columns, landing.read_log(t.spark, f"{root}-log"))
    return (found.select(text_list("missing_columns"), text_list("new_columns"), "blocked", "rows")
            .groupBy("missing_columns", "new_columns", "blocked").agg(F.sum("rows").alias("n")))


@query("overwrite_sink", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1")
def overwrite_sink(t):
    path = scratch(t.spark, "overwrite")
    sinks.overwrite(t.customer.unionByName(t.customer), path)
    sinks.overwrite(t.customer, path)
    return t.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("saved_table_view", "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def saved_table_view(t):
    """The customers as a bucketed table of the catalog, saved twice, and a view over it."""
    name, path = f"customers_{uuid.uuid4().hex}", scratch(t.spark, "saved")
    for _ in range(2):
        sinks.save_table(t.customer, name, bucket_by="c_custkey", buckets=4, path=path)
    sinks.save_view(t.spark, f"{name}_rich", f"SELECT * FROM {name} WHERE c_acctbal >= 0")
    return t.spark.table(f"{name}_rich").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("overwrite_empty", "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal < -100000")
def overwrite_empty(t):
    path = scratch(t.spark, "overwrite")
    sinks.overwrite(t.customer, path)
    sinks.overwrite(t.customer.where("c_acctbal < -100000"), path, t.customer.schema)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("copy_history", """SELECT user_id AS run_id, event_type, value FROM events
  WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)""")
def copy_history(t):
    history = t.events.withColumnRenamed("user_id", "run_id")
    runs = history.where("event_type = 'error' AND value > 20").select("run_id")
    return sinks.copy_history(history, ["run_id", "event_type", "value", "not_there"], runs=runs)


@query("copy_project", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def copy_project(t):
    return sinks.copy_history(t.events.withColumnRenamed("event_type", "system"), ["event_id", "value"], project="purchase")


@query("schema_diff", """WITH want AS (SELECT p_brand AS table_name, p_name AS column_name, min(p_type) AS data_type FROM part GROUP BY 1, 2),
  have AS (SELECT p_brand AS table_name, p_name AS column_name, max(p_type) AS live_type FROM part
           WHERE p_size > 25 AND p_brand <> 'Brand#1' GROUP BY 1, 2)
  SELECT w.table_name, w.column_name, w.data_type, h.live_type,
    CASE WHEN w.table_name NOT IN (SELECT table_name FROM have) THEN 'create' WHEN h.live_type IS NULL THEN 'add' ELSE 'warn' END AS action
  FROM want w LEFT JOIN have h USING (table_name, column_name) WHERE h.live_type IS NULL OR h.live_type <> w.data_type""")
def schema_diff(t):
    part = t.part.select(F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name"), "p_type", "p_size")
    want = part.groupBy("table_name", "column_name").agg(F.min("p_type").alias("data_type"))
    have = (part.where("p_size > 25 AND table_name <> 'Brand#1'").groupBy("table_name", "column_name")
            .agg(F.max("p_type").alias("data_type")))
    return sinks.schema_diff(want, have)


# ---------------------------------------------------------------- assets
def customer_assets(t):
    """Customers as assets of ``region.nation``, tables or views by balance."""
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.lower("r_name").alias("catalog_name"), F.lower("n_name").alias("schema_name"),
                    F.lower("c_name").alias("table_name"),
                    F.when(F.col("c_acctbal") < 0, "view").otherwise("table").alias("kind"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("key")))


LAYERS = (catalog.Layer("bronze", ("africa.nation_0", "asia.nation_2")),
          catalog.Layer("silver", ("america.nation_1", "america.nation_6"), tables=("customer#*5", "nation_6.*")),
          catalog.Layer("gold", ("europe.nation_3", "europe.nation_8"), exclude=("*00?", "nation_8.*7")))


@query("asset_scan", """WITH a AS (SELECT lower(r_name) AS c, lower(n_name) AS s, lower(c_name) AS t FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT c || '.' || s || '.' || t AS full_name, CASE WHEN c IN ('africa', 'asia') THEN 'bronze' WHEN c = 'america' THEN 'silver' ELSE 'gold' END AS layer
  FROM a WHERE (c = 'africa' AND s = 'nation_0') OR (c = 'asia' AND s = 'nation_2')
    OR (c = 'america' AND ((s = 'nation_1' AND t LIKE 'customer#%5') OR s = 'nation_6'))
    OR (c = 'europe' AND s = 'nation_3' AND t NOT LIKE '%00_') OR (c = 'europe' AND s = 'nation_8' AND t NOT LIKE '%00_' AND t NOT LIKE '%7')""")
def asset_scan(t):
    return catalog.select_assets(customer_assets(t), LAYERS).select("full_name", "layer")


_SCANNED = ("customer", "orders", "lineitem", "events")


@query("catalog_scan", f"""SELECT table_name, CASE table_name WHEN 'events' THEN 'view' ELSE 'table' END AS kind, table_name = 'orders' AS has_comment, COUNT(*) AS n_columns
  FROM (SELECT DISTINCT table_name, column_name FROM information_schema.columns WHERE table_name IN {_SCANNED}) GROUP BY 1""")
def catalog_scan(t):
    """A schema of the session's catalog over the given tables: three tables, one with a comment, and a view."""
    schema = f"scan_{uuid.uuid4().hex}"
    t.spark.sql(f"CREATE DATABASE {schema}")
    for name in _SCANNED[:-1]:
        note = "COMMENT 'order headers'" if name == "orders" else ""
        columns = ", ".join(f"`{c}` {k}" for c, k in getattr(t, name).dtypes)
        t.spark.sql(f"CREATE TABLE {schema}.{name} ({columns}) USING parquet {note} LOCATION '{t.folder}/{name}.parquet'")
    sinks.save_view(t.spark, f"{schema}.events", f"SELECT * FROM parquet.`{t.folder}/events.parquet`")
    tables, columns = catalog.catalog_assets(t.spark, "spark_catalog", [schema])
    t.spark.sql(f"DROP DATABASE {schema} CASCADE")  # names only: the tables' files are not the schema's
    counted = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    return tables.join(counted, "table_name").select("table_name", "kind", "has_comment", "n_columns")


TABLE_LAYERS = {"region": "silver", "nation": "silver", "customer": "silver", "supplier": "silver", "part": "silver",
                "orders": "silver", "lineitem": "silver", "events": "bronze", "documents": "bronze", "pages": "bronze",
                "conversations": "bronze", "embeddings": "gold", "benchmark": "gold", "labels": "gold"}
_WIDTH = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
          "documents": 5, "pages": 3, "conversations": 4, "embeddings": 3, "benchmark": 2, "labels": 3}


@query("inventory", " UNION ALL ".join(
    f"SELECT '{layer}' AS layer, '{name}' AS full_name, {_WIDTH[name]} AS column_count, COUNT(*) AS row_count, FALSE AS has_comment, TRUE AS readable, 'table' AS kind, NULL::VARCHAR AS error FROM {name}"
    for name, layer in TABLE_LAYERS.items()))
def inventory(t):
    return catalog.inventory({name: getattr(t, name) for name in TABLE_LAYERS}, TABLE_LAYERS).drop("last_updated")


@query("inventory_layers", """SELECT layer, COUNT(*) AS assets, FALSE AS below_minimum, 0::BIGINT AS unreadable, COUNT(*) FILTER (WHERE n = 0) AS empty,
  COUNT(*) AS undocumented, CAST(max(updated) AS DATE) AS newest FROM (""" + " UNION ALL ".join(
    f"SELECT '{layer}' AS layer, (SELECT COUNT(*) FROM {name}) AS n, {'(SELECT max(ts) FROM events)' if name == 'events' else 'NULL::TIMESTAMP'} AS updated"
    for name, layer in TABLE_LAYERS.items()) + ") GROUP BY layer")
def inventory_layers(t):
    """The inventory as it is, assessed by layer; the event log's change is its newest event."""
    changes = t.events.select(F.lit("events").alias("table_name"), F.lit("WRITE").alias("operation"), F.col("ts").alias("changed_at"))
    found = catalog.inventory({name: getattr(t, name) for name in TABLE_LAYERS}, TABLE_LAYERS, changes=freshness.last_changes(changes))
    return freshness.assess_layers(found, b.now()).select("layer", "assets", "below_minimum", "unreadable", "empty", "undocumented", F.to_date("newest_update").alias("newest"))


def user_assets(t):
    """Users of the event log as assets: rows, last change, whether readable and described."""
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_updated"),
        F.max(F.col("event_type") == "signup").alias("has_comment"),
        (F.count_if(F.col("event_type") == "error") < 15).alias("readable")).select(
        F.get(F.array(F.lit("bronze"), F.lit("silver"), F.lit("gold")), F.col("user_id").cast("int") % 3).alias("layer"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("full_name"), F.lit("table").alias("kind"), "row_count", "last_updated",
        "has_comment", "readable")


_USERS = """SELECT CASE user_id % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS layer, 'user_' || user_id AS full_name,
  COUNT(*) AS row_count, MAX(ts) FILTER (WHERE event_type = 'purchase') AS last_updated, bool_or(event_type = 'signup') AS has_comment,
  COUNT(*) FILTER (WHERE event_type = 'error') < 15 AS readable FROM events GROUP BY user_id"""
AGE_SQL = "round((epoch_us(TIMESTAMP '2024-01-31') // 1000000 - epoch_us({}) // 1000000) / 360) / 10"


@query("layer_assessment", f"""SELECT layer, COUNT(*) AS assets, COUNT(*) < 50 AS below_minimum, {AGE_SQL.format('MAX(last_updated)')} AS age_hours,
  COUNT(*) FILTER (WHERE NOT readable) AS unreadable, COUNT(*) FILTER (WHERE readable AND row_count = 0) AS empty,
  COUNT(*) FILTER (WHERE NOT has_comment) AS undocumented,
  CASE layer WHEN 'gold' THEN FALSE WHEN 'bronze' THEN {AGE_SQL.format('MAX(last_updated)')} > 1.0 ELSE {AGE_SQL.format('MAX(last_updated)')} > 24.0 END AS stale
  FROM ({_USERS}) GROUP BY layer""")
def layer_assessment(t):
    out = freshness.assess_layers(user_assets(t), b.now(), 50, {"bronze": 1, "silver": 24})
    return out.select("layer", "assets", "below_minimum", "age_hours", "unreadable", "empty", "undocumented", "stale")


def user_changes(t):
    return t.events.select(F.concat(F.lit("user_"), F.col("user_id")).alias("table_name"), F.upper("event_type").alias("operation"),
                           F.col("ts").alias("changed_at"))


def user_limits(t):
    hours = F.get(F.array(F.lit(None), F.lit(24.0), F.lit(240.0)), F.col("user_id").cast("int") % 3)
    layer = F.get(F.array(F.lit("bronze"), F.lit("silver"), F.lit("gold")), F.col("user_id").cast("int") % 3)
    return t.events.select("user_id").distinct().select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("table_name"), layer.alias("layer"), hours.alias("max_hours"))


CHANGE_OPERATIONS = ("PURCHASE", "SIGNUP")
FRESH_SQL = f"""SELECT table_name, layer, age_hours, max_hours,
    CASE WHEN max_hours IS NULL THEN FALSE WHEN age_hours IS NULL THEN TRUE ELSE age_hours > max_hours END AS stale
  FROM (SELECT 'user_' || user_id AS table_name, CASE user_id % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS layer,
    CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 24.0::DOUBLE ELSE 240.0::DOUBLE END AS max_hours,
    {AGE_SQL.format("MAX(ts) FILTER (WHERE event_type IN ('purchase', 'signup'))")} AS age_hours
  FROM events GROUP BY user_id)"""


def user_freshness(t):
    return freshness.freshness(user_changes(t), user_limits(t), b.now(), CHANGE_OPERATIONS)


@query("freshness", FRESH_SQL)
def freshness_of_users(t):
    return user_freshness(t).drop("last_data_change", "error")


@query("table_status", f"""SELECT u.layer, u.full_name, u.row_count, f.age_hours, f.max_hours, f.stale FROM ({_USERS}) u
  JOIN ({FRESH_SQL}) f ON f.table_name = u.full_name""")
def table_status(t):
    return freshness.table_status(user_assets(t), user_freshness(t)).drop("last_data_change")


@query("fk_edges", """WITH one AS (SELECT l_orderkey, min(l_suppkey) AS s, min(l_partkey) AS p, min(l_linenumber) AS pos FROM lineitem GROUP BY 1 HAVING COUNT(*) = 1)
  SELECT 'fk_' || l_orderkey AS constraint_name, 'supplier_' || s AS child_table, 'part_' || p AS child_column,
    'customer_' || c_custkey AS parent_table, 'nation_' || c_nationkey AS parent_column
  FROM one JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE pos = 1""")
def fk_edges(t):
    """Orders as foreign keys of their lines' columns, customers as the keys they refer to."""
    def named(prefix, column):
        return F.concat(F.lit(prefix), F.col(column))

    children = t.lineitem.select(named("fk_", "l_orderkey").alias("constraint_name"), named("supplier_", "l_suppkey").alias("table_name"),
                                 named("part_", "l_partkey").alias("column_name"), F.lit(1).alias("ordinal_position"),
                                 F.col("l_linenumber").alias("position_in_unique_constraint"))
    parents = t.customer.select(named("pk_", "c_custkey").alias("constraint_name"), named("customer_", "c_custkey").alias("table_name"),
                                named("nation_", "c_nationkey").alias("column_name"), F.lit(1).alias("ordinal_position"),
                                F.lit(None).cast("int").alias("position_in_unique_constraint"))
    referential = t.orders.select(named("fk_", "o_orderkey").alias("constraint_name"), named("pk_", "o_custkey").alias("unique_constraint_name"))
    return catalog.fk_edges(referential, children.unionByName(parents))


@query("sensitive_columns", """SELECT source AS table_name, d.doc_id AS column_name, quality AS tag_value FROM documents d JOIN labels USING (doc_id)
  WHERE quality IN (1) AND source IN (SELECT source FROM documents GROUP BY source HAVING min(n_chars) < 60)""")
def sensitive_columns(t):
    tags = t.labels.join(t.documents, "doc_id").select(F.col("source").alias("table_name"), F.col("doc_id").alias("column_name"),
                                                      F.col("quality").alias("tag_value"))
    assets = t.documents.groupBy(F.col("source").alias("table_name")).agg(
        F.when(F.min("n_chars") < 60, "table").otherwise("view").alias("kind"))
    return catalog.sensitive_columns(tags, assets, [1])


# ---------------------------------------------------------------- profiles
def _profiled(t):
    return {"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem, "part": t.part.withColumn("p_size", F.nullif("p_size", F.lit(1)))}


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_COLUMNS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
            "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
            "lineitem": LINE_COLUMNS, "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}
_PART = "(SELECT * REPLACE (nullif(p_size, 1) AS p_size) FROM part)"


def _each_column(template: str) -> str:
    return " UNION ALL ".join(template.format(t=t, c=c, rel=_PART if t == "part" else t) for t, cs in _COLUMNS.items() for c in cs)


def _union(frames):
    from functools import reduce
    return reduce(lambda a, c: a.unionByName(c), frames)


@query("profile_columns", _each_column("""SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls,
  round((COUNT(*) - COUNT({c})) / COUNT(*), 4) AS null_fraction, COUNT(DISTINCT {c}) AS "distinct",
  CAST(MIN({c}) AS VARCHAR) AS min, CAST(MAX({c}) AS VARCHAR) AS max FROM {rel}"""))
def profile_columns(t):
    return _union([profile.profile(df, exact=True).select(F.lit(n).alias("table_name"), "*") for n, df in _profiled(t).items()])


_LOADED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("profile_loads", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT(v) AS nulls, round(1 - COUNT(v) / COUNT(*), 4) AS null_fraction,
  CASE WHEN COUNT(DISTINCT v) <= 100 THEN COUNT(DISTINCT v) END AS few, TRUE AS close, MIN(v) AS min, MAX(v) AS max
  FROM (SELECT CASE WHEN '{c}' <> 'c_mktsegment' OR c_custkey % 2 = 1 THEN CAST({c} AS VARCHAR) END AS v FROM customer)""" for c in _LOADED))
def profile_loads(t):
    """Customers landed in two loads, the first without a column: the table's profile is the union of what each load left."""
    root = scratch(t.spark, "profiled")
    for part, names in enumerate((_LOADED[:3], _LOADED)):
        t.customer.where(F.col("c_custkey") % 2 == part).select(*names).write.option("header", True).csv(f"{root}/landing/{part}")
        landing.load_new_files(t.spark, f"{root}/landing/{part}", "customers", f"{root}/table", f"{root}/log", f"load-{part}", profiled=True)
    found = sketches.profile_of_loads(t.spark, f"{root}/table")
    exact = profile.value_counts(landing.bronze(t.spark, f"{root}/table", f"{root}/log"), _LOADED).where("value IS NOT NULL").groupBy("column_name").agg(F.count(F.lit(1)).alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact")
    return (found.join(exact, "column_name").withColumn("close", near).withColumn("few", F.when(F.col("distinct") <= 100, F.col("distinct")))
            .select("column_name", "rows", "nulls", "null_fraction", "few", "close", "min", "max"))


@query("profile_approx", _each_column("SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(DISTINCT {c}) AS exact, TRUE AS close FROM {rel}"))
def profile_approx(t):
    """The one-scan profile against exact counts: within five standard errors of the sketch."""
    out = []
    for name, df in _profiled(t).items():
        sketch = profile.profile(df).select("column_name", F.col("distinct").alias("approx"))
        exact = profile.profile(df, exact=True).select("column_name", F.col("distinct").alias("exact"))
        close = F.abs(F.col("approx") - F.col("exact")) <= F.greatest(F.lit(2.0), F.col("exact") * 0.25)
        out.append(exact.join(sketch, "column_name").select(F.lit(name).alias("table_name"), "column_name", "exact", close.alias("close")))
    return _union(out)


@query("profile_values", """SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, COUNT(DISTINCT o_orderstatus) AS "distinct",
    CAST(to_json(list_sort(list(DISTINCT o_orderstatus))) AS VARCHAR) AS values FROM orders
  UNION ALL SELECT 'orders', 'o_orderpriority', COUNT(DISTINCT o_orderpriority), CAST(to_json(list_sort(list(DISTINCT o_orderpriority))) AS VARCHAR) FROM orders
  UNION ALL SELECT 'customer', 'c_mktsegment', COUNT(DISTINCT c_mktsegment), CAST(to_json(list_sort(list(DISTINCT c_mktsegment))) AS VARCHAR) FROM customer
  UNION ALL SELECT 'part', 'p_type', COUNT(DISTINCT p_type), CAST(to_json(list_sort(list(DISTINCT p_type))) AS VARCHAR) FROM part
  """ + " ".join(f"""UNION ALL SELECT 'lineitem', '{c}', COUNT(DISTINCT {c}), CAST(to_json(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))) AS VARCHAR) FROM lineitem
  HAVING COUNT(DISTINCT {c}) BETWEEN 1 AND 12""" for c in LINE_COLUMNS))
def profile_values(t):
    return _union([profile.value_lists(df, df.columns).select(F.lit(n).alias("table_name"), "*") for n, df in _profiled(t).items()])


@query("profile_top_values", """SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, o_orderstatus AS value, COUNT(*) AS n FROM orders GROUP BY 3
  UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment, COUNT(*) FROM customer GROUP BY 3
  UNION ALL SELECT 'part', 'p_type', p_type, COUNT(*) FROM part GROUP BY 3 UNION ALL SELECT 'part', 'p_brand', p_brand, COUNT(*) FROM part GROUP BY 3
  UNION ALL SELECT 'lineitem', 'l_returnflag', l_returnflag, COUNT(*) FROM lineitem GROUP BY 3
  UNION ALL SELECT 'lineitem', 'l_linestatus', l_linestatus, COUNT(*) FROM lineitem GROUP BY 3""")
def profile_top_values(t):
    hidden = {"orders": ["o_orderpriority"], "customer": [], "part": [], "lineitem": []}
    return _union([profile.top_values(df, hidden=hidden[n]).select(F.lit(n).alias("table_name"), "*") for n, df in _profiled(t).items()])


@query("profile_samples", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, array_to_string(list_sort(list(DISTINCT left(CAST({c} AS VARCHAR), 60)))[:5], ',') AS samples
  FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20)""" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def profile_samples(t):
    return profile.samples(t.part, ["p_partkey"]).withColumn("samples", text_list("samples"))


# ---------------------------------------------------------------- keys
def _tables(t):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
    return {n: getattr(t, n) for n in names}


CANDIDATES = (("region", ("r_regionkey",)), ("nation", ("n_nationkey",)), ("nation", ("n_regionkey",)),
              ("customer", ("c_custkey",)), ("customer", ("c_nationkey", "c_mktsegment")), ("supplier", ("s_suppkey",)),
              ("part", ("p_partkey",)), ("orders", ("o_orderkey",)), ("orders", ("o_custkey", "o_orderdate")),
              ("lineitem", ("l_orderkey", "l_linenumber")), ("events", ("event_id",)), ("documents", ("doc_id",)))
_PK_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{", ".join(k)}' AS key_columns, rows, "distinct", nulls,
  rows > 0 AND rows = "distinct" AND nulls = 0 AS holds FROM (SELECT COUNT(*) AS rows, COUNT(DISTINCT row({", ".join(k)})) AS "distinct",
  COUNT(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in k)}) AS nulls FROM {t})""" for t, k in CANDIDATES)


@query("pk_holds", _PK_SQL)
def pk_holds(t):
    return keys.pk_tests(_tables(t), CANDIDATES)


EDGES = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
         ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
         ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
         ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("lineitem", "l_partkey", "small_part", "p_partkey"),
         ("customer", "c_nationkey", "supplier", "s_nationkey"))
_SMALL = "(SELECT * FROM part WHERE p_size <= 25)"
_ORPHAN_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, '{pc}' AS parent_column, COUNT(*) AS orphans
  FROM {c} WHERE {cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_SMALL if p == "small_part" else p} x WHERE x.{pc} = {cc})"""
    for c, cc, p, pc in EDGES)


def _orphans(t):
    """Small parts are a column of part that is null for the others, so part is read once."""
    small = {("small_part", "p_partkey"): ("part", "small_partkey")}
    found = keys.fk_tests({**_tables(t), "part": t.part.withColumn("small_partkey", F.expr("CASE WHEN p_size <= 25 THEN p_partkey END"))},
                          [(c, cc, *small.get((p, pc), (p, pc))) for c, cc, p, pc in EDGES])
    is_small = F.col("parent_column") == "small_partkey"
    return found.withColumns({"parent_table": F.when(is_small, "small_part").otherwise(F.col("parent_table")),
                              "parent_column": F.when(is_small, "p_partkey").otherwise(F.col("parent_column"))})


@query("fk_orphans", _ORPHAN_SQL)
def fk_orphans(t):
    return _orphans(t)


PATTERNS = ("(?i)_id$", "(?i)key$", "(?i)_code$")
_KEY_TRIES = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
              "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
              "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"], "documents": ["doc_id"]}
_INFER_SQL = "SELECT table_name, arg_min(key_column, rank) AS key_column FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS key_column, {i} AS rank, COUNT(*) = COUNT(DISTINCT {c}) AND COUNT(*) > 0 AS holds FROM {t}"
    for t, cs in _KEY_TRIES.items() for i, c in enumerate(cs)) + ") WHERE holds GROUP BY table_name"


def _inferred(t):
    return _union([keys.infer_key(df, n, PATTERNS) for n, df in _tables(t).items()])


@query("key_inference", _INFER_SQL)
def key_inference(t):
    return _inferred(t)


def _resolved(t):
    """Declared keys of the large tables, an inferred one that fails for nation, profiled keys for the rest."""
    tests = keys.pk_tests(_tables(t), CANDIDATES)
    profiled = _inferred(t).withColumnRenamed("key_column", "key_columns")
    rows = "table_name STRING, key_columns STRING"
    declared = t.spark.createDataFrame([("lineitem", "l_orderkey, l_linenumber"), ("orders", "o_orderkey")], rows)
    inferred = t.spark.createDataFrame([("nation", "n_regionkey"), ("customer", "c_custkey")], rows)
    return keys.resolve_keys(t.spark.createDataFrame([("region", "r_regionkey")], rows), declared, inferred, profiled, tests)


@query("key_resolution", f"""WITH pk AS ({_PK_SQL}), inf AS ({_INFER_SQL})
  SELECT r.table_name, r.key_columns, r.source, coalesce(pk.holds, FALSE) AS verified FROM (
    SELECT 'region' AS table_name, 'r_regionkey' AS key_columns, 'existing' AS source
    UNION ALL VALUES ('lineitem', 'l_orderkey, l_linenumber', 'declared'), ('orders', 'o_orderkey', 'declared'), ('customer', 'c_custkey', 'inferred')
    UNION ALL SELECT table_name, key_column, 'profiled' FROM inf WHERE table_name IN ('nation', 'supplier', 'part', 'events', 'documents')) r
  LEFT JOIN pk USING (table_name, key_columns)""")
def key_resolution(t):
    return _resolved(t)


@query("fk_discovery", f"""SELECT *, orphans = 0 AS verified FROM ({_ORPHAN_SQL}) WHERE parent_table NOT IN ('small_part')
  AND NOT (child_table = 'customer' AND parent_table = 'supplier')""")
def fk_discovery(t):
    found = written(_orphans(t), "orphans")
    return keys.resolve_foreign_keys(found.drop("orphans"), _resolved(t), found.drop("parent_column"))


@query("rules_from_keys", f"""WITH pk AS (SELECT * FROM ({_PK_SQL}) WHERE holds), fk AS (SELECT * FROM ({_ORPHAN_SQL}) WHERE orphans = 0),
  parts AS (SELECT table_name, unnest(string_split(key_columns, ', ')) AS c FROM pk)
  SELECT table_name, 'not_null' AS rule_type, c AS column_name, CAST(NULL AS VARCHAR) AS target, 'critical' AS severity, 'key' AS origin FROM parts
  UNION ALL SELECT table_name, 'unique', key_columns, NULL, 'critical', 'key' FROM pk
  UNION ALL SELECT child_table, 'references', child_column, parent_table || '.' || parent_column, 'warning', 'key' FROM fk""")
def rules_from_keys(t):
    primary = keys.pk_tests(_tables(t), CANDIDATES).where("holds")
    return keys.key_rules(primary, _orphans(t).where("orphans = 0")).drop("reason")


@query("fingerprint", """SELECT l_orderkey, left(sha256(CAST(COUNT(*) AS VARCHAR) || ':' || CAST(SUM(h) AS VARCHAR)), 12) AS fingerprint FROM (
    SELECT l_orderkey, CAST(CAST('0x' || left(sha256('{"p":"' || l_linenumber || '","l_partkey":"' || l_partkey || '","l_suppkey":"' || l_suppkey || '"}'), 15) AS BIGINT) AS HUGEINT) AS h
    FROM lineitem) GROUP BY l_orderkey""")
def fingerprint(t):
    return diff.fingerprint(t.lineitem, ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey"])
