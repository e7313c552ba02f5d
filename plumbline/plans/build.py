"""The whole build of a data product and a whole check run, from written tables to written tables."""
from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import freshness, medallion, quality
from ..session import written
from ..sources import landing, sinks
from ..specs import DQ_FRESHNESS, DQ_QUARANTINE, DQ_RESULTS, DQ_RUNS, Rule


# ---------------------------------------------------------------- landing to gold
def load_bronze(spark: SparkSession, landing_root: str, root: str, run_id: str) -> None:
    """Load every source's new files. A file that lacks a column of its bronze table ends the load of that source before a row is stored."""
    for raw, _, _ in medallion.SILVER.values():
        landing.load_new_files(spark, f"{landing_root}/{raw}", raw, f"{root}/bronze/raw_{raw}", f"{root}/bronze/ingestion_log", run_id)


def build_silver(spark: SparkSession, root: str, run_id: str | None = None, buckets: int | None = None) -> None:
    """Merge bronze into silver: everything, or what one run loaded, so that a small load costs what it holds."""
    for entity, (raw, key, _) in medallion.SILVER.items():
        table, log = f"{root}/bronze/raw_{raw}", f"{root}/bronze/ingestion_log"
        if run_id is not None and sinks.table_at(spark, f"{table}/load=r-{run_id}") is None:
            continue  # the run brought no file of this source
        rows = landing.bronze(spark, table, log, run_id)
        sinks.merge_into(spark, f"{root}/silver/{entity}", medallion.silver_rows(rows, entity), [key], F.current_timestamp(), buckets)


def build_gold(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The marts, written; the customer view, planned. Monetary sums and the fill rate get the declared precision."""
    s = {e: spark.read.parquet(f"{root}/silver/{e}").drop("_bucket", "_updated_at") for e in medallion.SILVER}
    orders = s["orders"]
    money, rate = "decimal(18,2)", "decimal(6,4)"
    # Shipments and returns take customer, product, region and price from their order.
    about = orders.select("order_id", "product_id", "region_code", "unit_price")
    marts = {
        "sales_daily": medallion.sales_mart(orders, s["product"], s["region"]).withColumn("revenue", F.col("revenue").cast(money)),
        "shipment_fill_daily": medallion.fill_mart(s["shipment"], about, s["product"], s["region"]).withColumn("fill_rate", F.col("fill_rate").cast(rate)),
        "returns_daily": medallion.returns_mart(s["returns"], about, s["product"], s["region"]).withColumn("returned_value", F.col("returned_value").cast(money))}
    for name, df in marts.items():
        df.write.mode("overwrite").parquet(f"{root}/gold/{name}")
    out = {name: spark.read.parquet(f"{root}/gold/{name}") for name in marts}
    out["customer_360"] = medallion.customer_view(s["customer"], s["region"], orders).withColumn("lifetime_revenue", F.col("lifetime_revenue").cast(money))
    return out


# ---------------------------------------------------------------- a check run
LOGS = {"dq_results": DQ_RESULTS, "dq_quarantine": DQ_QUARANTINE, "dq_freshness": DQ_FRESHNESS}


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = sinks.table_at(spark, f"{root}/{name}", LOGS.get(name, DQ_RUNS))
    return spark.createDataFrame([], LOGS.get(name, DQ_RUNS)) if found is None else found.drop("run")


def check_run(spark: SparkSession, root: str, run_id: str, now: dt.datetime, tables: Mapping[str, DataFrame], rules: Sequence[Rule],
              keys: Mapping[str, Sequence[str]], hidden: Mapping[str, Sequence[str]], changes: DataFrame, limits: DataFrame,
              finished: dt.datetime | None = None, rows: int = 100) -> DataFrame:
    """Start, results, quarantine, freshness, finish; returns the alerts.

    Every run owns its folder in each log and overwrites it, so a repeated run leaves one set of rows. Until its last
    write the run is unfinished, and readers keep seeing the one before.
    """
    def log(df, name, schema):
        stamp = df.select(F.lit(run_id).alias("check_run_id"), F.lit(now).alias("checked_at"), "*")
        names = [c.split()[0] for c in schema.split(", ")]
        for n in names:
            if n not in stamp.columns:
                stamp = stamp.withColumn(n, F.lit(None).cast("string"))
        stamp.select(*names).write.mode("overwrite").parquet(f"{root}/{name}/run=r-{run_id}")

    def state(end):
        run = spark.createDataFrame([(run_id, now, end)], DQ_RUNS)
        run.coalesce(1).write.mode("overwrite").parquet(f"{root}/dq_runs/run=r-{run_id}")

    state(None)
    found = written(quality.evaluate(tables, rules, keys=quality.shown_keys(tables, keys, hidden), rows=rows), "dq-found")
    log(found, "dq_results", DQ_RESULTS)
    log(quality.quarantine(tables, rules, keys, hidden, rows, found=found), "dq_quarantine", DQ_QUARANTINE)
    log(freshness.freshness(changes, limits, F.lit(now)), "dq_freshness", DQ_FRESHNESS)
    state(finished or now)
    runs = read_log(spark, root, "dq_runs")
    none = spark.createDataFrame([], "alert STRING")
    return quality.alerts(quality.latest(read_log(spark, root, "dq_results"), runs), quality.latest(read_log(spark, root, "dq_freshness"), runs), none)


def drop_old(spark: SparkSession, root: str, days: int, now: dt.datetime) -> None:
    """Remove the folders of runs older than ``days`` from the logs; the folders of other runs are not touched."""
    for name, time in (("dq_results", "checked_at"), ("dq_quarantine", "checked_at"), ("dq_freshness", "checked_at"), ("dq_runs", "started_at")):
        found = sinks.table_at(spark, f"{root}/{name}")
        if found is not None:
            runs = found.groupBy("run").agg(F.max(time).alias("newest"))
            kept = quality.retain(runs, "newest", days, F.lit(now)).select("run")
            for row in runs.join(kept, "run", "left_anti").collect():  # names of old runs
                sinks.remove(spark, f"{root}/{name}/run={row['run']}")
