"""Freshness of tables and layers, status of tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import tenth_hours

# Operations of a change log that write data.
DATA_OPERATIONS = ("WRITE", "MERGE", "UPDATE", "DELETE", "TRUNCATE", "STREAMING UPDATE", "COPY INTO", "RESTORE",
                   "CREATE TABLE AS SELECT", "REPLACE TABLE AS SELECT", "CREATE OR REPLACE TABLE AS SELECT",
                   "CREATE MATERIALIZED VIEW", "REFRESH MATERIALIZED VIEW", "CREATE STREAMING TABLE")


def last_changes(changes: DataFrame, operations: Sequence[str] = DATA_OPERATIONS) -> DataFrame:
    """table_name, last_data_change from a change log (table_name, operation, changed_at)."""
    return (changes.where(F.upper("operation").isin(*[o.upper() for o in operations]))
            .groupBy("table_name").agg(F.max("changed_at").alias("last_data_change")))


def freshness(changes: DataFrame, limits: DataFrame, now: Column, operations: Sequence[str] = DATA_OPERATIONS,
              errors: DataFrame | None = None) -> DataFrame:
    """table_name, layer, last_data_change, age_hours, max_hours, stale, error.

    The age is rounded to a tenth before it meets the limit. Without a limit nothing is stale; with a limit, a table
    that never changed is, and so is one whose change log could not be read: ``errors`` (table_name, error).
    """
    if errors is not None:
        limits = limits.join(errors.select("table_name", "error"), "table_name", "left")
    else:
        limits = limits.withColumn("error", F.lit(None).cast("string"))
    age = tenth_hours(F.col("last_data_change"), now)
    stale = (F.when(F.col("max_hours").isNull(), False).when(F.col("last_data_change").isNull(), True)
             .otherwise(F.col("age_hours") > F.col("max_hours")))
    return (limits.join(last_changes(changes, operations), "table_name", "left").withColumn("age_hours", age)
            .select("table_name", "layer", "last_data_change", "age_hours", F.col("max_hours").cast("double").alias("max_hours"),
                    stale.alias("stale"), "error"))


def assess_layers(inventory: DataFrame, now: Column, minimum: int = 1, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Per layer: assets, below_minimum, age of the newest table, stale, and how many assets are unreadable, empty, undocumented.

    ``inventory``: layer, full_name, kind, row_count, last_updated, has_comment, readable.
    """
    limit = F.lit(None).cast("double")
    for layer, hours in (limits or {}).items():
        limit = F.when(F.col("layer") == layer, F.lit(float(hours))).otherwise(limit)
    newest = F.max(F.when(F.col("kind") == "table", F.col("last_updated")))
    grouped = inventory.groupBy("layer").agg(
        F.count(F.lit(1)).alias("assets"), newest.alias("newest_update"),
        F.count_if(~F.col("readable")).alias("unreadable"),
        F.count_if(F.col("readable") & (F.col("row_count") == 0)).alias("empty"),
        F.count_if(~F.col("has_comment")).alias("undocumented"))
    return (grouped.withColumn("below_minimum", F.col("assets") < minimum)
            .withColumn("age_hours", tenth_hours(F.col("newest_update"), now)).withColumn("limit_hours", limit)
            .withColumn("stale", F.coalesce(F.col("limit_hours") > 0, F.lit(False))
                        & F.coalesce(F.col("age_hours") > F.col("limit_hours"), F.lit(True))))


def table_status(inventory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows, last change, hours since and staleness per table and layer."""
    change = fresh.select(F.col("table_name").alias("full_name"), "last_data_change", "age_hours", "max_hours", "stale")
    return inventory.join(change, "full_name", "left").select(
        "layer", "full_name", "row_count", "last_data_change", "age_hours", "max_hours",
        F.coalesce("stale", F.lit(False)).alias("stale"))
