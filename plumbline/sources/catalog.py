"""Assets, constraints and tags as frames: selection by layer, inventory, key edges, sensitive columns."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import ASSET_INVENTORY


@dataclass(frozen=True)
class Layer:
    """Where a layer's assets live. A pattern with a dot is matched on ``schema.table``, else on ``table``."""

    name: str
    sources: tuple[str, ...]
    tables: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()


def glob_regex(pattern: str) -> str:
    parts = [".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern]
    return f"^{''.join(parts)}$"


def _any_match(patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        name = F.concat_ws(".", "schema_name", "table_name") if "." in p else F.col("table_name")
        out = out | name.rlike(glob_regex(p))
    return out


def select_assets(assets: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """Assets (catalog_name, schema_name, table_name, ...) that a layer selects, with their layer and full name."""
    source = F.concat_ws(".", "catalog_name", "schema_name")
    layer = None
    for spec in layers:
        taken = source.isin(*spec.sources)
        if spec.tables is not None:
            taken = taken & _any_match(spec.tables)
        if spec.exclude:
            taken = taken & ~_any_match(spec.exclude)
        layer = F.when(taken, spec.name) if layer is None else layer.when(taken, spec.name)
    return (assets.withColumn("layer", layer).where(F.col("layer").isNotNull())
            .withColumn("full_name", F.concat_ws(".", "catalog_name", "schema_name", "table_name")))


def catalog_assets(spark: SparkSession, catalog: str, schemas: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tables and columns of the declared schemas of the session catalog (catalog metadata only, no data is read)."""
    tables, columns = [], []
    for schema in schemas:
        for t in spark.catalog.listTables(f"{catalog}.{schema}"):
            if t.isTemporary:
                continue
            kind = "view" if t.tableType == "VIEW" else "table"
            tables.append((catalog, schema, t.name, kind, t.description is not None))
            columns += [(catalog, schema, t.name, c.name, c.dataType)
                        for c in spark.catalog.listColumns(f"{catalog}.{schema}.{t.name}")]
    base = "catalog_name STRING, schema_name STRING, table_name STRING"
    return (spark.createDataFrame(tables, f"{base}, kind STRING, has_comment BOOLEAN"),
            spark.createDataFrame(columns, f"{base}, column_name STRING, data_type STRING"))


def inventory(frames: Mapping[str, DataFrame], layers: Mapping[str, str], comments: Mapping[str, str] | None = None,
              kinds: Mapping[str, str] | None = None, changes: DataFrame | None = None) -> DataFrame:
    """One row per asset, in the columns of ASSET_INVENTORY; each count reads no column data.

    ``kinds`` names the assets that are not tables, ``changes`` (table_name, last_data_change) dates them.
    """
    comments, kinds = comments or {}, kinds or {}
    rows = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(layers.get(name)).alias("layer"), F.lit(name).alias("full_name"),
            F.lit(len(df.columns)).alias("column_count"), "row_count",
            F.lit(bool(comments.get(name))).alias("has_comment"), F.lit(True).alias("readable"),
            F.lit(kinds.get(name, "table")).alias("kind"), F.lit(None).cast("string").alias("error"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("last_updated", F.lit(None).cast("timestamp"))
    if changes is None:
        return rows
    # stacked and folded by name: the names of assets are constants, which a join would turn into a comparison of all pairs
    dated = changes.select(F.col("table_name").alias("full_name"), F.col("last_data_change").cast("timestamp").alias("last_updated"))
    every = rows.unionByName(dated, allowMissingColumns=True)
    folded = every.groupBy("full_name").agg(*[F.max(c).alias(c) for c in rows.columns if c != "full_name"])
    return folded.where(F.col("column_count").isNotNull())


def unreadable(spark: SparkSession, layer: str, name: str, error: str) -> DataFrame:
    """Inventory row of an asset whose read failed; union it with :func:`inventory`."""
    return spark.createDataFrame(
        [(layer, name, "table", 0, None, None, False, False, error)], ASSET_INVENTORY)


def fk_edges(referential: DataFrame, usage: DataFrame) -> DataFrame:
    """Single-column foreign keys: child column to parent column.

    ``referential``: constraint_name, unique_constraint_name. ``usage``: constraint_name, table_name, column_name,
    ordinal_position, position_in_unique_constraint. A constraint with several columns gives no edge.
    """
    # One row survives only where there was one, so any aggregate picks that row; the count is partial before the shuffle.
    child = (usage.groupBy("constraint_name")
             .agg(F.count(F.lit(1)).alias("parts"), F.min("table_name").alias("child_table"),
                  F.min("column_name").alias("child_column"),
                  F.min("position_in_unique_constraint").alias("position"))
             .where(F.col("parts") == 1).drop("parts"))
    parent = usage.select(F.col("constraint_name").alias("unique_constraint_name"),
                          F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"),
                          F.col("ordinal_position").alias("position"))
    return (child.join(referential.select("constraint_name", "unique_constraint_name"), "constraint_name")
            .join(parent, ["unique_constraint_name", "position"])
            .select("constraint_name", "child_table", "child_column", "parent_table", "parent_column"))


def sensitive_columns(tags: DataFrame, assets: DataFrame, values: Sequence[str]) -> DataFrame:
    """Tagged columns of tables (not views) whose tag value is one of the sensitive ones."""
    tables = assets.where(F.col("kind") == "table").select("table_name")
    return (tags.where(F.col("tag_value").isin(*values)).join(tables, "table_name", "left_semi")
            .select("table_name", "column_name", "tag_value"))
