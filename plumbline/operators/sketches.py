"""Column profiles that add up: one row of state per load, kept in the load's folder, and the profile of a table from these rows alone.

A state holds counts, bounds in the columns' own types and a HyperLogLog sketch of each column's values. States of loads are merged
exactly, but for the sketches, whose union is what one sketch over all rows would be. A new load is scanned once, by itself.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .profile import METADATA_COMPARABLE, comparable

PRECISION = 14  # of the sketches: 2^14 registers, a standard error below one percent
STATE = "_profile"  # readers of the rows pass over names that start so
SKETCHED = ("int", "bigint", "string", "binary")  # types Spark sketches as they are


def state(df: DataFrame, columns: Sequence[str] | None = None, hidden: Sequence[str] = (), kinds: Sequence[str] = METADATA_COMPARABLE) -> DataFrame:
    """One row: ``rows``, and of every column the values present, a sketch and, unless it is hidden or not comparable, its bounds."""
    types = dict(df.dtypes)
    out = [F.count(F.lit(1)).alias("rows")]
    for c in columns or df.columns:
        value = F.col(f"`{c}`")
        out += [F.count(value).alias(f"present_{c}"),
                F.hll_sketch_agg(value if types[c] in SKETCHED else value.cast("string"), PRECISION).alias(f"sketch_{c}")]
        if c not in hidden and comparable(types[c], kinds):
            out += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}")]
    return df.agg(*out)


def write_state(df: DataFrame, folder: str, columns: Sequence[str] | None = None, hidden: Sequence[str] = ()) -> None:
    """Keep the state of the rows of a folder beside them; written again when the folder is."""
    state(df, columns, hidden).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{STATE}")


def read_states(spark: SparkSession, table_path: str) -> DataFrame:
    """The states of all loads of a table, one row each; columns that came later are null in earlier ones."""
    return spark.read.option("mergeSchema", True).parquet(f"{table_path}/*/{STATE}")


def merged(states: DataFrame) -> DataFrame:
    """The state of all rows together, one row. Loads are folded where they are read."""
    def fold(name: str) -> Column:
        column = F.col(f"`{name}`")
        if name == "rows" or name.startswith("present_"):
            return F.coalesce(F.sum(column), F.lit(0)).alias(name)
        if name.startswith("sketch_"):
            return F.hll_union_agg(column, F.lit(False)).alias(name)
        return (F.min if name.startswith("min_") else F.max)(column).alias(name)

    return states.agg(*[fold(name) for name in states.columns])


def profile_of(whole: DataFrame) -> DataFrame:
    """column_name, rows, nulls, null_fraction, distinct (estimated), min, max, as text, of one state; as profiles of rows have them."""
    def part(kind: str, c: str) -> Column:
        name = f"{kind}_{c}"
        return F.col(f"`{name}`").cast("string") if name in whole.columns else F.lit(None).cast("string")

    columns = [n.removeprefix("present_") for n in whole.columns if n.startswith("present_")]
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("rows"), (F.col("rows") - F.col(f"`present_{c}`")).alias("nulls"),
        F.when(F.col("rows") > 0, F.round(1 - F.col(f"`present_{c}`") / F.col("rows"), 4)).alias("null_fraction"),
        F.coalesce(F.hll_sketch_estimate(f"`sketch_{c}`"), F.lit(0)).alias("distinct"), part("min", c).alias("min"), part("max", c).alias("max"))
        for c in columns])
    return whole.select(F.inline(rows))


def profile_of_loads(spark: SparkSession, table_path: str) -> DataFrame:
    """The profile of a table from the states its loads left; no row of the table is read."""
    return profile_of(merged(read_states(spark, table_path)))
