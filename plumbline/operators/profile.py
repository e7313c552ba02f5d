"""Column profiles: one scan for counts and bounds, one frequency table for distinct counts, values and top values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types whose minimum and maximum are shown, as metadata profiling and quality profiling define them.
METADATA_COMPARABLE = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp",
                       "timestamp_ntz", "string", "boolean")
QUALITY_COMPARABLE = tuple(t for t in METADATA_COMPARABLE if t not in ("string", "boolean"))


def comparable(dtype: str, kinds: Sequence[str] = METADATA_COMPARABLE) -> bool:
    return dtype.split("(")[0] in kinds


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value (as text, null counted), n. Folded in the map tasks, one shuffle for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, hidden: Sequence[str] = (), exact: bool = False,
            kinds: Sequence[str] = METADATA_COMPARABLE) -> DataFrame:
    """column_name, rows, nulls, null_fraction, distinct, min, max; hidden columns show no bounds.

    One scan with one row of partial state per task. ``exact`` replaces the approximate distinct counts by exact ones
    from :func:`value_counts`.
    """
    types = dict(df.dtypes)
    columns = [c for c in (columns or df.columns)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(c).alias(f"n{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
        if c not in hidden and comparable(types[c], kinds):
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = df.agg(*aggs)
    have = set(one.columns)

    def part(name, dtype):
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    nulls = [F.col("_rows") - F.col(f"n{i}") for i in range(len(columns))]
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), nulls[i].alias("nulls"),
        F.when(F.col("_rows") > 0, F.round(1 - F.col(f"n{i}") / F.col("_rows"), 4)).alias("null_fraction"),
        part(f"d{i}", "bigint").alias("distinct"), part(f"lo{i}", "string").alias("min"),
        part(f"hi{i}", "string").alias("max")) for i, c in enumerate(columns)])
    long = one.select(F.inline(rows))
    if not exact:
        return long
    counts = (value_counts(df, columns).where(F.col("value").isNotNull())
              .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct")))
    return (long.drop("distinct").join(counts, "column_name", "left")
            .select("column_name", "rows", "nulls", "null_fraction",
                    F.coalesce("distinct", F.lit(0).cast("bigint")).alias("distinct"), "min", "max"))


def _few_valued(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """The values of the columns that may have at most ``most`` of them, counted: one scan of sketches rules out those far above,
    with a wide margin, so that columns of unique values are never shuffled."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)]).first() if columns else []
    few = [c for c, n in zip(columns, counts) if n <= 2 * most + 8]
    return value_counts(df.select(*few), few) if few else value_counts(df.where(F.lit(False)).withColumn("_", F.lit("")), ["_"])


def _low(counts: DataFrame, most: int) -> DataFrame:
    present = counts.where(F.col("value").isNotNull())
    few = (present.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"))
           .where(F.col("distinct").between(1, most)))
    return present.join(few, "column_name")


def value_lists(df: DataFrame, columns: Sequence[str], most: int = 12, shown: int = 50) -> DataFrame:
    """column_name, distinct, values: the sorted values, as JSON, of columns with at most ``most`` of them.

    Values are gathered only after the count proved that there are few. ``most`` may not exceed ``shown``, so a list is never cut.
    """
    if most > shown:
        raise ValueError(f"lists of up to {most} values do not fit into {shown}")
    return (_low(_few_valued(df, columns, most), most).groupBy("column_name")
            .agg(F.max("distinct").alias("distinct"), F.array_sort(F.collect_list("value")).alias("_values"))
            .select("column_name", "distinct", F.to_json("_values").alias("values")))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, hidden: Sequence[str] = (), most: int = 25) -> DataFrame:
    """column_name, value, n of visible string columns with at most ``most`` values; hidden columns are never read."""
    types = dict(df.dtypes)
    shown = [c for c in (columns or df.columns) if c not in hidden and types[c] == "string"]
    return _low(_few_valued(df, shown, most), most).select("column_name", "value", "n")


def samples(df: DataFrame, key: Sequence[str], rows: int = 20, shown: int = 5, width: int = 60) -> DataFrame:
    """column_name, samples: first distinct values of the first rows by ``key``, cut to ``width`` characters and sorted."""
    few = df.orderBy(*key).limit(rows)
    aggs = [F.slice(F.array_sort(F.collect_set(F.substring(F.col(c).cast("string"), 1, width))), 1, shown).alias(c)
            for c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("samples")) for c in df.columns])
    return few.agg(*aggs).select(F.inline(pairs))
