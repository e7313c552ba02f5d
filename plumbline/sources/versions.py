"""Written versions of a keyed table with a digest per bucket of keys, so that two versions are compared without reading what is equal.

A version is a Parquet table split by a hash of its keys. Beside its rows lies one row per bucket: how many rows it holds, and the exact sums
of two 64-bit hashes of whole rows. Equal buckets have equal digests, whatever the order of their rows or files; buckets whose
digests differ are read, and only in these are keys compared.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import diff
from .sinks import table_at

BUCKETS = 256
DIGESTS = "_digests"  # readers of the rows pass over names that start so


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, columns: Sequence[str], bucket: str = "_bucket") -> DataFrame:
    """bucket, n, sum_1, sum_2 of the rows. A null counts as a value of its own, so it cannot move between columns unseen."""
    parts = [part for c in sorted(columns) for part in (F.col(c), F.col(c).isNull())]
    hashes = {"sum_1": F.xxhash64(*parts), "sum_2": F.xxhash64(F.lit(1), *parts)}
    return rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h.cast("decimal(20,0)")).alias(c) for c, h in hashes.items()])


def write_version(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Stores rows and digests. The digests come last, and are those of the stored rows: a version without them was not finished."""
    spark = rows.sparkSession
    dealt = rows.withColumn("_bucket", bucket_of(keys, buckets))
    dealt.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    digests = bucket_digests(stored, rows.columns).withColumn("buckets", F.lit(buckets)).withColumn("keys", F.lit(",".join(keys)))
    digests.coalesce(1).write.mode("overwrite").parquet(f"{path}/{DIGESTS}")


def changed_buckets(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> list[int]:
    """Buckets whose digests differ, of at most as many as the versions have. Both must be split alike, by these keys."""
    found = [table_at(spark, f"{path}/{DIGESTS}") for path in (old, new)]
    for path, digests in zip((old, new), found):
        if digests is None:
            raise ValueError(f"{path} is no finished version")
    layouts = {tuple(r) for digests in found for r in digests.select("buckets", "keys").distinct().collect()}
    if len(layouts) > 1 or any(layout[1] != ",".join(keys) for layout in layouts):
        raise ValueError(f"the versions are split differently: {sorted(layouts)}, asked by {','.join(keys)}")
    values = ["n", "sum_1", "sum_2"]
    differing = diff(*(digests.select("_bucket", *values) for digests in found), ["_bucket"], values)
    return sorted(r["_bucket"] for r in differing.select("_bucket").collect())


def read_buckets(spark: SparkSession, path: str, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets; folders of others are not opened."""
    return spark.read.parquet(path).where(F.col("_bucket").isin(list(buckets)))


def version_diff(spark: SparkSession, old: str, new: str, keys: Sequence[str], values: Sequence[str], loose_text: Sequence[str] = ()) -> DataFrame:
    """:func:`~plumbline.operators.diff.diff` of two written versions, from the buckets that differ alone."""
    changed = changed_buckets(spark, old, new, keys)
    return diff(read_buckets(spark, old, changed), read_buckets(spark, new, changed), keys, values, loose_text)
