"""Writes: append with new columns, merge, overwrite, copy of one project's rows, additive schema differences."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.medallion import upsert
from ..session import scratch

BUCKETS = 64
LAYOUT = "_layout"  # readers of the rows pass over names that start so
# Names that mean the same base type.
TYPE_ALIASES = {"LONG": "BIGINT", "INTEGER": "INT", "SHORT": "SMALLINT", "BYTE": "TINYINT", "REAL": "FLOAT",
                "DEC": "DECIMAL", "NUMERIC": "DECIMAL", "VARCHAR": "STRING", "CHAR": "STRING", "BOOL": "BOOLEAN"}


def table_at(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame | None:
    """The parquet table at a path, or None where nothing was written yet."""
    reader = spark.read.options(**options)
    try:
        return (reader.schema(schema) if schema else reader).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_widening(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; a column only one side has is null on the other."""
    return existing.unionByName(new, allowMissingColumns=True)


def overwrite(df: DataFrame, path: str, schema=None) -> None:
    """Replace the content; an empty frame leaves an empty table with its columns."""
    (df if schema is None else df.to(schema)).write.mode("overwrite").parquet(path)


def _layout(spark: SparkSession, path: str, keys: Sequence[str], buckets: int | None) -> int:
    """The number of buckets a merged table was begun with, noted beside its rows; other keys or another number are refused."""
    noted = table_at(spark, f"{path}/{LAYOUT}")
    if noted is None:
        if table_at(spark, path) is not None:
            raise ValueError(f"{path} was not written by a merge")
        buckets = buckets or BUCKETS
        spark.createDataFrame([(buckets, list(keys))], "buckets int, keys array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/{LAYOUT}")
        return buckets
    number, by = noted.select("buckets", "keys").first()
    if by != list(keys) or buckets not in (None, number):
        raise ValueError(f"{path} is split by {', '.join(by)} into {number} buckets, not by {', '.join(keys)} into {buckets}")
    return number


def merge_into(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], stamp: Column | None = None,
               buckets: int | None = None, newest: str | None = None) -> None:
    """Upsert into a parquet table that is split into key buckets: only buckets the source touches are read and rewritten.

    A repeated source key is folded by ``newest`` or refused, also when the table is new. The merged buckets are written to the
    work folder before they replace the old ones, so a rerun after a failure merges the same rows again, to the same result.
    The first merge notes keys and ``buckets`` beside the rows; later ones use what is noted and refuse anything else.
    Readers may meet a merge half done; :func:`merge_table` swaps whole versions.
    """
    buckets = _layout(spark, path, keys, buckets)
    incoming = source.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
    if stamp is not None:
        incoming = incoming.withColumn("_updated_at", stamp)
    target = table_at(spark, path, mergeSchema="true")  # earlier merges may have brought columns
    if target is None:
        target = incoming.limit(0)
    touched = [r["_bucket"] for r in incoming.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
    work = scratch(spark, "merge")
    upsert(target.where(F.col("_bucket").isin(touched)), incoming, keys, newest=newest).write.parquet(work)
    # Rows of a bucket are brought together, and adaptive execution splits a bucket that is too large for one task.
    (spark.read.parquet(work).hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket").parquet(path))
    remove(spark, work)


def merge_table(spark: SparkSession, name: str, source: DataFrame, keys: Sequence[str], stamp: Column | None = None,
                buckets: int | None = None, newest: str | None = None, path: str | None = None) -> None:
    """Upsert into a table of the session's catalog that is bucketed and sorted by its keys; readers see whole versions only.

    ``name`` is a view over the version in force, and notes keys, buckets and version as its properties; later merges use what is
    noted and refuse other keys or numbers. The join with the source shuffles the source alone, into the table's buckets. The next
    version is written whole, then the view is replaced; the version before stays for queries that still read it, the one before that
    goes. A merge that fails leaves the view as it was, and its rerun writes the same version again. With a ``path`` versions lie under it.
    """
    noted = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()} if spark.catalog.tableExists(name) else None
    if noted is None:
        version, target, buckets = 0, None, buckets or BUCKETS
    else:
        version, number, by = int(noted["merge.version"]), int(noted["merge.buckets"]), noted["merge.keys"].split(",")
        if by != list(keys) or buckets not in (None, number):
            raise ValueError(f"{name} is bucketed by {', '.join(by)} into {number} buckets, not by {', '.join(keys)} into {buckets}")
        buckets, target = number, spark.table(f"{name}_v{version}")
    if stamp is not None:
        source = source.withColumn("_updated_at", stamp)
    dealt = source.repartition(buckets, *keys)  # the table's own buckets
    rows = upsert(dealt.limit(0) if target is None else target, dealt, keys, newest=newest)
    stored = f"{name}_v{version + 1}"
    spark.sql(f"DROP TABLE IF EXISTS {stored}")  # of a merge that failed
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", f"{path}/v{version + 1}") if path else writer).saveAsTable(stored)
    properties = ", ".join(f"'merge.{k}' = '{v}'" for k, v in (("version", version + 1), ("keys", ",".join(keys)), ("buckets", buckets)))
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ({properties}) AS SELECT * FROM {stored}")
    if version > 1:
        spark.sql(f"DROP TABLE IF EXISTS {name}_v{version - 1}")
        if path:
            remove(spark, f"{path}/v{version - 1}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save_table(df: DataFrame, name: str, *, bucket_by: str | None = None, buckets: int = 64, path: str | None = None) -> None:
    """Create or replace a table of the session's catalog, managed or at a path, bucketed when later joins share the key."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)


def save_view(spark: SparkSession, name: str, query: str) -> None:
    """Create or replace a view of the session's catalog over its tables."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")


def copy_history(source: DataFrame, target_columns: list[str], *, project: str | None = None,
                 runs: DataFrame | None = None) -> DataFrame:
    """Rows of one project, in the columns both tables have: by ``system``, else by the project's run ids."""
    shared = [c for c in target_columns if c in source.columns]
    if "system" in source.columns and project is not None:
        rows = source.where(F.col("system") == project)
    elif "run_id" in source.columns and runs is not None:
        rows = source.join(runs.select("run_id"), "run_id", "left_semi")
    else:
        raise ValueError("the table has neither a system nor a run_id to select rows by")
    return rows.select(*shared)


def copy_into_empty(rows: DataFrame, target: DataFrame, path: str) -> None:
    if not target.isEmpty():
        raise ValueError(f"{path} already has rows; copy only into an empty table")
    rows.write.mode("append").parquet(path)


def base_type(column):
    """Type name without precision or spelling variants."""
    name = F.upper(F.regexp_extract(column, r"^\s*(\w+)", 1))
    known = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def schema_diff(want: DataFrame, have: DataFrame) -> DataFrame:
    """Declared against live columns (table_name, column_name, data_type): create, add or warn.

    Live tables and columns nobody declared are left alone, so they give no row.
    """
    tables = have.select("table_name").distinct().withColumn("_live", F.lit(True))
    live = have.select("table_name", "column_name", F.col("data_type").alias("live_type"))
    joined = (want.join(live, ["table_name", "column_name"], "left")
              .join(tables, "table_name", "left"))
    action = (F.when(F.col("_live").isNull(), "create")
              .when(F.col("live_type").isNull(), "add")
              .when(base_type(F.col("live_type")) != base_type(F.col("data_type")), "warn"))
    return (joined.withColumn("action", action).where(F.col("action").isNotNull())
            .select("table_name", "column_name", "data_type", "live_type", "action"))
