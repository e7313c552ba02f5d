"""Landed CSV files: read as strings with their origin, skip what was loaded, log per file, check pending files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..operators import sketches
from ..session import few_or_merged, scratch, written
from ..specs import INGESTION_LOG
from .sinks import remove, table_at

MORE_COLUMNS = 8  # cells a record may have beside those of the first record met
ORIGIN = ("_source_file", "_ingest_ts", "_batch_id")


def with_origin(df: DataFrame, batch_id: str | Column) -> DataFrame:
    batch = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    return (df.withColumn("_source_file", F.col("_metadata.file_path"))
            .withColumn("_ingest_ts", F.current_timestamp())
            .withColumn("_batch_id", batch))


def unloaded(landed: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of files the log does not name. The log side is pruned to one column and never collected."""
    seen = log.select(F.col("source_file").alias("_source_file"))
    return landed.join(seen, "_source_file", "left_anti")


def log_files(loaded: DataFrame, source: str, run_id: str) -> DataFrame:
    """One row per file with that file's own row count (not the total of the source)."""
    return (loaded.groupBy(F.col("_source_file").alias("source_file"))
            .agg(F.count(F.lit(1)).alias("rows_loaded"), F.max("_ingest_ts").alias("loaded_at"))
            .select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), "source_file", "rows_loaded", "loaded_at"))


def new_files(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """path, _source_file of the landed files the log does not name; the files themselves are not opened."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("_source_file"))
    return unloaded(listed, log)


def csv_records(spark: SparkSession, paths: str | list[str], most: int, newlines: bool = True) -> DataFrame:
    """_source_file, at, cells: every record of the files, headers included, as an array of texts; ``at`` says where it stands.

    Quotes are read as CSV has them: a quoted cell may hold commas, doubled quotes and, with ``newlines``, line ends; a file is
    then read by one task. Without, large files are split. Of a record, ``most`` cells and the one after them are kept.
    """
    schema = ", ".join(f"c{i} STRING" for i in range(most + 1))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return _csv(spark, newlines).schema(schema).csv(paths).select(F.col("_metadata.file_path").alias("_source_file"), at.alias("at"),
                                                                  F.array(*[f"c{i}" for i in range(most + 1)]).alias("cells"))


def _csv(spark: SparkSession, newlines: bool) -> DataFrameReader:
    return spark.read.option("header", False).option("multiLine", newlines).option("escape", '"')


def _guess(spark: SparkSession, paths: str | list[str], newlines: bool) -> int:
    """How many cells the first record of one file has, and some more."""
    return len(_csv(spark, newlines).csv(paths).columns) + MORE_COLUMNS


def file_headers(records: DataFrame) -> DataFrame:
    """_source_file, header_row, names, rows: the columns of each file, by its first record, and the records after it.

    One aggregate of numbers that is folded in the tasks, however large the files are, then a join for one record of each: the files are
    written and broadcast where they are few, so that records are not shuffled to find a header.
    """
    first = F.min(F.when(F.col("at.block") == 0, F.col("at.row")))
    files = written(records.groupBy("_source_file").agg(first.alias("header_row"), (F.count(F.lit(1)) - 1).alias("rows")), "files")
    width = F.array_max(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1)))
    names = F.transform(F.slice("cells", 1, F.coalesce(width, F.lit(0))), lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("_c"), i.cast("string"))))
    heads = records.select("_source_file", F.col("at.row").alias("header_row"), names.alias("names"))
    return heads.join(few_or_merged(files), ["_source_file", "header_row"]).select("_source_file", "header_row", "rows", "names")


def with_names(records: DataFrame, headers: DataFrame, batch_id: str) -> DataFrame:
    """The records under the names of their own file's header, null where a file lacks a column. Only distinct column names come to the driver."""
    columns = sorted(r["name"] for r in headers.select(F.explode("names").alias("name")).distinct().collect())
    known = headers.select("_source_file", "header_row", "names")
    rows = records.join(known, "_source_file").where(F.col("at.row") != F.col("header_row"))
    cells = [F.get("cells", F.array_position("names", F.lit(c)).cast("int") - 1).alias(c) for c in columns]
    return rows.select(*cells, "_source_file", F.current_timestamp().alias("_ingest_ts"), F.lit(batch_id).alias("_batch_id"))


def check_headers(headers: DataFrame, table_columns: list[str]) -> DataFrame:
    """Per file: rows, columns the table has and the file lacks, and the other way round; ``blocked`` when it lacks any."""
    have = F.array(*[F.lit(c) for c in table_columns if not c.startswith("_")]).cast("array<string>")
    return (headers.select(F.col("_source_file").alias("source_file"), "rows", F.array_except(have, "names").alias("missing_columns"),
                           F.array_except("names", have).alias("new_columns"))
            .withColumn("blocked", F.size("missing_columns") > 0))


def _landed(spark: SparkSession, paths: list[str], newlines: bool) -> tuple[str, DataFrame, DataFrame]:
    """A work folder with the records and headers of files. Each file is opened once, and again only where one is far wider than the first."""
    most, work = _guess(spark, paths, newlines), scratch(spark, "landed")
    while True:
        found = csv_records(spark, paths, most, newlines)
        found.write.mode("overwrite").parquet(f"{work}/records")
        records = spark.read.schema(found.schema).parquet(f"{work}/records")
        file_headers(records).write.mode("overwrite").parquet(f"{work}/headers")
        headers = spark.read.parquet(f"{work}/headers")
        if headers.where(F.size("names") > most).isEmpty():
            return work, records, headers
        most *= 4


def read_new(spark: SparkSession, files: DataFrame, batch_id: str, newlines: bool = True) -> DataFrame | None:
    """The rows of the listed files (path) under the columns of all, or None without files. Only names of these files come to the driver."""
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return None
    _, records, headers = _landed(spark, paths, newlines)
    return with_names(records, headers, batch_id)


class BlockedFiles(ValueError):
    """Files that lack columns of their table."""


def load_new_files(spark: SparkSession, path: str, source: str, table_path: str, log_path: str, run_id: str,
                   columns: list[str] | None = None, newlines: bool = True, profiled: bool = False) -> DataFrame:
    """Store the rows of files not yet logged, then log the files; returns the log rows of this run.

    A pending file that lacks one of the table's ``columns`` ends the load before anything is stored; without ``columns`` those the
    table holds from other runs count. New files are opened once: their records are written to the work folder, and headers, counts, checks and
    rows are taken from there. Columns meet by name, new ones are added. A ``profiled`` load keeps the state of its rows' profile.

    A run owns one folder of the table and one of the log and overwrites them; what it loaded before does not count as
    loaded when it is repeated, so a repeat stores the same rows once. The log counts the stored rows. Rows of a run
    that died before its log are not read by :func:`bronze`, and their files are loaded by the next run.
    """
    mine = (F.col("run_id") == run_id) & (F.col("source") == source)
    paths = [r["path"] for r in new_files(spark, path, read_log(spark, log_path).where(~mine)).select("path").collect()]  # of new files
    if paths:
        work, records, headers = _landed(spark, paths, newlines)
        if columns is None:
            columns = _columns_of_others(spark, table_path, log_path, source, run_id)
        first = check_headers(headers, columns).where("blocked").select("source_file", "missing_columns").orderBy("source_file").first()
        if first is not None:
            remove(spark, work)
            raise BlockedFiles(f"{first['source_file']} lacks {', '.join(first['missing_columns'])}")
        folder = f"{table_path}/load=r-{run_id}"
        with_names(records, headers, run_id).write.mode("overwrite").parquet(folder)
        remove(spark, work)
        if profiled:
            sketches.write_state(spark.read.parquet(folder), folder, [c for c in spark.read.parquet(folder).columns if c not in ORIGIN])
        log_files(spark.read.parquet(folder), source, run_id).write.mode("overwrite").parquet(f"{log_path}/load=r-{run_id}-{source}")
    return read_log(spark, log_path).where(mine)


def _columns_of_others(spark: SparkSession, table_path: str, log_path: str, source: str, run_id: str) -> list[str]:
    """Columns of the table, by the loads of other runs that were logged."""
    runs = read_log(spark, log_path).where((F.col("source") == source) & (F.col("run_id") != run_id)).select("run_id").distinct()
    if runs.isEmpty():
        return []
    held = table_at(spark, table_path, mergeSchema="true")
    return [c for c in held.columns if c != "load"] if held is not None else []


def bronze(spark: SparkSession, table_path: str, log_path: str, run_id: str | None = None) -> DataFrame:
    """Loaded rows whose file and run are logged, with the columns of all loads (missing ones are null); or the rows of
    one run, read from its folder alone."""
    if run_id is None:
        rows = spark.read.option("mergeSchema", True).parquet(table_path).drop("load")
    else:
        rows = spark.read.parquet(f"{table_path}/load=r-{run_id}")
    logged = read_log(spark, log_path).select(F.col("run_id").alias("_batch_id"), F.col("source_file").alias("_source_file"))
    return rows.join(logged, ["_batch_id", "_source_file"], "left_semi")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    log = table_at(spark, log_path, INGESTION_LOG)
    return spark.createDataFrame([], INGESTION_LOG) if log is None else log.drop("load")


def pending_files(spark: SparkSession, path: str, table_columns: list[str], log: DataFrame, newlines: bool = True) -> DataFrame:
    """Per file not yet loaded: rows, columns the table has and the file lacks, and the other way round. Nothing is stored in the table."""
    paths = [r["path"] for r in new_files(spark, path, log).select("path").collect()]  # of new files
    if not paths:
        return check_headers(spark.createDataFrame([], "_source_file STRING, rows BIGINT, names ARRAY<STRING>"), table_columns)
    return check_headers(_landed(spark, paths, newlines)[2], table_columns)
