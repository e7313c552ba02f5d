"""Landed files as a stream: every file is loaded once, the stream checkpoint taking the place of the file log."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import read_new


def stream_bronze(spark: SparkSession, source: str, out: str, checkpoint: str, columns: list[str], batch_id: str,
                  files_per_trigger: int = 1000) -> None:
    """Load what has arrived since the last run and stop.

    The stream carries file names; a micro-batch reads at most ``files_per_trigger`` files by their headers, so columns may come in
    any order and columns nobody declared are kept. A declared column that no file of a batch has is null. A micro-batch owns one
    folder of the table and overwrites it, so a repeat stores its rows once.
    """
    def store(files: DataFrame, number: int) -> None:
        rows = read_new(spark, files, batch_id)
        if rows is not None:
            missing = {c: F.lit(None).cast("string") for c in columns if c not in rows.columns}
            rows.withColumns(missing).write.mode("overwrite").parquet(f"{out}/batch={number}")

    listed = (spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
              .option("maxFilesPerTrigger", files_per_trigger).load(source).select("path", F.col("_metadata.file_path").alias("_source_file")))
    query = listed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
