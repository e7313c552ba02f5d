"""Quality rules on arrival: good rows, failing rows and counts per micro-batch."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import bad
from ..sources.sinks import table_at
from ..specs import ROW_RULES, Rule


def flagged(df: DataFrame, rules: Sequence[Rule], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Rows with ``_failed``, the ids of the rules they break: row rules and references to static tables."""
    marks = []
    for i, r in enumerate(rules):
        if r.type in ROW_RULES:
            marks.append(F.when(bad(r), F.lit(r.id)))
        elif r.type == "references":
            table, column = r.to.rsplit(".", 1)
            known = (tables or {})[table].select(F.col(column).alias(f"_p{i}")).where(F.col(f"_p{i}").isNotNull()).distinct()
            col = F.col(r.columns[0])
            df = df.join(known, col == F.col(f"_p{i}"), "left")
            marks.append(F.when(col.isNotNull() & F.col(f"_p{i}").isNull(), F.lit(r.id)))
        else:
            raise ValueError(f"{r.type} needs the whole table; check it in a batch run")
    helpers = [c for c in df.columns if c.startswith("_p") and c[2:].isdigit()]
    return df.withColumn("_failed", F.array_compact(F.array(*marks))).drop(*helpers)


def stream_quality(stream: DataFrame, rules: Sequence[Rule], out: str, checkpoint: str,
                   tables: Mapping[str, DataFrame] | None = None) -> None:
    """Store a stream's rows under ``out/rows`` in the parts ``good`` and ``quarantine`` and its counts under
    ``out/results``, then stop when all input is read.

    A batch is computed and written once, and counted from what was written. It overwrites its own folders, so a batch
    repeated after a failure leaves no second copy.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        folder = f"batch={batch_id}"
        part = F.when(F.size("_failed") > 0, "quarantine").otherwise("good")
        (flagged(batch, rules, tables).withColumn("part", part)
         .write.mode("overwrite").partitionBy("part").parquet(f"{out}/rows/{folder}"))
        stored = table_at(batch.sparkSession, f"{out}/rows/{folder}")
        if stored is None:
            return
        counts = stored.agg(F.count(F.lit(1)).alias("total"),
                            *[F.count_if(F.array_contains("_failed", r.id)).alias(f"f{i}") for i, r in enumerate(rules)])
        long = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col("total").alias("total_rows"),
                                  F.col(f"f{i}").alias("failed_rows")) for i, r in enumerate(rules)])
        counts.select(F.inline(long)).write.mode("overwrite").parquet(f"{out}/results/{folder}")

    (stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def stored_rows(spark: SparkSession, out: str, part: str) -> DataFrame:
    """Rows of all batches so far, ``good`` or ``quarantine``, with the rules they break."""
    return spark.read.parquet(f"{out}/rows").where(F.col("part") == part).drop("batch", "part")


def results(spark: SparkSession, out: str) -> DataFrame:
    """Counts per rule over all batches so far."""
    return (spark.read.parquet(f"{out}/results").groupBy("rule_id")
            .agg(F.sum("total_rows").alias("total_rows"), F.sum("failed_rows").alias("failed_rows")))
