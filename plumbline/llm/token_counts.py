"""Operator 10, token counts: batch encoding in an Arrow function that returns lengths only."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, texts
from .encoding import encoder
from .workers import arrow_map


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``) of every row's whole text.

    Rows are neither dropped nor merged: repeated rows give repeated results, a null doc_id stays null, a null or empty text has
    0 bytes and 0 tokens, an empty table gives an empty one, other columns are not read. Texts are encoded in calls of about equal
    bytes; long ones are split where no token crosses. Nothing is shuffled: scan splits are balanced by bytes already.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], pa.array(enc.counts(texts(part)), pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return (arrow_map(rows, count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
