"""The given tables and vocabulary files the registered queries read."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
