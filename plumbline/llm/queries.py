"""The registered queries of the operators for training data and the pipeline, and the SQL some of them are checked with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .best_fit import best_fit_packed
from .jaccard_join import JACCARD_SQL, jaccard_classes
from .language_id import language
from .line_dedup import LINE_SQL, line_dedup
from .merkle import MERKLE_SQL, manifest, tampered
from .mixing import MIX_SQL, mixed
from .nearest import nearest
from .packing import packed
from .quality_classifier import quality_scores
from .quality_rules import judged
from .ranked_search import SEARCH_SQL, ranked_search
from .tables import BYTES, WORDS, table, vocabulary
from .token_counts import token_counts
from .token_files import token_digest, write_token_files


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("row")


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path, vocabulary(WORDS), end_id=1)
    return token_digest(spark, path)


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), vocabulary(WORDS), end_id=1)


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup(table(spark, folder, "documents"), shortest=40, least=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).drop("key")


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary(BYTES), limit=1024)


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packed(table(spark, folder, "documents"), vocabulary(BYTES), end_id=2, window=1024).drop("ids")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    stored = manifest(table(spark, folder, "documents"), scratch(spark, "merkle"), tampered())
    return stored.verified().withColumnRenamed("name", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_classifier, op2_quality_rules, op3_jaccard_join, op4_token_files, op5_nearest, op6_language_id, op7_packing, op8_line_dedup, op9_mixing, op10_token_counts,
             op11_best_fit_packing, op12_ranked_search, op13_merkle_manifest)
    return {q.__name__: q for q in every}


def oracles() -> dict[str, str]:
    return {"op3_jaccard_join": JACCARD_SQL, "op8_line_dedup": LINE_SQL, "op9_mixing": MIX_SQL,
            "op12_ranked_search": SEARCH_SQL, "op13_merkle_manifest": MERKLE_SQL}
