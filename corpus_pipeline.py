"""A training corpus from raw documents, stage by stage: each is written as Parquet and read back as the next one's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.jaccard_join import one_of_each
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import mix
from plumbline.llm.packing import packed
from plumbline.llm.quality_rules import accepted
from plumbline.llm.tables import WORDS, table, vocabulary
from plumbline.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that fail the base rules or look unlike trusted ones go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines that many documents share stay in one of them; n_chars follows the text."""
    kept = line_dedup(docs, carry=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("text")), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*[F.when(F.col("n_dropped") > 0, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of documents linked by a Jaccard similarity of 0.8 on five words, one stays."""
    return one_of_each(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as its source's target asks."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every token of the mix in full windows."""
    return packed(docs, vocabulary(WORDS), end_id=1)


STAGES = [("quality_rules", quality_rules), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("mixing", mixture), ("packing", packing)]
ORACLE_SQL = None  # hashes, tokenizers and connected components are not in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
