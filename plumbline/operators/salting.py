"""An equality join whose frequent keys are split by measured frequency."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 100_000  # rows of a key that one task may take
MOST = 1_000     # keys that are split; the next most frequent one holds no more than a thousandth of all rows


def frequent(large: DataFrame, key: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """key, salts: the most frequent keys above ``least`` rows, at most ``most`` of them, and in how many shares each is split."""
    counted = large.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    return counted.orderBy(F.desc("_n"), key).limit(most).select(key, F.ceil(F.col("_n") / least).cast("int").alias("_salts"))


def salted_join(large: DataFrame, small: DataFrame, key: str, spread: Column, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Inner join on ``key``; rows of ``large`` that share a frequent key are dealt over shares by a hash of ``spread``, and the rows of
    ``small`` with that key are copied once per share. Null keys join nothing. What is broadcast has at most ``most`` rows."""
    hot = F.broadcast(frequent(large, key, least, most))
    shares = F.coalesce("_salts", F.lit(1))
    dealt = large.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), shares).cast("int")).drop("_salts")
    copied = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
