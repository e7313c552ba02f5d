"""Operator 2, quality rules: a hashed n-gram log-likelihood ratio between trusted documents and the whole corpus.

Words and word pairs are hashed into ``buckets`` buckets. Two multinomials are counted, one over every document and one over trusted
documents; a document's score is the mean over its words and pairs of log p(trusted) - log p(corpus). A document scores
low when it is made of what trusted documents hardly hold. Only DataFrame functions are used.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed, written

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 1 << 14
TAIL, MARGIN = 0.005, 0.02


def words_of(text: str) -> Column:
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES, -1))


def with_base(rows: DataFrame) -> DataFrame:
    """Adds words, the counts of the base rules and base_failed to rows with a text that is not null."""
    rows = rows.withColumn("words", words_of("text")).withColumn("n_words", F.size("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.col("n_words") - 3),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))))
    rows = rows.withColumn("lines", lines).withColumn("windows", windows)
    repeats = F.size(F.array_distinct(F.transform("windows", lambda w: w["h"]))) < F.size("windows")
    rows = rows.withColumn("windows", F.when(repeats, F.sort_array("windows")))
    again = F.transform("windows", lambda w, j: F.when((w["h"] == F.get("windows", j - 1)["h"]) | (w["h"] == F.get("windows", j + 1)["h"]), w["i"]))
    rows = rows.withColumn("at", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("at", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - i, F.lit(3)))), F.lit(0), lambda a, n: a + n)
    return (rows.withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
            .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .withColumn("n_words", F.col("n_words").cast("long")).drop("lines", "windows", "at")
            .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def _features(buckets: int) -> Column:
    """Buckets of every word and every pair of neighbours."""
    def bucket(*parts):
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    return F.flatten(F.transform("words", lambda w, i: F.array(bucket(w), bucket(w, F.coalesce(F.get("words", i + 1), F.lit(""))))))


def _scored(rows: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds score, the mean ratio over words and pairs, to rows with words; null where there are none.

    The ratios are a scalar subquery: as a literal their text, hundreds of KB, would stand in every plan the driver makes and keeps.
    """
    table = rows.sparkSession.createDataFrame([(ratios,)], "ratios array<double>").scalar()
    total = F.aggregate(F.transform(_features(len(ratios)), lambda b: F.get("ratios", b)), F.lit(0.0), lambda a, r: a + r)
    return rows.withColumn("ratios", table).withColumn("score", F.when(F.size("words") > 0, total / (2 * F.size("words")))).drop("ratios")


def _low(scores: DataFrame, share: float) -> float | None:
    """The exact percentile of the scores, between its two neighbours: bins of a thousandth are counted, at most some ten thousand rows on
    the driver, and only the rows of the bins that hold the two are sorted out. Null without scores."""
    bins = scores.where("score IS NOT NULL").groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    total = sum(r.n for r in bins)
    if not total:
        return None
    at = share * (total - 1)
    below, held = 0, []
    for r in bins:
        if below + r.n > math.floor(at) and below <= math.ceil(at):
            held.append((r.bin, below, r.n))
        below += r.n
    start, n = held[0][1], sum(h[2] for h in held)
    within = scores.where(F.floor(F.col("score") * 1000).between(held[0][0], held[-1][0]))
    return within.agg(F.percentile("score", F.lit((at - start) / (n - 1) if n > 1 else 0.0))).first()[0]


def fitted(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """log p(trusted) - log p(corpus) of each bucket, and the score a document must reach.

    Counts are over all documents and, for the trusted side, over one half of all documents with ``quality`` 1. One half is added to each
    count, so every ratio is finite. The other half of the trusted documents sets the threshold, ``MARGIN`` below the score that all
    but ``TAIL`` of them reach. Labels are merged by id, however many there are, and the shuffles of either join go as it ends.
    Without trusted documents all ratios are 0. What passes the driver is as long as ``buckets``, or as there are bins of scores.
    """
    good = (labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good")).distinct()
            .withColumn("counts", F.pmod(F.xxhash64(F.lit(2), "good"), F.lit(2)) == 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    same = F.col("doc_id") == F.col("good")
    n, g = [0.5] * buckets, [0.5] * buckets
    with shuffles_removed(docs.sparkSession):
        counts = (rows.join(good.hint("merge"), same, "left").withColumn("words", words_of("text"))
                  .select("counts", F.explode(_features(buckets)).alias("bucket")).groupBy("bucket")
                  .agg(F.count("*").alias("n"), F.count_if("counts").alias("n_good")).collect())  # a row per bucket at most
        for r in counts:
            n[r.bucket] += r.n
            g[r.bucket] += r.n_good
        if sum(g) <= buckets / 2:
            return [0.0] * buckets, -MARGIN
        shift = math.log(sum(n)) - math.log(sum(g))
        ratios = [math.log(b) - math.log(a) + shift for a, b in zip(n, g)]
        other = rows.join(good.where("NOT counts").hint("merge"), same).withColumn("words", words_of("text"))
        low = _low(written(_scored(other, ratios).select("score"), "scores"), TAIL)
    return ratios, (low if low is not None else 0.0) - MARGIN


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """All columns of every row in a struct ``row``, doc_id, the base counts, base_failed, score (null without words) and kept.

    kept is false where the base rules fail and otherwise says whether the score reaches the threshold. A null or empty text has no
    words and fails the base rules. Rows are judged one by one: repeated rows and ties get equal verdicts, an empty table gives an
    empty one. Without trusted documents the base rules decide alone.
    """
    ratios, threshold = fitted(docs, labels, buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _scored(with_base(rows), ratios)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("words", "text")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept. The verdict stays above an explode: as a plain filter the optimizer would push it below
    the steps it is made of and evaluate them again for every word."""
    one = F.when(F.col("kept"), F.array("row"))
    return judged(docs, labels, **options).select(F.explode_outer(one).alias("row")).where("row IS NOT NULL").select("row.*")
