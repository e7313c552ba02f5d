"""Operator 8, line dedup: levelled sorted runs of line hashes that batches are anti-joined with, and added to.

Lines are compared by a 128-bit hash of their key. Documents come in batches of descending doc_id. A batch's keys are anti-joined
with the runs: those not met before have their largest holder in this batch. New and known keys are then written as a run of level 0,
sorted by hash; when a level has ``fanout`` runs they are merged into one run of the next. The runs together say how many documents
hold a key, and which is the largest.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def key_hashes(lines: Column, shortest: int) -> Column:
    """The hash of every line's key; null where the key has fewer than ``shortest`` code points."""
    return F.transform(F.transform(lines, line_key),
                       lambda k: F.when(F.char_length(k) >= shortest, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(8), k).alias("h2"))))


class LineRuns:
    """Sorted runs of (h1, h2, n, keeper) in a shared folder, by level, oldest first."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in reversed(self.levels) for run in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        path = scratch(self.spark, f"line-run-{level}")
        rows.repartition(*HASH).sortWithinPartitions(*HASH).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.read.schema(rows.schema).parquet(path))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's (h1, h2, n, keeper), one row per key. Later batches hold smaller ids, so known keys keep their keeper.

        Runs are merged with whatever their size: broadcast, each would be a map of its own on the driver.
        """
        runs = self.runs()
        if runs:
            fresh = reduce(lambda batch, run: batch.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), runs, keys.select(*HASH))
            keys = keys.join(fresh.withColumn("fresh", F.lit(True)).hint("merge"), HASH, "left").select(
                *HASH, "n", F.when(F.col("fresh"), F.col("keeper")).alias("keeper"))
        self._write(keys, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._write(merged(self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def table(self) -> DataFrame | None:
        """Every key once, or None before the first batch."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else merged(runs) if runs else None


def merged(runs: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, runs)
    return every.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def repeated_keys(held: DataFrame, batches: int, fanout: int, least: int) -> DataFrame:
    """Keys held by at least ``least`` documents of (doc_id, keys), with the largest holder."""
    spark = held.sparkSession
    ends = held.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else []
    batch = sum(((F.coalesce(F.col("doc_id") <= e, F.lit(True))).cast("int") for e in (ends or [])), F.lit(0))
    # Rows of an id that stands once are a document each; the keys of a repeated id are made distinct first. Written, the ids have a known size.
    again = written(held.groupBy("doc_id").agg(F.count("doc_id").alias("n")).where("n > 1").select("doc_id"), "line-repeated-ids")

    def exploded(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", batch.alias("batch"), F.explode(F.array_distinct("keys")).alias("key")).where("key IS NOT NULL")

    rows = exploded(held.join(again, "doc_id", "left_anti")).unionByName(exploded(held.join(again, "doc_id", "left_semi")).distinct())
    keys = written(rows.groupBy("batch", "key.h1", "key.h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")), "line-keys")
    index = LineRuns(spark, fanout)
    for b in range(len(ends or []) + 1):
        index.add(keys.where(F.col("batch") == b).select(*HASH, "n", "keeper"))
    return index.table().where(F.col("n") >= least)


def line_dedup(docs: DataFrame, shortest: int = 40, least: int = 5, batches: int = 4, fanout: int = 4, carry: bool = False) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and text (the lines that stay) of every row; with ``carry`` also the whole row, as ``row``.

    Keys of at least ``shortest`` code points in at least ``least`` documents lose all their lines except in the largest doc_id that
    holds them. A null or empty text is one empty line, and stays. A null doc_id is smaller than all others; when only rows
    without an id hold a key, all keep it. Rows of one doc_id are one document, whatever their texts; rows without an id are one each. Rows
    equal in doc_id and text get the same result. An empty table gives an empty one. Texts are read once for hashes and once to drop lines; a key, however frequent, is folded
    to a row per task before it is shuffled, and only the rows of repeated keys are joined with their documents.
    """
    rows = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
                       F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    same = F.xxhash64("text").alias("same")
    held = written(rows.select("doc_id", same, key_hashes(lines_of("text"), shortest).alias("keys")), "line-hashes")
    repeated = written(repeated_keys(held, batches, fanout, least), "line-repeated")
    found = (held.select("doc_id", "same", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
             .select("doc_id", "same", "at", "key.h1", "key.h2").join(repeated, HASH)
             .where(~F.col("doc_id").eqNullSafe(F.col("keeper"))))
    drops = found.groupBy("doc_id", "same").agg(F.collect_set("at").alias("drops")).withColumnsRenamed({"doc_id": "d", "same": "s"})
    marked = rows.withColumn("same", same).join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s")), "left")
    split = marked.withColumn("lines", lines_of("text")).withColumn("n_lines", F.size("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.select(*(["row"] if carry else []), "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))


LINE_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY 1"""
