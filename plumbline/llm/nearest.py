"""Operator 5, approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to length one, rotated by three rounds of random signs and a fast Hadamard transform, and hashed to the signed axis
it is nearest to; each of ``tables`` uses other signs. A query looks into the ``probes`` nearest axes of every table, and what it finds
there is ranked by exact inner products. Vectors of different lengths get one more coordinate that makes their lengths equal, so that
a large inner product is still a small angle.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .workers import arrow_map, importable

TABLES, PROBES, BLOCK = 16, 8, 2048
_FOUND = "query long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, up to a factor."""
    half = 1
    while half < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(x.shape)
        half *= 2
    return x


def rotated(x: np.ndarray, table: int, size: int) -> np.ndarray:
    out = np.zeros((len(x), size))
    out[:, :x.shape[1]] = x
    signs = np.random.default_rng(table)
    for _ in range(3):
        out = hadamard(out * signs.choice((-1.0, 1.0), size))
    return out


def axes(x: np.ndarray, table: int, size: int, most: int) -> np.ndarray:
    """The ``most`` signed axes nearest to each row, nearest first; equal ones in the order of their numbers."""
    turned = rotated(x, table, size)
    near = np.concatenate([turned, -turned], 1)
    if most == 1:
        return near.argmax(1)[:, None]
    return np.argsort(-near, axis=1, kind="stable")[:, :most]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _hashed(rows: DataFrame, tables: int, probes: int, size: int, longest: float | None) -> DataFrame:
    """A row per table and probe of (class, vector, ids), with table and axis. ``longest`` adds the coordinate that evens lengths out."""
    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch["vector"])
                if longest and probes == 1:
                    x = np.concatenate([x, np.sqrt(np.maximum(0.0, longest ** 2 - (x ** 2).sum(1)))[:, None]], 1)
                for t in range(tables):
                    axis = axes(x, t, size, probes)
                    rows = np.repeat(np.arange(len(x)), axis.shape[1])
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), t), pa.int32()), pa.array(axis.reshape(-1), pa.int32())],
                                                     [*part.schema.names, "table", "axis"])

    return arrow_map(rows, hash_rows, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", table int, axis int")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: an id, no missing or infinite component, not all zero, of the commonest dimension."""
    x = F.col("embedding")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & x.isNotNull()).where(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                                                           & F.exists("vector", lambda v: v != 0))
    top = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("vector") == (top["n"] if top else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every query, by inner product, ties to the smaller vec_id.

    ``is_query`` tells queries by their vec_id. Rows whose vector or id is missing, whose vector is zero, holds null or non-finite
    components or has another dimension than most, take no part. Equal vectors are one class: it is indexed once, with its ``k + 1``
    smallest ids, and a query asks once for all its equals, so a vector that a third of all rows hold costs as much as any other.
    Repeated rows count once. Queries that found fewer than ``k`` and than all other ids are compared with every class. Axes with many vectors or queries are searched in blocks of ``block`` by ``block``, so no task holds an axis.
    """
    importable(vectors.sparkSession)
    good = usable(vectors)
    keyed = written(good.select("vec_id", "vector", F.xxhash64("vector").alias("c1"), F.xxhash64(F.lit(5), F.col("vector")).alias("c2")), "ann-vectors")
    first = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))
    few = keyed.groupBy("c1", "c2", "vec_id").agg(F.first("vector").alias("vector")).withColumn("place", first).where(F.col("place") <= k + 1)
    classes = written(few.groupBy("c1", "c2").agg(F.min_by("vector", "place").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
                      .withColumn("class", F.monotonically_increasing_id()), "ann-classes")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    span = classes.agg(F.min(norm).alias("low"), F.max(norm).alias("high"), F.max(F.size("vector")).alias("n")).first()
    if span["n"] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = span["high"] if span["high"] > span["low"] * (1 + 1e-5) else None
    size = 1 << (span["n"] + bool(longest) - 1).bit_length()
    asking = keyed.where(is_query).select("vec_id", "c1", "c2").distinct().join(classes.select("c1", "c2", "class"), ["c1", "c2"])
    asking = written(asking.select(F.col("vec_id").alias("query_id"), "class"), "ann-queries")
    index = written(_hashed(classes.select("class", "vector", "ids"), tables, 1, size, longest), "ann-index")
    asked = written(_hashed(classes.select("class", "vector").join(asking.select("class").distinct(), "class", "left_semi"),
                            tables, min(probes, 2 * size), size, longest), "ann-probes")
    spot = ["table", "axis"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*spot).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    counts = blocks(index, "i").join(blocks(asked, "q"), spot)
    index = index.join(counts, spot).withColumn("i_block", F.pmod(F.xxhash64("class"), F.col("i"))).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q").cast("long") - 1)))
    asked = asked.join(counts, spot).withColumn("q_block", F.pmod(F.xxhash64("class"), F.col("q"))).withColumn("i_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i").cast("long") - 1)))
    key = [*spot, "i_block", "q_block"]

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query", "vec_id", "score"])
        asks, x, y = queries["class"].to_numpy(), _matrix(queries["vector"]), _matrix(rows["vector"])
        ids = rows["ids"].combine_chunks()
        lists, sizes = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(x), 256):
            near = x[a:a + 256] @ y.T
            if near.shape[1] > k + 1:
                least = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)]
                q, v = np.nonzero(near >= least[:, None] - 1e-9 * np.abs(least[:, None]))
            else:
                q, v = np.nonzero(np.ones_like(near, bool))
            exact = (x[a + q] * y[v]).sum(1)  # row by row: a pair has the same score in every block
            n = sizes[v]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(asks[a + q], n), lists[np.repeat(starts[v], n) + inside], np.repeat(exact, n)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "vec_id", "score"])

    def answers(queries: DataFrame, asked: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
        found = (asked.select(*key, "class", "vector").groupBy(*key)
                 .cogroup(index.select(*key, "class", "vector", "ids").groupBy(*key)).applyInArrow(search, _FOUND))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= 2 * k + 1)
        best = best.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        rows = queries.join(best.withColumnRenamed("query", "class"), "class").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    probed = written(answers(asking, asked, index, key), "ann-answers")
    owed = min(k, classes.select(F.explode("ids").alias("id")).distinct().limit(k + 1).count() - 1)
    enough = probed.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= owed) if owed > 0 else asking
    short = written(asking.join(enough.select("query_id"), "query_id", "left_anti"), "ann-short")
    i, q = (max(1, -(-n // block)) for n in (classes.count(), short.select("class").distinct().count()))
    if short.isEmpty():
        return probed
    every = classes.withColumn("i_block", F.pmod(F.xxhash64("class"), F.lit(i))).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q - 1).cast("long"))))
    asked = written(classes.select("class", "vector").join(short.select("class").distinct(), "class", "left_semi"), "ann-short-vectors")
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("class"), F.lit(q)))
    asked = asked.withColumn("i_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(i - 1).cast("long"))))
    exact = answers(short, asked, every, ["i_block", "q_block"])
    return probed.join(short.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(exact)
