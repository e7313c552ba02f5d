"""Operator 1, quality classifier: zstandard dictionaries of good and bad labelled text, and the compressed size with each.

A text is compressed in short chunks, each with the dictionary of good and with that of bad text. The difference of the two sizes
over their sum is positive where good text is the better model; a logistic curve, fitted on labelled documents whose own text is
not in the dictionaries they are measured with, turns it into a probability.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .batches import slices
from .workers import arrow_map

CHUNK, LEVEL = 512, 6
SAMPLE_DOCS = 1500  # labelled documents of a class that are learned from
SAMPLE_CHUNKS, SAMPLE_BYTES = 2, 1024  # of such a document's text, evenly spaced over the whole of it
DICTIONARY = 1 << 20  # bytes of a dictionary


class Sizes:
    """Compressed sizes of texts with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if kind:
                kind.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        good, bad = (sum(len(c.compress(text[i:i + CHUNK])) for i in range(0, max(1, len(text)), CHUNK)) for c in self.compressors)
        return (bad - good) / (bad + good)


def _differences(rows: DataFrame, dictionaries: dict[int, tuple[bytes, bytes]]) -> DataFrame:
    """Adds diff to (id, tag, text); ``tag`` chooses the dictionaries."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {t: Sizes(*d) for t, d in dictionaries.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                diffs = [sizes[t].difference((x or "").encode()) for t, x in zip(part["tag"].to_pylist(), part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["id"], part["tag"], pa.array(diffs, pa.float64())], ["id", "tag", "diff"])

    return arrow_map(rows.select("id", "tag", "text"), measure, "id long, tag int, diff double")


def _known(labels: DataFrame, learn: Column) -> DataFrame:
    return (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id"))
            .agg(F.min("quality").cast("int").alias("quality")).where(learn))


def _sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> DataFrame:
    """id, quality, tag (the half it belongs to) and text of the labelled documents learned from: of each class those whose id hashes
    lowest. A doc_id of several rows teaches by its least text, so there is one row for each."""
    known = _known(labels, learn)
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(sample) for q in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).withColumn("tag", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return written(rows.where("text <> ''").join(F.broadcast(ids), "id").groupBy("id", "quality", "tag").agg(F.min("text").alias("text")), "labelled-sample")


def _chunks(sampled: DataFrame) -> list[tuple[int, int, bytes]]:
    """(quality, tag, bytes) of the chunks the dictionaries are made of."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, q, t, x in zip(*(batch[c].to_pylist() for c in ("id", "quality", "tag", "text"))):
                x = x.encode()
                pieces = max(1, len(x) // SAMPLE_BYTES)
                for k in sorted({round(p) for p in np.linspace(0, pieces - 1, SAMPLE_CHUNKS)}):
                    out.append((i, q, t, x[k * SAMPLE_BYTES:(k + 1) * SAMPLE_BYTES]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                                             ["id", "quality", "tag", "chunk"])

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    rows = arrow_map(sampled.select("id", "quality", "tag", "text"), take, "id long, quality int, tag int, chunk binary")
    return [(r.quality, r.tag, bytes(r.chunk)) for r in rows.orderBy(F.xxhash64("id"), "id", "chunk").collect()]  # at most 2 * SAMPLE_DOCS * SAMPLE_CHUNKS


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability that ``y`` is 1, by Newton steps with a small pull towards 0."""
    if not len(x):
        return 0.0, 0.0
    scale = float(x.std()) or 1.0
    rows, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-rows @ w))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(2), rows.T @ (weight * (p - y)) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(doc_id: str) -> Column:
    """crc32(doc_id as text) mod 3 is 1. A missing id is not held out, and no label belongs to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score (probability of quality 1) and predicted of every row, from its whole text alone.

    Learned from labels that are not held out, at most ``sample`` documents of each class and one row of each; contradicting labels count as 0. A null or
    empty text has no difference and gets the score of that. Repeated rows get equal scores, an empty table gives an empty one.
    Without labels every score is 0.5; with one class the curve leans to it. Rows are scored where they are read: nothing is shuffled.
    """
    sampled = _sampled(docs, labels, ~held_out("id"), sample)
    chunks = _chunks(sampled)

    def dictionary(quality: int, tags: tuple[int, ...]) -> bytes:
        return b"".join(c for q, t, c in chunks if q == quality and t in tags)[:DICTIONARY]

    other_half = {t: (dictionary(1, (1 - t,)), dictionary(0, (1 - t,))) for t in (0, 1)}
    fit = _differences(sampled, other_half).join(sampled.select("id", "quality"), "id").orderBy("id", "diff").collect()
    share = {r.quality: r["count"] for r in _known(labels, ~held_out("id")).groupBy("quality").count().collect()}
    good = np.array([r["quality"] for r in fit], float)
    weight = np.where(good == 1, share.get(1, 0) / max(1, good.sum()), share.get(0, 0) / max(1, (1 - good).sum()))  # classes as common as they are
    slope, offset = _logistic(np.array([r["diff"] for r in fit]), good, weight / max(1e-9, weight.mean() if len(weight) else 1))
    whole = {0: (dictionary(1, (0, 1)), dictionary(0, (0, 1)))}
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).alias("tag"), F.col("text").cast("string").alias("text"))
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("diff") + F.lit(offset))))
    return (_differences(rows, whole).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
