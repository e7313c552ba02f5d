"""Operator 6, language identification by partial matching: per-language byte contexts with escapes give exact code lengths.

For every language the bytes that follow each context of up to ``ORDER`` bytes are counted. A byte costs -log2(n / (total + kinds))
bits where its context knows it; elsewhere it costs the escape, -log2(kinds / (total + kinds)) bits, and what the context one byte
shorter says, down to 8 bits for any byte. Counts are frozen once learned. The language that needs the fewest bits is predicted.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .batches import slices
from .workers import arrow_map

ORDER = 3
PAD = b"\n" * ORDER  # before every text, so that its first bytes have a context
SAMPLE_DOCS, SAMPLE_CHUNKS, SAMPLE_BYTES = 600, 4, 1024  # learned from: documents of a language, evenly spaced parts of each
WINDOW = 1 << 20  # bytes coded at a time
SLOTS = 20  # bits of the table that finds a context


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each position from ORDER on, as one number."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for k in range(size):
        at = ORDER - size + 1 + k
        out = out << np.uint32(8) | data[at:at + len(out)]
    return out


class Known:
    """Sorted grams with a row of numbers each, found through a table of hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.table = np.zeros(1 << SLOTS, np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each gram, and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        row = self.table[self._slot(grams)]
        found = self.keys[row] == grams
        miss = np.flatnonzero(~found)  # unknown, or its slot holds another
        at = np.minimum(np.searchsorted(self.keys, grams[miss]), len(self.keys) - 1)
        row[miss], found[miss] = at, self.keys[at] == grams[miss]
        return row, found


class Model:
    """Code lengths of every known gram and escape of every known context, a column for each language."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        parts = {lang: np.frombuffer(b"".join(PAD + t for t in ts), np.uint8) for lang, ts in texts.items()}
        starts = {lang: np.cumsum([0] + [len(t) + ORDER for t in ts]) for lang, ts in texts.items()}
        self.codes: list[Known] = []
        self.escapes: list[Known] = []
        n = len(self.languages)
        for size in range(1, ORDER + 2):
            counted = []
            for lang in self.languages:
                inside = np.ones(max(0, len(parts[lang]) - ORDER), bool)
                for s in starts[lang][1:-1]:
                    inside[s - ORDER:s] = False  # the next text's padding is not coded
                counted.append(np.unique(_grams(parts[lang], size)[inside], return_counts=True))
            keys = np.unique(np.concatenate([k for k, _ in counted])) if n else np.zeros(0, np.uint32)
            contexts = np.unique(keys >> np.uint32(8)) if size > 1 else np.zeros(1, np.uint32)
            own = np.searchsorted(contexts, keys >> np.uint32(8)) if size > 1 else np.zeros(len(keys), np.int64)
            codes, escapes = np.zeros((len(keys), n)), np.zeros((len(contexts), n))
            below = self.codes[-1].values[np.searchsorted(self.codes[-1].keys, keys & np.uint32((1 << 8 * (size - 1)) - 1))] if size > 1 else np.full((len(keys), n), 8.0)
            for c, (k, count) in enumerate(counted):
                at = np.searchsorted(keys, k)
                total, kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
                np.add.at(total, own[at], count)
                np.add.at(kinds, own[at], 1)
                seen = kinds > 0
                escapes[seen, c] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                codes[:, c] = escapes[own, c] + below[:, c]
                codes[at, c] = -np.log2(count / (total[own[at]] + kinds[own[at]]))
            self.codes.append(Known(keys, codes.astype(np.float32)))
            self.escapes.append(Known(contexts, escapes.astype(np.float32)))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits each text takes in each language. Texts are coded in windows, each behind the ``ORDER`` bytes before it, so memory does
        not grow with a text."""
        total = np.zeros((len(texts), len(self.languages)))
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            text = PAD + text
            for at in range(0, len(text) - ORDER, WINDOW):
                owners.append(i)
                parts.append(text[at:at + ORDER + WINDOW])
                size += len(parts[-1])
                if size >= WINDOW:
                    np.add.at(total, owners, self._window_bits(parts))
                    owners, parts, size = [], [], 0
        if parts:
            np.add.at(total, owners, self._window_bits(parts))
        return total

    def _window_bits(self, parts: list[bytes]) -> np.ndarray:
        """Bits of each part in each language, without its first ``ORDER`` bytes."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        cost = np.zeros((len(data) - ORDER, len(self.languages)), np.float32)
        left = np.arange(len(cost))
        for size in range(ORDER + 1, 0, -1):
            grams = _grams(data, size)[left]
            row, found = self.codes[size - 1].find(grams)
            cost[left[found]] += self.codes[size - 1].values[row[found]]
            left, grams = left[~found], grams[~found]
            if not len(left):
                break
            row, found = self.escapes[size - 1].find(grams >> np.uint32(8))
            cost[left[found]] += self.escapes[size - 1].values[row[found]]
        cost[left] += 8
        ends = np.cumsum([len(p) for p in parts]) - ORDER
        return np.stack([cost[end - len(p) + ORDER:end].sum(0, dtype=np.float64) for p, end in zip(parts, ends)])


def held_out(doc_id: str) -> Column:
    """crc32(doc_id as text) mod 4 is 2. A missing id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, learn: Column, sample: int = SAMPLE_DOCS) -> Model:
    """A model of at most ``sample`` documents of each language, those whose id hashes lowest, and of some parts of each. A doc_id of
    several rows teaches by its least text in that language.

    Ids are dealt into groups; the ``sample``-th smallest of the groups' least hashes is reached by that many ids, so only ids up to it
    are ranked, about ``sample`` of a language however many rows it has.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(learn & F.col("lang").isNotNull() & (F.col("text") != ""))
    known = rows.select("lang", "id", F.xxhash64("id").alias("hash"))
    least = known.groupBy("lang", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(16 * sample)).alias("deal")).agg(F.min("hash").alias("least"))
    bound = least.groupBy("lang").agg(F.get(F.sort_array(F.collect_list("least")), F.lit(sample - 1)).alias("last"))
    near = (known.join(F.broadcast(bound), "lang")  # a row for each language, of which the model has a column each
            .where(F.col("last").isNull() | (F.col("hash") <= F.col("last"))).select("lang", "id", "hash").distinct())
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    ids = written(near.withColumn("first", first).where(F.col("first") <= sample).select("id", "lang"), "language-sample")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                data = text.lower().encode()
                pieces = max(1, len(data) // SAMPLE_BYTES)
                for k in sorted({round(p) for p in np.linspace(0, pieces - 1, SAMPLE_CHUNKS)}):
                    out.append((lang, data[k * SAMPLE_BYTES:(k + 1) * SAMPLE_BYTES]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())], ["lang", "part"])

    sampled = rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("lang", "id").agg(F.min("text").alias("text"))  # at most ``sample`` rows of each language
    texts: dict[str, list[bytes]] = {}
    for r in arrow_map(sampled.select("lang", "text"), take, "lang string, part binary").orderBy("lang", "part").collect():
        texts.setdefault(r.lang, []).append(bytes(r.part))
    return Model(texts)


def language(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its share of the likelihood) of every row, from its whole text alone.

    A text that is null or has no letters is ``und`` with score 0, as is every text when nothing could be learned. Equal code lengths
    go to the language first by code point. Repeated rows get equal answers; an empty table gives an empty one; a null doc_id stays.
    Held-out documents and those without a language teach nothing. Rows are scored where they are read: nothing is shuffled.
    """
    model = learned(docs, ~held_out("id"), sample)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in part["text"].to_pylist()]
                answers: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
                spoken = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model.languages else []
                if spoken:
                    bits = model.bits([texts[i].lower().encode() for i in spoken])
                    best = bits.argmin(1)
                    share = 1 / np.exp2(bits.min(1)[:, None] - bits).sum(1)
                    for i, b, s in zip(spoken, best, share):
                        answers[i] = model.languages[b], float(s)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array([a for a, _ in answers], pa.string()),
                                                  pa.array([s for _, s in answers], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, predict, "doc_id long, held_out boolean, lang_pred string, score double")
