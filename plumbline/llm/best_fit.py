"""Operator 11, best-fit packing planned on the histogram of lengths.

How many pieces there are of each length, at most ``window`` numbers, is all that planning needs. Best fit decreasing runs over these
counts: sequences with the same contents are one entry of a plan, so the plan's size follows from the window and not from the table. Pieces
of a length are numbered by distributed counting, and a piece takes the slot of its number: length and rank are joined with the plan.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .batches import slices
from .encoding import encoder
from .units import units
from .workers import arrow_map

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, local long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("ids", pa.binary()), ("part", pa.int32()), ("local", pa.int64())])
SLOTS = "slot_length long, from_rank long, to_rank long, each long, first_sequence long, base long"
BATCH_BYTES = 8 << 20  # of text encoded at a time


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, window: int) -> DataFrame:
    """The pieces of every document, the first of which may be shorter than ``window`` where there are several.

    ``ids`` are packed as wide as the encoder packs them; ``local`` numbers a task's (``part``'s) pieces of one length.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, code, part = units(tokenizer), encoder(tokenizer).code, TaskContext.get().partitionId()
        width = np.dtype(code).itemsize
        end = b"" if end_id is None else np.array([end_id], code).tobytes()
        numbers = np.zeros(window + 1, np.int64).tolist()
        for batch in batches:
            for some in slices(batch, "text", BATCH_BYTES):
                out: list[tuple] = []
                for doc, ids in zip(some["doc_id"].to_pylist(), of.ids(some["text"])):
                    ids += end
                    n = len(ids) // width
                    head = (n - 1) % window + 1 if n else 0
                    for piece, at in enumerate([0, *range(head, n, window)] if n else []):
                        held = ids[at * width:(at + window if at else head) * width]
                        length = len(held) // width
                        crc = zlib.crc32(np.frombuffer(held, code).astype("<u4").tobytes())
                        out.append((doc, piece, at, length, crc, held, part, numbers[length]))
                        numbers[length] += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts by length: (length, first rank, end of ranks, pieces a sequence, first sequence, offset).

    A piece goes where the least room is left that holds it, into a new sequence where none does. Sequences in the same state stay
    together as a range, and a range takes as many pieces of a length as fit before the next one is looked at, which is what piece by
    piece would give. A length ends in the middle of at most one sequence, so it adds at most two ranges; a range holds fewer than
    sqrt(2 * window) + 1 different lengths. The plan therefore has fewer than 2 * window * (sqrt(2 * window) + 1) entries.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first sequence, sequences)
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, n, fits = 0, counts[length], length
        while rank < n:
            while fits < window and not room[fits]:
                fits += 1
            each = fits // length
            if room[fits]:
                first, many = room[fits].pop()
            else:  # only whole empty sequences are left: as many as the rest needs
                first, many = sequences, -(-(n - rank) // each)
                sequences += many
            full = min(many, (n - rank) // each)
            last = min(each, n - rank - full * each) if full < many else 0
            if full:
                out.append((length, rank, rank + full * each, each, first, window - fits))
                room[fits - each * length].append((first, full))
            if last:
                out.append((length, rank + full * each, rank + full * each + last, last, first + full, window - fits))
                room[fits - last * length].append((first + full, 1))
            if many > full + (last > 0):
                room[fits].append((first + full + (last > 0), many - full - (last > 0)))
            rank += full * each + last
    return out


def best_fit_packed(docs: DataFrame, tokenizer: str, end_id: int | None = 2, window: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (packed), sequence_id and offset.

    Every id of every row's whole text lies in one piece; only documents of more than ``window`` ids are cut. A null or empty text is a
    document of the end id alone (without an end id it has no row), a null doc_id stays null, repeated rows are packed each, other columns
    are not read, an empty table gives an empty result. Sequences hold at most ``window`` ids, gapless from offset 0. Texts are encoded once
    and their pieces written; a count per length reaches the driver. A length that a third of all pieces have is numbered by task.
    """
    table = written(pieces(docs, tokenizer, end_id, window), "packing-pieces")
    counts = written(table.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    slots = docs.sparkSession.createDataFrame(plan(total, window), SLOTS)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = table.join(earlier, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    # the plan is broadcast: its size is bounded by the window
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    nth = F.col("rank") - F.col("from_rank")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids",
                         (F.col("first_sequence") + F.expr("(rank - from_rank) div each")).alias("sequence_id"),
                         (F.col("base") + nth % F.col("each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and ids (packed, in order) of every sequence of :func:`best_fit_packed`."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("held")
    ids = F.aggregate("held", F.lit(b""), lambda a, h: F.concat(a, h["ids"]))
    return (packed.groupBy("sequence_id").agg(held)
            .select("sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + h["length"]).alias("n_tokens"),
                    F.col("held.doc_id").alias("doc_ids"), ids.alias("ids")))
