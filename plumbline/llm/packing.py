"""Operator 7, hierarchical packing: documents are routed to tiers of context sizes, each tier is packed, the gaps of long windows
are filled from shorter tiers, and sequences are dealt into step groups of equal tokens.

Documents are cut into windows of the largest size as they are encoded; what is left of each is shorter than that and goes to the
smallest tier that holds it. These pieces are dealt into bins of about ``bin_tokens`` by a hash of their row, so a bin is small
whatever the table, and every bin is packed on its own.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .batches import slices, texts
from .encoding import encoder
from .workers import arrow_map, importable

TIERS = (256, 512, 1024, 2048)
BIN_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _crc(ids: bytes, code: str) -> int:
    return zlib.crc32(np.frombuffer(ids, code).astype("<u4").tobytes())


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, window: int) -> DataFrame:
    """Every document's whole windows, without ids, and what is left of it, with ids. ``part`` is the task, ``row`` counts its windows
    and, apart from them, its rests."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part_no, counted = encoder(tokenizer), TaskContext.get().partitionId(), [0, 0]
        width = np.dtype(enc.code).itemsize
        end = b"" if end_id is None else np.array([end_id], enc.code).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, ids in zip(part["doc_id"].to_pylist(), enc.ids(texts(part))):
                    ids += end
                    n = len(ids) // width
                    for at in range(0, n, window):
                        cut = ids[at * width:(at + window) * width]
                        length = len(cut) // width
                        whole = length == window
                        out.append((doc, at, length, _crc(cut, enc.code) if whole else None, n, None if whole else cut, part_no, counted[whole]))
                        counted[whole] += 1
                yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, r)) for r in out], schema=_CUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, encode, PIECE + ", ids binary, part int, row long")


_CUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                  ("ids", pa.binary()), ("part", pa.int32()), ("row", pa.int64())])
_OUT = (PIECE + ", sequence_id long, offset long, tier int, step_id long")


def fill(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Packs pieces into windows: (window size, [(piece, first id, ids)]) for each sequence.

    From the longest tier down, a window takes its longest waiting piece first; its gap takes the longest pieces of its own and
    shorter tiers that fit, and what still is open takes the head of the shortest waiting piece. Only the last windows of a bin
    can stay open; they are closed at the powers of two that add up to what is left.
    """
    # lengths -> waiting pieces as (piece, first id), by length; an index of lengths that still wait
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(max(tiers) + 1)]
    for p in sorted(range(len(lengths)), reverse=True):
        if lengths[p]:
            waiting[lengths[p]].append((p, 0))
    left, out = sum(lengths), []
    longest = max(tiers)
    below = [0, *tiers]
    for low, size in reversed(list(zip(below, tiers))):
        while True:
            while longest > low and not waiting[longest]:
                longest -= 1
            if longest <= low or left < size:
                break
            gap, held = size, []
            fits = longest
            while gap:
                fits = min(fits, gap)
                while fits and not waiting[fits]:
                    fits -= 1
                if fits:
                    p, first = waiting[fits].pop()
                    held.append((p, first, fits))
                    gap -= fits
                    continue
                n = gap + 1  # nothing fits whole: the shortest longer piece gives its head
                while not waiting[n]:
                    n += 1
                p, first = waiting[n].pop()
                held.append((p, first, gap))
                waiting[n - gap].append((p, first + gap))
                gap = 0
            left -= size
            out.append((size, held))
        longest = min(longest, max(tiers))
    rest = [(p, first, n) for n in range(max(tiers), 0, -1) for p, first in waiting[n]]
    while rest:  # fewer ids than the shortest window of each tier that still has pieces
        size = 1 << min(left.bit_length() - 1, max(tiers).bit_length() - 1)
        gap, held = size, []
        while gap:
            p, first, n = rest.pop()
            held.append((p, first, min(n, gap)))
            if n > gap:
                rest.append((p, first + gap, n - gap))
            gap -= min(n, gap)
        left -= size
        out.append((size, held))
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int | None = 1, tiers: tuple[int, ...] = TIERS, bin_tokens: int = BIN_TOKENS,
           step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (window size) and step_id.

    Every id of every row's whole text lies in one piece; a null or empty text is a document of the end id alone, a null doc_id
    stays null and repeated rows are packed each. Other columns are not read; an empty table gives an empty result. Sequences are
    full windows of a tier; what a bin has left over is cut at powers of two, so nothing is padded. Steps of ``step_tokens`` take
    sequences from the longest down, so all but the last of a bin, or of the whole windows of an encoding task, hold the same number of
    tokens. Encoded pieces are written once.
    """
    if any(t & t - 1 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    code, window = encoder(tokenizer).code, max(tiers)
    table = written(pieces(docs, tokenizer, end_id, window), "pieces")
    tails = table.where("ids IS NOT NULL")
    tokens = tails.agg(F.sum("length")).first()[0] or 0
    bins = max(1, -(-tokens // bin_tokens))

    def pack_bin(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("part", "ascending"), ("row", "ascending")])
        rows, width = group.to_pylist(), np.dtype(code).itemsize
        number, out, sequences = rows[0]["bin"], [], fill([r["length"] for r in rows], tiers)
        at = 0
        for s, (size, held) in enumerate(sorted(sequences, key=lambda q: -q[0])):
            offset = 0
            for p, first, n in held:
                r = rows[p]
                cut = r["ids"][first * width:(first + n) * width]
                out.append((r["doc_id"], r["start"] + first, n, _crc(cut, code), r["doc_tokens"], number << 32 | s, offset, size,
                            number << 32 | at // step_tokens))
                offset += n
            at += size
        names = [f.split()[0] for f in _OUT.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    importable(docs.sparkSession)
    short = (tails.withColumn("bin", F.pmod(F.xxhash64("part", "row"), F.lit(bins)))
             .select("bin", "doc_id", "start", "length", "doc_tokens", "ids", "part", "row").groupBy("bin").applyInArrow(pack_bin, _OUT))
    whole_id = F.shiftleft(F.col("part").cast("long") + bins, 32)
    whole = table.where("ids IS NULL").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", whole_id.bitwiseOR(F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(window).alias("tier"),
        whole_id.bitwiseOR(F.floor(F.col("row") / max(1, step_tokens // window))).alias("step_id"))
    return whole.unionByName(short)
