"""Operator 4, token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A token folder holds two Parquet tables. ``vocabulary`` lists the ids by rank, the most frequent first. ``shards`` has one row per
block of documents, in document order: the first position of the block in its shard, the documents' ids and lengths, and two byte
strings. In ``data`` each rank takes 1 to 4 bytes, little-endian; ``control`` holds two bits per rank, four ranks a byte, lowest
bits first, with the number of bytes less one. Decoding looks the four lengths of each control byte up in a table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .batches import TEXT_BYTES, slices
from .encoding import encoder
from .units import units
from .workers import arrow_map

BLOCK = 1 << 18  # ids after which a block is closed
STEP = 1 << 16  # control bytes decoded at a time
QUAD = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
IDS = "doc_id long, ids binary"
_SHARDS = "shard int, block int, shard_start long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """doc_id and ids (packed, as wide as the encoder packs them) of every row; ``end_id`` closes each document."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = units(tokenizer)
        end = b"" if end_id is None else np.array([end_id], of.enc.code).tobytes()
        for batch in batches:
            for part in slices(batch, "text", 2 * TEXT_BYTES):
                ids = pa.array([i + end for i in of.ids(part["text"])], pa.binary())
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), encode, IDS)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2^32."""
    ranks = ranks.astype(np.uint32, copy=False)
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[:len(ranks)] = more
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    starts = np.cumsum(more + np.uint8(1), dtype=np.int64) - more - 1
    data = np.zeros(int(starts[-1]) + int(more[-1]) + 1 if len(ranks) else 0, np.uint8)
    data[starts] = ranks & 0xFF
    for k in (1, 2, 3):
        wide = np.flatnonzero(more >= k)
        data[starts[wide] + k] = ranks[wide] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block, decoded a bounded number of control bytes at a time."""
    out, at = np.empty(n, np.uint32), 0
    control, data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    for c in range(0, len(control), STEP):
        lengths = QUAD[control[c:c + STEP]].reshape(-1)[:n - 4 * c]
        ends = np.cumsum(lengths, dtype=np.int64)
        part = data[at:at + int(ends[-1])]
        starts = ends - lengths
        ranks = part[starts].astype(np.uint32)
        for k in (1, 2, 3):
            wide = np.flatnonzero(lengths > k)
            ranks[wide] |= part[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
        out[4 * c:4 * c + len(ranks)] = ranks
        at += int(ends[-1])
    return out


def _counted(batches: Iterator[pa.RecordBatch], code: str, size: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(size, np.int64)
    for batch in batches:
        for part in slices(batch, "ids"):
            counts += np.bincount(np.frombuffer(b"".join(part["ids"].to_pylist()), code), minlength=size)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encodes every row's whole text and writes the token folder at ``path``, documents in ascending doc_id order.

    A null or empty text is a document of the end id alone; a null doc_id comes first; rows that share a doc_id are ordered by a
    hash of their ids, so a rerun writes the same documents in the same order. Other columns are not read. An empty table gives a
    folder without documents. Texts are encoded once: ids are written, counted and then ranked. Only the vocabulary, whose size is
    the tokenizer's, passes the driver. Ids are sorted by range partitioning, with the hash and a row number splitting repeated keys.
    """
    enc = encoder(tokenizer)
    code, size = enc.code, max(enc.size, (end_id or 0) + 1)
    ids = written(encoded(docs, tokenizer, end_id), "token-ids")
    counted = arrow_map(ids.select("ids"), lambda b: _counted(b, code, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [(r, row.id, row.n) for r, row in enumerate(sorted(counted.collect(), key=lambda row: (-row.n, row.id)))]
    ids.sparkSession.createDataFrame(ranked, "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/vocabulary")
    rank_of = np.zeros(size, np.uint32)
    rank_of[[i for _, i, _ in ranked]] = [r for r, _, _ in ranked]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, number = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(i for _, i in held), code)
            control, data = pack(rank_of[every])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([[len(i) // width for _, i in held]], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["shard", "block", "shard_start", "doc_ids", "lengths", "control", "data"])

        width = np.dtype(code).itemsize
        for batch in batches:
            for d, i in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                held.append((d, i))
                size += len(i) // width
                if size >= BLOCK:
                    yield block()
                    start, number, held, size = start + size, number + 1, [], 0
        if held:
            yield block()

    order = ["doc_id", "same", "row"]
    ordered = (ids.select("doc_id", "ids", F.xxhash64("ids").alias("same"), F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids"))
    (arrow_map(ordered, blocks, _SHARDS).write.option("compression", "zstd").parquet(f"{path}/shards"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token folder: doc_id, shard, start (ids before it in its shard), ids (little-endian unsigned 32 bits)."""
    shards = spark.read.parquet(f"{path}/shards")
    words = {r.rank: r.id for r in spark.read.parquet(f"{path}/vocabulary").collect()}  # as many as the tokenizer has
    id_of = np.array([words[r] for r in range(len(words))], np.uint32)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], sum(row["lengths"]))].astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                for at in _runs(ends):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][at], pa.int64()), pa.array([row["shard"]] * (at.stop - at.start), pa.int32()),
                         pa.array(starts[at] + row["shard_start"], pa.int64()),
                         pa.array([ids[a:b].tobytes() for a, b in zip(starts[at], ends[at])], pa.binary())],
                        ["doc_id", "shard", "start", "ids"])

    return arrow_map(shards, decode, "doc_id long, shard int, start long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard and before, the number of ids in all shards before it. A row per shard: the only thing that meets in one task."""
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    totals = spark.read.parquet(f"{path}/shards").select("shard", lengths.alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, decoded from the files."""
    docs = read_token_files(spark, path).select("doc_id", "shard", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                                F.crc32("ids").alias("ids_crc32"))
    return (docs.join(shard_starts(spark, path), "shard")
            .select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def _runs(ends: np.ndarray) -> Iterator[slice]:
    """Consecutive documents of at most a few megabytes, or one."""
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES // 4, side="right")))
        yield slice(at, stop)
        at = stop
