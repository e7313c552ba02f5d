"""Operator 13, a Merkle manifest of a dataset in van Emde Boas layout.

Leaves are digests of rows, in order, one tree per group; two neighbours become their hash, and a last one alone the hash of itself.
2^``HEIGHT`` consecutive leaves and everything above them are a block, stored as one row whose nodes lie in van Emde Boas order: the upper
half of the levels first, then each subtree below it, both laid out in the same way. Any path from a leaf to the block's root
thus crosses few stretches of it, whatever the size of a page. Block roots are the leaves of the next layer, until a tree is one
block; the roots of the trees are the leaves of one more such tree.

The address of a node follows from its depth and index alone. Construction writes to it, and siblings are read from it.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, written
from .workers import arrow_map, importable

HEIGHT = 12  # levels above the leaves of a block: 4,096 leaves, 256 KB of digests
SIZE = 32
BLOCK = "tree string, block long, size long, height int, root binary, nodes binary, names array<long>, claims array<binary>"
_NAMES = [f.split()[0] for f in BLOCK.split(", ")]
ALONE, RIGHT, LEFT = 0, 1, 2  # how a step of a path says where the sibling is


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def address(depth: int, index: int | np.ndarray, levels: int) -> int | np.ndarray:
    """Where node ``index`` of ``depth`` (0 is the root) lies in the layout of a complete tree of ``levels``."""
    at = 0 * index
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = levels - top
        at = at + (1 << top) - 1 + (index >> depth - top) * ((1 << below) - 1)
        index, depth, levels = index & (1 << depth - top) - 1, depth - top, below
    return at


@functools.cache
def _addresses(levels: int) -> list[np.ndarray]:
    return [address(d, np.arange(1 << d), levels) for d in range(levels)]


def build(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """Root and nodes, in layout order, of a block of at most 2^``height`` leaves. Places without a node are zero."""
    places = _addresses(height + 1)
    nodes = np.zeros((1 << height + 1) - 1, f"V{SIZE}")
    row = [d.hex() for d in leaves]
    for depth in range(height, -1, -1):
        nodes[places[depth][:len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), f"V{SIZE}")
        if depth:
            row = [H("".join(row[i:i + 2])) for i in range(0, len(row), 2)]
    return bytes.fromhex(row[0]), nodes.tobytes()


def levels_of(nodes: bytes, count: int, height: int) -> list[list[str]]:
    """The digests of a block by level, leaves first, read at their addresses."""
    table, places, out = np.frombuffer(nodes, f"V{SIZE}"), _addresses(height + 1), []
    for depth in range(height, -1, -1):
        row = table[places[depth][:count]].tobytes().hex()
        out.append([row[i:i + 2 * SIZE] for i in range(0, len(row), 2 * SIZE)])
        count = -(-count // 2)
    return out


def siblings(levels: list[list[str]], leaf: int) -> list[tuple[int, str]]:
    """(where, digest) of the sibling on each level below the block's root; no digest where a node is alone."""
    out = []
    for row in levels[:-1]:
        other = leaf ^ 1
        out.append((ALONE, "") if other >= len(row) else (RIGHT if other > leaf else LEFT, row[other]))
        leaf >>= 1
    return out


def folded(digest: str, path: list[tuple[int, str]]) -> str:
    for where, other in path:
        digest = H(digest + other if where == RIGHT else other + digest if where == LEFT else digest)
    return digest


def _steps(path: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([where]) + bytes.fromhex(other) for where, other in path)


def _path(steps: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    while at < len(steps):
        where = steps[at]
        end = at + 1 + (SIZE if where else 0)
        out.append((where, steps[at + 1:end].hex()))
        at = end
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (from 0 in its tree) and size (rows of the tree). Sorted by ranges; a tree, and rows that are equal, may span many of them."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    keys = ["tree", *order, "row"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for name in batch["tree"].to_pylist():
                tree, n = (tree, n + 1) if name == tree else (name, 0)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shard] * len(at), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "shard", "at"])

    schema = ", ".join(f"{n} {t}" for n, t in ranged.dtypes) + ", shard int, at long"
    placed = written(arrow_map(ranged, local, schema), "merkle-sorted")
    counts = placed.groupBy("tree", "shard").agg(F.count("*").alias("n"))
    earlier, whole = Window.partitionBy("tree").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    starts = counts.select("tree", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size"))
    return placed.join(starts, ["tree", "shard"]).withColumn("pos", F.col("start") + F.col("at")).drop("shard", "at", "start")


def _layer(rows: DataFrame, height: int, path: str) -> DataFrame:
    """The blocks over rows (tree, pos, size, digest, name, claim), written to ``path``."""
    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        first, size = group["pos"][0].as_py(), group["size"][0].as_py()
        own = height if size > 1 << height else (size - 1).bit_length()
        root, nodes = build(group["digest"].to_pylist(), own)
        values = [group["tree"][0].as_py(), first >> height, size, own, root, nodes, group["name"].to_pylist(), group["claim"].to_pylist()]
        return pa.table([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)

    importable(rows.sparkSession)
    blocks = (rows.select("tree", "pos", "size", "digest", "name", "claim", F.shiftright("pos", height).alias("block"))
              .groupBy("tree", "block").applyInArrow(block, BLOCK))
    blocks.write.parquet(path)
    return rows.sparkSession.read.schema(BLOCK).parquet(path)


_NO_CLAIM = "CAST(NULL AS BIGINT) AS name", "CAST(NULL AS BINARY) AS claim"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]


class Manifest:
    """Layers of blocks over the trees, and over their roots; ``root`` is the hex digest of all, None for an empty dataset."""

    def __init__(self, spark: SparkSession, path: str, height: int):
        self.spark, self.path, self.height, self.root = spark, path, height, None
        self.trees: list[DataFrame] = []
        self.forest: list[DataFrame] = []  # layers over the trees' roots, whose places ``order`` holds
        self.order: DataFrame | None = None

    def _layers(self, rows: DataFrame, name: str) -> list[DataFrame]:
        layers: list[DataFrame] = []
        while True:
            layers.append(_layer(rows, self.height, f"{self.path}/{name}/layer-{len(layers)}"))
            more = layers[-1].where(F.col("size") > 1 << self.height)
            if more.isEmpty():
                return layers
            size = f"shiftright(size + {(1 << self.height) - 1}, {self.height}) AS size"
            rows = more.selectExpr("tree", "block AS pos", size, "root AS digest", *_NO_CLAIM)

    def roots(self) -> DataFrame:
        """tree and root of every tree: of its only block in a layer."""
        tops = [layer.where(F.col("size") <= 1 << self.height).select("tree", "root") for layer in self.trees]
        return functools.reduce(DataFrame.unionByName, tops)

    def write(self, rows: DataFrame) -> Manifest:
        """Stores the trees over rows (tree, pos, size, digest, name, claim) and the tree over their roots, by ascending tree."""
        self.trees = self._layers(rows, "trees")
        tops = written(self.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), "merkle-roots")
        over = written(numbered(tops, ["of"]), "merkle-order")
        self.order = over.select("of", F.col("pos").alias("block"))
        self.forest = self._layers(over.selectExpr("tree", "pos", "size", "digest", *_NO_CLAIM), "roots")
        last = self.forest[-1].select("root").first()
        self.root = last.root.hex() if last else None
        return self

    def _below(self, layer: DataFrame, paths: DataFrame) -> DataFrame:
        """tree, pos, subroot and path of every entry of a layer's blocks, whose own (tree, block, subroot, path) is given."""
        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    count = min(1 << height, r["size"] - (r["block"] << height))
                    rows = levels_of(r["nodes"], count, r["height"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["tree"]] * count, pa.string()), pa.array(range(r["block"] << height, (r["block"] << height) + count), pa.int64()),
                         pa.array([r["subroot"]] * count, pa.string()), pa.array([_steps(siblings(rows, i)) + r["path"] for i in range(count)], pa.binary())],
                        ["tree", "pos", "subroot", "path"])

        height = self.height
        rows = layer.select("tree", "block", "size", "height", "nodes").join(paths, ["tree", "block"])
        return arrow_map(rows, expand, "tree string, pos long, subroot string, path binary")

    def block_paths(self) -> DataFrame:
        """tree, block, subroot and path (to the root of all) of every block of the lowest layer."""
        paths = self.forest[-1].select("tree", "block", F.lit("").alias("subroot"), F.lit(b"").alias("path"))
        for layer in reversed(self.forest):
            paths = self._below(layer, paths).withColumnRenamed("pos", "block")
        tops = paths.join(self.order, "block").select(F.col("of").alias("tree"), "path")
        paths = None
        for n, layer in reversed(list(enumerate(self.trees))):
            here = layer.where(F.col("size") <= 1 << self.height).select("tree", "block", F.lower(F.hex("root")).alias("subroot")).join(tops, "tree")
            paths = here if paths is None else here.unionByName(paths)
            if n:
                paths = written(self._below(layer, paths).withColumnRenamed("pos", "block"), "merkle-paths")
        return paths

    def verified(self) -> DataFrame:
        """Every leaf's name, digest, subroot, root, proof_sha256 (of all its siblings, left to right by level) and folded_root, from
        the claimed digest, or the stored one where none is claimed."""
        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    count = len(r["names"])
                    rows, above = levels_of(r["nodes"], count, r["height"]), _path(r["path"])
                    out = []
                    for i, (leaf, claim) in enumerate(zip(rows[0], r["claims"])):
                        path = siblings(rows, i) + above
                        out.append((leaf, r["subroot"], H("".join(s for _, s in path)), folded(claim.hex() if claim else leaf, path)))
                    yield pa.RecordBatch.from_arrays([pa.array(r["names"], pa.int64()), *(pa.array(c, pa.string()) for c in zip(*out))],
                                                     ["name", "leaf", "subroot", "proof_sha256", "folded_root"])

        blocks = self.trees[0].select("tree", "block", "height", "nodes", "names", "claims").join(self.block_paths(), ["tree", "block"])
        rows = arrow_map(blocks, prove, "name long, leaf string, subroot string, proof_sha256 string, folded_root string")
        return rows.withColumn("root", F.lit(self.root)).withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """The digest of a row: its values, each `-` if null, else UTF-8 length, `:` and value."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def manifest(docs: DataFrame, path: str, claimed: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of documents at ``path``: one tree per lang, by ascending doc_id; the trees by lang, null first.

    Leaves are digests of doc_id, source, lang, n_chars and text. A null doc_id comes first in its tree; rows that share a doc_id are
    ordered by digest, so rows that are repeated give the same manifest in any order; other columns are not read. ``claimed`` is another
    digest to verify instead of a row's own (null: its own). An empty table gives a manifest without root or rows. Texts are hashed
    where they are read; only digests are sorted, dealt and stored, at most 2^``height`` of them in one row.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claim = F.lit(None).cast("binary") if claimed is None else claimed
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("name"),
                         row_digest(*columns).alias("digest"), claim.alias("claim"))
    leaves = written(leaves, "merkle-leaves")
    return Manifest(docs.sparkSession, path, height).write(numbered(leaves, ["name", "digest"]))


def tampered() -> Column:
    """What the registered query claims: rows whose doc_id's crc32 seven divides have one character more in n_chars."""
    more = F.col("n_chars").cast("long") + 1
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(odd & F.col("n_chars").isNotNull(), row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))


# Levels grow by recursion; a leaf's siblings are looked up by level and place, and folded in order.
MERKLE_SQL = r"""WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '') AS tree,
    [coalesce(strlen(x) || ':' || x, '-') FOR x IN [CAST(doc_id AS VARCHAR), source, lang]] AS head, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS body,
    xor(list_reduce(flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 7 = 0 AS odd FROM documents),
l AS (SELECT doc_id, tree, sha256(array_to_string(head, '') || size || body) AS leaf,
    CASE WHEN odd THEN sha256(array_to_string(head, '') || more || body) ELSE sha256(array_to_string(head, '') || size || body) END AS claim FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p
    UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 2, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s
    UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
o AS (SELECT DISTINCT tree, level, n FROM t WHERE n > 1), v AS (SELECT DISTINCT level, n FROM u WHERE n > 1),
a AS (SELECT p.tree, p.pos, 0 AS part, o.level, ((p.pos >> o.level) & 1) AS odd, t.digest
    FROM p JOIN o ON p.tree = o.tree LEFT JOIN t ON t.tree = p.tree AND t.level = o.level AND t.pos = xor(p.pos >> o.level, 1)
    UNION ALL SELECT p.tree, p.pos, 1, v.level, ((s.pos >> v.level) & 1), u.digest
    FROM p JOIN s ON s.tree = p.tree CROSS JOIN v LEFT JOIN u ON u.level = v.level AND u.pos = xor(s.pos >> v.level, 1)),
b AS (SELECT tree, pos, list(CASE WHEN digest IS NULL THEN '-' WHEN odd = 1 THEN 'L' || digest ELSE 'R' || digest END ORDER BY part, level) AS steps,
    sha256(coalesce(string_agg(digest, '' ORDER BY part, level), '')) AS proof FROM a GROUP BY 1, 2),
r AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(b.proof, sha256('')) AS proof_sha256,
  list_reduce(coalesce(b.steps, []), lambda h, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || h) WHEN 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END, p.claim) AS folded_root,
  folded_root = r.root AS verified
FROM p JOIN s ON s.tree = p.tree CROSS JOIN r LEFT JOIN b ON b.tree = p.tree AND b.pos = p.pos"""
