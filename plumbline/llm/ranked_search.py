"""Operator 12, ranked lexical search of many items at once, by common subexpressions.

Items share terms. Sets of terms that several items hold are mined, and sets those sets share, until no two hold three in common:
a query-sharing graph whose leaves are terms. For a batch of documents, each term's part of the score is a row of numbers, one per
document; the row of a shared set is summed once and every set and item above it adds that row instead of the set's terms.

Documents are read twice at most: once for their terms, which are written as postings of the items' terms alone, and once, from
these, for scores. Items are taken in blocks of about ``BLOCK_ITEMS``; what a block needs in every task follows from its items.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, written
from .batches import slices
from .workers import arrow_map

BLOCK_ITEMS = 256
LEAST_SHARED = 3  # a set of fewer terms saves no addition for two items
ROWS_BYTES = 32 << 20  # of score rows held for a batch of documents
PART = 1 << 20  # bytes of a text split at a time
# fixed values: digits, letters and everything beyond ASCII belong to a term; only A-Z are changed
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = "doc_id long, n long, terms binary, counts binary"
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])


def terms(text: bytes | None) -> Counter:
    """How often each term occurs in a text; a long text is split a part at a time."""
    found, at = Counter(), 0
    spaced = (text or b"").translate(_TERM_BYTES)
    while at < len(spaced):
        end = spaced.find(b" ", at + PART)
        end = len(spaced) if end < 0 else end
        found.update(spaced[at:end].split(b" "))
        at = end
    found.pop(b"", None)
    return found


def _term_lists(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int | None, Counter]]:
    for batch in batches:
        for some in slices(batch, "text"):
            for name, text in zip(some[key].to_pylist(), some["text"].to_pylist()):
                yield name, terms(text)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each. Rows that share an item_id are one item with the terms of all of them."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, found in _term_lists(batches, "item_id"):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([t.decode() for t in found], pa.string())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return arrow_map(rows, split, "item_id long, term string").distinct()


def share(items: list[list[int]], n_terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """The sharing graph: (parts of every shared set, parts of every item). Parts below ``n_terms`` are terms, the others shared sets.

    In every pass each set looks for the one it has most in common with; the largest common sets become sets of their own, in all
    that hold them whole, and each set takes part once a pass. Sets only hold sets listed before them.
    """
    used = Counter(t for item in items for t in item)
    columns = [t for t, k in used.items() if k > 1]
    place = {t: c for c, t in enumerate(columns)}
    table = np.zeros((len(items), len(columns)), np.float32)
    for i, item in enumerate(items):
        table[i, [place[t] for t in item if t in place]] = 1
    sizes = np.ones(len(columns))  # terms below a column
    while len(table) > 1:
        common = table @ table.T
        np.fill_diagonal(common, 0)
        best = common.argmax(axis=1)
        order = np.argsort(-common[np.arange(len(table)), best], kind="stable")
        free, new = np.ones(len(table), bool), []
        for i in order:
            j = best[i]
            if common[i, j] < LEAST_SHARED:
                break
            if not (free[i] and free[j]):
                continue
            held = table[i] * table[j]
            k = held.sum()
            if k < LEAST_SHARED:
                continue
            users = np.flatnonzero(free & (table @ held == k))
            free[users] = False
            new.append((held, users))
        if not new:
            break
        wide = np.zeros((len(table) + len(new), table.shape[1] + len(new)), np.float32)
        wide[:len(table), :table.shape[1]] = table
        for s, (held, users) in enumerate(new):
            wide[users, :table.shape[1]] *= 1 - held
            wide[users, table.shape[1] + s] = 1
            wide[len(table) + s, :table.shape[1]] = held
        sizes = np.concatenate([sizes, [float(held @ sizes) for held, _ in new]])
        table = wide
    # a set holds smaller ones only, or is nothing but one of the same size that was found later
    n = len(columns)
    ascending = sorted(range(len(table) - len(items)), key=lambda s: (sizes[n + s], -s))
    row_of = {n + s: n_terms + r for r, s in enumerate(ascending)}

    def parts(row: np.ndarray) -> list[int]:
        return [columns[c] if c < n else row_of[c] for c in np.flatnonzero(row).tolist()]

    own = [[t for t in item if t not in place] for item in items]
    return [parts(table[len(items) + s]) for s in ascending], [o + parts(table[i]) for i, o in enumerate(own)]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms with repeats), and which of the vocabulary's terms it holds, how often, of every document with a term."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, found in _term_lists(batches, "doc_id"):
            n = found.total()
            if not n:
                continue
            held = [(vocabulary[t], k) for t, k in found.items() if t in vocabulary]
            out.append((doc, n, np.array([t for t, _ in held], "<u4").tobytes(), np.array([k for _, k in held], "<u4").tobytes()))
            if len(out) == 2000:
                yield _columns(out)
                out = []
        if out:
            yield _columns(out)

    def _columns(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return arrow_map(rows, read, POSTINGS)


def _totals(postings: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and documents that hold each term of the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for some in slices(batch, "terms"):
                held += np.bincount(np.frombuffer(b"".join(some["terms"].to_pylist()), "<u4"), minlength=n_terms)
                docs += some.num_rows
                length += int(np.sum(some["n"].to_numpy()))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen]), pa.array([docs, length, *held[seen]])], ["term", "n"])

    rows = arrow_map(postings.select("n", "terms"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms of one block
    found = {r.term: r.n for r in rows}
    df = np.zeros(n_terms, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-1, 0), found.get(-2, 0), df


class _Best:
    """The ``k`` best documents of every item, batch after batch; ties go to the smaller doc_id, and one without an id comes last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, np.zeros((0, 4), np.int64)  # item, -score, no id, doc_id
        self.least = np.zeros(items, np.int64)  # the score a document must reach, and below which id at that score
        self.below = np.full(items, np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        item, at = np.nonzero((scores > self.least[:, None]) | ((scores == self.least[:, None]) & (ids < self.below[:, None])))
        if not len(item):
            return
        rows = np.concatenate([self.rows, np.stack([item, -scores[item, at], missing[at], ids[at]], axis=1)])
        rows = rows[np.lexsort(rows.T[::-1])]
        rank = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.least[last[:, 0]], self.below[last[:, 0]] = -last[:, 1], last[:, 3]


def _scored(postings: DataFrame, names: list[int | None], sets: list[list[int]], items: list[list[int]], weights: np.ndarray, docs: int, length: int,
            k: int) -> DataFrame:
    """item_id, doc_id, score and part of the ``k`` best documents of every task for every item."""
    n_terms = len(weights)
    width = max(16, min(4096, ROWS_BYTES // (8 * (n_terms + len(sets) + len(items) + 1))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items), k)
        rows = np.zeros((n_terms + len(sets), width), np.int64)
        out = np.zeros((len(items), width), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                some = batch.slice(start, width)
                held = some["terms"].to_pylist()
                term, tf = (np.frombuffer(b"".join(c), "<u4").astype(np.int64) for c in (held, some["counts"].to_pylist()))
                at = np.repeat(np.arange(len(held)), [len(h) // 4 for h in held])
                norm = 100 - 90 + (90 * some["n"].to_numpy() * docs) // length
                rows[:n_terms] = 0
                rows[term, at] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[at]))
                for s, parts in enumerate(sets):
                    rows[parts].sum(axis=0, out=rows[n_terms + s])
                for i, parts in enumerate(items):
                    rows[parts].sum(axis=0, out=out[i])
                ids = some["doc_id"]
                missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
                best.add(out[:, :len(held)], ids, missing)
        item, negative, missing, doc = best.rows.T
        part = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in item], pa.int64()), pa.array(doc, pa.int64(), mask=missing.astype(bool)),
                                          pa.array(-negative, pa.int64()), pa.array(part)], schema=_FOUND)

    return arrow_map(postings, score, "item_id long, doc_id long, score long, part int")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of every item's ``k`` best documents with a score above 0, of all documents.

    A document without a term (null, empty or only separators) counts for nothing and is never found; repeated rows are documents of
    their own; of equal scores the smaller doc_id comes first and a null one last. An item without a term finds nothing, rows that
    share an item_id (a null one too) are one item. Other columns are not read; empty tables give an empty result. All terms of a document
    are counted, however long it is. What reaches the driver and every task is the terms of one block of items, of which there
    are about ``BLOCK_ITEMS``. Tasks keep ``k`` documents per item, which are ranked by groups of tasks, then together.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items), "search-items")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // BLOCK_ITEMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    path = scratch(spark, "search-found")
    for b in range(blocks):
        rows = asked.where(F.col("block") == b).collect()
        vocabulary = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        of: dict[int | None, list[int]] = {}
        for r in rows:
            of.setdefault(r.item_id, []).append(vocabulary[r.term])
        postings = written(_postings(docs, {t.encode(): i for t, i in vocabulary.items()}), "search-postings")
        n, length, df = _totals(postings, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        names = sorted(of, key=lambda i: (i is not None, i))
        sets, parts = share([sorted(of[i]) for i in names], len(vocabulary))
        _scored(postings, names, sets, parts, weights, n, length, k).write.mode("append").parquet(path)
    found = spark.read.schema("item_id long, doc_id long, score long, part int").parquet(path)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", F.pmod("part", F.lit(64))], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


# Terms are counted by text, and every item's terms are joined with every document that holds one.
SEARCH_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
h AS (SELECT doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM h),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT doc_id, n, unnest(words) AS term FROM h),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
c AS (SELECT doc_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))) AS part FROM f JOIN g USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY 1, 2 HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= 10"""
