"""Units, best-fit packing, ranked search and the Merkle manifest against the library, brute force and SQL."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm.best_fit import best_fit_packed, plan, sequences
from plumbline.llm.merkle import Manifest, address, build, folded, levels_of, manifest, numbered, siblings, tampered
from plumbline.llm.ranked_search import BLOCK_ITEMS, item_terms, ranked_search, share
from plumbline.llm.tables import BYTES, WORDS, table, vocabulary
from plumbline.llm.units import units
from plumbline.session import scratch

ODD = ["", "  ", "a  b", "a\n\nb", " a", "a ", "\n", "x<|endoftext|>y <|startoftext|> z's don't I'LL 12 3a é́ b", "a\x1c b", "İ ΣΑΣ ß\tq", "a᠎ b",
       "tab\t\n x", "word " * 9000, "x" * 20000, "a×, b÷. é, é.'s", "<|ENDOFTEXT|> a<|endoftext|>b a<|startoftext|>'s", "a\nb\n c\n", None]
ROWS = [(3, "Some words, again.", "s"), (3, "Some words, again.", "s"), (1, None, None), (None, "", "t"), (2, "long " * 4000, "t"), (7, "Ünï\n<|endoftext|>", "u")]
SCHEMA = "doc_id long, text string, length string"


def library(name, texts):
    from tokenizers import Tokenizer
    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


# ---------------------------------------------------------------- units
@pytest.mark.parametrize("name", [BYTES, WORDS])
@pytest.mark.parametrize("window", [8 << 20, 50, 7])
def test_units_of_odd_texts(name, window, monkeypatch):
    monkeypatch.setattr("plumbline.llm.units.WINDOW", window)
    of = units(vocabulary(name))
    assert [np.frombuffer(i, of.enc.code).tolist() for i in of.ids(pa.array(ODD))] == library(name, ODD)
    assert [np.frombuffer(i, of.enc.code).tolist() for i in of.ids(pa.array(ODD)[5:])] == library(name, ODD[5:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab éÀ'ß1 \n\t\x1c 　.,!<|>İ🙂́sΣ×"), max_size=60), max_size=20))
def test_units_of_any_texts(texts):
    for name in (BYTES, WORDS):
        of = units(vocabulary(name))
        assert [np.frombuffer(i, of.enc.code).tolist() for i in of.ids(pa.array(texts, pa.string()))] == library(name, texts)


def test_unit_store_is_bounded(monkeypatch):
    monkeypatch.setattr("plumbline.llm.units.STORE_BYTES", 2000)
    monkeypatch.setattr("plumbline.llm.units.WINDOW", 100)
    of = units(vocabulary(BYTES))
    texts = [f"word{i} and 語{'語' * 300}{i}" for i in range(100)]  # lines without spaces are long units, which are not kept
    assert [np.frombuffer(i, of.enc.code).tolist() for i in of.ids(pa.array(texts))] == library(BYTES, texts)
    assert of.held < 8000 and max(map(len, of.store)) <= 200


# ---------------------------------------------------------------- best fit
def piecewise(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(window - n)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=80))))
def test_plan_is_best_fit(case):
    window, lengths = case
    held, entries = defaultdict(list), plan(Counter(lengths), window)
    for length, start, end, each, first, base in entries:
        for r in range(start, end):
            held[first + (r - start) // each].append((base + (r - start) % each * length, length))
    for one in held.values():
        one.sort()
        assert [at for at, _ in one] == [0, *np.cumsum([n for _, n in one])][:len(one)]
    assert sorted(window - sum(n for _, n in one) for one in held.values()) == piecewise(lengths, window)
    assert sorted(held) == list(range(len(held)))


def test_plan_does_not_grow_with_rows():
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 1 << 40) for n in range(1, 1025)}
    assert len(plan(counts, 1024)) < 2 * 1024 * (math.sqrt(2048) + 1)


@pytest.mark.parametrize("source", ["given", "made", "empty"])
def test_best_fit_packing(spark, folder, source):
    made = spark.createDataFrame(ROWS, SCHEMA)
    docs = {"given": table(spark, folder, "documents"), "made": made, "empty": made.limit(0)}[source]
    every = docs.collect()
    ids = [(r.doc_id, i + [2]) for r, i in zip(every, library(BYTES, [r.text for r in every]))]
    packed = best_fit_packed(docs.repartition(3), vocabulary(BYTES), window=256)
    rows = packed.collect()
    want = []
    for doc, i in ids:
        head = (len(i) - 1) % 256 + 1
        for piece, at in enumerate([0, *range(head, len(i), 256)]):
            part = i[at:at + 256 if at else head]
            want.append((doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), np.array(part, "<u2").tobytes()))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r[:6]) for r in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length, r.doc_id, bytes(r.ids)))
    for one in held.values():
        one.sort(key=lambda h: h[0])
        assert [h[0] for h in one] == [0, *np.cumsum([h[1] for h in one])][:len(one)]
    assert sorted(256 - sum(h[1] for h in one) for one in held.values()) == piecewise([w[3] for w in want], 256)
    joined = {r.sequence_id: (r.n_tokens, r.doc_ids, bytes(r.ids)) for r in sequences(packed).collect()}
    assert joined == {s: (sum(h[1] for h in one), [h[2] for h in one], b"".join(h[3] for h in one)) for s, one in held.items()}


def test_one_length_holds_most_pieces(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "three words here").otherwise(F.concat(F.lit("x "), F.col("id").cast("string"))).alias("text"))
    rows = best_fit_packed(docs.repartition(16), vocabulary(BYTES), window=64).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in rows) <= 64 and len(rows) <= sum(r.n for r in rows) / 64 * 1.05 + 1


# ---------------------------------------------------------------- ranked search
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def search(docs, items, k):
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in held:
            m = 100 - 90 + (90 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=lambda r: (r[0] is not None, r[0], r[1]))


DOCS = [(1, "alpha Beta beta, gamma"), (2, "alpha Beta beta, gamma"), (2, "alpha Beta beta, gamma"), (None, "alpha Beta beta, gamma"), (4, None), (5, " ,.\n"), (6, ""), (7, "Été ÉTÉ 9 alpha-9"),
        (8, "alpha " * 50_000 + "zeta"), (9, "beta " * 3)]
ITEMS = [(1, "ALPHA beta gamma zeta"), (2, "alpha beta gamma Été"), (2, "9 zeta"), (3, None), (None, "beta gamma alpha 9"), (5, "..."), (6, "nowhere"), (7, "alpha alpha beta gamma zeta")]


def test_search_of_made_rows(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit("x")), spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    for k in (2, 10):
        rows = [tuple(r) for r in ranked_search(docs.repartition(4), items, k).collect()]
        assert sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])) == search(DOCS, ITEMS, k)
    assert ranked_search(docs.limit(0), items).collect() == [] and ranked_search(docs, items.limit(0)).collect() == []


def test_search_of_given_rows_in_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr("plumbline.llm.ranked_search.BLOCK_ITEMS", 7)
    monkeypatch.setattr("plumbline.llm.ranked_search.ROWS_BYTES", 1 << 16)
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    got = [tuple(r) for r in ranked_search(docs, items).orderBy("item_id", "rank").collect()]
    assert got == search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), unique=True, max_size=20), max_size=25))
def test_shared_sets_give_back_the_items(items):
    sets, parts = share(items, 26)

    def whole(pieces, before):
        out = []
        for p in pieces:
            assert p < 26 + before  # a set holds sets listed before it
            out += [p] if p < 26 else whole(sets[p - 26], p - 26)
        return out

    assert [sorted(whole(p, len(sets))) for p in parts] == [sorted(i) for i in items]
    assert sum(map(len, sets)) + sum(map(len, parts)) <= sum(map(len, items))


def test_sharing_saves_additions(spark):
    items = item_terms(table(spark, "/root/testdata/check_s", "benchmark")).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
    place = {t: i for i, t in enumerate(sorted({t for r in items for t in r.terms}))}
    lists = [sorted(place[t] for t in r.terms) for r in items]
    sets, parts = share(lists, len(place))
    assert len(items) <= BLOCK_ITEMS and sets
    assert sum(map(len, sets)) + sum(map(len, parts)) < sum(map(len, lists))


# ---------------------------------------------------------------- Merkle manifest
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(row):
    """All levels of a tree, the leaves first."""
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 8, 13])
def test_layout(levels):
    places = [int(address(d, i, levels)) for d in range(levels) for i in range(1 << d)]
    assert sorted(places) == list(range((1 << levels) - 1)) and places[0] == 0
    for d in range(levels):
        assert address(d, np.arange(1 << d), levels).tolist() == [address(d, i, levels) for i in range(1 << d)]
    top = levels // 2
    if top:  # the upper half comes first, and each subtree below it lies in one stretch
        assert all(address(d, i, levels) < (1 << top) - 1 for d in range(top) for i in range(1 << d))
        below = (1 << levels - top) - 1
        for sub in range(1 << top):
            held = [address(top + d, (sub << d) + i, levels) for d in range(levels - top) for i in range(1 << d)]
            assert sorted(held) == list(range(min(held), min(held) + below))


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 9, 16])
def test_block(count):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(count)]
    want = climb([d.hex() for d in leaves])
    height = len(want) - 1
    root, nodes = build(leaves, height)
    rows = levels_of(nodes, count, height)
    assert rows == want and root.hex() == want[-1][0]
    assert all(folded(rows[0][i], siblings(rows, i)) == root.hex() for i in range(count))


def proof_rows(rows):
    """The contract's rows by brute force."""
    def digest(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = defaultdict(list)
    for r in rows:
        trees["" if r.lang is None else "=" + r.lang].append((r.doc_id if r.doc_id is not None else -1 << 63, digest(r.doc_id, r.source, r.lang, r.n_chars, r.text), r))
    grown = {t: climb([d for _, d, _ in sorted(held, key=lambda h: h[:2])]) for t, held in trees.items()}
    names = sorted(trees, key=lambda t: t.encode())
    over = climb([grown[t][-1][0] for t in names]) if names else []
    out = []
    for n, t in enumerate(names):
        for i, (_, leaf, r) in enumerate(sorted(trees[t], key=lambda h: h[:2])):
            start = leaf
            if r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0:
                start = digest(r.doc_id, r.source, r.lang, r.n_chars + 1, r.text)
            seen = []
            for at, levels in ((i, grown[t]), (n, over)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    seen.append(other)
                    start = sha(start + other if at % 2 == 0 else other + start)
                    at //= 2
            root = over[-1][0]
            out.append((r.doc_id, leaf, grown[t][-1][0], root, sha("".join(seen)), start, start == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
MADE = ([(i, f"text {i}", "en" if i % 3 else None, "s", i) for i in range(40)] + [(3, "same", "en", "s", 4)] * 3
        + [(None, "none", "en", None, 4), (50, None, "é", None, None), (51, "", "z", "s", 0), (52, "long " * 40_000, "", "", 200_000)])
MADE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_of_made_rows(spark, height):
    docs = spark.createDataFrame(MADE, MADE_SCHEMA).withColumn("tree", F.lit("x"))
    for df in (docs.repartition(5), docs.where("doc_id = 51"), docs.limit(0)):
        got = manifest(df, scratch(spark, "test-merkle"), tampered(), height).verified().withColumnRenamed("name", "doc_id").select(COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == proof_rows(df.collect())


def test_manifest_of_given_rows(spark, folder):
    docs = table(spark, folder, "documents")
    stored = manifest(docs, scratch(spark, "test-merkle"), tampered(), 3)
    got = stored.verified().withColumnRenamed("name", "doc_id").select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == proof_rows(docs.collect())
    assert len(stored.trees) > 1 and stored.root == got[0].root
    assert manifest(docs, scratch(spark, "test-merkle"), height=5).verified().where("verified").count() == docs.count()


def test_many_trees_and_equal_rows(spark):
    docs = spark.range(700).select((F.col("id") % 5).alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") > 300, "hot").otherwise(F.col("id").cast("string")).alias("lang"),
                                   F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    got = manifest(docs, scratch(spark, "test-merkle"), tampered(), 4).verified().withColumnRenamed("name", "doc_id").select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == proof_rows(docs.collect())


def test_numbers_span_ranges(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "a").otherwise("b").alias("tree"), (F.col("id") % 50).alias("k"))
    got = numbered(rows, ["k"]).collect()
    for tree, size in (("a", 400), ("b", 100)):
        of = sorted((r for r in got if r.tree == tree), key=lambda r: r.pos)
        assert [r.pos for r in of] == list(range(size)) and {r.size for r in of} == {size} and [r.k for r in of] == sorted(r.k for r in of)
    assert Manifest(spark, "", 3).root is None
