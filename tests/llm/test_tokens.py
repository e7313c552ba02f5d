"""Token counts, token files and packing against the tokenizers library on whole texts."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm.encoding import Encoder, cut
from plumbline.llm.packing import TIERS, fill, packed
from plumbline.llm.tables import BYTES, WORDS, table, vocabulary
from plumbline.llm.token_counts import token_counts
from plumbline.llm.token_files import pack, read_token_files, token_digest, unpack, write_token_files
from plumbline.session import scratch

ODD = ["", "  ", "a  b", "a\n\nb", " a", "a ", "\n", "x<|endoftext|>y <|startoftext|> z's don't I'LL 12 3a é́ b", "a\x1c b", "İ ΣΑΣ ß\tq", "a᠎ b",
       "tab\t\n x", "word " * 9000, "x" * 20000]
ROWS = [(3, "Some words, again.", "s"), (3, "Some words, again.", "s"), (1, None, None), (None, "", "t"), (2, "long " * 4000, "t"), (7, "Ünï\n<|endoftext|>", "u")]
SCHEMA = "doc_id long, text string, n_tokens string"  # one column has a name that results use too


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def both(request):
    from tokenizers import Tokenizer
    return Encoder(vocabulary(request.param)), Tokenizer.from_file(vocabulary(request.param))


def library(tok, texts):
    return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_odd_texts(both):
    enc, tok = both
    want = library(tok, ODD)
    assert enc.counts(ODD) == [len(w) for w in want]
    assert [list(np.frombuffer(i, enc.code)) for i in enc.ids(ODD)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab éÀ'ß1 \n\t\x1c 　.,!<|>İ🙂́s"), max_size=60), max_size=20))
def test_any_texts(both, texts):
    enc, tok = both
    want = library(tok, texts)
    assert enc.counts(texts) == [len(w) for w in want]
    assert [list(np.frombuffer(i, enc.code)) for i in enc.ids(texts)] == want


def test_store_is_emptied_and_still_right(both, monkeypatch):
    enc, tok = both
    monkeypatch.setattr("plumbline.llm.encoding.KEPT", 3)
    texts = ["one two three four", "five, six! seven", "one two"]
    for _ in range(2):
        assert enc.counts(texts) == [len(w) for w in library(tok, texts)]


def test_cut_keeps_text():
    text = "ab cd\nef " * 9000
    assert "".join(cut(text, 100)) == text and len(cut(text, 100)) > 100


def test_counts(spark, folder):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary(BYTES))
    docs = table(spark, folder, "documents").unionByName(spark.createDataFrame(ROWS, SCHEMA).drop("n_tokens"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    counts = map(len, library(tok, [t for _, t in rows]))
    want = sorted((d or -1, len(t.encode()), n, n > 1024) for (d, t), n in zip(rows, counts))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, vocabulary(BYTES)).collect()) == want
    made = spark.createDataFrame(ROWS, SCHEMA)
    assert token_counts(made, vocabulary(BYTES)).count() == 6 and token_counts(made.limit(0), vocabulary(BYTES)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=300))
def test_codec_round_trip(ranks):
    control, data = pack(np.array(ranks, np.uint32))
    assert list(unpack(control, data, len(ranks))) == ranks
    assert len(control) == -(-len(ranks) // 4)


def test_codec_over_steps(monkeypatch):
    monkeypatch.setattr("plumbline.llm.token_files.STEP", 7)
    ranks = np.random.default_rng(1).integers(0, 70000, 999)
    assert (unpack(*pack(ranks), 999) == ranks).all()


@pytest.mark.parametrize("source", ["given", "made", "empty"])
def test_token_files(spark, folder, source, monkeypatch):
    from tokenizers import Tokenizer
    made = spark.createDataFrame(ROWS, SCHEMA)
    docs = {"given": table(spark, folder, "documents"), "made": made, "empty": made.limit(0)}[source]
    path = scratch(spark, "test-token-files")
    write_token_files(docs, path, vocabulary(WORDS))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(d, i + [1]) for (d, _), i in zip(rows, library(Tokenizer.from_file(vocabulary(WORDS)), [t or "" for _, t in rows]))]
    got = sorted(token_digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(d if d is not None else -1 for d, _ in want)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])][:len(got)]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(i), crc(i)) for d, i in want)
    assert read_token_files(spark, path).count() == len(want)
    counts = [r.n for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=60))
def test_fill_leaves_no_gap(lengths):
    out = fill(lengths)
    assert all(sum(n for _, _, n in held) == size and size & size - 1 == 0 for size, held in out)
    taken = sorted((p, first, n) for _, held in out for p, first, n in held)
    at = dict.fromkeys(range(len(lengths)), 0)
    for p, first, n in taken:
        assert first == at[p]
        at[p] += n
    assert list(at.values()) == lengths


def test_routes_to_tiers():
    sizes = [size for size, _ in fill([2048, 1024, 512, 256])]
    assert sorted(sizes) == sorted(TIERS)


@pytest.mark.parametrize("source", ["given", "made", "empty"])
def test_packing(spark, folder, source):
    from tokenizers import Tokenizer
    made = spark.createDataFrame(ROWS, SCHEMA)
    docs = {"given": table(spark, folder, "documents"), "made": made.where("not (doc_id <=> 3)"), "empty": made.limit(0)}[source]
    tok = Tokenizer.from_file(vocabulary(WORDS))
    every = docs.collect()
    ids = {r.doc_id: i + [1] for r, i in zip(every, library(tok, [r.text or "" for r in every]))}
    rows = packed(docs, vocabulary(WORDS), bin_tokens=20_000).collect()
    assert all(r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    for key, at, end in (("doc_id", "start", lambda r: r.doc_tokens), ("sequence_id", "offset", lambda r: r.tier)):
        groups = {}
        for r in rows:
            groups.setdefault(r[key], []).append(r)
        for group in groups.values():
            group.sort(key=lambda r: r[at])
            assert [r[at] for r in group] == [0, *np.cumsum([r.length for r in group])][:len(group)]
            assert group[-1][at] + group[-1].length == end(group[0])
        assert key != "doc_id" or set(groups) == set(ids)
    twice = packed(made, vocabulary(WORDS)).where("doc_id = 3").agg(F.sum("length")).first()[0]
    assert twice == 2 * (len(library(tok, [ROWS[0][1]])[0]) + 1)


def test_steps_of_whole_windows_are_of_equal_tokens(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', IF(id % 20 = 0, 2500, 1 + id % 9)) AS text").repartition(2)
    rows = packed(docs, vocabulary(WORDS), bin_tokens=20_000, step_tokens=4096).where("offset = 0").select("sequence_id", "tier", "step_id").collect()
    steps = {}
    for r in rows:
        steps.setdefault(r.step_id, []).append(r.tier)
    last = {s >> 32: max(t for t in steps if t >> 32 == s >> 32) for s in steps}  # of each bin, and of each task's windows
    assert len(rows) == len({r.sequence_id for r in rows}) and len(steps) > len(last)
    assert all(sum(tiers) == 4096 for s, tiers in steps.items() if s != last[s >> 32])
