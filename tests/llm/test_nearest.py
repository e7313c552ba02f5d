"""Nearest neighbours against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.nearest import hadamard, nearest, usable
from plumbline.llm.tables import table

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k=20):
    ids, matrix = np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows])
    out = {}
    for i, v in zip(ids, matrix):
        if i % 20 == 0:
            out[int(i)] = sorted({(-s, j) for s, j in zip((matrix * v).sum(1), ids) if j != i})[:k]
    return out


def compare(df, **options):
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(usable(df).collect())
    assert set(got) == {q for q, w in want.items() if w}
    hits = 0
    for q, w in want.items():
        g = sorted(got.get(q, []))
        assert [x[0] for x in g] == list(range(1, len(w) + 1))
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)
        hits += len({x[1] for x in g} & {j for _, j in w})
    return hits / max(1, sum(map(len, want.values())))


def test_transform_is_orthogonal():
    h = hadamard(np.eye(8))
    assert (h @ h.T == 8 * np.eye(8)).all()


def test_recall(spark):
    assert compare(table(spark, "/root/testdata/sf0.01", "embeddings")) >= 0.9


@pytest.mark.parametrize("block", [7, 2048])
def test_lengths_copies_and_odd_rows(spark, block):
    r = np.random.default_rng(1)
    hot = [1.0, 2.0, 0.5, 0.0, -1.0]
    rows = [(i, [float(x) for x in r.normal(size=5) * r.uniform(0.1, 4)], "x") for i in range(200)] + [(i, hot, "x") for i in range(200, 320)]
    rows += [(400, None, "x"), (401, [0.0] * 5, "x"), (402, [1.0, None, 1.0, 1.0, 1.0], "x"), (403, [float("nan")] * 5, "x"), (420, [1.0, 2.0], "x"),
             (None, hot, "x"), (300, hot, "x"), (440, [float("inf")] * 5, "x"), (460, [], "x")]
    assert compare(spark.createDataFrame(rows, SCHEMA), block=block) >= 0.99


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and nearest(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_few_vectors_of_many_dimensions(spark, block):
    r = np.random.default_rng(3)
    rows = [(20 * i, [float(x) for x in r.normal(size=64)], "x") for i in range(21)]
    assert compare(spark.createDataFrame(rows, SCHEMA), block=block) == 1
    hot = [float(x) for x in r.normal(size=64)]
    rows = rows[:8] + [(1000 + i, hot, "x") for i in range(300)]
    assert compare(spark.createDataFrame(rows, SCHEMA), block=block) >= 0.9
