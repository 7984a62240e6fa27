"""Nearest neighbours against brute force: recall, exact scores, ties, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ann
from tallyforge.llm.ann import nearest, op1_ann, usable


def brute(ids, x, q, k=20):
    s = (x * x[ids == q]).sum(axis=1)
    s[ids == q] = -np.inf
    o = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
    return list(zip(ids[o].tolist(), s[o].tolist()))


def compare(rows, ids, x, least):
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, got in by.items():
        want = brute(ids, x, q)
        assert [g[0] for g in got] == list(range(1, len(want) + 1)) and q not in {g[1] for g in got}
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hit += len({g[1] for g in got} & {w[0] for w in want})
        total += len(want)
        for _, v, s in got:
            assert abs(s - float((x[ids == q][0] * x[ids == v][0]).sum())) < 1e-12
    assert hit >= least * total
    return by


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_query(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), dtype=np.float64)
    by = compare(op1_ann(spark, sf).collect(), ids, x, 0.9)
    assert set(by) == {i for i in ids if i % 20 == 0}


def test_recall_without_structure_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 40)
    monkeypatch.setattr(ann, "CHUNK", 7)
    monkeypatch.setattr(ann, "TASKS", 5)
    r = np.random.default_rng(0)
    x = r.normal(size=(5000, 32)).astype(np.float32)
    rows = nearest(usable(frame(spark, range(5000), x)), F.col("id") % 50 == 0).collect()
    compare(rows, np.arange(5000), x.astype(np.float64), 0.9)


def test_a_third_are_copies(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    by = compare(nearest(usable(frame(spark, range(900), x)), F.col("id") % 20 == 0).collect(), np.arange(900), x.astype(np.float64), 0.95)
    assert [v for _, v, _ in by[0]] == list(range(3, 63, 3))  # ties to the smaller id


def test_doubles_are_scored_as_doubles(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    compare(nearest(usable(df), F.col("id") % 20 == 0).collect(), np.arange(300), x, 0.95)


def test_clustered_vectors_need_few_lists(spark):
    r = np.random.default_rng(5)
    x = (r.normal(size=(60, 32))[r.integers(0, 60, 6000)] * 4 + r.normal(size=(6000, 32))).astype(np.float32)
    index = ann.Index(x[:3000], 78)
    assert index.probes(x[:3000], 20) < 40
    rows = nearest(usable(frame(spark, range(6000), x)), F.col("id") % 60 == 0).collect()
    compare(rows, np.arange(6000), x.astype(np.float64), 0.9)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.4, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    out = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(usable(df), F.col("id") % 20 == 0).collect())
    assert out == [(0, 1, 20, 1.0), (0, 2, 1, 0.4), (20, 1, 0, 1.0), (20, 2, 1, 0.4)]
    assert nearest(usable(df.filter("vec_id = 3")), F.lit(True)).collect() == []
    assert nearest(usable(df.filter("vec_id = 0")), F.lit(True)).collect() == []


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(kind, n, d):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, d))
    if kind == "tight clusters":
        return unit(unit(r.normal(size=(12, d)))[r.integers(0, 12, n)] + 0.01 * x)
    if kind == "clusters of all scales":
        return unit(unit(r.normal(size=(8, d)))[r.integers(0, 8, n)] + np.exp(r.uniform(-7, 0, (n, 1))) * x)
    if kind == "nearly the same":
        return unit(1 + 0.05 * x)
    if kind == "few long ones":
        x[r.choice(n, 40, replace=False)] *= 50
    if kind == "queries unlike the rest":
        x[::20, 4:] *= 0.02
    if kind == "no negative, many ties":
        return (x > 1.6) * 1.0 + (np.arange(d) == 0)
    if kind == "large":
        x *= 1e25
    if kind == "small":
        x *= 1e-25
    return x


@pytest.mark.parametrize("kind", ["tight clusters", "clusters of all scales", "nearly the same", "few long ones", "queries unlike the rest", "no negative, many ties", "large", "small"])
def test_nothing_near_is_missed(spark, monkeypatch, kind):
    for k, v in {"SAMPLE": 600, "BLOCK": 500, "CHUNK": 50}.items():
        monkeypatch.setattr(ann, k, v)
    n = 4000
    x = spread(kind, n, 32).astype(np.float32)
    rows = nearest(usable(frame(spark, range(n), x)), F.col("id") % 20 == 0).collect()
    got, y = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows}, x.astype(np.float64)
    want = {(q, i + 1): w for q in range(0, n, 20) for i, w in enumerate(brute(np.arange(n), y, q))}
    assert got.keys() == want.keys()
    assert np.allclose([got[k][1] for k in want], [w[1] for w in want.values()], rtol=1e-12, atol=0)
    assert sum(got[k][0] == w[0] for k, w in want.items()) >= 0.999 * len(want)  # sums in another order may swap neighbours


def test_small_steps_of_a_block(spark, monkeypatch):
    for k, v in {"SAMPLE": 300, "BLOCK": 200, "CHUNK": 9, "WINDOW": 30, "HELD": 100, "COMPONENTS": 200, "PROBES": 1}.items():
        monkeypatch.setattr(ann, k, v, raising=False)
    x = np.random.default_rng(8).integers(0, 3, size=(3000, 6)).astype(np.float32)  # many copies and exact ties
    x[:, 0] += 1
    by = compare(nearest(usable(frame(spark, range(3000), x)), F.col("id") % 60 == 0).collect(), np.arange(3000), x.astype(np.float64), 1)
    assert all([v for _, v, _ in got] == [v for v, _ in brute(np.arange(3000), x.astype(np.float64), q)] for q, got in by.items())


def test_copies_that_a_block_leaves_out():
    r = np.random.default_rng(9)
    x, ids = r.integers(0, 3, (2000, 4)).astype(np.float32), r.permutation(2000)
    assert ann._few_copies(x, ids, 7).tolist() == [i for i in range(2000) if ((x == x[i]).all(axis=1) & (ids < ids[i])).sum() < 7]
