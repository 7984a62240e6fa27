"""The language model: base scores, exact likelihoods, Baum-Welch counts, normalisation and gain on held-out texts."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hmm
from tallyforge.llm.hmm import Model, op2_hmm, score


def model(k=3, c=5, seed=0):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return Model(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((c, k)), 0))


def likelihood(m, seq):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[o, b]
        total += p
    return total


def test_forward_sums_over_all_paths():
    m, r = model(), np.random.default_rng(1)
    seqs = [r.integers(0, 5, n) for n in (1, 6, 3, 5, 1)]
    got = m.log10(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    assert np.allclose(got, [math.log10(likelihood(m, s)) for s in seqs])


def test_expected_counts_and_a_step_up():
    m, r = model(), np.random.default_rng(2)
    seqs = [r.integers(0, 5, n) for n in (4, 2, 1, 5)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    into = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    m.expected(flat, sizes, into)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        p_all = likelihood(m, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[o, b]
            p /= p_all
            start[path[0]] += p
            for a, b in zip(path, path[1:]):
                move[a, b] += p
            for a, o in zip(path, s):
                emit[o, a] += p
    for a, b in zip(into, (start, move, emit)):
        assert np.allclose(a, b)
    better = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    assert better.log10(flat, sizes).sum() >= m.log10(flat, sizes).sum()


@pytest.mark.parametrize("head,own", [(1 << 17, 1 << 14), (400, 100)])
def test_query(spark, sf, monkeypatch, head, own):
    monkeypatch.setattr(hmm, "HEAD", head)
    monkeypatch.setattr(hmm, "OWN", own)
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    late = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in docs.items() if not late[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = op2_hmm(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        ws = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (late[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_by_document(spark, sf, monkeypatch):
    """Each document's score against a plain forward recursion over its words."""
    monkeypatch.setattr(hmm, "HEAD", 500)
    monkeypatch.setattr(hmm, "OWN", 120)
    monkeypatch.setattr(hmm, "PIECE", 64)
    got = {}
    scored, encoded = hmm._scored, hmm._encoded
    monkeypatch.setattr(hmm, "_scored", lambda rows, m: got.update(model=m) or scored(rows, m))
    monkeypatch.setattr(hmm, "_encoded", lambda docs, voc: got.update(voc=voc) or encoded(docs, voc))
    rows = {r.doc_id: r.score for r in op2_hmm(spark, sf).collect()}
    m, voc = got["model"], got["voc"]
    docs = {r.doc_id: hmm.tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    own = {w: k for k, (w, _) in enumerate(voc.head[: voc.own])}
    for i, ws in docs.items():
        total, a = 0.0, None
        for w in ws:
            c = own.get(w, voc.own + hmm.ending(w))
            if w not in own:
                total += math.log10(counts[w] + 1) - voc.rest[hmm.ending(w)]
            a = (m.start if a is None else a @ m.move) * m.emit[c]
            total += math.log10(a.sum())
            a = a / a.sum()
        assert math.isclose(rows[i], total, rel_tol=1e-9), i


def test_pieces_of_a_text_are_no_starts():
    m, r = model(), np.random.default_rng(3)
    seq = r.integers(0, 5, 7)
    into = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    m.expected(seq, np.array([4, 3]), into, np.array([True, False]))
    assert math.isclose(into[0].sum(), 1) and math.isclose(into[1].sum(), 5) and math.isclose(into[2].sum(), 7)
    assert np.allclose(m.stationary() @ m.move, m.stationary()) and math.isclose(m.stationary().sum(), 1)


def test_a_training_step_holds_few_tokens(spark):
    """Texts of any length: what a step allocates doesn't grow with them, and its sums are those of all pieces at once."""
    r = np.random.default_rng(4)
    m, sizes = model(6, 300), [1_000_000, 1, 700, 512, 399_999]
    flat = r.integers(0, 300, sum(sizes))
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(flat, pa.int16()))], names=["classes"])

    class Rows:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
        select = groupBy = agg = lambda self, *_: self

        def mapInArrow(self, run, _):
            tracemalloc.start()
            (self.out,) = run([batch])
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

        def collect(self):
            return list(zip(*self.out.to_pydict().values()))

    rows, prior = Rows(), np.full(300, 1 / 300)
    got = hmm._step(rows, m, prior)
    assert rows.peak < 24 * len(flat) + 140 * (1 << 18)  # the classes and the pieces' sizes, and a bounded rest
    cut = [[hmm.PIECE] * (n // hmm.PIECE) + [n % hmm.PIECE] * (n % hmm.PIECE > 0) for n in sizes]
    into = [np.zeros(6), np.zeros((6, 6)), np.zeros((300, 6))]
    m.expected(flat, np.concatenate(cut), into, np.concatenate([[k == 0 for k in range(len(c))] for c in cut]))
    want = Model.fitted(*into, prior)
    assert all(np.allclose(getattr(got, k), getattr(want, k), rtol=1e-9, atol=0) for k in ("start", "move", "emit"))


def test_words_in_a_class_sum_to_one(spark, sf, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 300)
    monkeypatch.setattr(hmm, "OWN", 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = hmm._counts(docs.select("text")).collect()
    voc = hmm.Vocabulary(spark.createDataFrame(counts, "word binary, ending int, c long"))
    own = {w for w, _ in voc.head[: voc.own]}
    total = np.zeros(hmm.ENDINGS)
    for r in counts:
        if bytes(r.word) not in own:
            total[r.ending] += (r.c + 1) / 10 ** voc.rest[r.ending]
    assert np.allclose(total + 1 / 10**voc.rest, 1)  # the last is for unknown words
    m = Model.first(voc, 4)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and len(voc.head) <= 300


def test_odd_documents(spark, odd_docs, no_docs):
    rows = score(odd_docs, F.col("doc_id") == 5, states=2, steps=1).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 6)} == {1}
    assert next(r for r in rows if r.doc_id == 5).n_tokens == 60001
    assert score(no_docs, F.lit(False), states=2, steps=1).count() == 0
    assert {r.train_tokens for r in score(odd_docs, F.lit(True), states=2, steps=1).collect()} == {0}
