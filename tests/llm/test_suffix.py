"""Repeated strings against every window, at several lengths; both ways of refining."""

import hashlib
import random
from collections import Counter

import pytest

from tallyforge.llm import suffix
from tallyforge.llm.suffix import _cut, op10_suffix, repeats, text_table


def brute(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if cover[k] and (k == 0 or not cover[k - 1]))
        kept = bytes(x for x, y in zip(t, cover) if not y)
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    text = lambda n, a="abcd \né": "".join(r.choice(a) for _ in range(n))
    passages = [text(r.randint(40, 200)) for _ in range(6)]
    docs = [None, "", text(30), "a" * 300, "ab" * 150, "a" * 99, text(400), text(400)]
    for _ in range(60):
        docs.append("".join(r.choice([text(r.randint(0, 120)), r.choice(passages), r.choice(passages)[: r.randint(0, 150)], r.choice(passages)[r.randint(0, 60) :]]) for _ in range(r.randint(1, 6))))
    return docs + docs[8:12] + [docs[9]] * 3


@pytest.mark.parametrize("seed,length,hot", [(1, 60, 20_000), (2, 60, 1), (3, 24, 20_000), (4, 25, 2), (5, 100, 20_000)])
def test_against_every_window(spark, monkeypatch, seed, length, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PART", 500)
    docs = made(seed)
    texts = text_table(spark.createDataFrame([(d, 1) for d in docs], "text string, copies int").repartition(5))
    got = {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in _cut(texts, repeats(texts, length), length).collect()}
    b = [(d or "").encode() for d in docs]
    assert [got[hashlib.md5(x).digest()] for x in b] == brute(b, length)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute([d.text.encode() for d in docs], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == want


def test_buckets_follow_the_input(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert suffix._buckets(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(suffix, "BUCKET", 10_000)
    n = suffix._buckets(docs)
    assert 4 < n < 100 and text_table(docs).count() == docs.select("text").distinct().count()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    monkeypatch.setattr(suffix, "MOST", 7)
    assert suffix._buckets(docs) == 7


def test_odd_documents(spark, odd_docs):
    """Nulls, long texts, copies, and columns of the operator's own names."""
    docs = odd_docs.selectExpr("*", "1 as copies", "'k' as key", "0 as begin", "9 as n_bytes")
    texts = text_table(docs)
    got = {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in _cut(texts, repeats(texts, 50), 50).collect()}
    b = [(r.text or "").encode() for r in docs.select("text").collect()]
    assert [got[hashlib.md5(x).digest()] for x in b] == brute(b, 50)


def test_no_documents(spark, no_docs):
    texts = text_table(no_docs)
    assert repeats(texts).count() == 0 and _cut(texts, repeats(texts), 400).count() == 0
