"""Near-duplicates against all pairs' exact five-word similarities."""

import random
from itertools import combinations

import corpus_pipeline
from tallyforge.llm import neardup


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Ids that stay: the least of each component of links at 0.8 or more, of all pairs. (rows: id, text; ids are distinct)"""
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            of[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def edited():
    """Texts with copies at similarities from 0.3 to 1: single words, a run of words, words in another order, chains of copies."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(25):
        w = [word() for _ in range(r.randint(60, 300))]
        texts.append(" ".join(w))
        for _ in range(3):  # a run, about 0.8
            n = int(len(w) * r.uniform(0.02, 0.16))
            at = r.randrange(len(w) - n)
            texts.append(" ".join(w[:at] + [word() for _ in range(n)] + w[at + n :]))
        for _ in range(3):  # single words
            v = list(w)
            for at in r.sample(range(len(v)), max(1, int(len(v) * r.uniform(0.005, 0.06)))):
                v[at] = word()
            texts.append(" ".join(v))
        texts.append(" ".join(r.sample(w, len(w))))  # the same words
        v = list(w)
        for _ in range(4):  # a chain
            n = int(len(w) * 0.08)
            at = r.randrange(len(w) - n)
            v = v[:at] + [word() for _ in range(n)] + v[at + n :]
            texts.append(" ".join(v))
    texts += ["a b c", "A  b\tC", "a b c d", "a b c d e", "a b c d e f", "", None, " \n", "ab " * 500, "ab " * 300]
    return list(enumerate(texts))


def test_all_pairs(spark):
    rows = edited()
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(brute(rows))
    by = dict(rows)
    assert all(by[x.doc_id] == x.text for x in kept)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A group of many unlike texts with a passage in common, searched in blocks, loses no link."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(120)]
    rows = []
    for k in range(50):
        w = passage + [word() for _ in range(60)]
        rows.append((3 * k, " ".join(w)))
        for j in (1, 2):
            v = list(w)
            v[130 + j : 132 + j] = [word(), word()]
            rows.append((3 * k + j, " ".join(v)))
    kept = neardup.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(brute(rows)) == list(range(0, 150, 3))


def test_fingerprints_alone(spark, monkeypatch):
    """SimHash is a step of its own: without a band of MinHash, similar texts within its radius are linked, and no others."""
    monkeypatch.setattr(neardup, "_bands", lambda least: [])
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(1500)]
        for n in (0, 1, 1, 2, 5, 40, 120):
            v = list(w)
            v[700 : 700 + n] = [word() for _ in range(n)]
            texts.append(" ".join(v))
    texts += ["a b c", "a b d", "", None]
    rows = list(enumerate(texts))

    def fingerprint(text):
        h = [int(x) for x in neardup._shingles(neardup._words(text))]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fps, sets, root = [fingerprint(t) for t in texts], [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    want = set(root)
    assert len(brute(rows)) < len(want) < len(rows) - 12
    kept = neardup.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(x.doc_id for x in kept) == sorted(want)


def test_sf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(x) for x in docs.collect())
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(brute(rows))
