"""SimHash: fingerprints, links and components against all pairs."""

import random
import re

import pytest
import xxhash

from tallyforge.llm import simhash
from tallyforge.llm.graph import components
from tallyforge.llm.simhash import BkTree, classes, first_of_each, links, op6_simhash


def fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fp = {d.doc_id: fingerprint(d.text) for d in docs}
    want = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = op6_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", want[i]) for i in fp} and len(got) == len(fp)


@pytest.mark.parametrize("radius,shard", [(2, 2048), (2, 3), (5, 2048), (5, 3), (0, 2048)])
def test_links_lose_none(spark, monkeypatch, radius, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(8)})
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    found = links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius)
    assert all(near(a, b) for a, b in found.collect())
    got = {r.node: r.root for r in components(found).collect()}
    assert {x: got.get(x, x) for x in fps} == roots(fps, near)


def test_tree():
    r = random.Random(5)
    xs = [r.getrandbits(12) for _ in range(300)]
    t = BkTree()
    assert t.search(1, 3) == []
    for x in xs:
        t.add(x)
    for q in range(0, 4096, 97):
        assert sorted(t.search(q, 3)) == sorted({x for x in xs if (x ^ q).bit_count() <= 3})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{k: 1000 for k in range(1000, 1200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd_docs, no_docs):
    rows = classes(odd_docs.select("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 6)} == {3}  # fingerprint zero
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    one = first_of_each(odd_docs)
    assert one.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect())
    assert len(ids) == len(set(ids)) and (False, 1) in ids and (False, 2) not in ids and (False, 3) in ids and (False, 4) not in ids and (True, 0) in ids
    assert classes(no_docs.select("doc_id", "text")).count() == 0 and first_of_each(no_docs).count() == 0
