"""Pareto mixing: targets, caps, agreement of reruns, edge cases, and a brute-force ranking."""

from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.llm.mixing import Mix, mix, op3_mix


def decided(docs):
    m = Mix(docs)
    return m.decided(m.slim).select("doc_id", "source", "size", "target", "total", "copies", "taken_copies", "q").collect()


def test_words_come_near_the_targets(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(pmod(xxhash64(id), 90) as int) + 1) as text", "element_at(array('a', 'b', 'c'), cast(if(id % 3 = 0, 1, if(id % 7 = 0, 2, 3)) as int)) as source")
    rows = decided(docs)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        by[r.source][0] += r.size
        by[r.source][1] += r.size * r.taken_copies
        by[r.source][2] = r.target
        assert 0 <= r.taken_copies <= 2 and (r.taken_copies in (int(r.copies), int(r.copies) + 1))
    everything = sum(x[0] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - 1.5 * everything) < 1e-6 * everything
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 90
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, decided(docs.repartition(7))), key=str)


def test_the_first_of_the_order_are_taken(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "repeat('w ', cast(pmod(xxhash64(id), 40) as int) + 1) as text", "if(id % 2 = 0, 'a', 'b') as source")
    for s in ("a", "b"):  # more than one bin of ranks each
        x = sorted((r for r in decided(docs) if r.source == s and r.q is not None), key=lambda r: (r.q, r.doc_id))
        left = x[0].target - sum(int(r.copies) * r.size for r in decided(docs) if r.source == s) if x else 0
        before = 0
        for r in x:
            assert (r.taken_copies > int(r.copies)) == (before + r.size / 2 <= left + 1e-6)
            before += r.size


def test_odd_documents(spark, odd_docs, no_docs):
    rows = decided(odd_docs)
    assert len(rows) == odd_docs.count()
    assert len({r.taken_copies for r in rows if r.doc_id == 1}) == 1  # repeated rows are taken alike
    out = mix(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.taken_copies for r in rows)
    assert decided(no_docs) == [] and mix(no_docs).count() == 0


def test_nulls_sort_last(spark):
    docs = spark.createDataFrame([(1, "a b c d", None), (2, "a b c d", "x")], "doc_id long, text string, source string")
    t = {r.source: r.target for r in decided(docs)}
    assert abs(t["x"] - 8) < 1e-9 and abs(t[None] - 4) < 1e-9  # 3 : 1, the first at its cap


def test_query(spark, sf):
    out = op3_mix(spark, sf)
    assert out.filter(F.col("taken") > 2 * F.col("size")).count() == 0
