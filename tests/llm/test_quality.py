"""Quality rules: counts against a plain version, thresholds by group, edge cases."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.llm import quality
from tallyforge.llm.quality import counts, keep_good, op5_quality, thresholds


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf, odd_docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([("a b c a b c a b",), ("x x x x",), ("a\nb\na\n\n a",), ("# a | b c",)], "text string")):
        for r in df.select("text", counts(F.col("text")).alias("c")).collect():
            assert tuple(r.c[n] for n in names) == plain(r.text), (r.text or "")[:80]


def test_windows_of_equal_hashes(spark, monkeypatch, sf):
    """Windows are told apart by their words, whatever their hashes."""
    monkeypatch.setattr(quality, "_hashed", lambda *w: F.pmod(F.xxhash64(*w), F.lit(3)))
    texts = [("a b c a b c a b",), ("x y z 1 2 3 x y z 4 x y z",), ("one two three four five",), ("a a a a b a a a c",)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").filter("length(text) < 4000").unionAll(spark.createDataFrame(texts, "text string"))
    for r in docs.select("text", counts(F.col("text")).alias("c")).collect():
        assert r.c["n_repeat_words"] == plain(r.text)[4], r.text[:80]


def test_a_long_text_of_distinct_words(spark):
    (r,) = spark.range(1).select(counts(F.array_join(F.sequence(F.lit(1), F.lit(3_145_728)), " ")).alias("c")).collect()
    assert (r.c["n_words"], r.c["n_repeat_words"]) == (3_145_728, 0)


def test_small_groups_have_thresholds_of_their_own(spark):
    """A group's limit moves from its language's to its own with every document, at any size."""
    row = lambda source, n: [("en", source, 100, 500, n, 0, 0, 5, 0)]
    schema = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"
    high = []
    for n in (1, 10, 60, 300):
        slim = spark.createDataFrame(row("prose", 0) * 400 + row("tables", 60) * n, schema)
        high.append({r.t_source: r.symbols_high for r in thresholds(slim).collect()})
    assert [h["tables"] for h in high] == sorted(h["tables"] for h in high) and high[0]["tables"] < 0.2 and high[3]["tables"] > 0.55
    assert all(h["prose"] < 0.12 for h in high[:3])


def test_thresholds_follow_the_group(spark):
    text = "concat_ws(' ', transform(sequence(1, 60), x -> concat(if(x % {m} = 0, '|', 'w'), md5(concat(id, x)))))"
    a = spark.range(400).selectExpr("id as doc_id", f"{text.format(m=2)} as text", "'en' as lang", "'tables' as source")
    b = spark.range(400, 800).selectExpr("id as doc_id", f"{text.format(m=1000)} as text", "'en' as lang", "'prose' as source")
    odd = spark.range(800, 802).selectExpr("id as doc_id", f"{text.format(m=2)} as text", "'en' as lang", "'prose' as source")
    kept = {r.doc_id for r in keep_good(a.unionAll(b).unionAll(odd)).select("doc_id").collect()}
    assert kept == set(range(800))


def test_odd_documents(spark, odd_docs, no_docs):
    out = keep_good(odd_docs)
    assert out.columns == odd_docs.columns
    assert {3, 4, 6, 7}.isdisjoint({r.doc_id for r in out.collect()})
    assert keep_good(no_docs).count() == 0
    slim = odd_docs.select("lang", "source", counts(F.col("text")).alias("c")).select("lang", "source", "c.*")
    assert thresholds(slim).count() == slim.select("lang", "source").distinct().count()


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    x = op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    by = {(r.quality, r.kept): r["count"] for r in x.groupBy("quality", "kept").count().collect()}
    assert by.get((0, True), 0) <= 0.05 * by[0, False] and by.get((1, False), 0) <= 0.02 * by[1, True]
