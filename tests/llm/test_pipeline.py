"""The pipeline: each stage against a plain version of it, without a tolerance."""

import hashlib
from collections import Counter

import duckdb
import sentencepiece

import corpus_pipeline
from tallyforge.llm import mixing, quality, secrets
from tallyforge.llm.common import save
from tallyforge.llm.pieces import model_path
from tests.llm import test_neardup, test_secrets


def staged(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(save(stage(spark, out[-1], sf), "test"))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw, good, one, clean, mixed, encoded = staged(spark, docs, sf)
    assert good.columns == one.columns == clean.columns == mixed.columns == raw.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a, b, c, d, e = map(ids, (raw, good, one, clean, mixed))
    assert set(c) <= set(b) <= set(a) and len(c) < len(b) < len(a) and c == d and set(e) <= set(d) and max(map(e.count, set(e))) <= 2
    texts = [r.text for r in one.select("text").collect()]
    assert len(texts) == len(set(texts))
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in encoded.collect()) == want
    again = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in again.collect()) == want


def rows_of(df, sql):
    """SQL's rows over a stage's input."""
    c = duckdb.connect()
    c.register("documents", df.toArrow())
    return c.execute(sql).fetchall()


def test_each_stage_against_a_plain_version(spark, sf):
    """Quality and mixing against their SQL, near-duplicates against all pairs, secrets against every candidate's votes in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    edited = [(100_000 + k, t, "en", "web", 0) for k, (_, t) in enumerate(zip(range(60), (t for _, t in test_neardup.edited())))]
    planted = [(200_000 + k, f"{t} " + " ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest()[:5] for j in range(60)), "de", "tests/data.py" if k % 3 else None, 0) for k, (t, _, _) in enumerate(test_secrets.planted(9, 64))]
    docs = save(docs.unionByName(spark.createDataFrame(edited + planted, docs.schema)), "test")
    raw, good, one, clean, mixed, _ = staged(spark, docs, sf)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == sorted(r[0] for r in rows_of(raw, f"SELECT doc_id FROM ({quality.SQL}) WHERE kept"))
    pairs = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())
    assert ids(one) == sorted(test_neardup.brute(pairs)) and len(ids(one)) < len(pairs)
    forest = secrets.train(secrets.labelled(spark))
    got = {r.doc_id: r.text for r in clean.collect()}
    changed = 0
    for r in one.collect():
        text, at = "", 0
        for begin, n, votes in test_secrets.brute(forest, r.text, r.source):
            text += r.text[at:begin] + (secrets.REPLACEMENT if votes >= 0.5 else r.text[begin : begin + n])
            at = begin + n
        text += r.text[at:]
        assert got[r.doc_id] == text
        changed += text != r.text
    assert changed > 10
    copies = Counter(ids(mixed))
    size = {r.doc_id: len(r.text.encode().split()) for r in clean.collect()}
    assert {i: n * size[i] for i, n in copies.items()} == {i: taken for i, taken in rows_of(clean, f"SELECT doc_id, taken FROM ({mixing.SQL})") if taken}


def test_odd_documents(spark, odd_docs, no_docs, sf):
    out = staged(spark, odd_docs, sf)
    assert out[1].count() > 0 and out[-1].count() > 0
    assert staged(spark, no_docs, sf)[-1].count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    assert "pipeline" in q and [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(q)
