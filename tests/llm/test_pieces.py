"""The encoder against the sentencepiece library."""

import hashlib
import random
import time

import pytest
import sentencepiece

from tallyforge.llm.pieces import digests, encode, load, model_path, op7_pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_random_texts(library):
    m, r = load(model_path()), random.Random(1)
    for alphabet in ("abcdet hin  \n\t▁é\U0001f600<>s/0x41ErЯ的", " ▁", "the in er \n"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            ids = library.encode(t)
            assert m.encode(t) == ids and m.decode(ids) == library.decode(ids) == m.encoded(t)[2], t


@pytest.mark.parametrize("text", ["", " ", "\n", "\n\n a", "<s></s><unk><0x41>", " " * 50 + "x", "a\u0000b", "�​", "x" * 3000, "▁▁ ▁", "é" * 100])
def test_odd_texts(library, text):
    m = load(model_path())
    assert m.encode(text) == library.encode(text) and m.encoded(text)[2] == library.decode(library.encode(text))


def test_a_long_word_takes_time_in_proportion():
    """Marking places without a way on costs the same anywhere in a text."""
    m, r = load(model_path()), random.Random(4)
    word = "".join(r.choice("abcdefghij") for _ in range(4_000_000))
    m.split(word[:100_000])

    def seconds(n):
        began = time.thread_time()
        m.split(word[:n])
        return time.thread_time() - began

    assert seconds(4_000_000) < 13 * seconds(500_000)


def test_columns_that_come_back(spark, odd_docs, library):
    """The pipeline's columns alone leave Python; ids, their digest and the text decoded from them agree with the library."""
    names = ["doc_id", "lang", "n_tokens", "piece_ids", "ids_sha256", "decoded_sha256"]
    out = encode(odd_docs, model_path(), keep=names)
    assert out.columns == names
    rows = {(r.doc_id, r.n_tokens, tuple(r.piece_ids), r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(i, len(x), tuple(x), digest(",".join(map(str, x))), digest(library.decode(x))) for i, x in ((r.doc_id, library.encode(r.text or "")) for r in odd_docs.collect())}
    assert rows == want


def test_bytes_that_are_no_text(library):
    ids = [3 + 0xE9, 3 + 0x41, 3 + 0xFF, 264]
    assert load(model_path()).decode(ids).count("�") >= 2


def test_frames(spark, odd_docs, no_docs, library):
    rows = digests(odd_docs, model_path()).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()}
    want = {(i, hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest()) for i, t in texts}
    assert {(r.doc_id, r.ids_sha256) for r in rows} == want and len(rows) == odd_docs.count()
    full = encode(odd_docs.withColumnRenamed("size", "n_tokens"), model_path())
    assert full.count() == odd_docs.count() and full.filter("size(piece_ids) != n_tokens").count() == 0
    assert digests(no_docs, model_path()).count() == 0 and encode(no_docs, model_path()).count() == 0


def test_query(spark, sf, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_pieces(spark, sf).collect():
        ids = library.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
