"""Chat formatting: layouts, a reversible template, loss spans, edge cases."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from tallyforge.llm.chat import BY_FINGERPRINT, MAPPINGS, as_records, canonical, conversations, escape, fingerprint, format_records, op8_chat, parse, paths, read_back, render, unescape

TURNS = [("user", "hi <|end|>"), ("assistant", "yo")]
LAYOUTS = [
    {"messages": [{"role": "user", "content": "hi <|end|>"}, {"role": "assistant", "content": "yo"}], "id": 3},
    {"conversations": [{"from": "human", "value": "hi <|end|>"}, {"from": "gpt", "value": "yo", "weight": 1}]},
    {"prompt": "hi <|end|>", "response": "yo"},
    {"prompt": "hi <|end|>", "completion": "yo", "meta": {"source": "x"}},
    {"instruction": "hi <|end|>", "input": "", "output": "yo"},
    {"instruction": "hi <|end|>", "output": "yo"},
    {"system": None, "prompt": "hi <|end|>", "response": "yo"},
]


@pytest.mark.parametrize("record", LAYOUTS)
def test_layouts(record):
    assert canonical(record) == TURNS


def test_fingerprints():
    assert len(BY_FINGERPRINT) == len(MAPPINGS)
    assert paths({"a": [{"b": 1}, {"c": 2}], "d": {"e": None}}) == {"a[].b", "a[].c", "d.e"}
    assert fingerprint(["text", "role", "other"]) == fingerprint(["role", "text"])
    with pytest.raises(ValueError, match="odd"):
        canonical({"odd": 1})
    assert canonical({"odd": 1}, lenient=True) == []
    assert canonical({"role": "human", "text": None}) == [("human", "")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|>[]/turnend​\nINSTas ", max_size=12), st.text(alphabet="<|>[]/turnend​\nINST s", max_size=30)), max_size=4))
def test_the_template_is_reversible(turns):
    assert parse("".join(render(r, t)[0] for r, t in turns)) == turns
    for r, t in turns:
        assert unescape(escape(t)) == t
        text, lo, hi = render(r, t)
        assert unescape(text[lo:hi]) == (t if r == "assistant" else "")
        assert "[INST]" not in text and "</s>" not in text and text.count("<|turn|") == 1


def test_records_frame(spark):
    df = spark.createDataFrame([(k, "x", json.dumps(r)) for k, r in enumerate(LAYOUTS)] + [(99, None, None)], "id long, turn string, record string")
    rows = format_records(df).collect()
    assert len(rows) == 2 * len(LAYOUTS) and {r.turn for r in rows} == {0, 1}
    assert all(unescape(r.formatted[r.loss_begin : r.loss_end]) == ("yo" if r.turn else "") for r in rows)
    bad = spark.createDataFrame([(json.dumps({"odd": 1}),)], "record string")
    with pytest.raises(PythonException, match="no mapping"):
        format_records(bad).collect()
    assert format_records(bad, lenient=True).count() == 0 and format_records(df.filter("id < 0")).count() == 0


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_rows_frame(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "last"), (None, 0, "assistant", "n"), (2, 0, "assistant", ""), (3, 0, "user", "x" * 100_000), (3, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in read_back(conversations(as_records(df))).collect()}
    assert set(got) == {1, 2, 3, None} and got[3].n_turns == 2
    assert got[1].n_turns == 3 and got[1].turns_sha256 == digest("user\n\nassistant\nb\nuser\nlast\n") and (got[1].loss_chars, got[1].loss_sha256) == (1, digest("b"))
    assert got[2].loss_sha256 == digest("") and got[None].loss_sha256 == digest("n")
    assert read_back(conversations(as_records(df.filter("turn = 9")))).count() == 0


def test_mixed_layouts_in_one_frame(spark):
    """Each layout becomes the same conversation, by the query's own way, next to rows of a table and records of several turns."""
    records = [(k, 0, json.dumps(r)) for k, r in enumerate(LAYOUTS)]
    many = {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "human", "value": "c"}, {"from": "gpt", "value": "d"}]}
    records += [(50, 0, json.dumps(many)), (60, 1, json.dumps({"role": "assistant", "text": "second"})), (60, 0, json.dumps({"messages": [{"role": "user", "content": "first"}]}))]
    df = spark.createDataFrame(records, "conv_id long, place long, record string").repartition(3)
    got = {r.conv_id: r for r in read_back(conversations(df)).collect()}
    assert {got[k].turns_sha256 for k in range(len(LAYOUTS))} == {digest("".join(f"{r}\n{t}\n" for r, t in canonical(LAYOUTS[0])))}
    assert got[50].n_turns == 4 and got[50].loss_sha256 == digest("bd")
    assert got[60].turns_sha256 == digest("user\nfirst\nassistant\nsecond\n")


def test_query(spark, sf):
    by = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = op8_chat(spark, sf).collect()
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        loss = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(by[r.conv_id]), digest("".join(f"{a}\n{t}\n" for a, t in by[r.conv_id])))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
