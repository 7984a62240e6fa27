"""Chat formatting: records of different layouts to canonical turns, and turns to text by a template.

A record's schema is fingerprinted by a hash of its sorted nested field paths; the fingerprint selects a declarative
mapping (where the turns, roles and texts are, and what roles are called). Layouts: single prompt and response,
instruction with input and output, lists of messages or of from/value pairs, and tables of one turn a row.

The template marks turns by control strings. Inside texts, each occurrence of a control string's first character is
followed by a mark, so that no control string can occur there, and reading takes the marks out again. Formatted turns
are rows, in order, so a conversation of any length is streamed, never gathered; each carries the span of its text
that bears loss (assistants' texts).

Edge cases: null texts are empty; a null role is `user`; null turns sort last, ties by role and text as formatted; a null
conversation id is a conversation of its own; records of an unknown schema raise an error that names their paths
(or, if lenient, give no turns); extra fields change no fingerprint unless they are among a layout's paths; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, table

#: Control strings; all begin with MARK, which in texts is followed by ESCAPE, as is the bracket of other templates.
MARK, ESCAPE = "<", "\u200b"
OPEN, CLOSE, TURN_END = "<|turn|", "|>\n", "<|end|>\n"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns. turns: path of a list, or "" for the record itself; parts: (role, path) pairs
    that make one turn each, or else role and text: paths in a turn. Optional paths may be missing or empty."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: bool = True  # roles to the names in ROLES


ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}

MAPPINGS = (
    Mapping("turn rows", ("role", "text"), role="role", text="text", rename=False),
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping("prompt", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", ("completion", "prompt"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("input", "instruction", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction only", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system prompt", ("prompt", "response", "system"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)

#: Fields that layouts use; others don't count for the fingerprint.
USED = frozenset(p for m in MAPPINGS for p in m.paths)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record, those of its leaves; of lists the union over their elements."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")}
    return {at}


def fingerprint(found) -> str:
    """Of the sorted paths that layouts use."""
    return hashlib.sha256("\n".join(sorted(set(found) & USED)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


@lru_cache(4096)
def mapping(found: frozenset) -> Mapping | None:
    """The mapping for a set of paths; each set is hashed once."""
    return BY_FINGERPRINT.get(fingerprint(found))


def canonical(record: dict, lenient: bool = False) -> list[tuple[str, str]]:
    """A record's turns, as (role, text)."""
    found = frozenset(paths(record))
    m = mapping(found)
    if m is None:
        if lenient:
            return []
        raise ValueError(f"no mapping for a record of the paths {sorted(found)}")
    if m.parts:
        turns = []
        for role, keys in m.parts:
            text = "\n\n".join(x for x in (record.get(k) or "" for k in keys) if x)
            if text or role != "system":
                turns.append((role, text))
        return turns
    rows = record.get(m.turns) or [] if m.turns else [record]
    return [(_role(r.get(m.role), m.rename), r.get(m.text) or "") for r in rows]


def _role(name: str | None, rename: bool) -> str:
    return "user" if name is None else ROLES.get(name.lower(), name) if rename else name


def escape(text: str) -> str:
    return text.replace(MARK, MARK + ESCAPE).replace("[", "[" + ESCAPE)


def unescape(text: str) -> str:
    return text.replace("[" + ESCAPE, "[").replace(MARK + ESCAPE, MARK)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the span of its text in it if it bears loss (else empty)."""
    head = OPEN + escape(role).replace("|", "|" + ESCAPE) + CLOSE
    body = escape(text)
    return head + body + TURN_END, len(head), len(head) + (len(body) if role == "assistant" else 0)


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(TURN_END), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    return [(unescape(m[1].replace("|" + ESCAPE, "|")), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, value: str = "record", lenient: bool = False) -> DataFrame:
    """Records as JSON text to rows (their other columns, turn, formatted, loss_begin, loss_end); code points count."""
    prepare(records.sparkSession)
    rest = [c for c in records.columns if c != value]
    added = ["turn", "formatted", "loss_begin", "loss_end"]
    records = records.select(*[F.col(f"`{c}`") for c in rest if c not in added], F.col(value))
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([*records.drop(value).schema.fields, *[T.StructField(c, k) for c, k in zip(added, kinds)]])
    at = len(records.columns) - 1

    def run(batches):
        for b in batches:
            source, out = [], [[], [], [], []]
            for k, x in enumerate(b.column(at)):
                x = x.as_py()
                for n, (role, text) in enumerate(canonical(json.loads(x), lenient) if x else []):
                    source.append(k)
                    for col, y in zip(out, (n, *render(role, text))):
                        col.append(y)
            columns = [c.take(pa.array(source, pa.int64())) for c in b.columns[:at]]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, k) for c, k in zip(out, kinds)]], names=[*b.schema.names[:at], *added])

    return records.mapInArrow(run, schema)


def as_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of one turn a row to records (conv_id, place, record), of the layout of turn rows."""
    parts = F.struct(F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("place"), F.to_json(parts, {"ignoreNullFields": "false"}).alias("record"))


def conversations(records: DataFrame, lenient: bool = False) -> DataFrame:
    """Records (conv_id, place, record) of any layouts to formatted turns (conv_id, turn, formatted, loss_begin, loss_end):
    conversations whole and in order within partitions, by place, then by turn in the record, then by the turn itself."""
    x = format_records(records.select("conv_id", "place", "record"), lenient=lenient)
    x = x.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").asc_nulls_last(), "turn", "formatted")
    return x.select("conv_id", "turn", "formatted", "loss_begin", "loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """Formatted turns, whole and in order within partitions, to a row a conversation of what can be read from them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        now: list | None = None  # conversation, turns, digest, loss, digest, characters

        def row(x) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            out = []
            for conv, _, text, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                loss = unescape(text[lo:hi])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(zip(*out), kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k or kind) for c, k in zip(row(now), kinds)], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are records of one layout, the added conversation is one of another; both are told apart by their fingerprints."""
    said = "</s>[INST] ok [/INST]"
    more = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    more = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("place"), F.lit(more).alias("record"))
    rows = as_records(table(spark, sf_dir, "conversations"))
    return read_back(conversations(rows.unionByName(more)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, length(text) + (length(text) - length(replace(replace(text, '<', ''), '[', ''))) AS n FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(7 + length(role) + 3 + n + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
