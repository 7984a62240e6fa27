"""SentencePiece encoding and decoding, merge type, by backtracking.

A text's merge encoding is the one sequence of pieces of which every adjacent pair stays as it is when the two
are joined and merged again. So the encoder takes the longest piece that an Aho-Corasick automaton finds at a
place, keeps it if it is compatible with the piece before, else tries the next shorter one, and steps back if
none is left; places from which no way on was found are marked in a field of bytes and not tried again.

No piece of the model crosses a space that follows another character (checked when the model is loaded), and
some characters (such as line feed) occur in no piece of several characters; texts are split there, and what a
part gives is remembered in a table of at most 2 * `REMEMBERED` parts a worker. This changes no result.

Edge cases: null is the empty text, which has no ids; a character outside the vocabulary becomes its UTF-8 bytes'
pieces; control pieces' names in a text are ordinary text; extra columns and repeated rows don't matter, as each
row is encoded alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, prepare, table

SPACE = "▁"
#: Parts of texts whose ids a worker remembers, twice over; about 300 bytes each.
REMEMBERED = 250_000
#: Pairs of pieces whose compatibility a worker remembers.
PAIRS = 400_000
#: Ids that a worker holds before it passes them on.
AT_ONCE = 200_000
#: Longer parts are not remembered.
LONGEST = 64


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, b[i : i + n]
        i += n


class Pieces:
    """A merge-type model: encode, decode, and both with the parts remembered."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.names: list[str] = []
        self.bytes_: dict[int, int] = {}
        self.hidden: set[int] = set()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        byte_id: dict[int, int] = {}
        prefix, collapse, escape, rule = True, True, True, b""
        for f, v in _fields(model):
            if f == 1:
                d = dict(_fields(v))
                i, name, kind = len(self.names), d[1].decode(), d.get(3, 1)
                self.names.append(name)
                if kind == 6:
                    self.bytes_[i] = int(name[3:5], 16)
                    byte_id[self.bytes_[i]] = i
                elif kind == 1:
                    self.id[name], self.score[name] = i, struct.unpack("<f", d[2])[0]
                elif kind in (2, 3):
                    self.hidden.add(i)
                else:
                    raise ValueError(f"pieces of type {kind} aren't supported")
            elif f == 2:
                kind = dict(_fields(v)).get(3, 1)
                if kind != 2:
                    raise ValueError("not a merge-type model")
            elif f == 3:
                d = dict(_fields(v))
                prefix, collapse, escape, rule = d.get(3, 1), d.get(4, 1), d.get(5, 1), d.get(2, b"")
        if rule or collapse or not escape or not prefix or len(byte_id) != 256:
            raise ValueError("only models without normalisation, with a space before the text and with bytes for other characters are supported")
        if any(SPACE in n.lstrip(SPACE) for n in self.id):
            raise ValueError("a piece crosses a space")
        self.fallback = [byte_id[b] for b in range(256)]
        joined = {c for n in self.id if len(n) > 1 for c in n}
        self.cut = "\n" if "\n" not in joined else None
        self.longest = max(map(len, self.id))
        self.automaton = ahocorasick.Automaton()
        for n in self.id:
            if self.merged(n) == [n]:  # a piece that merging doesn't reach never occurs
                self.automaton.add_word(n, len(n))
        self.automaton.make_automaton()
        self.n = len(self.names)
        self.written = list(map(str, range(self.n)))
        #: By piece (or single character, past the ids) its number; by number its length and the next shorter piece that it starts with, or -1. A single character is always a piece of its own before bytes take its place.
        self.number = {n: self.id[n] for n in self.automaton}
        self.size = list(map(len, self.names))
        self.shorter = [-1] * self.n
        for n in list(self.number):
            if len(n) > 1:
                self.single(n[0])
        for n, i in self.number.items():
            self.shorter[i] = next((self.number[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in self.number), -1)
        #: By any start of a piece, the longest piece that it starts with, itself included.
        self.best = {n[:j]: next(self.number[n[:k]] for k in range(j, 0, -1) if n[:k] in self.number) for n in self.automaton for j in range(1, len(n) + 1)}
        #: By a piece, whether those that were tried after it are compatible with it.
        self.kept: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        #: What pieces are in a text, in UTF-8.
        self.utf8 = [bytes([self.bytes_[i]]) if i in self.bytes_ else b"" if i in self.hidden else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names[: self.n])]
        #: Words' ids, with a space before the word, joined by commas.
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.once: set[int] = set()
        self.end = self.part(self.cut) if self.cut else None

    def merged(self, text: str) -> list[str]:
        """Merging as it is defined: always the pair that makes the best piece, the leftmost of equals. For short texts."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def split(self, text: str) -> list[int]:
        """The pieces of a text with spaces escaped, by backtracking; characters without a piece have numbers past the ids."""
        reach, best, shorter, size, kept, most, n = self.automaton.longest_prefix, self.best, self.shorter, self.size, self.kept, self.longest, len(text)
        failed = bytearray(n + 1)  # 1 at p: there's no way on from place p
        out: list[int] = []
        pos, last = 0, -1
        after: dict[int, bool] = {}  # what is known of pieces after the last
        while pos < n:
            k = reach(text[pos : pos + most])
            i = best[text[pos : pos + k]] if k else self.single(text[pos])
            while True:
                end = pos + size[i]
                if not failed[end]:
                    if last < 0:
                        break
                    ok = after.get(i)
                    if ok or ok is None and self.compatible(last, i):
                        break
                i = shorter[i]
                while i < 0:  # none is left here
                    failed[pos] = 1
                    i = out.pop()
                    pos -= size[i]
                    last = out[-1] if out else -1
                    after = kept.get(last) or {}
                    i = shorter[i]
            out.append(i)
            last = i
            after = kept.get(i) or {}
            pos = end
        return out

    def single(self, c: str) -> int:
        """The number of a single character, which may be a new one."""
        i = self.number.get(c)
        if i is None:
            i = self.number[c] = len(self.names)
            self.names.append(c)
            self.size.append(1)
            self.shorter.append(-1)
        return i

    def compatible(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are when they are joined and merged again."""
        x, y = self.names[a], self.names[b]
        if self.pairs >= PAIRS:
            self.kept.clear()
            self.pairs = 0
        self.pairs += 1
        ok = self.merged(x + y) == [x, y]
        self.kept.setdefault(a, {})[b] = ok
        return ok

    def ids(self, pieces: list[int]) -> list[int]:
        if max(pieces, default=0) < self.n:
            return pieces
        return [x for i in pieces for x in ([i] if i < self.n else [self.fallback[b] for b in self.names[i].encode()])]

    def raw(self, ids: list[int]) -> str:
        """The text of ids, its first space kept. Bytes that are no UTF-8 become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            b = self.bytes_.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.hidden:
                out.append(self.names[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).removeprefix(" ")

    def text(self, ids: list[int]) -> str:
        """The same as decode, faster where bytes are UTF-8."""
        b = b"".join(map(self.utf8.__getitem__, ids))
        try:
            return b.decode().removeprefix(" ")
        except UnicodeDecodeError:
            return self.decode(ids)

    def part(self, part: str) -> str:
        """Of a part, with spaces escaped, the ids joined by commas."""
        return ",".join([self.written[i] for i in self.ids(self.split(part))])

    def word(self, word: str) -> str:
        """The same of a word with a space before it, remembered from its second time on."""
        got = self.older.get(word)
        if got is None:
            got = self.part(SPACE + word)
            if len(word) > LONGEST:
                return got
            h = hash(word)
            if h not in self.once:
                if len(self.once) >= 2 * REMEMBERED:
                    self.once.clear()
                self.once.add(h)
                return got
        if len(self.known) >= REMEMBERED:
            self.older = self.known.copy()
            self.known.clear()
        self.known[word] = got
        return got

    def line(self, line: str, prefix: str) -> list[str]:
        """The ids of the parts of a line: each is a word with the spaces before it; spaces at the end are one as well."""
        words = line.split(" ")
        known = self.known.get
        if "" in words or not prefix:
            got, spaces, first = [], prefix, True
            for w in words:
                spaces += "" if first else SPACE
                first = False
                if w:
                    got.append((known(w) or self.word(w)) if spaces == SPACE else self.part(spaces + w))
                    spaces = ""
            if spaces:
                got.append(self.part(spaces))
            return got
        got = list(map(known, words))
        at = -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            got[at] = self.word(words[at])
        return got

    def joined(self, text: str) -> str:
        """A text's ids, joined by commas."""
        if not text:
            return ""
        text = text.replace(SPACE, " ")
        if self.cut is None or self.cut not in text:
            return ",".join(self.line(text, SPACE))
        got = []
        for k, line in enumerate(text.split(self.cut)):
            if k:
                got.append(self.end)
            if line:
                got += self.line(line, "" if k else SPACE)
            elif not k:
                got.append(self.part(SPACE))
        return ",".join(got)

    def encoded(self, text: str) -> tuple[np.ndarray, str, str]:
        """Of a text: the ids, the ids joined by commas, the text decoded from the ids."""
        s = self.joined(text)
        ids = np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32)
        return ids, s, self.text(ids.tolist())

    def encode(self, text: str) -> list[int]:
        return self.encoded(text)[0].tolist()


@lru_cache(2)
def load(model: str) -> Pieces:
    with open(model, "rb") as f:
        return Pieces(f.read())


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str, text: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs with piece_ids (array, if ids), n_tokens, ids_sha256, decoded (if ids) and decoded_sha256. The model's path must be readable on the executors. Columns of these names are replaced.

    With keep, only these of docs' columns and of the added ones come back from Python, in this order.
    """
    prepare(docs.sparkSession)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["piece_ids", "decoded"] * ids
    docs = docs.drop(*(c for c in added if c != text))
    names = keep or [*(c for c in docs.columns if c not in added), *added]
    kinds = dict(zip(added, [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()), T.StringType()]))
    own = [c for c in names if c not in kinds]
    docs = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias(fresh(docs, "text_")[0]))
    schema = T.StructType([T.StructField(c, kinds[c]) if c in kinds else docs.schema[c] for c in names])

    def run(batches):
        m = load(model)
        for batch in batches:
            rows: list[tuple] = []
            held = lo = 0
            for k, t in enumerate(batch.column(len(own))):
                n, s, d = m.encoded(t.as_py() or "")
                rows.append((n, hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest(), d if "decoded" in names else None))
                held += len(n)
                if held >= AT_ONCE or k + 1 == len(batch):
                    arrays, one, two, texts = zip(*rows)
                    sizes = np.array(list(map(len, arrays)))
                    made = {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string()), "decoded": pa.array(texts, pa.string())}
                    made["piece_ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))
                    made |= dict(zip(own, batch.slice(lo, k + 1 - lo).columns))
                    yield pa.RecordBatch.from_arrays([made[c] for c in names], names=names)
                    rows, held, lo = [], 0, k + 1

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256); the text isn't sent back from Python."""
    return encode(docs, model, keep=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
