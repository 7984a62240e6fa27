"""Hidden Markov language model: latent states trained by Baum-Welch, exact scores by the scaled forward recursion.

The states emit word classes: each of the `OWN` most frequent tokens is a class of its own; all others fall into
one of `ENDINGS` classes by their last three bytes, within which a word has probability (c + 1) / (n + v + 1),
with its count c and the class's tokens n and distinct words v in training. So the model covers any word, and the
score of a text is the sum over all paths of states, times the words' probabilities in their classes.

Baum-Welch runs over all training documents: each task adds up expected counts (states by states, classes by
states) of its texts, Spark adds these up by class, and the driver turns them into parameters, whose size is fixed
by `OWN`, `ENDINGS` and the number of states. For training, texts of over `PIECE` tokens are cut into pieces of
that length, so that tasks advance many sequences at a time: a piece that doesn't begin a text begins with the chain's
stationary distribution and isn't counted as a start, and one transition in `PIECE` goes uncounted. Scores take whole
texts as one sequence.

Counts of all training tokens are a table. The most frequent, at most `HEAD`, are sent to the tasks; the rest of the tokens
of the texts is joined to the table by word. Both bounds are fixed, while the table and the join grow with the input.

Edge cases: null text is empty, one end token; a null id counts as the empty text in the split; repeated rows are
scored alike; extra columns don't matter; without any training document all counts are 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare, save, table

END = b"\n"
OWN, ENDINGS, HEAD = 1 << 14, 256, 1 << 17
PIECE = 512
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
#: Tokens that a task works on at once, and of these in a training step, which holds some 140 bytes a token.
AT_ONCE, TRAINED = 1_000_000, 1 << 18


def tokens(text: str | None) -> list[bytes]:
    """Words, lower-cased A-Z, then the end."""
    w = (text or "").encode().lower().split()
    w.append(END)
    return w


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _counts(docs: DataFrame) -> DataFrame:
    """(text) to (word, ending, c)."""
    schema = pa.schema([("word", pa.binary()), ("ending", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen: Counter = Counter()

        def flush():
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(map(ending, words)), pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=schema)
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > COUNTED:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, ending int, n bigint").groupBy("word", "ending").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What tasks need of the counts: the most frequent tokens, and the classes' sizes."""

    def __init__(self, table_: DataFrame):
        got = table_.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.n, self.v = got[0] or 0, got[1]
        # The most frequent, as many whole classes of equal log2 (count) in 32nds as fit: at most HEAD words go to the driver.
        level = F.floor(F.log2("c") * 32)
        common = sorted(table_.groupBy(level.alias("level")).count().collect(), reverse=True)
        room, least = HEAD - 1, math.inf
        for r in common:
            room -= r["count"]
            if room < 0:
                break
            least = r["level"]
        head = table_.filter((level >= F.lit(float(least))) | (F.col("word") == F.lit(END))).collect()
        words = {bytes(r["word"]): r["c"] for r in head}
        ends = words.pop(END, 0)
        self.head = [(END, ends), *sorted(words.items(), key=lambda x: (-x[1], x[0]))]
        sizes = table_.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
        n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for r in sizes:
            n[r["ending"]], v[r["ending"]] = r["n"], r["v"]
        for w, c in self.head[:OWN]:
            n[ending(w)] -= c
            v[ending(w)] -= c > 0
        self.own = min(OWN, len(self.head))
        self.rest = np.log10(n + v + 1)  # by ending, of words without a class of their own
        self.base = math.log10(self.n + self.v + 1)
        self.start = np.concatenate([np.array([c for _, c in self.head[: self.own]], float), n]) + 1
        self.start /= self.start.sum()

    def words(self) -> dict[bytes, tuple[int, float, float]]:
        """By frequent token: class, log10 (c + 1), log10 of the probability in the class."""
        out = {}
        for k, (w, c) in enumerate(self.head):
            x = math.log10(c + 1)
            out[w] = (k, x, 0.0) if k < self.own else (self.own + ending(w), x, x - self.rest[ending(w)])
        return out


def _encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """(doc_id, text, held_out) to rows with their classes, what the frequent tokens sum up to, and the other words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((voc.head, voc.own, voc.rest))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "head_base", "head_score", "classes", "others"]

    def run(batches):
        v = Vocabulary.__new__(Vocabulary)
        v.head, v.own, v.rest = shared.value
        words = v.words()
        known = {w for w, c in v.head if c}
        get = words.get
        own = v.own
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            ids, late = b.column(0), b.column(2)

            def batch(lo, hi):
                arrays = [pa.array(out[0], pa.int64()), ids.slice(lo, hi - lo), late.slice(lo, hi - lo), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.float64()), pa.array(out[6], pa.float64()), pa.array(out[7], pa.list_(pa.int16())), pa.array(out[8], pa.string())]
                return pa.RecordBatch.from_arrays(arrays, names=names)

            lo = 0
            for k, t in enumerate(b.column(1)):
                w = tokens(t.as_py())
                got = list(map(get, w))
                others = []
                if None in got:
                    for j, x in enumerate(got):
                        if x is None:
                            others.append(w[j])
                            got[j] = (own + ending(w[j]), 0.0, 0.0)
                cls, base, score = zip(*got)
                missing = len(others) + (END not in known)
                for col, x in zip(out, (row, None, None, len(w), len(w) - missing, math.fsum(base), math.fsum(score), np.array(cls, np.int16), b" ".join(others).decode())):
                    col.append(x)
                row += 1
                held += len(w)
                if held > AT_ONCE:
                    yield batch(lo, k + 1)
                    out, held, lo = [[] for _ in names], 0, k + 1
            if lo < len(ids):
                yield batch(lo, len(ids))

    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, head_base double, head_score double, classes array<smallint>, others string"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


class Model:
    """start (states), move (states by states), emit (classes by states); rows of move and columns of emit sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(voc: Vocabulary, states: int, seed: int = 7) -> Model:
        """Unlike states to begin with: each favours words of some endings, and tends to stay."""
        r = np.random.default_rng(seed)
        like = np.exp(r.normal(0, 1.0, (1024, states)))
        rows = [zlib.crc32(b"%b" % w[-2:]) % 1024 for w, _ in voc.head[: voc.own]] + [k for k in range(ENDINGS)]
        emit = voc.start[:, None] * like[np.array(rows)]
        move = np.full((states, states), 0.3 / (states - 1))
        np.fill_diagonal(move, 0.7)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def fitted(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        """From expected counts. prior: the classes' shares, which smooth the emissions."""
        k = len(start)
        emit = emit + 200.0 * prior[:, None]
        move = move + 1.0
        start = start + 1.0
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True)) if k else Model(start, move, emit)

    def stationary(self) -> np.ndarray:
        """The states' shares in the long run."""
        k = len(self.start)
        return np.linalg.lstsq(np.vstack([self.move.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0].clip(1e-12)

    def expected(self, flat: np.ndarray, sizes: np.ndarray, into: list[np.ndarray], begins: np.ndarray | None = None) -> None:
        """Adds the expected counts of sequences, one after the other in flat, to into (start, move, emit). begins: whether a sequence is a text's beginning."""
        order = np.argsort(-sizes, kind="stable")
        begins = np.ones(len(sizes), bool) if begins is None else begins[order]
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        steps = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
        emit, move, k = self.emit, self.move, len(self.start)
        at = np.concatenate([[0], np.cumsum(active)])
        obs = flat[np.concatenate([begin[:n] + t for t, n in enumerate(active)])]
        seen = emit[obs]
        alpha = np.empty((len(obs), k))
        scale = np.empty(len(obs))
        first = np.where(begins[:, None], self.start, self.stationary())
        for t in range(steps):
            lo, hi = at[t], at[t + 1]
            a = (alpha[at[t - 1] : at[t - 1] + hi - lo] @ move if t else first) * seen[lo:hi]
            s = a.sum(axis=1)
            scale[lo:hi] = s
            np.divide(a, s[:, None], out=alpha[lo:hi])
        beta = np.ones((active[-1], k))
        moved = np.zeros((k, k))
        for t in range(steps - 1, 0, -1):
            lo, hi = at[t], at[t + 1]
            later = seen[lo:hi] * beta / scale[lo:hi, None]
            n = hi - lo
            before = alpha[at[t - 1] : at[t]]
            moved += before[:n].T @ later
            alpha[lo:hi] *= beta  # now the posterior
            beta = np.ones((len(before), k))
            beta[:n] = later @ move.T
        alpha[: at[1]] *= beta
        into[0] += alpha[: at[1]][begins].sum(axis=0)
        into[1] += moved * move
        for j in range(k):
            into[2][:, j] += np.bincount(obs, alpha[:, j], len(emit))

    def log10(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Exact log10 probability of each sequence of classes, by the scaled forward recursion."""
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        sorted_ = sizes[order]
        steps = int(sorted_[0])
        active = np.searchsorted(-sorted_, -np.arange(steps), side="left")
        total = np.zeros(len(sizes))
        a = None
        for t in range(steps):
            n = active[t]
            seen = self.emit[flat[begin[:n] + t]]
            a = (a[:n] @ self.move if t else self.start) * seen
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:n] += np.log10(s)
        out = np.empty(len(sizes))
        out[order] = total
        return out


def _spans(sizes: np.ndarray, most: int):
    """Neighbours that sum up to at most `most`, or one: from and to, and the sums of all before these."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        yield lo, hi, int(upto[lo]), int(upto[hi])
        lo = hi


def _lists(batches, columns: int):
    """Batches of at most AT_ONCE tokens or one row: other columns, flat classes, sizes."""
    for b in batches:
        sizes = np.asarray(b.column(columns).value_lengths())
        for lo, hi, _, _ in _spans(sizes, AT_ONCE):
            part = b.slice(lo, hi - lo)
            yield part, np.asarray(part.column(columns).flatten()).astype(np.int64), sizes[lo:hi].astype(np.int64)


def _step(rows: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One step of Baum-Welch over all rows (classes)."""
    k = len(model.start)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["class", *[f"s{j}" for j in range(k)]]

    def run(batches):
        m = shared.value
        into = [np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)]
        for _, flat, sizes in _lists(batches, 0):
            pieces, begins = [], []
            for n in sizes.tolist():
                cut = [PIECE] * (n // PIECE) + [n % PIECE] * (n % PIECE > 0)
                pieces += cut
                begins += [True] + [False] * (len(cut) - 1)
            pieces, begins = np.array(pieces), np.array(begins)
            for lo, hi, at, end in _spans(pieces, TRAINED):
                m.expected(flat[at:end], pieces[lo:hi], into, begins[lo:hi])
        used = np.flatnonzero(into[2].any(axis=1))
        classes = np.concatenate([[-1], np.arange(-1 - k, -1), used])  # start, then states, then classes
        values = np.concatenate([into[0][None], into[1], into[2][used]])
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), *[pa.array(values[:, j]) for j in range(k)]], names=names)

    schema = "class int, " + ", ".join(f"s{j} double" for j in range(k))
    sums = rows.select("classes").mapInArrow(run, schema).groupBy("class").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).collect()
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for c, *x in sums:
        if c >= 0:
            emit[c] = x
        elif c == -1:
            start[:] = x
        else:
            move[c + 1 + k] = x
    return Model.fitted(start, move, emit, prior)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of _encoded, with path_score in place of classes and others."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    slim = rows.drop("classes", "others")
    names = [*slim.columns, "path_score"]

    def run(batches):
        for b, flat, sizes in _lists(batches, len(names) - 1):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.log10(flat, sizes))], names=names)

    return rows.select(*slim.columns, "classes").mapInArrow(run, StructType([*slim.schema.fields]).add("path_score", "double"))


def score(docs: DataFrame, held_out, states: int = 6, steps: int = 3) -> DataFrame:
    """Scores all documents (doc_id, text) by a model of those for which held_out isn't true. See op2_hmm for the columns."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = save(_counts(docs.filter(~F.col("held_out"))), "counts")
    voc = Vocabulary(counts)
    rows = save(_encoded(docs, voc), "classes")
    model = Model.first(voc, states)
    training = rows.filter(~F.col("held_out"))
    for _ in range(steps):
        model = _step(training, model, voc.start)
    # The words that aren't frequent, by way of the table of counts.
    rest = F.element_at(F.array(*[F.lit(float(x)) for x in voc.rest]), F.col("ending") + 1)
    others = rows.filter("others != ''").select("row", F.explode(F.split("others", " ")).alias("other"))
    others = others.select("row", F.encode("other", "utf-8").alias("other"))
    x = others.join(counts, F.col("other") == F.col("word"), "left")
    # The class's size is that of the word's ending, which the table has of known words only.
    cls = F.pmod(F.crc32(F.when(F.octet_length("other") > 3, F.substring("other", -3, 3)).otherwise(F.col("other"))), F.lit(ENDINGS)).cast("int")
    x = x.select("row", F.log10(F.coalesce("c", F.lit(0)) + 1).alias("lc"), F.col("c").isNotNull().cast("bigint").alias("known"), cls.alias("ending"))
    x = x.groupBy("row").agg(F.sum("lc").alias("other_base"), F.sum(F.col("lc") - rest).alias("other_score"), F.sum("known").alias("other_known")).withColumnRenamed("row", "row_")
    out = _scored(rows, model).join(x, F.col("row") == F.col("row_"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("other_known")).alias("n_known"), F.lit(voc.n).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + zero("other_base") - F.lit(voc.base) * F.col("n_tokens")).alias("base_score"),
        (F.col("path_score") + F.col("head_score") + zero("other_score")).alias("score"),
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score(docs, held_out)
