"""Near-duplicates by one rule: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates come from SimHash and from MinHash. SimHash: fingerprints of the sets of shingles that are equal or differ in
at most `RADIUS` bits, found by simhash.py's BK-trees. That is what closest pairs do; a pair at 0.8 differs in 9.7 bits on
average, so the bound itself needs MinHash: `BANDS` bands of `ROWS` minima each, so that a pair at 0.8 agrees in none of the bands
with a probability of (1 - 0.8 ** 4) ** 32 = 5e-8, and closer pairs with less. A candidate is linked only if the exact
similarity, of the words themselves, is at least 4 / 5; components are formed of these links alone.

Before their texts are fetched, candidates are dropped that agree in fewer than `AGREE` of the 128 minima (a pair at 0.8
does with a probability of 1e-9); before texts are compared word by word, those whose numbers of shingles, or whose
shingles' 64-bit hashes, can't reach the bound, with an allowance for equal hashes of unlike shingles.

Texts of the same words are one node and never expanded. The members of a band's group are first compared with its
first node; of the other pairs only those that aren't yet in the same component can matter. These are searched in
blocks of a group, and only likely pairs become rows. So many copies of one text cost a comparison each, not one a
pair, and a large group is spread over tasks and emits no pairs but likely ones. Texts are fetched for candidates alone: the others are kept out of the shuffles by a
bitmap of fixed size, whose false positives the joins remove.

Edge cases: words are those of simhash.py (A-Z lowered, white space of ASCII); a text of fewer than five words is one
shingle; null and empty texts have no words and are one node; null ids are allowed; of repeated rows one stays; extra
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import prepare, save
from .graph import components

WIDTH = 5
#: The least similarity of a link, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 4
#: Bits in which fingerprints of candidates may differ; simhash.py bounds its shards up to 2.
RADIUS = 2
#: Shingles whose minima are taken at once, and the binary digits of the bitmap's size.
CHUNK, BITMAP = 1024, 25
#: Minima that likely pairs have in common, and nodes of a group that are searched at once.
AGREE, BLOCK = 72, 1024
#: Hashes of unlike shingles that may be equal.
SLACK = 2
#: Shingles' hashes that a comparing task remembers.
REMEMBERED = 2_000_000

_MIX = np.random.default_rng(20).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64)
_XOR, _ODD = _MIX[0][:, None], (_MIX[1] * np.uint64(2) + np.uint64(1))[:, None]
_P = np.uint64(0x9E3779B97F4A7C15)
#: By a byte its bits, the lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingles(w: list[bytes]) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    from xxhash import xxh64_intdigest

    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([xxh64_intdigest(x) for x in w], np.uint64)
    width = min(WIDTH, len(w))
    s = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        s = _stir((s ^ h[k : k + len(s)]) * _P)
    return np.unique(s)


def _fingerprint(s: np.ndarray) -> int:
    """The SimHash of shingles' hashes as a signed number: a bit is set if it is in over half of them."""
    b = s.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(b[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(s), bitorder="little").tobytes(), "little", signed=True)


def _minima(s: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CHUNK):
        least = np.minimum(least, ((s[None, at : at + CHUNK] ^ _XOR) * _ODD).min(axis=1))
    return least


def _bands(least: np.ndarray) -> list[int]:
    """A number a band; texts that agree in a band's minima agree in it."""
    out = np.arange(BANDS, dtype=np.uint64) * _P
    for k in range(ROWS):
        out = _stir((out ^ least[k::ROWS]) * _P)
    return out.view(np.int64).tolist()


def _possible(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether texts of these shingles' hashes can be similar. Up to SLACK hashes may be equal by chance."""
    if DENOMINATOR * (min(len(p), len(q)) + SLACK) < NUMERATOR * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True)) + SLACK
    return DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both)


def similar(a: str | None, b: str | None) -> bool:
    """Whether the shingles' exact Jaccard similarity reaches the bound. Words are numbered, so nothing is hashed away."""
    number: dict[bytes, int] = {}
    sets = []
    for t in (a, b):
        x = np.array([number.setdefault(w, len(number)) for w in _words(t)], np.int32)
        if len(x) < WIDTH:
            x = np.concatenate([x, np.full(WIDTH - len(x), -1, np.int32)])  # no shingle of five words has a -1
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WIDTH))
        sets.append(np.unique(rows.view(f"V{4 * WIDTH}").ravel()))
    p, q = sets
    if DENOMINATOR * min(len(p), len(q)) < NUMERATOR * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both)


def _signatures(docs: DataFrame) -> DataFrame:
    """(key, text) to (key, words, size, fp, bands, minima); words: the MD5 of the words, minima: their low bytes."""

    def run(batches):
        for b in batches:
            nodes, sizes, fps, bands, minima = [], [], [], [], []
            for t in b.column(1):
                w = _words(t.as_py())
                s = _shingles(w)
                nodes.append(hashlib.md5(b" ".join(w)).digest())
                sizes.append(len(s))
                fps.append(_fingerprint(s))
                least = _minima(s)
                bands.append(_bands(least) if len(s) else [])
                minima.append((least >> np.uint64(8)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(minima, pa.binary())], names=["key", "words", "size", "fp", "bands", "minima"])

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, words binary, size int, fp bigint, bands array<bigint>, minima binary")


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (id, hash, ...) with `marked`: true for all whose (id, hash) keys has, and for few others."""
    at = lambda d: d.withColumn("_p", F.xxhash64("id", "hash").bitwiseAND(F.lit((1 << BITMAP) - 1)))
    part, bit = F.call_function("shiftright", F.col("_p"), F.lit(15)), F.col("_p").bitwiseAND(F.lit((1 << 15) - 1))
    bits = save(at(keys.select("id", "hash")).groupBy(part.alias("_b")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "bitmap")
    x = at(rows).join(F.broadcast(bits), part == F.col("_b"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.call_function("shiftright", bit, F.lit(3)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return x.select(*[rows[c] for c in rows.columns], F.coalesce(found, F.lit(False)).alias("marked"))


def _place(id_: str, hash_: str) -> Column:
    """A text's place as one key without nulls."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit("null")), F.col(hash_))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs of nodes (a, b), those whose texts are similar. docs: (id, hash, text)."""
    wanted = pairs.select(F.col("a").alias("x")).unionAll(pairs.select("b")).distinct()
    wanted = save(nodes.join(wanted, F.col("node") == F.col("x")).select("node", F.col("first.id").alias("id"), F.col("first.hash").alias("hash")), "wanted")
    near = _marked(docs, wanted).filter("marked").groupBy(_place("id", "hash").alias("at")).agg(F.first("text").alias("text"))
    texts = save(near.join(wanted.select("node", _place("id", "hash").alias("at")), "at").select("node", "text"), "texts")
    a, b = texts.toDF("xa", "ta"), texts.toDF("xb", "tb")
    both = pairs.join(a, F.col("a") == F.col("xa")).join(b, F.col("b") == F.col("xb")).select("a", "b", "ta", "tb")

    def run(batches):
        known: dict[int, np.ndarray] = {}
        held = 0

        def shingles(node: int, text) -> np.ndarray:
            nonlocal held
            s = known.get(node)
            if s is None:
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                s = known[node] = _shingles(_words(text.as_py()))
                held += len(s)
            return s

        for x in batches:
            keep = []
            for p, q, t, u in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), x.column(3)):
                keep.append(_possible(shingles(p, t), shingles(q, u)) and similar(t.as_py(), u.as_py()))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return save(both.mapInArrow(run, "a bigint, b bigint"), "links")


def _fingerprinted(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b), a < b, that connect all whose fingerprints differ in at most RADIUS bits."""
    x = nodes.filter("size > 0").select("node", "fp")
    first = save(x.groupBy("fp").agg(F.min("node").alias("m")), "fingerprints")
    equal = x.join(first.toDF("fp_", "m"), F.col("fp") == F.col("fp_")).filter("node != m").select(F.col("m").alias("a"), F.col("node").alias("b"))
    near = save(simhash.links(first.select("fp"), RADIUS).distinct(), "near")
    near = near.join(first.toDF("fa", "ma"), F.col("a") == F.col("fa")).join(first.toDF("fb", "mb"), F.col("b") == F.col("fb"))
    return equal.unionAll(near.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")))


def _agree(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) that are likely to be similar by their sizes and minima."""
    x = nodes.select("node", "size", "minima")
    both = pairs.join(x.toDF("na", "sa", "ma"), F.col("a") == F.col("na")).join(x.toDF("nb", "sb", "mb"), F.col("b") == F.col("nb")).select("a", "b", "sa", "sb", "ma", "mb")

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            _, _, p, q, ma, mb = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            m, n = (np.frombuffer(b"".join(x.tolist()), np.uint8).reshape(len(x), -1) for x in (ma, mb))
            yield b.select(["a", "b"]).filter(pa.array(_may(p, q) & ((m == n).sum(axis=1) >= AGREE)))

    return both.mapInArrow(run, "a bigint, b bigint")


def _may(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether texts of these numbers of shingles can be similar."""
    return DENOMINATOR * (np.minimum(p, q) + SLACK) >= NUMERATOR * np.maximum(p, q)


def _likely(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(band, node, root) to the distinct pairs (a, b) of a band, of unlike roots, that are likely to be similar."""
    blocks = open_.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("band", "band_")
    x = open_.join(nodes.select(F.col("node").alias("node_"), "size", "minima"), F.col("node") == F.col("node_")).join(blocks, F.col("band") == F.col("band_"))
    x = x.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "size", "root", "minima")

    def likely(cols: list[np.ndarray]):
        _, lo, hi, own, node, size, root, minima = cols
        m = np.frombuffer(b"".join(minima.tolist()), np.uint8).reshape(len(node), -1)
        inner = lo[0] == hi[0]
        left = range(len(node) - 1) if inner else np.flatnonzero(own == lo[0])
        right = np.flatnonzero(own == hi[0])
        for i in left:
            j = np.arange(i + 1, len(node)) if inner else right
            j = j[(root[j] != root[i]) & _may(size[j], size[i])]
            for k in j[(m[j] == m[i]).sum(axis=1) >= AGREE]:
                yield min(node[i], node[k]), max(node[i], node[k])

    def run(batches):
        rest: list[np.ndarray] | None = None
        for b in _ended(batches):
            if b is not None:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if rest is None or not len(rest[0]):
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rest[:3]], axis=0)) + 1
            cuts = [0, *new.tolist()] + ([len(rest[0])] if b is None else [])
            pairs = {p for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1 for p in likely([c[lo:hi] for c in rest])}
            rest = [c[cuts[-1] :] for c in rest]  # the last group may go on
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

    keys = ["band", "lo", "hi"]
    return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (id, hash, text) to rows (key, words), nodes (node, words, first, n) and components (node, root) of linked nodes."""
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("hash").alias("hash"))
    rows = save(_signatures(docs.select(key.alias("key"), "text")), "signatures")
    nodes = rows.groupBy("words").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("minima").alias("minima"))
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers, as what follows has many rows a node
    w = W.partitionBy("band")
    groups = nodes.select("node", F.explode("bands").alias("band")).withColumn("m", F.min("node").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    groups = save(groups.filter("k > 1").select("band", "node", "m"), "groups")
    star = groups.filter("node != m").select(F.col("m").alias("a"), F.col("node").alias("b"))
    star = save(_agree(_fingerprinted(nodes).unionAll(star).distinct(), nodes), "pairs")
    linked = _verified(star, nodes, docs)
    found = components(linked).toDF("node_", "root")
    open_ = groups.join(found, F.col("node") == F.col("node_"), "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    open_ = open_.withColumn("least", F.min("root").over(w)).withColumn("most", F.max("root").over(w)).filter("least != most")
    open_ = save(open_.select("band", "node", "root"), "open")
    more = save(_likely(open_, nodes).join(star, ["a", "b"], "left_anti"), "pairs")
    return rows.select("key", "words"), nodes.select("node", "words", "first", "n"), components(linked.unionAll(_verified(more, nodes, docs)))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) less near-duplicates: of each component one row stays, that of
    the smallest id (null last), then the smallest hash of the text."""
    inner = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    text = F.col("text").cast("string")
    x = docs.select(inner, F.col("doc_id").alias("id"), F.coalesce(F.md5(text), F.lit("")).alias("hash"), text.alias("text"))
    rows, nodes, found = classes(x.select("id", "hash", "text"))
    linked = nodes.join(found.toDF("node_", "root"), F.col("node") == F.col("node_"), "left").filter("n > 1 or root is not null")
    linked = save(linked.select("words", "first", F.coalesce("root", "node").alias("root")), "linked")
    best = linked.groupBy("root").agg(F.min("first").alias("best")).withColumnRenamed("root", "root_")
    best = linked.join(best, F.col("root") == F.col("root_")).select(F.col("words").alias("words_"), "best")
    state = rows.join(best, F.col("words") == F.col("words_")).select(F.col("key.id").alias("id"), F.col("key.hash").alias("hash"), (F.col("key") == F.col("best")).alias("stays"))
    state = save(state.distinct(), "state")
    flagged = _marked(x.select("row", "id", "hash"), state)
    alone, shared = flagged.filter("not marked").select("row"), flagged.filter("marked")
    to = state.select(_place("id", "hash").alias("at"), "stays")
    shared = shared.groupBy(_place("id", "hash").alias("at")).agg(F.first("row").alias("row")).join(to, "at", "left").filter("coalesce(stays, true)")
    return alone.unionAll(shared.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
