"""Removal of repeated byte strings, by prefix doubling over content-anchored positions.

Every byte covered by a string of `length` bytes that also starts elsewhere, in any document or the same one, is
removed. Sorting all positions by rank pairs at growing offsets would write some 16 bytes a position and round,
far more than the input, so positions are sampled by content and the doubling starts from them:

1. Anchors. Each window of `length` bytes is owned by its smallest 16-gram (by hash, the leftmost of equals), its
   anchor. Equal windows have equal anchors at equal offsets. An anchor owns a run of consecutive windows, on
   average half a window long.
2. Ranks. A run is cut at the middle offset. All windows of a half share a core of over half a window. Spark groups
   (core, whole context) pairs: halves with a unique core drop out; those whose whole context occurs twice are
   repeats over their whole length; the rest go on.
3. Doubling. Of the rest, groups of equal cores are refined at ever longer cores: each step halves what is missing
   to the full length, drops what has become unique and settles what has become equal, until the cores are whole
   windows. A group of more than `HOT` contexts isn't gathered in a task; its windows are ranked by Spark instead.
4. The repeats are merged by text and cut out.

Equal texts are one text throughout (copies are aggregated before the shuffle), and are repeats of each other.
Texts are kept in a table bucketed by their key, so that the later joins move only slim rows. Keys are MD5 digests;
within step 3 bytes are compared.

Edge cases: null is the empty text; texts shorter than `length` keep everything; repeated rows are copies; null
ids are allowed; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, named_table, new_path, prepare, save, table

GRAM = 16
#: Distinct contexts of a group that are compared in one task.
HOT = 20_000
#: Bytes of text scanned at once.
PART = 2 << 20
#: Bytes of the input's files a bucket of the texts' table, and how many buckets Spark allows.
BUCKET, MOST = 128 << 20, 100_000


def _owners(data: np.ndarray, length: int) -> np.ndarray:
    """For each start of a window, the position of its anchor."""
    w = length - GRAM + 1
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    blocks = -(-n // w)
    v = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    bits = np.uint64(w.bit_length())
    low = np.uint64((1 << w.bit_length()) - 1)
    v[:n] = h & ~low
    v = v.reshape(blocks, w)
    v |= np.arange(w, dtype=np.uint64)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    a, b = back[: n - w + 1], ahead[w - 1 : n]
    first = (a >> bits) <= (b >> bits)
    at = np.where(first, starts // w, (starts + w - 1) // w) * w
    return at + np.where(first, a & low, b & low).astype(np.int64)


def _runs(texts: list[bytes], length: int):
    """(text's index, anchor, least and greatest offset of its windows), in columns; offsets count back from the anchor."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    own = _owners(data, length)
    starts = np.arange(len(own))
    of = np.searchsorted(ends, starts, side="right")
    ok = of < len(texts)
    ok[ok] = starts[ok] + length <= ends[of[ok]]
    starts = starts[ok]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    own, of = own[starts], of[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(own) != 0) | (np.diff(of) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    of, own = of[first], own[first]
    return of, own - begins[of], own - starts[last], own - starts[first]


def _halves(length: int) -> tuple[tuple[int, int], tuple[int, int]]:
    most = length - GRAM
    return (0, most // 2), (most // 2 + 1, most)


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    """(key, text) to (key, x, least, most, core, whole): half-runs with the hashes of their core and whole context."""
    from_, to = _halves(length)

    def rows(keys: list[bytes], parts: list[bytes], shift: list[int], out: list[list]) -> None:
        from xxhash import xxh3_64_intdigest as digest

        for i, x, a, b in zip(*(c.tolist() for c in _runs(parts, length))):
            t = parts[i]
            for lo, hi in (from_, to):
                r, s = max(a, lo), min(b, hi)
                if r <= s:
                    for c, y in zip(out, (keys[i], x + shift[i], r, s, digest(t[x - lo : x + length - hi], lo) - (1 << 63), digest(t[x - s : x + length - r], r * length + s) - (1 << 63))):
                        c.append(y)

    schema = pa.schema([("key", pa.binary()), ("x", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("core", pa.int64()), ("whole", pa.int64())])

    def run(batches):
        out: list[list] = [[] for _ in schema]
        keys: list[bytes] = []
        parts: list[bytes] = []
        shift: list[int] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                t = (text.as_py() or "").encode()
                if len(t) < length:
                    continue
                key = key.as_py()
                for at in range(0, len(t) - length + 1, PART):  # windows that start here
                    part = t[at : at + PART + length - 1]
                    keys.append(key)
                    parts.append(part)
                    shift.append(at)
                    held += len(part)
                    if held >= PART:
                        rows(keys, parts, shift, out)
                        keys, parts, shift, held = [], [], [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out = [[] for _ in schema]
        if parts:
            rows(keys, parts, shift, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return texts.select("key", "text").mapInArrow(run, "key binary, x bigint, least int, most int, core bigint, whole bigint")


def _settle(members: list[tuple], lo: int, hi: int, length: int, out: list[tuple[int, int, int]]) -> None:
    """members (index, least, most, context) of equal cores: windows of offsets lo to hi that occur twice, to out."""
    groups: dict[bytes, list] = defaultdict(list)
    for m in members:
        _, a, b, c = m
        groups[c[b - lo : b + length - hi]].append(m)
    for group in groups.values():
        if len(group) < 2:
            continue
        same: dict[tuple, list] = defaultdict(list)
        for m in group:
            i, a, b, c = m
            r, s = max(a, lo), min(b, hi)
            same[r, s, c[b - s : b + length - r]].append(m)
        for (r, s, _), found in same.items():
            if len(found) > 1:
                out.extend((m[0], r, s) for m in found)
        if lo < hi and len(same) > 1:
            mid = (lo + hi) // 2
            one = [found[0] for found in same.values()]
            for p, q in ((lo, mid), (mid + 1, hi)):
                rest = [m for m in one if m[1] <= q and m[2] >= p]
                if len(rest) > 1:
                    _settle(rest, p, q, length, out)


def _contexts(cand: DataFrame, texts: DataFrame, length: int, windows: bool) -> DataFrame:
    """cand (core, key, x, least, most, single) with their contexts, or, if windows, with the digest of each window."""
    lists = cand.groupBy("key").agg(F.collect_list(F.struct("core", "x", "least", "most", "single")).alias("spots")).withColumnRenamed("key", "key_")
    joined = texts.select("key", "text").join(lists.hint("shuffle_hash"), F.col("key") == F.col("key_")).select("key", "text", "spots")
    names = ["core", "key", "x", "least", "most", "single", "context"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for key, text, spots in zip(*(batch.column(k) for k in range(3))):
                key, t = key.as_py(), text.as_py().encode()
                for s in spots.as_py():
                    x, a, b = s["x"], s["least"], s["most"]
                    spans = [(o, o) for o in range(a, b + 1)] if windows else [(a, b)]
                    for a, b in spans:
                        c = t[x - b : x + length - a]
                        for col, v in zip(out, (s["core"], key, x, a, b, s["single"], hashlib.blake2b(c, digest_size=16).digest() if windows else c)):
                            col.append(v)
                        held += 1
                    if held >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                        out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return joined.mapInArrow(run, "core bigint, key binary, x bigint, least int, most int, single boolean, context binary")


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts to repeats (key, begin, end); groups of equal cores come whole, one after the other."""
    halves = _halves(length)
    names, kinds = ["key", "begin", "end"], [pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        group: list[tuple] = []
        now = None

        def settle() -> list[tuple[bytes, int, int]]:
            found: list[tuple[int, int, int]] = []
            for lo, hi in halves:
                members = [(i, a, b, c) for i, (_, _, a, b, _, c) in enumerate(group) if lo <= a <= hi]
                if len(members) > 1:
                    _settle(members, lo, hi, length, found)
            return [(group[i][0], group[i][1] - s, group[i][1] - r + length) for i, r, s in found if group[i][4]]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=names)

        for b in batches:
            out = []
            for core, *row in zip(*(c.to_pylist() for c in b.columns)):
                if core != now:
                    if len(group) > 1:
                        out += settle()
                    group, now = [], core
                group.append(tuple(row))
            if out:
                yield batch(out)
        if len(group) > 1 and (out := settle()):
            yield batch(out)

    return contexts.repartition("core").sortWithinPartitions("core").mapInArrow(run, "key binary, begin bigint, end bigint")


def _cut(texts: DataFrame, repeats: DataFrame, length: int) -> DataFrame:
    """(key, text, copies) less the repeats: (key, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    lists = repeats.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).withColumnRenamed("key", "key_")
    joined = texts.join(lists.hint("shuffle_hash"), F.col("key") == F.col("key_"), "left").select("key", "text", "copies", "spans")
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text, copies, spans in zip(*(batch.column(k) for k in range(4))):
                t = (text.as_py() or "").encode()
                pairs = sorted((s["begin"], s["end"]) for s in spans.as_py() or ())
                if copies.as_py() > 1 and len(t) >= length:
                    pairs = [(0, len(t))]
                at = removed = n = 0
                digest = hashlib.sha256()
                stop = -1
                for a, b in pairs:
                    if a > stop:
                        n += 1
                    if b > at:
                        a = max(a, at)
                        digest.update(t[at:a])
                        removed += b - a
                        at = b
                    stop = max(stop, b)
                digest.update(t[at:])
                for c, v in zip(out, (key.as_py(), len(t), removed, n, digest.hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return joined.mapInArrow(run, "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _buckets(docs: DataFrame) -> int:
    """Buckets of about `BUCKET` bytes of the input's files, no fewer than the session's shuffle partitions."""
    size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # frames that aren't of files have no size
    return min(MOST, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET)))


def text_table(docs: DataFrame) -> DataFrame:
    """(text) to (key, text, copies), once a text, bucketed by key."""
    spark = docs.sparkSession
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.unhex(F.md5(t)).alias("key"), t.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = named_table(spark, "texts")
    n, before = _buckets(docs), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)  # so a task's rows are of its own buckets
    try:
        texts.write.bucketBy(n, "key").format("parquet").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("path", new_path(spark, "texts")).saveAsTable(name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.table(name)


def repeats(texts: DataFrame, length: int = 400) -> DataFrame:
    """(key, text, copies), each text once, to repeats (key, begin, end) of bytes; they may overlap."""
    prepare(texts.sparkSession)
    runs = save(_anchored(texts, length), "runs")
    classes = runs.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"))
    cores = classes.groupBy("core").agg(F.sum("n").alias("n_core"), F.count(F.lit(1)).alias("n_classes")).filter("n_core > 1")
    cores = save(cores.select(F.col("core").alias("core_"), "n_classes"), "cores")
    again = save(runs.join(cores, F.col("core") == F.col("core_")).drop("core_"), "candidates")
    twice = again.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "x", "least", "most")).alias("one"), F.max("n_classes").alias("n_classes"))
    twice = save(twice, "classes")
    equal = again.join(twice.filter("n > 1").select(F.col("core").alias("c"), F.col("whole").alias("w")), (F.col("core") == F.col("c")) & (F.col("whole") == F.col("w")), "left_semi")
    equal = equal.select("key", (F.col("x") - F.col("most")).alias("begin"), (F.col("x") - F.col("least") + length).alias("end"))
    rest = twice.filter("n_classes > 1").select("core", "one.*", (F.col("n") == 1).alias("single"), "n_classes")
    out = equal.unionAll(_refined(_contexts(rest.filter(F.col("n_classes") <= HOT), texts, length, False), length))
    hot = rest.filter(F.col("n_classes") > HOT)
    if not hot.isEmpty():
        w = save(_contexts(hot, texts, length, True), "windows")
        same = w.groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("context").alias("context_"))
        w = w.filter("single").join(same, F.col("context") == F.col("context_"), "left_semi")
        out = out.unionAll(w.select("key", (F.col("x") - F.col("most")).alias("begin"), (F.col("x") - F.col("least") + length).alias("end")))
    return out


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = text_table(docs)
    out = save(_cut(texts, repeats(texts), 400), "cut")
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key_"))
    return rows.join(out, F.col("key_") == F.col("key")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
