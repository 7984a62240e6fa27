"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance by BK-trees.

Equal fingerprints are one node, so copies are never expanded. Two fingerprints within the radius r differ in at
most r of r + k blocks of bits, so they agree in k of the blocks: each fingerprint goes to one shard per choice of
k blocks (2 up to radius 2, else 3), and a shard's fingerprints are linked by a BK-tree (children keyed by their distance from the parent;
a search follows only edges within the radius of its own distance). A shard's tree is sent to the task that holds
its queries. Trees aren't broadcast: together they grow with the corpus. A shard above `SHARD` fingerprints is
split again by two of the blocks of the bits that are left, so that at a radius of 2 no task gets more than 2 ** 16
fingerprints. (At larger radii more bits stay free, up to 30 at a radius of 5, and a shard may be larger.)

A shard yields a spanning forest of its links, not all pairs; components follow from the forests by star steps.

Edge cases: null and empty texts have no shingles and the fingerprint zero, linked like any other; null ids are
allowed (a component's id is its smallest that isn't null); repeated rows give repeated results; extra columns
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, save, table
from .graph import components

#: Fingerprints above which a shard is split again.
SHARD = 2048
#: Shingles hashed at once.
CHUNK = 1 << 16


def _fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number. A bit is set if it is in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # of bytes: A-Z and white space of ASCII only
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = w[at : at + CHUNK + width - 1]
        if len(part) < width:
            hashes = [xxh64_intdigest(b" ".join(part), seed)]
        elif width == 3:
            hashes = [xxh64_intdigest(b"%b %b %b" % x, seed) for x in zip(part, part[1:], part[2:])]
        else:
            hashes = [xxh64_intdigest(b" ".join(part[i : i + width]), seed) for i in range(len(part) - width + 1)]
        h = np.array(hashes, np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text) to (doc_id, fp); only these go through Python."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


class BkTree:
    """A BK-tree of unsigned 64-bit numbers. search gives the kept numbers within the radius."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def search(self, x: int, radius: int) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            y, children = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                out.append(y)
            if children:
                for k in range(max(1, d - radius), d + radius + 1):
                    child = children.get(k)
                    if child is not None:
                        todo.append(child)
        return out


def _forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within the radius, without cycles. members are distinct."""
    tree, parent, out = BkTree(), {x: x for x in members}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in members:
        for y in tree.search(x, radius):
            a, b = find(x), find(y)
            if a != b:
                parent[a] = b
                out.append((x, y))
        tree.add(x)
    return out


def _blocks(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """Bits low to high - 1 in n blocks, as (shift, mask)."""
    cuts = [low + (high - low) * k // n for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _sharded(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, ...) with shard: the number of a mask and the fingerprint's bits under it."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)]))
    return fps.withColumn("_m", each).select(*fps.columns, F.col("_m.k").alias("k"), F.col("_m.bits").alias("bits"))


def _linked(shards: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Links within groups of equal keys; groups come whole and sorted, one after the other."""

    def run(batches):
        rest: list[np.ndarray] | None = None

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            n = len(cols[0])
            new = np.zeros(n, bool)
            new[:1] = True
            for c in cols[:-1]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, n))
            fp = cols[-1].view(np.uint64)  # unsigned, as distances count bits
            out = [x for a, k in zip(at[size > 1].tolist(), size[size > 1].tolist()) for x in _forest(fp[a : a + k].tolist(), radius)]
            return pa.RecordBatch.from_arrays([pa.array(np.array([x[k] for x in out], np.uint64).view(np.int64)) for k in range(2)], names=["a", "b"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]  # the last is fp
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            n = len(cols[0])
            if not n:
                continue
            last = np.ones(n, bool)  # the last group may go on
            for c in cols[:-1]:
                last &= c == c[-1]
            first = n - int(np.argmin(last[::-1])) if not last.all() else 0
            if first:
                yield links([c[:first] for c in cols])
            rest = [c[first:] for c in cols]
        if rest is not None and len(rest[0]):
            yield links(rest)

    prepare(shards.sparkSession)
    x = shards.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return x.mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all within the radius."""
    agree = 2 if radius <= 2 else 3
    masks = [sum(m << a for a, m in x) for x in combinations(_blocks(0, 64, radius + agree), agree)]
    shards = _sharded(fps.select("fp"), masks)
    sizes = shards.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = save(sizes.filter(F.col("n") > SHARD).select(F.col("k").alias("hk"), F.col("bits").alias("hb")), "hot-shards")
    if hot.isEmpty():
        return _linked(shards, radius, ["k", "bits"])
    cool = shards.join(hot, (F.col("k") == F.col("hk")) & (F.col("bits") == F.col("hb")), "left_anti")
    again = shards.join(hot, (F.col("k") == F.col("hk")) & (F.col("bits") == F.col("hb"))).select("fp", "k", "bits")
    finer = []  # by k, masks over the bits that the shard doesn't fix
    for m in masks:
        left = [b for b in range(64) if not m >> b & 1]
        cuts = [left[len(left) * k // (radius + 2) : len(left) * (k + 1) // (radius + 2)] for k in range(radius + 2)]
        finer.append([sum(1 << b for b in x + y) for x, y in combinations(cuts, 2)])
    sub = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in finer])
    again = again.select("fp", "k", "bits", F.posexplode(F.get(sub, F.col("k"))).alias("j", "mask"))
    again = again.select("fp", "k", "bits", "j", F.col("fp").bitwiseAND(F.col("mask")).alias("more"))
    return _linked(cool, radius, ["k", "bits"]).unionAll(_linked(again, radius, ["k", "bits", "j", "more"]))


def classes(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id)."""
    rows = save(fingerprints(docs, width), "fingerprints")
    first = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    edges = links(first.select("fp"), radius)
    found = components(edges)  # (node, root), of linked fingerprints only
    grouped = first.join(found, F.col("fp") == F.col("node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "root_")
    moved = grouped.join(least, F.col("root") == F.col("root_")).select("fp", "component_id")
    of = first.join(moved.withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(save(of, "classes"), F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of docs (doc_id, text and any others) less near-duplicates: of each component one row stays, that of
    the smallest id (null last), then the smallest hash of the text."""
    inner = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")).alias("hash"))
    ids = classes(docs.select(key.alias("doc_id"), "text"), radius, width)
    keep = ids.filter("doc_id = component_id").select(F.col("doc_id.id").alias("id_"), F.col("doc_id.hash").alias("hash_")).distinct()
    rows = docs.select(inner, F.col("doc_id").alias("id"), key["hash"].alias("hash"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")), "left_semi")
    one = kept.groupBy("id", "hash").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row")[x].alias(x) for x in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
