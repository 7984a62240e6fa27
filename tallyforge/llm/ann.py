"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals, and an exact search of what its bounds don't rule out.

Fitting (on about `SAMPLE` vectors, those of the smallest hashed ids): coarse centroids, about sqrt(n) of them, and
for each group of components 256 code words of the residuals; and how many lists a query probes first: as many as hold
`TARGET` of the sample's own nearest neighbours. Indexing covers every vector: its list (nearest centroid), its residual's
codes and the residual's length, of which each list's largest is kept.

No vector is left out that could be among the k nearest. A query's k-th best score in the sample is a floor for its result.
In a list no score exceeds the centroid's inner product plus the query's length times the list's longest residual, so lists
below the floor hold no neighbour. All bounds are in double precision and allow for rounding, so the index decides
only how much is computed, not what is found: the result is that of brute force at any spread, scale or skew of the vectors.

Lists are packed into blocks (`BLOCK` vectors or a 32nd of all, `LARGEST` bytes at most; larger lists are split), and a
query goes once to each block that has a list above its floor. A task holds a block's vectors and streams the block's
queries past them (`QUERIES` at most; beyond, the block is held by several tasks). Of the lists that a query probes the
candidates are ranked by their centroid's inner product plus asymmetric distance tables (query against code words, no
decoding; one table for all the lists), and the best `RERANK` are scored exactly, which raises the query's floor. Then all
vectors of the lists still above it are multiplied with the query, those that reach the floor are scored on the original
vectors in double precision, and the best k over all blocks are kept, ties to the smaller id. Of equal vectors a block
keeps the k + 1 of the smallest ids. So a list that holds a third of all vectors is spread over many tasks, and nothing is
gathered in one place but centroids, code words, lists' sizes and the sample, which are bounded.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those without
id or of another length than most; of rows with equal ids the one with the least vector counts; copies tie and rank
by id; with fewer than k candidates all are returned; extra columns don't matter; an empty table gives an empty result.
Vectors of doubles are scored as doubles; only the index rounds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, sampled, save, table

SAMPLE, LISTS, WORDS = 20_000, 8_192, 256
#: Vectors of a block, at least, bytes of its vectors as doubles, at most, and queries that a task gets.
BLOCK, LARGEST, QUERIES = 4_096, 16 << 20, 65_536
RERANK = 50
#: Queries that a task searches for at once, vectors whose sums it holds in the processor's cache, vectors that it multiplies at once, and pairs that it holds before it keeps the best.
CHUNK, ROWS, WINDOW, HELD = 256, 512, 2_048, 1 << 20
#: Components of the sample's vectors by which floors are set, at most, and of pairs that are scored at once.
COMPONENTS = 2 << 20
#: Tasks of the search, at most.
TASKS = 4_096
#: Share of the sample's nearest neighbours that the lists probed first hold, of how many queries it is measured, and how many lists are probed at least. They only raise floors early.
TARGET, MEASURED, PROBES = 0.5, 512, 8


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x the nearest row of c, the first of equals."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _centroids(x: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty centroid takes a vector of the largest
            c[n == 0] = x[r.choice(len(x), int((n == 0).sum()))]
    return c


def _rounding(d: int) -> float:
    """More than an inner product of d components is off, as a share of the lengths' product, however it is summed."""
    return 16 * (d + 8) * 2.0**-53


def _lengths(x: np.ndarray) -> np.ndarray:
    """Each row's length, at any scale."""
    most = np.abs(x).max(axis=1)
    unit = x / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt(np.einsum("ij,ij->i", unit, unit))


class Index:
    """Centroids (lists by components) and code words (groups by words by components of a group), in units of `scale`."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        d = sample.shape[1]
        self.scale = float(np.median(np.abs(sample).max(axis=1)))
        sample = self.small(sample)
        self.groups = next(g for g in range(max(1, d // 4), 0, -1) if d % g == 0)
        self.coarse = _centroids(sample, lists, seed)
        rest = (sample - self.coarse[_nearest(sample, self.coarse)]).reshape(len(sample), self.groups, -1)
        words = [_centroids(np.ascontiguousarray(rest[:, g]), WORDS, seed + g, 6) for g in range(self.groups)]
        n = max(map(len, words))
        self.words = np.stack([np.concatenate([w, np.repeat(w[:1], n - len(w), axis=0)]) for w in words])

    def small(self, x: np.ndarray) -> np.ndarray:
        """x as the index sees it: of any scale, but so that no square overflows."""
        with np.errstate(over="ignore"):
            return np.clip(x / np.float64(self.scale), -1e15, 1e15).astype(np.float32)

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists].astype(np.float64) * self.scale

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.small(x)
        at = _nearest(x, self.coarse)
        rest = (x - self.coarse[at]).reshape(len(x), self.groups, -1)
        return at, np.stack([_nearest(np.ascontiguousarray(rest[:, g]), self.words[g]) for g in range(self.groups)], axis=1).astype(np.uint8)

    def probes(self, sample: np.ndarray, k: int) -> int:
        """How many lists hold TARGET of the k nearest of the sample to some of its members."""
        sample = self.small(sample)
        some = np.linspace(0, len(sample) - 1, min(MEASURED, len(sample))).astype(np.int64)
        at = _nearest(sample, self.coarse)
        near = sample[some] @ sample.T
        near[np.arange(len(some)), some] = -np.inf
        best = np.argpartition(-near, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(some), 1), np.int64)
        place = np.empty((len(some), len(self.coarse)), np.int64)  # of each list, in the order in which a query probes
        np.put_along_axis(place, np.argsort(-(sample[some] @ self.coarse.T), axis=1, kind="stable"), np.arange(len(self.coarse))[None], axis=1)
        need = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
        return max(PROBES, int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1)

    def probe(self, q: np.ndarray, used: np.ndarray, probes: int) -> np.ndarray:
        """For each query, the least inner product of the lists in use that it probes first."""
        near = q @ self.coarse[used].T
        return np.partition(near, len(used) - probes, axis=1)[:, len(used) - probes] if probes < len(used) else np.full(len(q), -np.inf, np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the code words with each query's parts: groups by words by queries."""
        return np.ascontiguousarray(np.einsum("qgd,gwd->gwq", q.reshape(len(q), self.groups, -1), self.words))


def _vectors(col) -> np.ndarray:
    """An Arrow list column of equal lengths."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    return np.asarray(col.flatten()).reshape(len(col), -1)


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector) of the vectors that take part, once an id."""
    v = F.col("vector")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    x = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("vector")).filter(fine)
    common = x.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.filter(F.size("vector") == (common[0] if common else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def _packed(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """Lists by size to (list, first block, number of blocks): blocks of several lists, or lists in several blocks."""
    out, block, held = [], 0, 0
    for i in sorted(sizes):
        n = sizes[i]
        if held and held + n > most:
            block, held = block + 1, 0
        split = -(-n // most)
        out.append((i, block, split))
        if split > 1:
            block += split
        else:
            held += n
    return out


class _Lists:
    """The lists in use: their blocks and how far their scores reach; and the vectors of the sample, for floors."""

    def __init__(self, index: Index, packed: list[tuple[int, int, int]], away: dict[int, float], ids: np.ndarray, sample: np.ndarray):
        self.used = np.array([i for i, _, _ in packed])
        self.group, at = np.unique([b for _, b, _ in packed], return_index=True)  # lists that share a block, or one that has several
        self.at, self.split = at, np.array([s for _, _, s in packed])[at]
        far = np.array([away[i] for i in self.used.tolist()])
        self.reach = far + _rounding(sample.shape[1]) * (_lengths(index.centres(self.used)) + far)
        self.ids, self.sample = ids, sample

    def floors(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """For each query no more than the k-th best score, -inf if the sample has fewer."""
        if len(self.ids) < k:
            return np.full(len(q), -np.inf)
        x = self.sample.astype(np.float64)
        near = q @ x.T
        near[ids[:, None] == self.ids[None]] = -np.inf
        return np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - _rounding(q.shape[1]) * _lengths(q) * _lengths(x).max()

    def above(self, index: Index, lists: np.ndarray, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Lists (by place in used) by queries: whether a vector of the list may reach the query's floor."""
        return ~(index.centres(self.used[lists]) @ q.T + np.outer(self.reach[lists], _lengths(q) * (1 + _rounding(q.shape[1]))) < floor)

    def blocks(self, asked: np.ndarray) -> list[np.ndarray]:
        """Lists by queries to each query's blocks."""
        groups = np.logical_or.reduceat(asked, self.at, axis=0)
        where = np.repeat(self.group, self.split) + np.concatenate([np.arange(n) for n in self.split])
        return [where[np.repeat(g, self.split)] for g in groups.T]


def nearest(vectors: DataFrame, is_query, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """(id, vector) as by usable() to (query_id, rank, vec_id, score): for the rows of is_query the k nearest others, exactly."""
    spark = vectors.sparkSession
    prepare(spark)
    kind = vectors.schema["vector"].dataType.simpleString()
    vectors = save(vectors, "vectors")
    n = vectors.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    some = sampled(vectors, SAMPLE, n, "id").toArrow()
    if not some.num_rows:  # no hash is that small
        some = vectors.limit(1).toArrow()
    sample = _vectors(some.column("vector"))
    index = Index(sample, min(LISTS, int(np.ceil(np.sqrt(n)))))
    probes = index.probes(sample, k)
    shared = spark.sparkContext.broadcast(index)

    def encoded(batches):
        for b in batches:
            x = _vectors(b.column(1))
            at, codes = shared.value.encode(x)
            away = _lengths(x.astype(np.float64) - shared.value.centres(at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(away)], names=["id", "vector", "list", "codes", "away"])

    indexed = save(vectors.mapInArrow(encoded, f"id bigint, vector {kind}, list int, codes binary, away double"), "index")
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()
    d = sample.shape[1]
    packed = _packed({r["list"]: r["n"] for r in sizes}, max(BLOCK, min(n // 32, LARGEST // (8 * d))))
    blocks = max(b + s for _, b, s in packed)
    least_rows = max(k + 1, COMPONENTS // d)
    lists = spark.sparkContext.broadcast(_Lists(index, packed, {r["list"]: r["away"] for r in sizes}, np.asarray(some.column("id"))[:least_rows], sample[:least_rows]))

    def probing(batches):
        for b in batches:
            for lo in range(0, b.num_rows, CHUNK):
                rows, known = b.slice(lo, CHUNK), lists.value
                ids, q = np.asarray(rows.column(0)), _vectors(rows.column(1)).astype(np.float64)
                least, floor = shared.value.probe(shared.value.small(q), known.used, probes), known.floors(ids, q, k)
                to = known.blocks(known.above(shared.value, np.arange(len(known.used)), q, floor))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(to, pa.list_(pa.int32())), pa.array(least), pa.array(floor)], names=["id", "vector", "blocks", "least", "floor"])

    of = F.broadcast(spark.createDataFrame([(int(i), int(b), int(s)) for i, b, s in packed], "of int, first int, split int"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    parts = max(1, -(-indexed.filter(is_query).count() // QUERIES))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    left = indexed.join(of, F.col("list") == F.col("of")).select((F.col("first") + spread(F.col("split"))).alias("block"), part, F.lit(False).alias("asks"), "id", "vector", "list", "codes", F.lit(None).cast("float").alias("least"), F.lit(None).cast("double").alias("floor"))
    right = indexed.filter(is_query).select("id", "vector").mapInArrow(probing, f"id bigint, vector {kind}, blocks array<int>, least float, floor double")
    right = right.select(F.explode("blocks").alias("block"), spread(F.lit(parts)).alias("part"), F.lit(True).alias("asks"), "id", "vector", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("codes"), "least", "floor")
    tasks = min(blocks * parts, TASKS)
    both = left.unionAll(right).repartitionById(tasks, F.pmod(F.col("block") * parts + F.col("part"), F.lit(tasks)).cast("int"))

    def search(batches):
        now, block, parts = None, None, []
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                rows = b.slice(lo, hi - lo)
                if not key[2, lo]:
                    if now != (at := tuple(key[:2, lo])):
                        now, block, parts = at, None, []
                    parts.append(rows)
                elif now == tuple(key[:2, lo]):
                    if block is None:
                        block = _Block(shared.value, lists.value, pa.Table.from_batches(parts), top)
                        parts = []
                    for i in range(0, len(rows), block.chunk):
                        yield block.search(rows.slice(i, block.chunk), rerank, top)

    top = k
    found = both.sortWithinPartitions("block", "part", "asks").mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _few_copies(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The rows without those that equal `most` others of smaller ids."""
    bits = np.ascontiguousarray(x).view(np.uint32 if x.dtype == np.float32 else np.uint64).astype(np.uint64)
    odd = np.random.default_rng(3).integers(0, 1 << 63, bits.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = (bits * odd).sum(axis=1)
    order = np.lexsort((ids, hashed))
    first = np.searchsorted(hashed[order], hashed[order], side="left")
    late = np.arange(len(ids)) - first >= most
    for i in np.unique(first[late]):
        run = first == i
        if (bits[order[run]] != bits[order[i]]).any():  # other vectors of the same hash
            late &= ~run
    return np.sort(order[~late])


class _Block:
    """A block's vectors, by list and id, and the search among them."""

    def __init__(self, index: Index, known: _Lists, rows: pa.Table, k: int):
        ids, lists, x = np.asarray(rows.column("id")), np.asarray(rows.column("list")), _vectors(rows.column("vector"))
        kept = _few_copies(x, ids, k + 1)
        order = kept[np.lexsort((ids[kept], lists[kept]))]
        self.index, self.known, self.ids = index, known, ids[order]
        self.x = x[order].astype(np.float64)
        self.lengths = _lengths(self.x)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order].T.astype(np.intp)
        self.lists, first = np.unique(lists[order], return_index=True)
        self.bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(order)]))
        self.chunk = max(1, min(CHUNK, HELD * 4 // len(order)))
        self.windows: list[list[tuple[int, int, int]]] = []  # runs of (list, from, to) that are multiplied together if most are asked for
        held = WINDOW
        for i, (lo, hi) in enumerate(self.bounds):
            for at in range(lo, hi, WINDOW):
                n = min(at + WINDOW, hi) - at
                if held + n > WINDOW:
                    self.windows.append([])
                    held = 0
                self.windows[-1].append((i, at, at + n))
                held += n

    def near(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries by vectors: approximate inner products, -inf in lists that aren't probed."""
        coarse = self.index.coarse[self.lists] @ q.T
        tables = self.index.tables(q)
        out = np.full((len(self.ids), len(q)), -np.inf, np.float32)
        for (lo, hi), c in zip(self.bounds, coarse):
            asked = np.flatnonzero(c >= least)
            if not len(asked):
                continue
            few = (tables.shape[1] + hi - lo) * len(asked) < (hi - lo) * len(q)
            t = np.ascontiguousarray(tables[:, :, asked]) if few else tables
            for at in range(lo, hi, ROWS):
                code = self.codes[:, at : min(at + ROWS, hi)]
                sums = np.take(t[0], code[0], axis=0)
                more = np.empty_like(sums)
                for g in range(1, len(code)):
                    np.take(t[g], code[g], axis=0, out=more, mode="clip")
                    sums += more
                if few:
                    out[at : at + len(sums), asked] = sums + c[asked]
                else:
                    out[at : at + len(sums)] = np.where(c >= least, sums + c, -np.inf)
        return np.ascontiguousarray(out.T)

    def best(self, ids: np.ndarray, q: np.ndarray, of: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of queries and vectors to the best k of each query, nearest first: queries, vectors, scores; and each query's k-th score, -inf if it has fewer."""
        step = max(1, COMPONENTS // q.shape[1])
        exact = np.concatenate([np.einsum("ij,ij->i", self.x[at[i : i + step]], q[of[i : i + step]]) for i in range(0, len(of), step)] or [np.zeros(0)])
        order = np.lexsort((self.ids[at], -exact, of))
        of, at, exact = of[order], at[order], exact[order]
        place = np.arange(len(of)) - np.searchsorted(of, of, side="left")
        last = np.full(len(q), -np.inf)
        last[of[place == k - 1]] = exact[place == k - 1]
        return of[place < k], at[place < k], exact[place < k], last

    def quick(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, rerank: int, k: int) -> np.ndarray:
        """The k-th best score of each query among the `rerank` approximately best in the lists that it probes first, -inf if there are fewer."""
        small, last = self.index.small(q), np.full(len(q), -np.inf)
        here = np.flatnonzero(((self.index.coarse[self.lists] @ small.T) >= least).any(axis=0))
        if not len(here) or len(self.ids) <= k:
            return last
        near = self.near(small[here], least[here])
        near[ids[here, None] == self.ids[None]] = -np.inf
        most = min(max(rerank, k), near.shape[1])
        last_of = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
        chosen = (near >= last_of[:, None]) & (near > -np.inf)
        for i in np.flatnonzero(chosen.sum(axis=1) > most):  # ties
            above = int((near[i] > last_of[i]).sum())
            chosen[i, np.flatnonzero(near[i] == last_of[i])[most - above :]] = False
        of, at = np.nonzero(chosen)
        return self.best(ids, q, here[of], at, k)[3]

    def search(self, asking: pa.RecordBatch, rerank: int, k: int) -> pa.RecordBatch:
        ids, q = np.asarray(asking.column("id")), _vectors(asking.column("vector")).astype(np.float64)
        floor = np.fmax(np.asarray(asking.column("floor")), self.quick(ids, q, np.asarray(asking.column("least")), rerank, k))
        asked = self.known.above(self.index, np.searchsorted(self.known.used, self.lists), q, floor)
        off = _rounding(q.shape[1]) * _lengths(q)
        pairs, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for window in self.windows:
            wanted = [np.flatnonzero(asked[i]) for i, _, _ in window]
            lo, hi, some = window[0][1], window[-1][2], np.flatnonzero(asked[[i for i, _, _ in window]].any(axis=0))
            if 2 * sum(len(w) * (b - a) for w, (_, a, b) in zip(wanted, window)) > len(some) * (hi - lo):
                parts = [(lo, hi, some)]
            else:
                parts = [(a, b, w) for w, (_, a, b) in zip(wanted, window)]
            for lo, hi, some in parts:
                if not len(some):
                    continue
                of, at = np.nonzero(~(q[some] @ self.x[lo:hi].T < (floor - off * self.lengths[lo:hi].max())[some, None]))
                of, at = some[of], at + lo
                other = ids[of] != self.ids[at]
                pairs.append((of[other], at[other]))
                held += len(of)
                if held > HELD:
                    of, at, _, last = self.best(ids, q, *map(np.concatenate, zip(*pairs)), k)
                    pairs, held, floor = [(of, at)], len(of), np.fmax(floor, last)
        of, at, exact, _ = self.best(ids, q, *map(np.concatenate, zip(*pairs)), k)
        return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(self.ids[at]), pa.array(exact)], names=["query_id", "vec_id", "score"])


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)
