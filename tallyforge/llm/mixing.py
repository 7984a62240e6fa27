"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected number of copies is in proportion to its
inclusion weight within its source, up to `cap`, scaled so that the expected words meet the target. Its whole
part is certain. The fractions are drawn by Pareto order sampling: documents are ranked by the odds of a uniform
number over the odds of inclusion, and the first are taken until the source's remaining words are met, so that
the size (in words) is fixed rather than random.

Random numbers are hashes of document id, source and text, so reruns agree. Only DataFrame functions are used.

Scale: one pass over the texts gives a slim table (source, size, number), which is written. The rest is
aggregates by source and weight level (at most 64 levels a source) and by source and bin of the rank, about
`BIN` documents each; only the bin where a source's words are met is sorted. No source is ever sorted whole.
The window over sources is one row per source.

Edge cases: null text has size 0; a null source is a source of its own, last; null ids are allowed; equal rows
(same id, source and text) share their number and are taken alike; a source without words keeps each document
once; an empty table gives an empty result; extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, save, table

#: Documents in a bin of the rank.
BIN = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, source: Column, text: Column) -> Column:
    """A number in (0, 1) with 52 random bits."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(source, F.lit("null")), F.lit(":"), F.coalesce(F.md5(text), F.lit("null")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(by_source: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, total) to (source, total, target): shares by weight of all words, none above cap times its source's words."""
    k = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(k) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = by_source.withColumn("w", weight.cast("double"))
    # Filled up in the order of total / weight: at row m, all before it are at their cap and the rest share by weight.
    order = W.orderBy((F.col("total") / F.col("w")).asc(), F.col("source").asc_nulls_first())
    before, rest, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    w = w.select("source", "total", "w", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("capped"), F.sum("w").over(rest).alias("rest"), F.sum("total").over(everything).alias("everything"))
    level = (F.lit(share) * F.col("everything") - F.lit(cap) * F.col("capped")) / F.col("rest")
    w = w.withColumn("level", F.when(level * F.col("w") <= F.lit(cap) * F.col("total"), level))
    level = F.min(F.struct(F.col("capped"), F.col("level"))).over(W.partitionBy())
    first = w.withColumn("first", F.min(F.when(F.col("level").isNotNull(), F.struct("capped", "level"))).over(everything))
    target = F.least(F.lit(cap) * F.col("total"), F.col("first.level") * F.col("w"))
    return first.select("source", "total", F.coalesce(target, F.lit(cap) * F.col("total")).cast("double").alias("target"))


class Mix:
    """The plan of a mix: per source and weight level the expected copies, per source where the ranking is cut."""

    def __init__(self, docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)):
        self.cap = cap
        slim = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("source").cast("string"), F.col("text")).alias("u"))
        self.slim = slim = save(slim.withColumn("w", F.length(F.bin("size")).cast("bigint")), "mix")
        levels = slim.groupBy("source", "w").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        self.levels = levels = save(levels, "mix-levels")
        self.targets = t = save(targets(levels.groupBy("source").agg(F.sum("words").alias("total")), share, cap, weights), "mix-targets")
        # Expected copies by level: the heaviest levels reach the cap first.
        down = W.partitionBy("source").orderBy(F.col("w").desc())
        x = levels.join(t.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
        x = x.withColumn("capped", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        x = x.withColumn("rest", F.sum(F.col("w") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing)))
        c = F.when(F.col("rest") > 0, (F.col("target") - F.lit(cap) * F.col("capped")) / F.col("rest"))
        x = x.withColumn("c", F.when(c * F.col("w") <= F.lit(cap), c))
        x = x.withColumn("c", F.max(F.when(F.col("c").isNotNull(), F.struct("w", "c"))).over(W.partitionBy("source"))["c"])
        copies = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.least(F.lit(cap), F.coalesce(F.col("c") * F.col("w"), F.lit(cap))))
        self.copies = save(x.select("source", "w", "words", "n", "total", "target", copies.alias("copies")), "mix-copies")
        left = self.copies.groupBy("source").agg(F.max("target").alias("target"), F.max("total").alias("total"), F.sum(F.floor("copies") * F.col("words")).alias("certain"), F.sum("n").alias("n"))
        left = left.select("source", "target", "total", (F.col("target") - F.col("certain")).alias("left"), F.ceil(F.col("n") / F.lit(BIN)).alias("bins"))
        ranked = self._ranked(slim, left).filter("q is not null")
        bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        cut = bins.withColumn("upto", upto).filter("upto > left").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "left")).alias("x"))
        cut = save(cut.select(F.col("source").alias("c_source"), "x.*"), "mix-bins")
        inside = ranked.drop("left").join(cut.withColumnRenamed("bin", "c_bin"), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("c_bin")))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("q", "doc_id", "u").rowsBetween(W.unboundedPreceding, 0))
        last = inside.withColumn("upto", F.col("before") + upto).filter("upto - size / 2 <= left").groupBy("source").agg(F.max(F.struct("q", "doc_id", "u")).alias("last"))
        self.left = save(
            left.join(cut.select("c_source", F.col("bin").alias("cut_bin")), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source").join(last.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source"),
            "mix-cut",
        )

    def _ranked(self, rows: DataFrame, left: DataFrame) -> DataFrame:
        """Adds copies, q (the Pareto rank; null without a fraction), bin and what left has, by source."""
        a = self.copies.select(F.col("source").alias("_s"), F.col("w").alias("_w"), "copies")
        b = left.withColumnRenamed("source", "_l")
        rows = rows.join(a, F.col("source").eqNullSafe(F.col("_s")) & (F.col("w") == F.col("_w"))).drop("_s", "_w")
        rows = rows.join(b, F.col("source").eqNullSafe(F.col("_l"))).drop("_l")
        p = F.col("copies") - F.floor("copies")
        q = F.when(p > 0, F.col("u") / (1 - F.col("u")) * ((1 - p) / p))
        rows = rows.withColumn("q", q)
        return rows.withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.col("q") / (1 + F.col("q")) * F.col("bins"))))

    def decided(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, u, w, ...) with taken_copies, source_size and target; decided row by row, without a sort."""
        x = self._ranked(rows, self.left)
        taken = F.col("q").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.struct("q", "doc_id", "u") <= F.col("last")), F.lit(False)))
        return x.withColumn("taken_copies", F.floor("copies") + taken.cast("bigint"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The mix itself: the rows of docs (doc_id, source, text and any others), each as often as it is taken."""
    m = Mix(docs, share, cap, weights)
    keep, inner = docs.columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(inner.alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("source").cast("string"), F.col("text")).alias("u"))
    rows = m.decided(rows.withColumn("w", F.length(F.bin("size")).cast("bigint")))
    out = rows.filter("taken_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("taken_copies").cast("int"))).alias("copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = m.decided(m.slim)
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("taken_copies") * F.col("size")).alias("taken"), F.col("copies").alias("expected_copies"))


SQL = r"""
WITH slim AS (
  SELECT doc_id, source, size, length(bin(size)) AS w,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(source, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
), src AS (
  SELECT source, sum(size)::DOUBLE AS total,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS wt
  FROM slim GROUP BY source
), fill AS (
  SELECT *, (1.5::DOUBLE * sum(total) OVER () - 2.0::DOUBLE * coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (o) AS m
  FROM src WINDOW o AS (ORDER BY total / wt, source NULLS FIRST)
), lev AS (SELECT arg_min(level, m) AS level FROM fill WHERE level * wt <= 2.0 * total
), tgt AS (SELECT source, total, least(2.0 * total, coalesce((SELECT level FROM lev) * wt, 2.0 * total)) AS target FROM src
), lv AS (SELECT source, w, sum(size)::DOUBLE AS words FROM slim GROUP BY source, w
), lc AS (
  SELECT lv.*, total, target, CASE WHEN sum(w * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 THEN
    (target - 2.0 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS c
  FROM lv JOIN tgt ON lv.source IS NOT DISTINCT FROM tgt.source WINDOW o AS (PARTITION BY lv.source ORDER BY w DESC)
), cs AS (SELECT source, arg_max(c, w) AS c FROM lc WHERE c * w <= 2.0 GROUP BY source
), cp AS (
  SELECT lc.source, w, words, total, target, CASE WHEN total = 0 THEN 1.0 ELSE least(2.0, coalesce(cs.c * w, 2.0)) END AS copies
  FROM lc LEFT JOIN cs ON lc.source IS NOT DISTINCT FROM cs.source
), lft AS (SELECT source, max(target) - sum(floor(copies) * words) AS lefts FROM cp GROUP BY source
), rk AS (
  SELECT slim.*, cp.total, cp.target, cp.copies, lft.lefts, cp.copies - floor(cp.copies) AS p,
    CASE WHEN cp.copies > floor(cp.copies) THEN u / (1 - u) * ((1 - (cp.copies - floor(cp.copies))) / (cp.copies - floor(cp.copies))) END AS q
  FROM slim JOIN cp ON slim.source IS NOT DISTINCT FROM cp.source AND slim.w = cp.w JOIN lft ON slim.source IS NOT DISTINCT FROM lft.source
)
SELECT doc_id, size, total::BIGINT AS source_size, target::DOUBLE AS target,
  (size * (floor(copies) + CASE WHEN q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, u ROWS UNBOUNDED PRECEDING) - size / 2.0 <= lefts THEN 1 ELSE 0 END))::BIGINT AS taken,
  copies::DOUBLE AS expected_copies
FROM rk
"""
