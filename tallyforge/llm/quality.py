"""Quality rules with adaptive thresholds.

Each document gets counts (words, symbols, repeated lines and windows, capitals). Those that fail a base rule go.
The others are judged by ratios of these counts, against thresholds that follow the document's language and
source instead of fixed cutoffs: a ratio is too high above q75 + 3 * (q75 - q25) + margin, too low below
q25 - 3 * (q75 - q25) - margin.

The quantiles come from mergeable sketches: counts by logarithmic bucket, each 2 % wide, so that a quantile is
exact to 1 %. Sketches merge by adding counts, which Spark does before and after the shuffle; a hot source costs
no more than its buckets. A language's quantiles are averaged with those of all documents, and a group's with its
language's, by the number of documents against `PRIOR`: small groups lean on their parents and large ones don't, with
no switch by size. The thresholds are joined to the documents' slim counts.

Edge cases: null text has no words and fails the base rules; null language or source is a group of its own;
null ids, repeated rows and extra columns are kept as they are; an empty table gives an empty result.

Repeated windows are found without a shuffle: within a document, hashes of the 3-word windows are sorted together
with their positions (packed in one long), and equal neighbours of equal words are repeats. Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, let, save, table

#: Width of a bucket of the sketches; smaller values than the least count as 0.
GAMMA, SMALLEST = 1.02, 1e-3
#: Documents as which the parent's quantiles count against a group's own.
PRIOR = 50
SPREAD = 3.0
#: Ratio, numerator, denominator, margin, whether low values are bad as well.
RATIOS = (
    ("symbols", "n_symbols", "n_words", 0.1, False),
    ("repeats", "n_repeat_words", "n_words", 0.3, False),
    ("lines", "n_dup_lines", "n_lines", 0.25, False),
    ("length", "word_chars", "n_words", 2.0, True),
    ("capitals", "n_capitals", "word_chars", 0.15, False),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _hashed(*words: Column) -> Column:
    return F.xxhash64(*words)


def _repeated(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more, exactly.

    Windows are sorted by a 64-bit hash, less the bits of a position, with their positions. Neighbours of equal hashes
    are compared word by word; if any differ, the windows whose hashes aren't unique are sorted by their words instead.
    """
    bits = F.length(F.bin(F.size(w)))
    upper = lambda x: F.call_function("shiftright", x, bits)
    packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", _hashed(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("bigint")))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    at = lambda x: x.bitwiseAND(mask).cast("int")
    alike = lambda x, y: F.coalesce(upper(x) == upper(y), F.lit(False))

    def positions(p: Column) -> Column:
        return let(F.filter(p, lambda x, k: alike(x, F.get(p, k + 1)) | alike(x, F.get(p, k - 1))), checked)

    def checked(twice: Column) -> Column:
        def differs(x: Column, k: Column) -> Column:
            i, j = at(x), at(F.get(twice, k + 1))
            return alike(x, F.get(twice, k + 1)) & ((F.get(w, i) != F.get(w, j)) | (F.get(w, i + 1) != F.get(w, j + 1)) | (F.get(w, i + 2) != F.get(w, j + 2)))

        def same_words(s: Column) -> Column:
            same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
            return F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))), lambda x: x["i"].cast("bigint"))

        window = lambda x: F.struct(F.get(w, at(x)).alias("a"), F.get(w, at(x) + 1).alias("b"), F.get(w, at(x) + 2).alias("c"), at(x).alias("i"))
        by_words = let(F.sort_array(F.transform(twice, window)), same_words)
        return F.sort_array(F.when(F.size(F.filter(twice, differs)) > 0, by_words).otherwise(F.transform(twice, lambda x: x.bitwiseAND(mask))))

    covered = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    count = F.aggregate(let(F.sort_array(packed), positions), start, covered, lambda acc: acc["n"])
    return F.when(F.size(w) > 3, count).otherwise(F.lit(0).cast("bigint"))


def counts(text: Column) -> Column:
    """A struct of COUNTS."""
    t = F.coalesce(text, F.lit(""))
    without = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("bigint")
    of_words = let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeated(w).alias("n_repeat_words")),
    )
    of_lines = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    both = F.array(F.struct(of_words.alias("w"), of_lines.alias("l"), without(r"[#*$%&|<>]+").alias("n_symbols"), without(r"\p{Lu}+").alias("n_capitals")))
    return F.element_at(
        F.transform(both, lambda x: F.struct(*[(x["w"][c] if c in ("n_words", "word_chars", "n_repeat_words") else x["l"][c] if c in ("n_lines", "n_dup_lines") else x[c]).alias(c) for c in COUNTS])), 1
    )


def base_failed(c) -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def thresholds(slim: DataFrame) -> DataFrame:
    """(lang, source, COUNTS) to (t_lang, t_source, <ratio>_low, <ratio>_high), for each group."""
    value = lambda a, b: F.col(a).cast("double") / F.col(b)
    ratios = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.when(F.col(b) > 0, value(a, b)).alias("value")) for r, a, b, _, _ in RATIOS])).alias("x")
    x = slim.filter(~base_failed(F.col)).select("lang", "source", ratios).select("lang", "source", "x.*").filter("value is not null")
    bucket = F.when(F.col("value") < SMALLEST, F.lit(-1000)).otherwise(F.ceil(F.log("value") / F.log(F.lit(GAMMA))).cast("int"))
    sketch = save(x.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "sketch")
    groups = slim.select("lang", "source").distinct()
    middle = F.when(F.col("bucket") == -1000, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)))
    quantile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), middle))

    def quantiles(*by: str) -> DataFrame:
        w = W.partitionBy(*by, "ratio")
        m = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
        m = m.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        q = m.groupBy(*by, "ratio").agg(F.max("total").alias("n"), quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))
        each = F.map_from_entries(F.collect_list(F.struct("ratio", F.struct("n", "q25", "q75"))))
        return q.groupBy(*by).agg(each.alias("of"))

    def blended(own: Column, parent: Column, r: str) -> Column:
        """A ratio's n, q25 and q75: the own ones with the parent's as of PRIOR documents."""
        x, y = F.try_element_at(own, F.lit(r)), F.try_element_at(parent, F.lit(r))
        n = F.coalesce(x["n"], F.lit(0)).cast("double")
        mean = lambda q: F.when(y.isNull(), x[q]).otherwise((n * F.coalesce(x[q], F.lit(0.0)) + float(PRIOR) * y[q]) / (n + float(PRIOR)))
        return F.struct(n.alias("n"), mean("q25").alias("q25"), mean("q75").alias("q75"))

    ratios = [r[0] for r in RATIOS]
    every = quantiles().select(F.col("of").alias("o2"))
    of_lang = quantiles("lang").toDF("l1", "o1")
    of_group = quantiles("lang", "source").toDF("l0", "s0", "o0")
    g = groups.join(of_group, F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left").join(of_lang, F.col("lang").eqNullSafe(F.col("l1")), "left")
    g = g.join(F.broadcast(every), F.lit(True), "left")  # one row
    g = g.select("lang", "source", "o0", F.map_from_arrays(F.array(*map(F.lit, ratios)), F.array(*[blended(F.col("o1"), F.col("o2"), r) for r in ratios])).alias("p"))
    limits = []
    for r, _, _, margin, low in RATIOS:
        x = blended(F.col("o0"), F.col("p"), r)
        spread = SPREAD * (x["q75"] - x["q25"]) + margin
        limits += [(x["q75"] + spread).alias(f"{r}_high")] + ([(x["q25"] - spread).alias(f"{r}_low")] if low else [])
    return save(g.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *limits), "thresholds")


def judged(rows: DataFrame, limits: DataFrame, lang: str, source: str, count) -> Column:
    """Joins the thresholds to rows; count(name) is a count's column. Returns rows with base_failed and kept under unused names."""
    failed, kept = fresh(rows, "base_failed", "kept")
    out = rows.join(limits, F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")), "left")
    good = F.lit(True)
    for r, a, b, _, low in RATIOS:
        v = count(a).cast("double") / F.when(count(b) > 0, count(b))
        good = good & F.coalesce(v <= F.col(f"{r}_high"), F.lit(True))
        if low:
            good = good & F.coalesce(v >= F.col(f"{r}_low"), F.lit(True))
    bad = base_failed(count)
    return out.select(*[rows[c] for c in rows.columns], bad.alias(failed), (~bad & good).alias(kept))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (text, lang, source and any others) that the rules keep."""
    (q,) = fresh(docs, "quality_counts")
    rows = save(docs.withColumn(q, counts(F.col("text"))), "quality")
    limits = thresholds(rows.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), f"{q}.*"))
    inner, lang, source = "row", "lang", "source"
    flat = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inner), F.col("lang").cast("string").alias(lang), F.col("source").cast("string").alias(source), F.col(q).alias("counts"))
    out = judged(flat, limits, lang, source, lambda c: F.col("counts")[c]).filter("kept")
    return out.select(*[F.col(inner)[c].alias(c) for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = save(docs.select("doc_id", "lang", "source", counts(F.col("text")).alias("c")).select("doc_id", "lang", "source", "c.*"), "quality")
    out = judged(slim, thresholds(slim), "lang", "source", F.col)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH a AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    row_number() OVER () AS id
  FROM documents
), g AS (
  SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM a WHERE len(w) >= 3
), r AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, s) AS n FROM g) WHERE n > 1
), rep AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, i + k AS p FROM r, range(3) x(k)) GROUP BY id
), c AS (
  SELECT a.id, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::BIGINT AS n_capitals
  FROM a LEFT JOIN rep USING (id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), v AS (
  SELECT lang, source, ratio, value FROM (
    SELECT lang, source, unnest(['symbols', 'repeats', 'lines', 'length', 'capitals']) AS ratio,
      unnest([n_symbols::DOUBLE / n_words, n_repeat_words::DOUBLE / n_words, n_dup_lines::DOUBLE / n_lines, word_chars::DOUBLE / n_words, n_capitals::DOUBLE / word_chars]) AS value
    FROM b WHERE NOT base_failed)
), s AS (
  SELECT lang, source, ratio, CASE WHEN value < 1e-3 THEN -1000 ELSE ceil(ln(value) / ln(1.02::DOUBLE))::INT END AS bucket, count(*) AS n FROM v GROUP BY ALL
), lv AS (
  SELECT 0 AS level, lang, source, ratio, bucket, n FROM s UNION ALL SELECT 1, lang, NULL, ratio, bucket, n FROM s UNION ALL SELECT 2, NULL, NULL, ratio, bucket, n FROM s
), m AS (SELECT level, lang, source, ratio, bucket, sum(n) AS n FROM lv GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total,
    CASE WHEN bucket = -1000 THEN 0.0::DOUBLE ELSE pow(1.02::DOUBLE, bucket) * (2.0::DOUBLE / 2.02::DOUBLE) END AS middle FROM m
), q AS (
  SELECT level, lang, source, ratio, min(middle) FILTER (upto >= 0.25 * total) AS q25, min(middle) FILTER (upto >= 0.75 * total) AS q75, max(total)::DOUBLE AS n FROM u GROUP BY ALL
), gr AS (SELECT lang, source, ratio FROM (SELECT DISTINCT lang, source FROM b), (VALUES ('symbols'), ('repeats'), ('lines'), ('length'), ('capitals')) r(ratio)
), p AS (
  SELECT g.*, q0.q25 AS x25, q0.q75 AS x75, coalesce(q0.n, 0) AS xn,
    CASE WHEN q2.n IS NULL THEN q1.q25 ELSE (coalesce(q1.n, 0) * coalesce(q1.q25, 0) + 50.0::DOUBLE * q2.q25) / (coalesce(q1.n, 0) + 50.0::DOUBLE) END AS y25,
    CASE WHEN q2.n IS NULL THEN q1.q75 ELSE (coalesce(q1.n, 0) * coalesce(q1.q75, 0) + 50.0::DOUBLE * q2.q75) / (coalesce(q1.n, 0) + 50.0::DOUBLE) END AS y75
  FROM gr AS g LEFT JOIN q q2 ON q2.level = 2 AND q2.ratio = g.ratio
    LEFT JOIN q q1 ON q1.level = 1 AND q1.ratio = g.ratio AND q1.lang IS NOT DISTINCT FROM g.lang
    LEFT JOIN q q0 ON q0.level = 0 AND q0.ratio = g.ratio AND q0.lang IS NOT DISTINCT FROM g.lang AND q0.source IS NOT DISTINCT FROM g.source
), z AS (
  SELECT lang, source, ratio, (xn * coalesce(x25, 0) + 50.0::DOUBLE * y25) / (xn + 50.0::DOUBLE) AS q25, (xn * coalesce(x75, 0) + 50.0::DOUBLE * y75) / (xn + 50.0::DOUBLE) AS q75 FROM p
), f AS (
  SELECT lang, source,
    max(q75 + (3 * (q75 - q25) + 0.1)) FILTER (ratio = 'symbols') AS symbols, max(q75 + (3 * (q75 - q25) + 0.3)) FILTER (ratio = 'repeats') AS repeats,
    max(q75 + (3 * (q75 - q25) + 0.25)) FILTER (ratio = 'lines') AS lines, max(q75 + (3 * (q75 - q25) + 2.0)) FILTER (ratio = 'length') AS high,
    max(q25 - (3 * (q75 - q25) + 2.0)) FILTER (ratio = 'length') AS low, max(q75 + (3 * (q75 - q25) + 0.15)) FILTER (ratio = 'capitals') AS capitals
  FROM z GROUP BY ALL
), j AS (SELECT b.*, f.* EXCLUDE (lang, source) FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(n_symbols::DOUBLE / n_words <= symbols AND n_repeat_words::DOUBLE / n_words <= repeats AND n_dup_lines::DOUBLE / n_lines <= lines
    AND word_chars::DOUBLE / n_words <= high AND word_chars::DOUBLE / n_words >= low AND n_capitals::DOUBLE / word_chars <= capitals, true) AS kept
FROM j
"""
