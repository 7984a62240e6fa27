"""What the operators share: the word pattern, written tables in the shared folder, unused names."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


#: Rows and bytes of a batch for Python, at most; a single longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Bytes that a task holds back of a table that it writes.
ROW_GROUP = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package (on a cluster it is shipped with --py-files), and bound Arrow batches where the session doesn't."""
    for k, most in BATCH.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, str(most))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. A lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named_table(spark: SparkSession, prefix: str) -> str:
    """An unused name for a table, which release() drops."""
    name = f"{prefix}_{uuid.uuid4().hex}"
    _made.append((spark, f"table:{name}"))
    return name


def release() -> None:
    """Delete the tables written so far. Results that still read them can't be used afterwards."""
    while _made:
        spark, path = _made.pop()
        try:
            if path.startswith("table:"):
                spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix('table:')}")
                continue
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


atexit.register(release)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def sampled(df: DataFrame, rows: int, count: int, *by: str) -> DataFrame:
    """About `rows` of df's `count` rows, those of small hashes of the columns `by`; all if there are no more.

    Unlike a limit after a sort, no task sends more than its share.
    """
    if count <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < F.lit(int((1 << 40) * (rows / count))))


def let(value: Column, body) -> Column:
    """body(x) where x is value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
