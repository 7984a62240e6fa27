"""Sessions with the settings that the engine's semantics need."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Groups that a task keeps in a map of objects before it sorts.
HASHED = 16_384
#: Overflow must raise, times must not depend on the place, and groups of texts and rows are hashed.
REQUIRED = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(HASHED)}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session; on a cluster the master and sizes come from its configuration. conf: more settings, _ for dots."""
    b = SparkSession.builder.appName(name).config(map={**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}, **REQUIRED})
    return (b.master(master) if master else b).getOrCreate()


def require(spark: SparkSession) -> SparkSession:
    """Set what the engine needs on a session of the caller's."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset, a local session gets one of its own, once; a cluster's is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("tallyforge.shared.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("tallyforge.shared.dir", at)
    return at.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _tidy() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


atexit.register(_tidy)
