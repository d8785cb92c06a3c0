"""Session helpers: recommended settings and a checkpoint folder every executor can reach."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# The feature table has more than 100 columns.  Above `maxFields` Spark would leave whole-stage codegen; a
# generated method over 8000 bytes is never compiled by the JIT, so such stages fall back to split methods.
# Call-site capture costs several gateway calls per column expression while a wide plan is built.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def builder(app: str = "barloom"):
    """A session builder with the settings above; master and memory stay with the cluster."""
    b = SparkSession.builder.appName(app)
    for name, value in SETTINGS.items():
        b = b.config(name, value)
    return b


def fit_methods(spark: SparkSession) -> None:
    """Let stages whose generated method would be too long for the JIT fall back to split methods; a limit that is set stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, SETTINGS[name])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; make one only for a local master without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    active = sc.getCheckpointDir()
    if named:
        if not active:
            sc.setCheckpointDir(named)
        return named
    if active:
        return active
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Used where two branches must see the very same partitioning (sampled range bounds differ between two
    evaluations of one plan).  The files survive the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_of(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Partitions for about so many rows: at most ``each`` in one on average, so that a task's memory does not follow the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def settle_by(df: DataFrame, key: str | Sequence[str], ts: str, rows: int = 0) -> DataFrame:
    """``settle`` with all rows of a key in one partition, in order of ``ts``; windows and joins by ``key`` then move no row.

    Spark forgets how an adaptive plan laid out its result, so this one plan is made without adaption.  ``rows``: see ``parts_of``.
    """
    conf = df.sparkSession.conf
    parts = parts_of(df.sparkSession, rows)
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = [key] if isinstance(key, str) else list(key)
        return settle(df.repartition(parts, *keys).sortWithinPartitions(*keys, ts))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
