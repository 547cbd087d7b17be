"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def builder(app: str = "candor", master: str | None = None) -> SparkSession.Builder:
    """A builder with the settings used by the tests and the benchmark."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
    )
    return b.master(master) if master else b


def tune(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on. Safe to call on any session, any number of times."""
    # Python workers find this package where the driver found it.
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # `percentile` keeps small per-group maps; the default of 128 groups sorts every task for nothing.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    # Top rows per group are limited inside the map tasks up to this many rows; the default is 1000.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    # Wide projections make methods over 8,000 bytes of code, which HotSpot never compiles. Spark then splits them instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # The shuffle files of a finished job go at once, not when the driver collects garbage: queries of several jobs need less disk.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="candor-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def stored(df, name: str):
    """The table written to the checkpoint folder once and read from there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df):
    """Materialise into the checkpoint folder, so a lost executor never recomputes past this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
