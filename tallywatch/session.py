"""Session helpers shared by tests, the benchmark and scratch-writing jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tallywatch", cores: str | int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on.

    Times are UTC. Joins with a hot key are split at run time, even where that
    costs one more shuffle. Generated methods above 8000 bytecodes are never compiled by
    HotSpot, so wide projections are faster outside whole-stage code generation.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    for name in ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{name}", "true")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to split by itself.

    A file below one split is read by one task, which is slow when the work per
    row is heavy. Only inputs under one split per core are reshuffled; a large
    scan already has more splits than cores and is returned unchanged.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b").lower().rstrip("b")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if not split.isdigit() or int(str(size)) >= cores * int(split):
        return df
    return df.repartition(cores)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint root of the session.

    ``spark.checkpoint.dir`` names the shared root on a cluster. Only a local master,
    where all tasks run on this machine, may do without: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "tallywatch-scratch")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
