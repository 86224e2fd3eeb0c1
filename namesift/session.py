"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator assumes. Skewed joins are split even where the
# split costs one more exchange: a hot id or prompt is then never one task. Batches sent to
# Python are bounded in rows and bytes, so that its memory does not grow with a task's rows.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes such as shuffle partitions stay the cluster's."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, because there every
    task sees it; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="namesift-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one stage table; never reused, so a rerun cannot mix outputs."""
    return f"{stage_root(spark)}/namesift/{name}-{uuid.uuid4().hex}"


@contextmanager
def letting_go(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffles of each query run inside as soon as it ends; else they stay until the driver collects garbage.

    For queries whose frame is not run again.
    """
    conf, cleanup = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    conf.set(cleanup, "true")
    try:
        yield
    finally:
        conf.set(cleanup, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage, survives lost executors and gives the planner the true
    size, so later joins choose broadcast or shuffle by measured bytes. The shuffles
    that made it are not read again and are deleted.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    with letting_go(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    Text work costs far more than moving the text once, but only a small table or
    one unsplittable file comes in so few pieces; a large table passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
