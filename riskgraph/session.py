"""Session helpers: building a session for tests/benchmarks and finding the
shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "riskgraph", extra: dict | None = None) -> SparkSession:
    """A session for these operators. What spark-submit, the cluster's
    defaults or a running session set stays as it is; only settings that none
    of them has are filled in. The arguments of this call do override."""
    active = SparkSession.getActiveSession()
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit the JVM is there and knows its settings
        SparkContext._ensure_initialized()
    given = dict(active.sparkContext.getConf().getAll()) if active else dict(SparkConf().getAll())
    conf = {} if active else {k: v for k, v in _DEFAULTS.items() if k not in given}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    builder = SparkSession.builder
    if "spark.app.name" not in given:
        builder = builder.appName(app_name)
    if master and "spark.master" not in given:
        builder = builder.master(master)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when the session names none – a local test – a scratch folder is made and
    registered, so that cluster jobs never write to a machine-local path."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="riskgraph-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    return f"{root}/riskgraph/{app}/{name}-{uuid.uuid4().hex[:12]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


ROWS_PER_BUCKET = 2_000_000


def bucket_count(spark: SparkSession, n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Bucket count for a table written to be joined in place, sized from
    its row count (~``rows_per_bucket`` rows, tens of MB, per bucket), at
    least the cluster's default parallelism so every core has work. 100
    billion edges get 50,000 buckets; a test table gets one per core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(max(0, n_rows) / rows_per_bucket))


#: Rows up to which a step of a loop is planned as one job of few tasks, and rows of such a task.
SMALL_ROWS, ROWS_PER_TASK = 2_000_000, 100_000


@contextlib.contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """The session for statements over ``rows`` rows. A loop whose tables have become small (contracted levels of a
    graph) would spend its time on the stages of adaptive plans, each a job of its own: below ``SMALL_ROWS`` plans are
    fixed, with a partition for every ``ROWS_PER_TASK`` rows. Larger ones keep the session's settings."""
    if rows > SMALL_ROWS:
        yield
        return
    new = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(1, math.ceil(rows / ROWS_PER_TASK)))}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
