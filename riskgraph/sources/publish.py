"""Staged publish of a table under a uniqueness rule (A10).

The table is written aside and checked there. Without violations it is moved to its place whole, under a name of its
own that a small pointer names; with violations it is not published, and the offending rows are kept beside it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import _filesystem, exists


@dataclass
class Published:
    ok: bool
    path: str | None        # the table, if it was published
    rejects: str | None     # every row of a key that occurs more than once or is null, with the number of its rows
    n_violations: int       # keys


def rows_of_violations(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once or is null, with ``key_rows``. The counts are partial aggregates; only the
    keys at fault are joined back."""
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("key_rows"))
    bad = counts.where((F.col("key_rows") > 1) | F.col("__key").isNull())
    return df.join(bad, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def publish_unique(df: DataFrame, folder: str, key: str) -> Published:
    """Publish ``df`` below ``folder`` if ``key`` is unique and never null. A reader sees the old table or the new one,
    whole; a refused or lost publish leaves the old one."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    folder = folder.rstrip("/")
    staged = f"{folder}/staged/{name}"
    df.write.parquet(staged)
    back = spark.read.schema(df.schema).parquet(staged)
    counts = back.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    n = counts.count()
    if n:
        rejects = f"{folder}/rejected/{name}"
        rows_of_violations(back, key).write.parquet(rejects)
        return Published(False, None, rejects, n)
    fs, at = _filesystem(spark, f"{folder}/tables/{name}")
    fs.mkdirs(at.getParent())
    fs.rename(_filesystem(spark, staged)[1], at)
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").json(f"{folder}/current-{name}")
    old = _filesystem(spark, f"{folder}/current")[1]
    fs.delete(old, True)
    fs.rename(_filesystem(spark, f"{folder}/current-{name}")[1], old)
    return Published(True, f"{folder}/tables/{name}", None, 0)


def read_published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The published table, or None where there is none."""
    at = f"{folder.rstrip('/')}/current"
    if not exists(spark, f"{at}/_SUCCESS"):
        return None
    name = spark.read.schema("name string").json(at).first()["name"]
    return spark.read.parquet(f"{folder.rstrip('/')}/tables/{name}")
