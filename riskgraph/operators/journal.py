"""Journal of a propagation run: what it has written, so that a lost driver costs one round.

A journal is a folder with one small folder per entry. An entry is written after the table that it names is complete,
and Spark's commit marks it whole; a half-written entry or table is never read. Entries belong to a run, named by a
signature of the inputs and the parameters: other inputs start another run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import exists, open_bucketed

_DDL = "name string, fields string"


class Journal:
    def __init__(self, spark: SparkSession, folder: str, signature: str) -> None:
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(signature.encode()).hexdigest()[:24]}"

    def read(self, name: str) -> dict | None:
        """Fields of an entry, or None where it was never committed."""
        at = f"{self.folder}/{name}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            return None
        rows = self.spark.read.schema(_DDL).json(at).collect()  # one row
        return json.loads(rows[0]["fields"])

    def commit(self, name: str, **fields) -> None:
        (self.spark.createDataFrame([(name, json.dumps(fields))], _DDL).coalesce(1)
            .write.mode("overwrite").json(f"{self.folder}/{name}"))

    def last(self, prefix: str, most: int) -> tuple[int, dict] | None:
        """The highest committed number k <= ``most`` of the entries ``prefix``k, and its fields. Rounds are committed
        in order, so the search halves."""
        low, high = -1, most
        while low < high:
            mid = (low + high + 1) // 2
            if exists(self.spark, f"{self.folder}/{prefix}{mid}/_SUCCESS"):
                low = mid
            else:
                high = mid - 1
        return None if low < 0 else (low, self.read(f"{prefix}{low}"))


def described(df: DataFrame, path: str, key: str, buckets: int) -> dict:
    """Fields from which :func:`opened` reads a bucketed table again."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return {"path": path, "key": key, "buckets": buckets, "ddl": ddl}


def opened(spark: SparkSession, fields: dict) -> DataFrame:
    return open_bucketed(spark, fields["path"], fields["key"], fields["buckets"], fields["ddl"])
