"""Sources and sinks (A1-A7, A11, A12) plus the lineage cut used by loops.

Every reader takes an explicit schema: no inference pass over the data and no
implicit string arithmetic later on (Spark's ANSI mode stays on)."""

from __future__ import annotations

import contextlib
import gc
import hashlib
import re
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             sep: str = ",", header: bool = True) -> DataFrame:
    """CSV scan with a header (A1, A2).

    With ``schema`` the columns are parsed as typed at the scan. Without it
    every column is read as a string (the raw yearly extracts are untyped);
    pair that with :func:`cast_columns`."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    return reader.csv(path)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Explicit casts for untyped (all-string) sources. A decimal comma is
    turned into a point first, so '12,5' reads as 12.5 rather than failing."""
    cols = []
    for name in df.columns:
        if name in types:
            t = types[name]
            c = F.col(name)
            if t in ("double", "float") or t.startswith("decimal"):
                c = F.regexp_replace(c, ",", ".")
            cols.append(c.cast(t).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet scan (A3); filters and projections reach the scan."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table scan (A4)."""
    return spark.table(name)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Parquet sink, overwrite (A5)."""
    w = df.write.mode("overwrite")
    parts = list(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV sink with a header (A6). Written by the executors, one file per
    partition; nothing passes through the driver."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """Named view for SQL users."""
    df.createOrReplaceTempView(name)
    return df


def preview(df: DataFrame, order: Iterable[Column | str], n: int = 20) -> DataFrame:
    """Sorted top-n display (A11). The order should end in a unique key so
    that ties are deterministic; Spark plans this as a TakeOrdered."""
    return df.orderBy(*order).limit(n)


def describe_schema(df: DataFrame) -> str:
    """Schema display."""
    return df.schema.treeString()


def schema_rows(df: DataFrame) -> DataFrame:
    """Schema display (A12) as rows: place, name, type, nullable."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string, nullable boolean")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet under the session's checkpoint folder
    and read it back: the lineage ends here and the data survives the loss
    of any executor (it is in the shared folder, not in executor memory)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is columns of a table that :func:`cut` wrote, else :func:`cut` of it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project" and re.fullmatch(r"Project \[[\w#, ]*\]", plan.toString().split("\n")[0]):
        plan = plan.child()
    files = df.inputFiles() if plan.nodeName() == "LogicalRelation" else []
    return df if files and all("/riskgraph/" in f for f in files) else cut(df, name)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished statements removed. Spark does so when the driver collects its garbage, which
    may come long after; until then every statement of a query over large tables holds its own."""
    gc.collect()
    spark._jvm.System.gc()


#: Catalog names of bucketed tables of this process, with the folder of each.
_CUT_TABLES: dict[str, str] = {}


def with_partitions(spark: SparkSession, n: int):
    """The session with ``n`` shuffle partitions for the statements inside."""
    @contextlib.contextmanager
    def held():
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            yield
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    return held()


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, repartition: bool = True) -> tuple[DataFrame, str]:
    """``df`` as an external table bucketed by ``key`` into ``buckets`` files, read back, and its folder. A later join
    on ``key`` with another table of the same bucket count reads both sides in place: no exchange.

    ``repartition=False`` when ``df`` ends in an aggregate by ``key``: it is written with as many shuffle partitions
    as buckets. Both use the same hash, so that each bucket is one file and no extra shuffle is needed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"rg_{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    with with_partitions(spark, buckets):
        out = df.repartition(buckets, key) if repartition else df
        (out.write.mode("overwrite").format("parquet")
            .bucketBy(buckets, key).option("path", path).saveAsTable(table))
    _CUT_TABLES[table] = path
    return spark.table(table), path


def cut_bucketed(df: DataFrame, name: str, key: str, buckets: int, repartition: bool = True) -> DataFrame:
    """Like :func:`cut`, but bucketed (:func:`write_bucketed`). Used for the prepared edges and the per-round node
    state of the propagation loop."""
    return write_bucketed(df, name, key, buckets, repartition)[0]


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int, ddl: str) -> DataFrame:
    """A folder that :func:`write_bucketed` left, as a bucketed table again (another process may have written it)."""
    table = f"rg_opened_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    _CUT_TABLES[table] = path
    return spark.table(table)


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`cut` or :func:`write_bucketed` made, with its catalog entry. Only folders below the
    session's scratch folder are removed."""
    if "/riskgraph/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    same = urlparse(path).path
    for table in [t for t, at in _CUT_TABLES.items() if urlparse(at).path == same]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        del _CUT_TABLES[table]
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove the scratch folders that ``df`` reads (results of :func:`cut` or :func:`write_bucketed`)."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/riskgraph/" in f}:
        drop_folder(df.sparkSession, path)


def drop_cut_tables(spark: SparkSession) -> int:
    """Drop the catalog entries made by :func:`write_bucketed` in this process
    (external tables: the files stay in the checkpoint folder, whose lifetime
    the cluster manages). Call when the results are no longer needed."""
    n = 0
    while _CUT_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_CUT_TABLES.popitem()[0]}")
        n += 1
    return n


def input_signature(spark: SparkSession, paths: Iterable[str]) -> str:
    """Hash of the names, sizes and times of the files below ``paths`` (files or folders): another one when an input
    is written again, also under its old name. A listing on the driver; no file is read."""
    digest = hashlib.sha256()
    for path in paths:
        fs, p = _filesystem(spark, path)
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        digest.update("\n".join([path, *sorted(found)]).encode())
    return digest.hexdigest()
