"""Batch loader sink for the export tables (A8, A9), as a Python data source to files.

    nodes.write.format("graph_batches").option("key", "cont_rut").option("sequence", "1").mode("append").save(folder)

Each task writes its rows in batches of ``batch`` (10,000) to files of its own in a staging folder. Only when all tasks
are done does the commit name these files in one manifest, which is renamed into place whole; an aborted or lost load
leaves no manifest, and the abort removes what was staged. A load is read back with :func:`read_loaded`: of the rows of
one key the one of the highest sequence holds, so that a load done twice is a load done once, and a later load replaces
what it names. Within one sequence the largest row in column order holds, which does not depend on the order of tasks.

Files are reached through pyarrow's file systems, so the folder may be local (shared) or on HDFS; rows pass from the
executors to the files and not through the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 10_000
FORMAT = "graph_batches"


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(folder) if ":" in folder else (pa.fs.LocalFileSystem(), folder)
    return fs, path.rstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    files: list
    rows: int


class GraphBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> GraphBatchWriter:
        return GraphBatchWriter(self.options, schema, overwrite)


class GraphBatchWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        self.folder, self.sequence = options["path"], int(options["sequence"])
        self.key, self.batch = options["key"], int(options.get("batch", BATCH))
        missing = [k for k in self.key.split(",") if k not in schema.names]
        if missing:
            raise ValueError(f"no such key column: {missing}")
        self.schema, self.overwrite, self.load = schema, overwrite, uuid.uuid4().hex

    def _staging(self) -> str:
        return f"staging/{self.load}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.folder)
        fs.create_dir(f"{root}/{self._staging()}", recursive=True)
        mine, files, n = uuid.uuid4().hex, [], 0  # a task that runs again has files of its own; the lost ones are never named
        held: list[pa.RecordBatch] = []

        def put(rows: pa.Table) -> None:
            name = f"{self._staging()}/{mine}-{len(files)}.parquet"
            with fs.open_output_stream(f"{root}/{name}") as out:
                pq.write_table(rows, out)
            files.append(name)

        for batch in iterator:
            held.append(batch)
            n += batch.num_rows
            if sum(b.num_rows for b in held) >= self.batch:
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= self.batch:
                    put(rows.slice(0, self.batch))
                    rows = rows.slice(self.batch)
                held = rows.to_batches()
        if any(b.num_rows for b in held):
            put(pa.Table.from_batches(held))
        return Staged(files, n)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.folder)
        if self.overwrite:
            fs.delete_dir_contents(f"{root}/loads", missing_dir_ok=True)
        fs.create_dir(f"{root}/loads", recursive=True)
        manifest = {"sequence": self.sequence, "key": self.key, "rows": sum(m.rows for m in messages if m),
                    "files": [f for m in messages if m for f in m.files]}
        aside = f"{root}/{self._staging()}.json"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps(manifest).encode())
        fs.move(aside, f"{root}/loads/{self.load}.json")

    def abort(self, messages: list) -> None:
        fs, root = _open(self.folder)
        if fs.get_file_info(f"{root}/{self._staging()}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{root}/{self._staging()}")


def register(spark: SparkSession) -> None:
    """Make the sink known to the session."""
    spark.dataSource.register(GraphBatches)


def load(df: DataFrame, folder: str, key: Sequence[str], sequence: int, overwrite: bool = False, batch: int = BATCH) -> None:
    """One load of ``df`` into ``folder``; ``sequence`` says which of two loads of a key is the later one."""
    register(df.sparkSession)
    (df.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("key", ",".join(key))
        .option("sequence", str(sequence)).option("batch", str(batch)).save(folder))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(load, sequence, key, rows, files) of the committed loads."""
    schema = "sequence long, key string, rows long, files array<string>"
    try:
        found = spark.read.schema(schema).json(f"{folder}/loads")
        return found.withColumn("load", F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]+)[.]json$", 1)).select("load", "sequence", "key", "rows", "files")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "load string, " + schema)


def read_loaded(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that hold after all committed loads, one per key. Files that no manifest names are not read: the list
    of loads (one row each) picks the staging folders, and a partial maximum per key and task goes before the shuffle."""
    loads = manifests(spark, folder)
    first = loads.orderBy("sequence", "load").first()
    if first is None:
        return spark.createDataFrame([], schema)
    key = first["key"].split(",")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/staging")
    name = F.regexp_extract(F.col("_metadata.file_path"), "(staging/[0-9a-f]+/[^/]+[.]parquet)$", 1)
    named = loads.select("sequence", F.explode("files").alias("__file"))
    rows = rows.withColumn("__file", name).join(named, "__file")
    rest = [c for c in schema.names if c not in key]
    held = rows.groupBy(*key).agg(F.max(F.struct("sequence", *rest)).alias("__row"))
    return held.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in schema.names])
