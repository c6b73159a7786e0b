"""What the operators of this folder share: the tables, Arrow batches in slices of bounded size, distributed ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import cut

#: Words of every contract here: runs of anything but ASCII white space. bytes.split() splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hands the memory that this Python process has freed back to the system. Spark keeps its Python processes, and what
    the largest batch took would stay theirs while the JVM beside them grows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into runs of rows with about ``limit`` bytes of ``text`` (a longer single row stays whole),
    each with its texts as UTF-8 bytes; null reads as empty. After the last one the process gives back what it freed."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type):
            col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        sizes = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
        at = 0
        while at < len(sizes):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")))
            yield batch.slice(at, n), [x or b"" for x in col.slice(at, n).to_pylist()]
            at += n
        batch = col = None
    give_back()


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def frame(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def lower_ascii(text: bytes) -> bytes:
    """bytes.lower() changes A-Z only."""
    return text.lower()


def total(df: DataFrame, c: Column) -> int:
    return int(df.agg(F.sum(c)).first()[0] or 0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with a column ``name``: the gapless rank from 0 of each row among the rows of equal ``by``, in
    ascending ``order`` (unique within ``by`` for a rank that does not depend on the run).

    A window over ``by`` alone would put a hot key into one task. Here the rows are range-partitioned on
    (by, order) and written once with their partition's number; ranks within (partition, by) and the counts of the
    partitions before them, both from that one written table, add up to the rank. A task holds one range
    partition at most."""
    by, order = list(by), list(order)
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
               .select("__before", F.col("__part").alias("__p"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]))
    own = Window.partitionBy("__part", *by).orderBy(*order)
    keys = [F.col("__part") == F.col("__p"), *[F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]]
    return (placed.withColumn("__own", F.row_number().over(own).cast("long") - 1).join(offsets, keys)
            .select(*df.columns, (F.col("__own") + F.col("__before")).alias(name)))
