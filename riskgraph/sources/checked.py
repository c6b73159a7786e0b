"""CSV extracts with broken rows (A1, A2): good rows typed, the others kept with their file and the reason.

The reader takes every line as text columns and puts lines that do not fit into a column of their own; nothing is
dropped and one bad row does not end the scan. Values are then cast one by one, with a decimal comma or point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StringType, StructField, StructType

from .io import cut

CORRUPT = "__corrupt"


def _number(c: Column, decimal: str) -> Column:
    return F.replace(c, F.lit(decimal), F.lit(".")) if decimal != "." else c


def _cast(f: StructField, decimal: str) -> Column:
    c = F.trim(F.col(f"`{f.name}`"))
    if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
        c = _number(c, decimal)
    return c.try_cast(f.dataType)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, sep: str = ",", decimal: str = ".",
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, rejects). Good rows have the columns of ``schema``. Rejects have file, line (the row as it stands in the
    file) and reason: ``columns`` where their number is wrong, else the columns that cannot be cast or that may not be
    null, in the order of the schema, joined by commas. An empty field is null.

    The extract is scanned once: both results read one written table."""
    text = StructType([*(StructField(f.name, StringType()) for f in schema.fields), StructField(CORRUPT, StringType())])
    raw = (spark.read.schema(text).option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true").csv(path))
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(sep, *[F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in schema.fields]))
    bad = F.array_compact(F.array(*[
        F.when(_cast(f, decimal).isNull() & (F.col(f"`{f.name}`").isNotNull() if f.nullable else F.lit(True)), F.lit(f.name)) for f in schema.fields]))
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("columns")).when(F.size(bad) > 0, F.concat_ws(",", bad))
    read = cut(raw.select(*[F.col(f"`{f.name}`") for f in schema.fields], F.col("_metadata.file_path").alias("__file"),
                          line.alias("__line"), reason.alias("__reason")), "checked-csv")
    good = read.where("__reason is null").select(*[_cast(f, decimal).alias(f.name) for f in schema.fields])
    rejects = read.where("__reason is not null").select(F.col("__file").alias("file"), F.col("__line").alias("line"), F.col("__reason").alias("reason"))
    return good, rejects
