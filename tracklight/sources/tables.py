"""Reading and writing tables and JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_table(
    spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Scan one of the tables of `schemas.TABLES`, with its declared schema.

    With `fmt="jdbc"` give the connection in `options`; `partitionColumn`, `lowerBound`,
    `upperBound` and `numPartitions` split the scan over the executors.
    """
    schema = schemas.TABLES[name]
    if fmt == "jdbc":
        columns = [F.col(field.name).cast(field.dataType) for field in schema]
        return spark.read.format("jdbc").options(**options).load().select(*columns)
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a table; with `partition_by`, only the partitions present in `df` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "issue_idx") -> None:
    """Write as a catalog table bucketed by `key`, so later joins and groups on it need no shuffle.

    Issues and workflow bucketed alike serve the reports that take `bucketed`, nested stages and
    lead times without any setting.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType, layout: str = "array"
) -> DataFrame:
    """Read a collection of JSON objects; a missing file is an empty collection.

    `layout="array"` reads files that hold one array of objects (one task per file);
    `layout="lines"` reads snapshots of `write_documents`, which can be split.
    """
    if layout not in ("array", "lines"):
        raise ValueError(f"layout must be 'array' or 'lines', not {layout!r}")
    try:
        return (
            spark.read.schema(schema)
            .option("multiLine", layout == "array")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
            .json(path)
        )
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return spark.createDataFrame([], schema)


def write_documents(df: DataFrame, path: str) -> None:
    """Write the whole collection as a new snapshot, one JSON object per line.

    `path` must be new: the snapshot being read is never overwritten, so a failed write loses
    nothing and a reader of the old snapshot is not disturbed.
    """
    (
        df.write.mode("errorifexists")
        .option("ignoreNullFields", "false")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .json(path)
    )


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object, NULL fields kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def read_usage_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = schemas.USAGE_EVENTS,
    max_files: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """The usage feed as a stream of the files below `path`.

    `pattern` selects files by name, `max_files` bounds one micro-batch.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
