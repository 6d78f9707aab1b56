"""Files attached to issues."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

# Folder layout and the entry a store keeps in empty folders.
ATTACHMENT_PATH = r"(?:^|/)issues/(\d+)/([^/]+)$"
EMPTY_FOLDER_ENTRY = ".emptyFolderPlaceholder"


def attachment_manifest(paths: DataFrame, column: str = "path") -> DataFrame:
    """Manifest of (path, name, issue_idx) from a column of file paths; other paths drop out."""
    path = F.col(column)
    return paths.filter(path.rlike(ATTACHMENT_PATH)).select(
        path.alias("path"),
        F.regexp_extract(path, ATTACHMENT_PATH, 2).alias("name"),
        F.regexp_extract(path, ATTACHMENT_PATH, 1).cast("long").alias("issue_idx"),
    )


def read_attachments(spark: SparkSession, root: str) -> DataFrame:
    """Manifest of the files below `root`; only the listing is read. No such folder: no files."""
    try:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        ).select("path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.ATTACHMENTS)
    return attachment_manifest(files)


def list_attachments(manifest: DataFrame, issue_idx: int | None = None) -> DataFrame:
    """File names per issue, or of one issue, without the empty-folder entry."""
    files = manifest.filter(F.col("name") != EMPTY_FOLDER_ENTRY)
    if issue_idx is not None:
        files = files.filter(F.col("issue_idx") == issue_idx)
    return files.select("issue_idx", "name")


def with_mime_type(files: DataFrame) -> DataFrame:
    return files.withColumn("mime_type", text.mime_type(F.col("name")))
