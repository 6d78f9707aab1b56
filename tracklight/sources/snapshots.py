"""Versioned snapshots of a collection, of which readers see only whole ones.

A snapshot is written to a folder of its own. Then a marker file that bears its number is created,
which succeeds for one writer only, and this alone publishes it: the latest snapshot is that of the
highest marker. What a writer leaves that dies before, nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import read_documents, write_documents


class SnapshotConflict(RuntimeError):
    """Another writer has published a snapshot of the same version."""


class Snapshots:
    """The collection at `path`, as JSON documents (`json`) or `parquet`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json"):
        if fmt not in ("json", "parquet"):
            raise ValueError(f"fmt must be 'json' or 'parquet', not {fmt!r}")
        self.spark, self.path, self.schema, self.fmt = spark, path.rstrip("/"), schema, fmt

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _markers(self) -> dict[int, str]:
        files, folder = self._hadoop("published")
        if not files.exists(folder):
            return {}
        found = {}
        for status in files.listStatus(folder):
            stream = files.open(status.getPath())
            try:
                found[int(status.getPath().getName())] = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        # An empty marker is one whose writer has not named its folder yet.
        return {version: name for version, name in found.items() if name}

    def versions(self) -> list[int]:
        return sorted(self._markers())

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot, by default the latest; an empty collection if none was ever published."""
        markers = self._markers()
        if version is None:
            if not markers:
                return self.spark.createDataFrame([], self.schema)
            version = max(markers)
        folder = f"{self.path}/{markers[version]}"
        if self.fmt == "json":
            return read_documents(self.spark, folder, self.schema, layout="lines")
        return self.spark.read.schema(self.schema).parquet(folder)

    def write(self, rows: DataFrame) -> str:
        """Write a snapshot that nobody sees yet; returns its folder."""
        name = f"data-{uuid.uuid4().hex}"
        if self.fmt == "json":
            write_documents(rows.select(*self.schema.names), f"{self.path}/{name}")
        else:
            rows.select(*self.schema.names).write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, name: str, version: int) -> int:
        """Make a written snapshot the one of this version; `SnapshotConflict` if there is one."""
        files, marker = self._hadoop("published", str(version))
        if version in self._markers() or files.exists(marker):
            raise SnapshotConflict(f"version {version} of {self.path} is taken")
        # Written beside and renamed, so that a marker is never seen half written.
        _, draft = self._hadoop("drafts", f"{version}-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(name.encode())
        stream.close()
        files.mkdirs(marker.getParent())
        if not _rename_new(self.spark, draft, marker):
            raise SnapshotConflict(f"version {version} of {self.path} is taken")
        return version

    def replace(self, rows: DataFrame, based_on: int | None = None) -> int:
        """Write and publish the next snapshot; returns its version.

        `based_on` is the version that `rows` were made from, by default the latest one before
        writing. If another one was published since, nothing is: `SnapshotConflict`.
        """
        last = max(self.versions(), default=0) if based_on is None else based_on
        return self.publish(self.write(rows), last + 1)

    def expire(self, keep: int) -> int:
        """Remove all but the newest `keep` snapshots and what no marker names; returns how many folders."""
        markers = self._markers()
        kept = {markers[v] for v in sorted(markers)[-keep:]} if keep > 0 else set()
        files, folder = self._hadoop()
        removed = 0
        for version in sorted(markers)[: max(0, len(markers) - keep)]:
            files.delete(self._hadoop("published", str(version))[1], False)
        for status in files.listStatus(folder) if files.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith("data-") and name not in kept:
                files.delete(status.getPath(), True)
                removed += 1
        return removed


def _rename_new(spark: SparkSession, source, target) -> bool:
    """Rename unless the target exists, in one step of the file system; False if it exists."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(context.makeQualified(source), context.makeQualified(target), options)
    except Exception as error:  # what the file system says of a target that exists, through py4j
        if "FileAlreadyExistsException" not in str(error):
            raise
        return False
    return True
