"""Tables that grow by micro-batches, kept as runs that are merged like the digits of a counter.

Batch k writes one run: its own rows, together with the runs of the batches right before it for
each trailing one in the binary digits of k. So after n batches a run stands for each one among
the digits of n. A reader opens about log2(n) folders, a row is written at most log2(n) times, and
what a batch writes follows, on average, its own rows and not the size of the table. Runs of
`TOP` levels are not merged any more, which bounds the largest merge.

A repeated batch writes the same folder from the same runs. `tidy` removes runs that were merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOP = 10


def remove(spark: SparkSession, folder: str) -> bool:
    """Remove a folder with all that is in it; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables of one batch, written and read back so that plans stay short."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int):
        self.spark, self.folder = spark, f"{path}/scratch/batch={batch_id}"

    def __enter__(self) -> Scratch:
        return self

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)


def _ends(batches: int) -> list[tuple[int, int]]:
    """(level, last batch) of the runs that hold the first `batches` batches, oldest first."""
    top = [(TOP, (i + 1 << TOP) - 1) for i in range(batches >> TOP)]
    return top + [
        (level, (batches >> level << level) - 1) for level in reversed(range(TOP)) if batches >> level & 1
    ]


class RunLog:
    """The table `name` below `path`.

    `fold` makes of the rows of some runs fewer that say the same; it must not matter in which
    order and how often it is applied. Readers apply it to what they get. A run lies in the order of
    `order_by`, so that filters on its first column pass over most of what they do not want.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        name: str,
        schema: T.StructType,
        fold: Callable[[DataFrame], DataFrame] | None = None,
        order_by: tuple[str, ...] = (),
    ):
        self.spark, self.path, self.schema = spark, f"{path}/{name}", schema
        self.fold, self.order_by = fold or (lambda rows: rows), order_by

    def _folder(self, level: int, end: int) -> str:
        return f"{self.path}/level={level}/run={end}"

    def _rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        # Each run is named, so that files of others, whole or not, are never seen.
        folders = [self._folder(*run) for run in runs]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write the run of batch `batch_id`."""
        before, after = _ends(batch_id), _ends(batch_id + 1)
        level, end = after[-1]
        merged = before[len(after) - 1 :]
        rows = rows.select(*self.schema.names)
        rows = self.fold(rows.unionByName(self._rows(merged)) if merged else rows)
        if self.order_by:
            rows = rows.repartitionByRange(*self.order_by).sortWithinPartitions(*self.order_by)
        rows.write.mode("overwrite").parquet(self._folder(level, end))

    def read(self, last: int) -> DataFrame:
        """All rows up to batch `last`, folded."""
        return self.fold(self.rows(last))

    def rows(self, last: int) -> DataFrame:
        """The rows of the runs up to batch `last` as they are, for filters before the fold."""
        return self._rows(_ends(last + 1))

    def tidy(self, last: int) -> int:
        """Remove the runs that those of batch `last` have taken up; returns how many.

        `last` must be finished. The runs that a repetition of batch `last` would read stay.
        """
        kept = {*_ends(last + 1), *_ends(last)}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        removed = 0
        for level in range(TOP + 1):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/level={level}")
            files = folder.getFileSystem(conf)
            for status in files.listStatus(folder) if files.exists(folder) else []:
                end = int(status.getPath().getName().removeprefix("run="))
                if end <= last and (level, end) not in kept:
                    removed += remove(self.spark, status.getPath().toString())
        return removed
