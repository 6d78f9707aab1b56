"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tracklight.session import ensure_checkpoint_dir

#: Words of the contracts: runs of anything but ASCII white space. `bytes.split()` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> Column:
    """Number of words of a text column; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether the id falls into the fold; a NULL id falls into none."""
    return F.coalesce(crc_remainder(doc_id, modulus) == remainder, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the folder that the cluster shares."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once in a Python worker, which Spark reuses for many tasks.

    This module travels by value, so it is a new one in each task; `sys.modules` stays.
    """
    holder = sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker"))
    kept = holder.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def unused(name: str, df: DataFrame) -> str:
    """`name`, with as many underscores before it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(
    df: DataFrame, function: Callable[[list[bytes | None]], dict[str, list]], schema: str
) -> DataFrame:
    """Add columns that `function` makes from each batch of column `text` (UTF-8 bytes).

    The other columns of `df` are kept, `text` is not. `schema` declares the new columns; one of
    the same name in `df`, in any case, gives way.
    """
    made_fields = StructType.fromDDL(schema).fields
    new = {f.name: to_arrow_type(f.dataType) for f in made_fields}
    gone = {"text", *map(str.lower, new)}
    fields = [f for f in df.schema if f.name.lower() not in gone]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few texts at a time, so that long ones do not add up.
            for piece in pieces(batch):
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                made = function(texts)
                yield pa.RecordBatch.from_pydict(
                    {c: piece.column(c) for c in kept}
                    | {k: pa.array(made[k], kind) for k, kind in new.items()}
                )

    columns = [F.col(f"`{c}`") for c in kept]
    return df.select(*columns, "text").mapInArrow(run, StructType([*fields, *made_fields]))


def filter_texts(df: DataFrame, keep: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows whose text (UTF-8 bytes) `keep` says True for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                yield piece.filter(pa.array(keep(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pieces(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass `most_bytes`; a longer text is a piece of its own."""
    start = held = 0
    for i, size in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
        if held and held + (size or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)
