"""Binary files of token ids with Elias-Fano encoded document boundaries.

A corpus is a folder of shard files, each a part of the documents in ascending doc_id order, and a
`manifest` table that names them. A shard file holds, after a header as `HEADER` has it,

    the ends of its documents in the id array, Elias-Fano encoded,
    its doc_ids less the smallest one, Elias-Fano encoded as well,
    the ids of all its documents, one after the other, as little-endian integers of 2 or 4 bytes.

An Elias-Fano sequence takes about 2 bits and the low bits a value; of a 64-bit table nothing is
kept. Its select structure is the place of every 256th one among the high bits, as 32-bit integers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import kept_by_worker, pieces
from tracklight.llm.tokens import Encoder
from tracklight.plans.scans import running

MAGIC = b"IDS-EF01"
#: Magic, bytes of an id, documents, documents without an id (they stand first), ids, smallest
#: doc_id, bytes of the encoded ends and of the encoded doc_ids.
HEADER = "<8sQQQQqQQ"
SEQUENCE = "<QQQ"  # values, low bits of each, bytes of the high bits
SAMPLE = 256
#: Ids of a shard file, unless one document has more.
SHARD_IDS = 16 << 20


class EliasFano:
    """A rising sequence of whole numbers below 2^64 in near-minimal space."""

    def __init__(self, buffer: bytes | memoryview):
        self.n, self.low_bits, high = struct.unpack_from(SEQUENCE, buffer)
        start = struct.calcsize(SEQUENCE)
        low = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(buffer, np.uint8, low, start)
        self.high = np.frombuffer(buffer, np.uint8, high, start + low)
        samples = (self.n + SAMPLE - 1) // SAMPLE
        self.samples = np.frombuffer(buffer, "<u4", samples, start + low + high)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """`values` are unsigned and rise or stay."""
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(
            ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"
        )
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        head = struct.pack(SEQUENCE, n, low_bits, len(high))
        return head + low.tobytes() + high.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """The i-th value, by going on from the last sampled one."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(window[skip:]) + skip
            if left < len(ones):
                high = byte * 8 + int(ones[left]) - i
                return high << self.low_bits | self._low(i)
            left -= len(ones)
            byte, skip = byte + 64, 0

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        end = first + self.low_bits
        word = int.from_bytes(self.low[first // 8 : (end + 7) // 8].tobytes(), "little")
        return word >> first % 8 & (1 << self.low_bits) - 1

    def decode(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits]
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        low = (bits.reshape(self.n, self.low_bits).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
        return high | low

    @property
    def nbytes(self) -> int:
        return struct.calcsize(SEQUENCE) + self.low.nbytes + self.high.nbytes + self.samples.nbytes


class Shard:
    """A shard file in memory."""

    def __init__(self, buffer: bytes | memoryview):
        magic, width, self.n, self.nulls, ids, self.least, ends, keys = struct.unpack_from(HEADER, buffer)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        view, start = memoryview(buffer), struct.calcsize(HEADER)
        self.ends = EliasFano(view[start : start + ends])
        self.keys = EliasFano(view[start + ends : start + ends + keys])
        self.ids = np.frombuffer(buffer, f"<u{width}", ids, start + ends + keys)

    @staticmethod
    def encode(doc_ids: list[int | None], documents: list[np.ndarray], width: int) -> list[bytes]:
        """The parts of a file of documents that come in ascending order of their ids, NULL first."""
        known = [k for k in doc_ids if k is not None]
        least = known[0] if known else 0
        ends = EliasFano.encode(np.cumsum([len(d) for d in documents], dtype=np.uint64))
        keys = EliasFano.encode(np.array([k - least for k in known], np.uint64))
        n, ids = len(documents), sum(map(len, documents))
        head = struct.pack(HEADER, MAGIC, width, n, n - len(known), ids, least, len(ends), len(keys))
        return [head, ends, keys, *[np.ascontiguousarray(d, f"<u{width}") for d in documents]]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(k) + self.least for k in self.keys.decode().tolist()]

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the i-th document starts and ends, by two selects."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.ids[start:end]


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def write_corpus(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int = 2, shard_ids: int = SHARD_IDS
) -> None:
    """Encode the whole texts of `docs` and write them as shard files below the folder `path`.

    Rows are range-partitioned by doc_id, those of one id further by a hash of the text and the
    place in the input, so an id that many rows share spreads as well; each task writes its rows as
    one or more files in order, NULL ids first, rows of one id by that hash. `end_id` ends each
    document. NULL and empty texts have this id alone. Only doc_id and text of `docs` are read. No
    rows give an empty manifest. An id that does not fit into `width` bytes is an error.

    A file has a name of its own for each attempt of a task, and the manifest, which is written
    when all files are, names those of the attempts that counted.
    """
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({f"_{i}": c for i, c in enumerate(order)})
    placed = rows.repartitionByRange("_0", "_1", "_2").sortWithinPartitions("_0", "_1", "_2")
    placed = placed.select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("encoder", tokenizer), lambda: Encoder(tokenizer))
        end, most = struct.pack("<I", end_id), (1 << 8 * width) - 1
        store, folder = _filesystem(path)
        made, keys, documents, held, shard = [], [], [], 0, 0

        def flush() -> None:
            name = f"shard-{shard:08d}-{len(made):05d}-{uuid.uuid4().hex}.ids"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as out:
                for part in Shard.encode(keys, documents, width):
                    out.write(part)
            made.append((shard, len(made), name, len(keys), held))

        for batch in batches:
            for piece in pieces(batch, 16 << 20):
                encoded = [raw + end for raw in encoder.encode(piece.column("text").to_pylist())]
                ids = np.frombuffer(b"".join(encoded), "<u4")
                if ids.max() > most:
                    raise ValueError(f"an id does not fit into {width} bytes")
                ids, at = ids.astype(f"<u{width}"), 0
                for key, raw in zip(piece.column("doc_id").to_pylist(), encoded):
                    n = len(raw) // 4
                    if documents and held + n > shard_ids:
                        flush()
                        keys, documents, held = [], [], 0
                    keys.append(key)
                    documents.append(ids[at : at + n])
                    held, at = held + n, at + n
                shard = piece.column("shard")[0].as_py()
        if documents:
            flush()
        columns = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            names=["shard", "piece", "name", "n_docs", "n_ids"],
        )

    schema = "shard long, piece long, name string, n_docs long, n_ids long"
    placed.mapInArrow(run, schema).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of a corpus with the documents and ids before each (first_doc, first_id)."""
    files = spark.read.parquet(f"{path}/manifest")
    # One task holds the files of a partition; the running sums go over the partitions.
    shards = files.groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_ids")])
    before = running(shards, [], "shard", {f"_{c}": ("sum", F.col(c)) for c in ("n_docs", "n_ids")})
    within = running(files, ["shard"], "piece", {f"_p_{c}": ("sum", F.col(c)) for c in ("n_docs", "n_ids")})
    return within.join(before.select("shard", "_n_docs", "_n_ids"), "shard").select(
        *files.columns,
        (F.col("_n_docs") + F.col("_p_n_docs")).alias("first_doc"),
        (F.col("_n_ids") + F.col("_p_n_ids")).alias("first_id"),
    )


def read_corpus(
    spark: SparkSession, path: str, made: Callable[[Shard, int], dict[str, list]], schema: str
) -> DataFrame:
    """What `made` gives for each shard file and the number of ids before it, one task a file."""
    files = manifest(spark, path).select("name", "first_id")
    n = max(1, min(files.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _filesystem(path)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{folder}/{name}") as file:
                    shard = Shard(file.readall())
                yield pa.RecordBatch.from_pydict(made(shard, first), schema=wanted)

    wanted = _arrow_schema(schema)
    return files.repartitionByRange(n, "first_id", "name").mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids of every document of a corpus."""

    def made(shard: Shard, first: int) -> dict[str, list]:
        ends = shard.ends.decode().astype(np.int64)
        starts = np.concatenate([[0], ends])[:-1]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        ids = pa.ListArray.from_arrays(offsets, pa.array(shard.ids.astype(np.int32)))
        return {"doc_id": shard.doc_ids(), "start": starts + first, "n_tokens": ends - starts, "ids": ids}

    return read_corpus(spark, path, made, "doc_id long, start long, n_tokens long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32 of every document of a corpus.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """

    def made(shard: Shard, first: int) -> dict[str, list]:
        ends = [shard.ends.select(i) for i in range(shard.n)]
        starts = [0, *ends[:-1]]
        wide = memoryview(shard.ids.astype("<u4"))
        return {
            "doc_id": shard.doc_ids(),
            "start": [first + s for s in starts],
            "n_tokens": [e - s for s, e in zip(starts, ends)],
            "ids_crc32": [zlib.crc32(wide[s:e]) for s, e in zip(starts, ends)],
        }

    return read_corpus(spark, path, made, "doc_id long, start long, n_tokens long, ids_crc32 long")
