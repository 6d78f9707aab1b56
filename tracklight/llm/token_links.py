"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

The tokens of both that share the bytes between two common ends form a group, and every token of
one is linked to every token of the other there. A chunk of documents holds, for each pair of
linked ids, a compressed bitmap of its documents, and bit planes of how often each of them links
the pair. Popcounts of the bitmaps add up to the documents of a pair, those of the planes, by their
weight, to its links; going through the postings again gives the scores of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import kept_by_worker, pieces
from tracklight.llm.tokens import Encoder, byte_level_tokens, sentence_piece_tokens, words
from tracklight.session import shared_dir


class Aligner:
    """Groups and links of texts. What it finds in a word is kept, as most words come again."""

    MOST_WORDS = 300_000
    LONGEST_WORD = 64

    def __init__(self, byte_level: str, sentence_piece: str):
        import sentencepiece

        # Strings of special tokens are ordinary text.
        self.a = Encoder(byte_level, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=sentence_piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = byte_level_tokens(self.a.tokenizer.get_vocab())
        self.b_bytes = sentence_piece_tokens(pieces)
        self.a_size, self.b_size = (np.array(list(map(len, t))) for t in (self.a_bytes, self.b_bytes))
        self.cuttable = self.a.cuttable and not any("▁" in p.lstrip("▁") for p in pieces)
        # Ids as text, behind what separates them from the one before.
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.names = [f"{c}{i}" for c, n in ((";", na), (",", na), ("|", nb), (",", nb)) for i in range(n)]
        self.name_size = np.array(list(map(len, self.names)))
        self.forget()

    def forget(self) -> None:
        """Word 0 stands for texts without tokens."""
        self.known: dict[str, int] = {}
        self.numbers = [np.zeros((1, 4), np.int64)]  # n_a, n_b, n_groups, n_links of each word
        self.valid = [np.ones(1, bool)]
        self.groups = [b""]
        self.found = [(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def learn(self, new: list[str]) -> None:
        """Find the groups and links of words that have a space before them."""
        raw, want = self.a.behind_spaces(new), [(" " + w).encode() for w in new]
        a, n_a = np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(r) // 4 for r in raw], np.int64)
        found = self.b.encode(new, num_threads=1)
        n_b = np.array(list(map(len, found)), np.int64)
        b = np.fromiter(chain.from_iterable(found), np.int64, n_b.sum())
        size = np.array(list(map(len, want)), np.int64)
        valid = (n_a > 0) & (n_b > 0)
        for ids, n, tokens, sizes in ((a, n_a, self.a_bytes, self.a_size), (b, n_b, self.b_bytes, self.b_size)):
            valid &= _whole(ids, n, tokens, sizes, want, size)
        a, b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)]
        n_a, n_b, size = (np.where(valid, n, 0) for n in (n_a, n_b, size))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        owner = np.searchsorted(np.cumsum(size), a_end[a_cut])
        groups = len(owner)
        links = np.bincount(a_group, minlength=groups) * np.bincount(b_group, minlength=groups)
        numbers = np.stack([n_a, n_b, np.bincount(owner, minlength=len(new)), _sums(owner, links, len(new))], axis=1)

        self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.numbers.append(numbers.astype(np.int64))
        self.valid.append(valid)
        self.groups += self._texts(a, b, a_group, b_group, n_a + n_b)
        self.found.append(self._pairs(a, b, a_group, b_group, owner, len(new)))

    def _texts(self, a, b, a_group, b_group, n) -> list[bytes]:
        """The ids of each word's groups as text."""
        na, nb = len(self.a_bytes), len(self.b_bytes)
        a_new, b_new = (np.diff(g, prepend=-1) != 0 for g in (a_group, b_group))
        names = np.empty(len(a) + len(b), np.int64)
        # Tokens of one side stand behind those of the other side in the groups before.
        names[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = np.where(a_new, a, na + a)
        names[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = np.where(b_new, 2 * na + b, 2 * na + nb + b)
        text = "".join(map(self.names.__getitem__, names.tolist())).encode()
        ends = np.concatenate([[0], np.cumsum(self.name_size[names])])[np.concatenate([[0], np.cumsum(n)])].tolist()
        return [text[x + 1 : y] for x, y in zip(ends, ends[1:])]

    def _pairs(self, a, b, a_group, b_group, owner, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each word with how often it links them: starts of the words, pairs, counts."""
        na, nb = len(self.a_bytes), len(self.b_bytes)
        a_key, a_n = np.unique(a_group * na + a, return_counts=True)
        b_key, b_n = np.unique(b_group * nb + b, return_counts=True)
        group, b_start = a_key // na, np.searchsorted(b_key // nb, np.arange(len(owner) + 1))
        reach = np.diff(b_start)[group]
        at = _ranges(b_start[group], reach)
        key = np.repeat(owner[group] * (na * nb) + a_key % na * nb, reach) + b_key[at] % nb
        key, times = _added(key, np.repeat(a_n, reach) * b_n[at])
        starts = np.searchsorted(key, np.arange(n) * (na * nb))
        return starts, key % (na * nb), times

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and validity of all known words; starts, pairs and counts of their links."""
        if len(self.numbers) > 1:
            self.numbers, self.valid = [np.concatenate(self.numbers)], [np.concatenate(self.valid)]
            sizes = np.cumsum([0] + [len(p) for _, p, _ in self.found])
            starts = np.concatenate([s + k for (s, _, _), k in zip(self.found, sizes)])
            self.found = [(starts, *(np.concatenate([f[i] for f in self.found]) for i in (1, 2)))]
        return self.numbers[0], self.valid[0], *self.found[0]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of each text, the digests of their groups, and the links: text, pair, count."""
        if len(self.groups) > self.MOST_WORDS:
            self.forget()
        cut = [(words(t) if self.cuttable else [t]) if t else [] for t in texts]
        self.learn([w for w in set().union(*cut) if w not in self.known])
        places = [list(map(self.known.__getitem__, c)) for c in cut]
        size = np.array(list(map(len, places)))
        word = np.fromiter(chain.from_iterable(places), np.int64, size.sum())
        if not self.tables()[1][word].all():
            for i, place in enumerate(places):
                if not self.tables()[1][place].all():
                    # The whole text decides, since bytes that one word lost another may have.
                    self.learn([texts[i]])
                    place[:] = [len(self.groups) - 1]
            size = np.array(list(map(len, places)))
            word = np.fromiter(chain.from_iterable(places), np.int64, size.sum())
        owner = np.repeat(np.arange(len(texts)), size)
        numbers, _, starts, pairs, times = self.tables()
        made = np.stack([_sums(owner, numbers[word, k], len(texts)) for k in range(4)], axis=1)
        digests = [
            hashlib.sha256(b";".join(map(self.groups.__getitem__, p))).hexdigest() if n else ""
            for p, n in zip(places, made[:, 0].tolist())
        ]
        # Each distinct word of a text once, with how often it stands there.
        key, n = np.unique(owner << 32 | word, return_counts=True)
        owner, word = key >> 32, key & (1 << 32) - 1
        reach = np.append(starts, len(pairs))[word + 1] - starts[word]
        at = _ranges(starts[word], reach)
        links = np.repeat(owner, reach), pairs[at], np.repeat(n, reach) * times[at]
        for w in [w for c in cut for w in c if len(w) > self.LONGEST_WORD]:
            self.known.pop(w, None)
        return made, digests, *links


def _whole(ids, n, tokens: list[bytes], sizes: np.ndarray, want: list[bytes], size: np.ndarray) -> np.ndarray:
    """Whether the `n` tokens of each text are its bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(n)])]
    made, all_ = b"".join(map(tokens.__getitem__, ids.tolist())), b"".join(want)
    same = np.diff(ends) == size
    if same.all() and made == all_:
        return same
    return np.array([made[x:y] == w for x, y, w in zip(ends[:-1].tolist(), ends[1:].tolist(), want)], bool)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers for each owner."""
    low, high = values & (1 << 26) - 1, values >> 26
    low, high = (np.bincount(owner, v, n).astype(np.int64) for v in (low, high))
    return low + (high << 26)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each range, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


# -- postings -----------------------------------------------------------------------------------

#: A chunk ends with this many documents, which 16 bits count, or links of documents and pairs.
CHUNK_DOCS, CHUNK_POSTINGS = 1 << 16, 2 << 20

_ALIGNED = (
    "chunk long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a int, b int, n_docs long, pair_links long, docs binary, planes binary"
)


def postings(keys: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """The compressed bitmaps of each pair, from sorted keys pair << 16 | document.

    Returns pairs, documents and links of each by popcount, and two binary columns. `docs` is an
    array of 16-bit numbers, or a bitmap of `n_docs` bits where that is shorter. `planes` has the
    bits of the counts, a bitmap over the documents of the pair for each, and is NULL if all are 1.
    """
    pair, doc = keys >> 16, (keys & 0xFFFF).astype("<u2")
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(np.append(first, len(pair)))
    row = np.repeat(np.arange(len(first)), n)

    width = (n_docs + 7) // 8
    dense = 2 * n > width
    size = np.where(dense, width, 2 * n)
    start = np.cumsum(size) - size
    raw = np.zeros(size.sum(), np.uint8)
    sparse = ~dense[row]
    at = _ranges(start[~dense], 2 * n[~dense])
    raw[at] = doc[sparse].view(np.uint8)
    marks = np.zeros((int(dense.sum()), width * 8), np.uint8)
    marks[(np.cumsum(dense) - 1)[row[~sparse]], doc[~sparse]] = 1
    raw[_ranges(start[dense], size[dense])] = np.packbits(marks, axis=1, bitorder="little").ravel()

    most = np.maximum.reduceat(times, first) if len(first) else n
    count = np.where(most > 1, np.ceil(np.log2(most + 1.0)).astype(np.int64), 0)
    width = (n + 7) // 8
    plane_start = np.cumsum(count * width) - count * width
    bits = np.zeros(int((count * width).sum()) * 8, np.uint8)
    rank = np.arange(len(row)) - first[row]
    links = np.zeros(len(first), np.int64)
    for k in range(int(count.max(initial=1)) or 1):
        has = (times >> k & 1).astype(bool)
        links += np.bincount(row[has], minlength=len(first)) << k
        has &= count[row] > k
        r = row[has]
        bits[(plane_start[r] + k * width[r]) * 8 + rank[has]] = 1
    planes = _binary(np.packbits(bits, bitorder="little"), count * width, count == 0)
    return pair[first], n, links, _binary(raw, size), planes


def _binary(raw: np.ndarray, size: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A binary column of pieces of the given sizes that follow each other."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return column if null is None else pa.compute.if_else(pa.array(null), None, column)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the sizes of its values."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = np.frombuffer(b"".join(v for v in values.to_pylist() if v), np.uint8)
    return raw, pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def unpacked(n: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and count of every posting of `n` documents each row."""
    raw, size = _bytes(docs)
    start = np.cumsum(size) - size
    dense = size != 2 * n
    row = np.repeat(np.arange(len(n)), n)
    doc = np.zeros(len(row), np.int64)
    doc[~dense[row]] = raw[_ranges(start[~dense], size[~dense])].view("<u2")
    if dense.any():
        marks = np.unpackbits(raw[_ranges(start[dense], size[dense])].reshape(int(dense.sum()), -1), axis=1, bitorder="little")
        doc[dense[row]] = np.nonzero(marks)[1]

    raw, size = _bytes(planes)
    bits, start, width = np.unpackbits(raw, bitorder="little"), np.cumsum(size) - size, (n + 7) // 8
    count = size // np.maximum(width, 1)
    times = (count[row] == 0).astype(np.int64)
    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    for k in range(int(count.max(initial=0))):
        has = count[row] > k
        r = row[has]
        times[has] += bits[(start[r] + k * width[r]) * 8 + rank[has]].astype(np.int64) << k
    return row, doc, times


def write_alignment(docs: DataFrame, path: str, byte_level: str, sentence_piece: str) -> None:
    """Align the whole texts of `docs` (doc_id, text) and write documents and postings below `path`.

    Each task numbers its documents within chunks of its own and writes both in one output, so that
    a task that runs again replaces the numbers and what uses them together.
    """
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("aligner", byte_level, sentence_piece)
        aligner = kept_by_worker(key, lambda: Aligner(byte_level, sentence_piece))
        nb = len(aligner.b_bytes)
        keys, times, done, seq, held = [], [], 0, 0, 0

        def flush(part: int) -> pa.RecordBatch:
            # What the pieces of a chunk found is merged; equal documents do not meet again.
            key, count = _added(np.concatenate(keys), np.concatenate(times))
            pair, n, links, bitmaps, planes = postings(key, count, done)
            return _rows(chunk=np.full(len(pair), part << 20 | seq), a=(pair // nb).astype(np.int32), b=(pair % nb).astype(np.int32), n_docs=n, pair_links=links, docs=bitmaps, planes=planes)

        part = 0
        for batch in batches:
            for piece in pieces(batch, 2 << 20):
                part, texts = piece.column("part")[0].as_py(), piece.column("text").to_pylist()
                for i in range(0, len(texts), CHUNK_DOCS):
                    some = texts[i : i + CHUNK_DOCS]
                    if done + len(some) > CHUNK_DOCS or held > CHUNK_POSTINGS:
                        yield flush(part)
                        keys, times, done, seq, held = [], [], 0, seq + 1, 0
                    made, digests, owner, pair, count = aligner.align(some)
                    yield _rows(chunk=np.full(len(some), part << 20 | seq), doc=np.arange(done, done + len(some), dtype=np.int32), doc_id=piece.column("doc_id").slice(i, len(some)), n_a=made[:, 0], n_b=made[:, 1], n_groups=made[:, 2], n_links=made[:, 3], groups_sha256=digests)
                    key, count = _added(pair << 16 | owner + done, count)
                    keys.append(key)
                    times.append(count)
                    done, held = done + len(some), held + len(key)
        if keys:
            yield flush(part)

    def _rows(**columns) -> pa.RecordBatch:
        n = len(columns["chunk"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in wanted], schema=wanted
        )

    wanted = _arrow_schema(_ALIGNED)
    rows.mapInArrow(run, _ALIGNED).write.parquet(path)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links of every linked pair of the corpus, and whether no other b of its a has more documents."""
    pairs = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return pairs.join(most, "a").withColumn("is_best", F.col("n_docs") == F.col("_most")).drop("_most")


def link_documents(docs: DataFrame, byte_level: str, sentence_piece: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    `byte_level` is a tokenizer file of the `tokenizers` library, `sentence_piece` a model of
    `sentencepiece`. Only doc_id and text of `docs` are read. Texts that are NULL, empty, or not the
    same bytes again in the tokens of either have zeros and an empty digest. Each row is a document
    of its own, whatever its id. No rows give no rows.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "links")
    write_alignment(docs, f"{path}/aligned", byte_level, sentence_piece)
    aligned = spark.read.schema(_ALIGNED).parquet(f"{path}/aligned")
    found = aligned.where("a IS NOT NULL").select("chunk", "a", "b", "n_docs", "pair_links", "docs", "planes")
    pair_counts(found).write.parquet(f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs").select("a", "b", F.col("n_docs").alias("count"), "is_best")

    def score(table: pa.Table) -> pa.Table:
        n, count = (table.column(c).to_numpy() for c in ("n_docs", "count"))
        row, doc, times = unpacked(n, table.column("docs"), table.column("planes"))
        last = int(doc.max(initial=-1)) + 1
        best = table.column("is_best").to_numpy()
        return pa.table({
            "chunk": pa.array(np.full(last, table.column("chunk")[0].as_py())),
            "doc": pa.array(np.arange(last, dtype=np.int32)),
            "n_best": pa.array(_sums(doc, times * best[row], last)),
            "count_sum": pa.array(_sums(doc, times * count[row], last)),
        })

    scored = (
        found.join(pairs, ["a", "b"])
        .select("chunk", "n_docs", "docs", "planes", "count", "is_best")
        .groupBy("chunk")
        .applyInArrow(score, "chunk long, doc int, n_best long, count_sum long")
    )
    rows = aligned.where("doc IS NOT NULL").select("chunk", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = rows.join(scored, ["chunk", "doc"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
