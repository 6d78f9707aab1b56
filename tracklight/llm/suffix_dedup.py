"""Substring dedup: prefix-partitioned suffix trees over the places where texts may repeat.

A window is WINDOW consecutive words. Of every window the smallest hash of GRAM consecutive words is
its anchor; equal windows have equal anchors at the same place, so a window can only repeat where its
anchor does. The suffixes that start at repeated anchors are dealt out by a prefix: that of GRAM words
(the anchor) if few suffixes share it, else the whole window, which pre-aggregates. A task then builds
the tree of its suffixes, sorted with their longest common prefixes, and one of the words that lead
up to them; a node of both trees that spans a whole window is a repeat, and its first leaf stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import checkpointed, map_texts, pieces
from tracklight.session import shared_dir

WINDOW = 20
#: Words of an anchor; a window holds WINDOW - GRAM + 1 places for it.
GRAM = 6
OFFSETS = WINDOW - GRAM + 1
#: An anchor at more places than this is split further, by whole windows.
TREE_SUFFIXES = 4096
#: An anchor at more places of one task than this counts as one at more than TREE_SUFFIXES.
LOCAL_PLACES = 64
#: Anchors that a task holds before it passes them on.
FLUSH_ANCHORS = 1_000_000
#: Suffixes whose trees are held at a time.
CHUNK_SUFFIXES = 1 << 15
_HELD_WINDOWS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place of its anchor; for each place, the hash of the words there."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * _ODD + h[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= _ODD
    grams ^= grams >> np.uint64(32)
    view = np.lib.stride_tricks.sliding_window_view(grams, OFFSETS)
    return view.argmin(1) + np.arange(len(view)), grams  # the first of equal ones


def _joined(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, sha256) of the words of each text."""

    def run(texts: list[bytes | None]) -> dict[str, list]:
        words = [(t or b"").split() for t in texts]
        return {"n_words": [len(w) for w in words], "sha256": [_joined(w) for w in words]}

    return map_texts(docs, run, "n_words long, sha256 string")


def _with_copies(described: DataFrame) -> DataFrame:
    """Add is_copy: whether the same words are a document of a smaller id. NULL ids are none."""
    first = checkpointed(described.groupBy("sha256").agg(F.min("doc_id").alias("first")))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return described.join(first, "sha256").withColumn("is_copy", copy).drop("first")


# Which anchors repeat --------------------------------------------------------------------------
#
# A row holds the anchors of some documents that fall into one part of the range of hashes, packed
# into bytes: hashes, steps of ids and places are three columns that compress well apart.


def _pack(doc_id: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> bytes:
    columns = hashes.astype(np.uint64), np.diff(doc_id, prepend=0), at.astype(np.int32)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = len(data) // 20
    ids = np.cumsum(np.frombuffer(data, np.int64, n, 8 * n))
    return ids, np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int32, n, 16 * n)


def _anchor_parts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, known, packed): the anchors of all documents, by part.

    An anchor at more than LOCAL_PLACES places of one task is known to repeat and to be hot: one entry
    without a place tells the others so, and its places go along as known, spread by document.
    """

    def flushed(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = np.repeat([d for d, _, _ in held], [len(at) for _, _, at in held]).astype(np.int64)
        hashes = np.concatenate([h for _, h, _ in held])
        at = np.concatenate([a for _, _, a in held])
        kinds, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        hot = count[which] > LOCAL_PLACES
        told = kinds[count > LOCAL_PLACES]
        none = np.full(len(told), -1)
        rows = []
        for known, d, h, a in (
            (False, np.concatenate([none, ids[~hot]]), np.concatenate([told, hashes[~hot]]), np.concatenate([none, at[~hot]])),
            (True, ids[hot], hashes[hot], at[hot]),
        ):
            part = ((d.view(np.uint64) * _ODD if known else h) >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            for chosen in np.split(order, edges) if len(order) else []:
                rows.append((int(part[chosen[0]]), known, _pack(d[chosen], h[chosen], a[chosen])))
        columns = list(zip(*rows)) or [(), (), ()]
        types = (pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "known", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts):
                    places, grams = _anchors((text or b"").split())
                    if len(places):
                        places = np.unique(places)
                        held.append((doc_id, grams[places], places))
                        size += len(places)
                    if size > FLUSH_ANCHORS:
                        yield from flushed(held)
                        held, size = [], 0
        if held:
            yield from flushed(held)

    return docs.mapInArrow(run, "part int, known boolean, packed binary")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, at, hot) of the anchors at several places, from rows sorted by part."""

    def made(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(ids), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(hot)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "at", "hot"])

    def judged(held: list[bytes]) -> pa.RecordBatch:
        ids, hashes, at = map(np.concatenate, zip(*map(_unpack, held)))
        _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        told = np.bincount(which[at < 0], minlength=len(count)) > 0
        hot = told | (count > TREE_SUFFIXES)
        keep = (at >= 0) & (hot | (count > 1))[which]
        return made(ids[keep], hashes[keep], at[keep], hot[which][keep])

    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and held:
                yield judged(held)
                held = []
            part = row["part"]
            if row["known"]:
                ids, hashes, at = _unpack(row["packed"])
                yield made(ids, hashes, at, np.ones(len(ids), bool))
            else:
                held.append(row["packed"])
    if held:
        yield judged(held)


def _packed(docs: DataFrame) -> DataFrame:
    def run(texts: list[bytes | None]) -> dict[str, list]:
        pack = zstandard.ZstdCompressor(level=3).compress
        return {"packed": [pack(t or b"") for t in texts]}

    return map_texts(docs, run, "packed binary")


def _candidates(words: list[bytes], at, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose anchor is among those given: their anchors' places; all places; all hashes."""
    places, grams = _anchors(words)
    known = np.zeros(len(grams), bool)
    at, hashes = np.array(at, np.int64), np.array(hashes, np.int64).view(np.uint64)
    inside = at < len(grams)
    at, hashes = at[inside], hashes[inside]
    known[at[grams[at] == hashes]] = True
    return np.flatnonzero(known[places]) if len(places) else places, places, grams


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (prefix, doc_id, at, left, right): an anchor with all words of its windows."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc in batch.to_pylist():
            rows = {"prefix": [], "doc_id": [], "at": [], "left": [], "right": []}
            words = unpack(doc["packed"]).split()
            cold = [not h for h in doc["hot"]]
            at = [a for a, c in zip(doc["at"], cold) if c]
            hashes = [h for h, c in zip(doc["hash"], cold) if c]
            starts, places, grams = _candidates(words, at, hashes)
            anchors, first, count = np.unique(places[starts], return_index=True, return_counts=True)
            signed = grams[anchors].view(np.int64).tolist()
            for a, s, n, h in zip(anchors.tolist(), starts[first].tolist(), count.tolist(), signed):
                rows["prefix"].append(h)
                rows["doc_id"].append(doc["doc_id"])
                rows["at"].append(a)
                rows["left"].append(b" ".join(words[s:a]))
                rows["right"].append(b" ".join(words[a : s + n - 1 + WINDOW]))
            if rows["at"]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(rows.items(), kinds)})


def _tree(rows: list[list[int]], width: int) -> np.ndarray:
    """Nodes of the tree of word sequences: entry [d, i] is the node of sequence i at depth d.

    The sequences are sorted; where the longest common prefix of neighbours is shorter than d, a new
    node of depth d begins.
    """
    words = np.full((len(rows), width), -1, np.int32)
    for i, row in enumerate(rows):
        words[i, : len(row)] = row
    order = np.lexsort(words.T[::-1])
    ranked = words[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    nodes = np.zeros((width + 1, len(rows)), np.int64)
    for d in range(1, width + 1):
        nodes[d, order[1:]] = np.cumsum(common < d)
    return nodes


def _first_leaves(doc_id: np.ndarray, at: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start) of the first window of each word sequence among the suffixes given."""
    order = np.lexsort((at, doc_id))
    doc_id, at = doc_id[order], at[order]
    numbers: dict[bytes, int] = {}
    before = [[numbers.setdefault(w, len(numbers)) for w in left[i].split()[::-1]] for i in order]
    after = [[numbers.setdefault(w, len(numbers)) for w in right[i].split()] for i in order]
    most = np.array([len(b) for b in before])  # words of a window that may stand before the anchor
    least = WINDOW - np.array([len(a) for a in after])
    lead, follow = _tree(before, OFFSETS - 1), _tree(after, WINDOW)
    docs, starts = [], []
    for i in range(OFFSETS):
        has = np.flatnonzero((least <= i) & (i <= most))
        if len(has):
            node = lead[i, has] * (len(at) + 1) + follow[WINDOW - i, has]
            first = has[np.unique(node, return_index=True)[1]]
            docs.append(doc_id[first])
            starts.append(at[first] - i)
    return np.concatenate(docs), np.concatenate(starts)


def _by_document(doc_id: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((starts, doc_id))
    doc_id, starts = doc_id[order], starts[order].astype(np.int32)
    ids, first = np.unique(doc_id, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)), pa.int32()), pa.array(starts))
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "starts": lists})


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First windows of a partition sorted by prefix, some whole prefixes at a time."""

    def firsts(held: pa.Table) -> pa.RecordBatch:
        return _by_document(
            *_first_leaves(
                held["doc_id"].to_numpy(), held["at"].to_numpy().astype(np.int64),
                held["left"].to_pylist(), held["right"].to_pylist(),
            )
        )

    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) >= CHUNK_SUFFIXES:
            ends = np.flatnonzero(np.diff(held["prefix"].to_numpy()))
            if len(ends):
                yield firsts(held.slice(0, int(ends[-1]) + 1))
                held = held.slice(int(ends[-1]) + 1)
    if held is not None and len(held):
        yield firsts(held)


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc_id, start): the first place of each window with a frequent anchor in these rows."""
    unpack = zstandard.ZstdDecompressor().decompress

    def made(held: dict[bytes, tuple[int, int]]) -> pa.RecordBatch:
        places = list(held.values())
        return pa.RecordBatch.from_pydict(
            {
                "window": pa.array(list(held), pa.binary()),
                "doc_id": pa.array([d for d, _ in places], pa.int64()),
                "start": pa.array([s for _, s in places], pa.int32()),
            }
        )

    held: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        for doc in batch.to_pylist():
            words = unpack(doc["packed"]).split()
            at = [a for a, h in zip(doc["at"], doc["hot"]) if h]
            hashes = [h for h, hot in zip(doc["hash"], doc["hot"]) if hot]
            for s in _candidates(words, at, hashes)[0].tolist():
                window = b" ".join(words[s : s + WINDOW])
                here = doc["doc_id"], s
                if held.get(window, here) >= here:
                    held[window] = here
            if len(held) > _HELD_WINDOWS:
                yield made(held)
                held = {}
    yield made(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sha256, n_removed, kept_sha256, spans): what later windows take from each text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = {"doc_id": [], "sha256": [], "n_removed": [], "kept_sha256": [], "spans": []}
        for doc in batch.to_pylist():
            words = unpack(doc["packed"]).split()
            starts = _candidates(words, doc["at"], doc["hash"])[0]
            later = starts[~np.isin(starts, [s for part in doc["firsts"] or [] for s in part])]
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, later, 1)
            np.add.at(steps, later + WINDOW, -1)
            gone = np.cumsum(steps)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
            row = doc["doc_id"], _joined(words), int(gone.sum()), _joined(kept), edges.reshape(-1, 2).tolist()
            for name, value in zip(out, row):
                out[name].append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): words that earlier windows make superfluous.

    Removed are the words of every window whose word sequence also starts earlier: in a smaller
    doc_id, or in the same at an earlier word. `spans` lists the removed words as [start, end) pairs.
    Only doc_id and text of `docs` are read. NULL and empty texts have no words. Rows with one id
    count as one document: neither of two windows at the same word of it is earlier, and where their
    texts differ, a word that starts a first window in one of them does so in all. Rows with a NULL id
    have no place in the order: they lose nothing and nothing is lost to them. No rows give no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "suffix-dedup")
    rows = docs.select("doc_id", "text")
    _described(rows).write.parquet(f"{folder}/words")
    _with_copies(spark.read.parquet(f"{folder}/words")).write.parquet(f"{folder}/described")
    described = spark.read.parquet(f"{folder}/described")

    words = described.agg(F.sum("n_words")).first()[0] or 0
    parts = min(max(256, words >> 20), 1 << 16)
    placed = _anchor_parts(rows.where("doc_id IS NOT NULL"), parts).repartition("part")
    repeated = placed.sortWithinPartitions("part").mapInArrow(
        _repeated, "doc_id long, hash long, at int, hot boolean"
    )
    repeated = repeated.groupBy("doc_id").agg(
        *[F.collect_list(c).alias(c) for c in ("at", "hash", "hot")]
    )
    # A copy loses everything to the first of its kind, which stands for it in the trees.
    copies = described.groupBy("doc_id").agg(F.min("is_copy").alias("all")).where("all").select("doc_id")
    repeated = repeated.join(copies, "doc_id", "left_anti")
    _packed(rows).join(repeated, "doc_id").write.parquet(f"{folder}/candidates")
    candidates = spark.read.parquet(f"{folder}/candidates")

    suffixes = candidates.mapInArrow(_suffixes, "prefix long, doc_id long, at int, left binary, right binary")
    leaves = suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees, "doc_id long, starts array<int>")
    hot = candidates.where(F.exists("hot", lambda h: h)).mapInArrow(_hot_windows, "window binary, doc_id long, start int")
    hot = hot.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    hot = hot.select("first.doc_id", F.array("first.start").alias("starts"))
    firsts = leaves.unionByName(hot).groupBy("doc_id").agg(F.collect_list("starts").alias("firsts"))

    removed = candidates.join(firsts, "doc_id", "left").mapInArrow(
        _removed, "doc_id long, sha256 string, n_removed long, kept_sha256 string, spans array<array<long>>"
    )
    removed = removed.dropDuplicates(["doc_id", "sha256"])
    whole = F.col("is_copy") & (F.col("n_words") >= WINDOW)
    n_removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    kept = F.when(whole, _joined([])).otherwise(F.coalesce("kept_sha256", "sha256"))
    span = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    none = F.array().cast("array<array<long>>")
    return described.join(removed, ["doc_id", "sha256"], "left").select(
        "doc_id",
        "n_words",
        n_removed.alias("n_removed"),
        kept.alias("kept_sha256"),
        F.when(whole, span).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
