"""SimHash near-dedup: fingerprints by majority of bits, linked by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import checkpointed, map_texts
from tracklight.llm.graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: A bucket with more fingerprints is cut into tiles of about half as many, compared two by two.
BUCKET_ROWS = 2048
#: Fingerprints whose bit planes are held at a time.
CHUNK_ROWS = 1 << 16
_STEP = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The 64 majority bits of the shingle hashes, as a signed long; 0 for a text without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
        n = len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _STEP):
        size = min(_STEP, n - start)
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, size)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) for every whole text; NULL is an empty text."""

    def run(texts: list[bytes | None]) -> dict[str, list]:
        return {"print": [fingerprint(t) for t in texts]}

    return map_texts(docs.select("doc_id", "text"), run, "print long")


# Comparison -----------------------------------------------------------------------------------


def masks(rows: int) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree under at least one of them.

    The bits are cut into blocks; of `n` blocks, RADIUS differing bits leave n - RADIUS untouched.
    With more rows there are more blocks, so that buckets of unrelated fingerprints stay small.
    """
    blocks = RADIUS + 2
    while blocks < 2 * RADIUS and rows >> (64 * (blocks - RADIUS) // blocks) > 64:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit plane b holds bit b of all fingerprints, 64 of them a word; one empty word at the end."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(prints) // 64) + 1
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three bits, in all positions of the words at once."""
    half = a ^ b
    return (a & b) | (half & c), half ^ c


def near_pairs(prints: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of fingerprints of one bucket that differ in at most RADIUS bits.

    Rows come sorted by bucket. For each distance d, all rows are compared with the d-th row after
    them at once: planes against shifted planes, eight planes a step into carry-save counters.
    A block of 64 pairs is abandoned when none of its pairs can be within the radius any more.
    """
    planes = _planes(prints)
    words = planes.shape[1]
    d = 0
    while True:
        d += 1
        together = buckets[:-d] == buckets[d:]
        if d >= len(prints) or not together.any():
            return
        open_ = _packed(together, words)[:-1]
        at = np.flatnonzero(open_)
        open_ = open_[at]
        skip, shift = divmod(d, 64)
        last = words - 1
        zero = np.zeros(len(at), np.uint64)
        ones, twos, fours, over = zero, zero.copy(), zero.copy(), zero.copy()
        for first in range(0, 64, 8):
            here = planes[first : first + 8, at]
            low = planes[first : first + 8, np.minimum(at + skip, last)] >> np.uint64(shift)
            if shift:
                high = planes[first : first + 8, np.minimum(at + skip + 1, last)]
                low |= high << np.uint64(64 - shift)
            p = here ^ low
            fours_in = []
            for k in (0, 4):
                twos_a, ones = _add(ones, p[k], p[k + 1])
                twos_b, ones = _add(ones, p[k + 2], p[k + 3])
                carry, twos = _add(twos, twos_a, twos_b)
                fours_in.append(carry)
            eights, fours = _add(fours, *fours_in)
            over |= eights
            within = open_ & ~(over | (fours & (ones | twos)))
            alive = np.flatnonzero(within)
            if len(alive) < 0.7 * len(at):
                at, open_, within = at[alive], open_[alive], within[alive]
                ones, twos, fours, over = ones[alive], twos[alive], fours[alive], over[alive]
            if not len(alive):
                break
        else:
            bits = np.unpackbits(within.view(np.uint8), bitorder="little").reshape(-1, 64)
            word, bit = np.nonzero(bits)
            i = at[word] * 64 + bit
            yield i, i + d


def _join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    at = parent[i]
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def _links(prints: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from every fingerprint to the first of those it hangs together with in its bucket."""
    parent = np.arange(len(prints))
    for i, j in near_pairs(prints, buckets):
        _join_roots(parent, i, j)
    top = _roots(parent, np.arange(len(prints)))
    members = np.flatnonzero(top != np.arange(len(prints)))
    return prints[top[members]].view(np.int64), prints[members].view(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a sorted partition, some whole buckets at a time."""

    def made(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        a, b = _links(rows[0].astype(np.int64).view(np.uint64), _runs(rows[1:]))
        return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held = new if held is None else tuple(map(np.concatenate, zip(held, new)))
        if len(held[0]) >= CHUNK_ROWS:
            cut = int(np.flatnonzero(np.diff(_runs(held[1:]), prepend=-1))[-1])
            if cut:
                yield made(tuple(c[:cut] for c in held))
                held = tuple(c[cut:] for c in held)
    if held is not None and len(held[0]):
        yield made(held)


def _runs(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """A number for each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (`print`) that hang the near ones together.

    Of all pairs within the radius only as many are returned as connect them. A bucket holds the
    fingerprints that agree under one mask. A large bucket is cut into tiles by a hash, and each two
    tiles are a bucket of their own, so no task holds more than about BUCKET_ROWS at a time.
    """
    chosen = masks(prints.count())
    keyed = prints.select(
        "print",
        F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in chosen])).alias("mask", "key"),
    )
    sizes = keyed.groupBy("mask", "key").count().where(F.col("count") > BUCKET_ROWS)
    tiles = F.ceil(F.col("count") * 2 / BUCKET_ROWS)
    large = checkpointed(sizes.select("mask", "key", tiles.alias("tiles")))
    keyed = keyed.join(large, ["mask", "key"], "left")
    tile = F.pmod(F.xxhash64("print"), F.col("tiles"))
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    two = F.transform(others, lambda o: F.struct(F.least(o, tile).alias("i"), F.greatest(o, tile).alias("j")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    keyed = keyed.withColumn("_to", F.explode(F.when(F.col("tiles").isNull(), one).otherwise(two)))
    keys = ["mask", "key", "i", "j"]
    placed = keyed.select("print", "mask", "key", "_to.i", "_to.j").repartition(*keys)
    found = placed.sortWithinPartitions(*keys).mapInArrow(_compare, "a long, b long")
    return found.distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of documents by chains of near fingerprints.

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest doc_id that
    can be reached. Only doc_id and text of `docs` are read; every row gives a row. NULL and empty
    texts have the fingerprint zero, which links like any other. A row with a NULL id keeps it; it
    does not count as smallest, unless the group has no other. No rows give no rows.

    Equal texts meet in one fingerprint before anything is compared, so the size of a group of
    copies does not matter.
    """
    rows = checkpointed(fingerprints(docs))
    firsts = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("print"))).withColumnRenamed("node", "print")
    groups = checkpointed(firsts.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    smallest = checkpointed(groups.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpointed(groups.join(smallest, "root").select("print", "component_id"))
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without all but the document of the smallest id of each group of near documents.

    All columns stay. Rows with a NULL id stay. Of repeated rows with one id, one stays.
    """
    groups = checkpointed(near_groups(docs).select("doc_id", "component_id"))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    gone = others.join(first, "doc_id", "left_anti")
    kept = docs.join(gone, "doc_id", "left_anti")
    known = groups.where("doc_id IS NOT NULL")
    if known.count() == known.distinct().count():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
