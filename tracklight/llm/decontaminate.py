"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import filter_texts, map_texts

#: Words in the shortest match that counts. Items with fewer words cannot be found.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover for a leak.
COVERAGE = 0.5
#: Items are held by tasks in blocks of about so many bytes of text, one block a pass.
BLOCK_BYTES = 32 << 20
_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass
class Block:
    """Some items: their words as numbers, and where each run of MIN_MATCH words stands in them."""

    ids: list[int | None]
    words: dict[str, int]
    items: list[np.ndarray]
    seeds: np.ndarray  # sorted Karp-Rabin hashes
    seed_item: np.ndarray
    seed_at: np.ndarray


def _seeds(numbers: np.ndarray) -> np.ndarray:
    """The running hash of MIN_MATCH words from every position."""
    n = len(numbers) - MIN_MATCH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = numbers.astype(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(MIN_MATCH):
        total = total * _BASE + wide[k : k + n]
    return total


def block_of(rows: list[tuple[int | None, str | None]]) -> Block:
    words: dict[str, int] = {}
    ids, items = [], []
    for item_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        own = [words.setdefault(w, len(words) + 1) for w in tokens(text or "")]
        if len(own) >= MIN_MATCH:
            ids.append(item_id)
            items.append(np.array(own, np.int32))
    hashes = [_seeds(item) for item in items]
    seeds = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    order = np.argsort(seeds, kind="stable")
    item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
    at = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, int)]).astype(int)
    return Block(ids, words, items, seeds[order], item[order], at[order])


def tiles(text: np.ndarray, item: np.ndarray, at: np.ndarray, item_at: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in the text, place in the item, words), the longest first.

    `at`, `item_at` are the places where seeds agree. Runs of seeds on one diagonal are the longest
    matches there. The longest is marked first (of equal ones the first in the item, then in the
    text); a match that runs into marked words goes on with what is left of it, as long as that has
    MIN_MATCH words.
    """
    order = np.lexsort((at, at - item_at))
    at, item_at = at[order], item_at[order]
    same = (text[at[:, None] + np.arange(MIN_MATCH)] == item[item_at[:, None] + np.arange(MIN_MATCH)]).all(1)
    at, item_at = at[same], item_at[same]  # equal hashes of other words
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(item_at) != 1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(at))) + MIN_MATCH - 1
    heap = [(-int(n), int(item_at[s]), int(at[s])) for s, n in zip(starts, sizes)]
    heapq.heapify(heap)
    marked, item_marked = np.zeros(len(text), bool), np.zeros(len(item), bool)
    found = []
    while heap:
        n, p, t = heapq.heappop(heap)
        taken = marked[t : t - n] | item_marked[p : p - n]
        if not taken.any():
            marked[t : t - n] = item_marked[p : p - n] = True
            found.append((t, p, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for start, end in zip(edge[::2], edge[1::2]):
            if end - start >= MIN_MATCH:
                heapq.heappush(heap, (-int(end - start), p + int(start), t + int(start)))
    return found


def matches(text: bytes | None, block: Block, coverage: float) -> list[tuple[int | None, float, int, int]]:
    """(item_id, coverage, tiles, longest tile) of the items that a whole text gives away."""
    if not text or not len(block.seeds):
        return []
    get = block.words.get
    own = np.fromiter((get(w, 0) for w in tokens(text.decode())), np.int32)
    if len(own) < MIN_MATCH:
        return []
    # A seed has no word that is in no item.
    strange = np.cumsum(np.concatenate([[0], own == 0]))
    at = np.flatnonzero(strange[MIN_MATCH:] == strange[:-MIN_MATCH])
    if not len(at):
        return []
    hashes = _seeds(own)[at]
    low = np.searchsorted(block.seeds, hashes, "left")
    count = np.searchsorted(block.seeds, hashes, "right") - low
    at, low, count = at[count > 0], low[count > 0], count[count > 0]
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place, first, n in zip(at.tolist(), low.tolist(), count.tolist()):
        for k in range(first, first + n):
            pairs[int(block.seed_item[k])].append((place, int(block.seed_at[k])))
    out = []
    for i, places in sorted(pairs.items()):
        item = block.items[i]
        if len({p for _, p in places}) + (MIN_MATCH - 1) * len(places) < coverage * len(item):
            continue  # too few seeds to cover so much
        places = np.array(places)
        found = tiles(own, item, places[:, 0], places[:, 1])
        share = sum(n for _, _, n in found) / len(item)
        if found and share >= coverage:
            out.append((block.ids[i], share, len(found), max(n for _, _, n in found)))
    return out


def _blocks(items: DataFrame, block_bytes: int):
    """Blocks of items, each broadcast: of a size that does not grow with the number of items."""
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = [tuple(r) for r in part.toLocalIterator()]
        yield items.sparkSession.sparkContext.broadcast(vars(block_of(rows)))


def leaks(
    docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each leak of an item into a document.

    Words are runs of letters, digits and underscores in lower case. Only doc_id and text of `docs`
    and item_id and text of `items` are read; a repeated item counts once, a repeated document each
    time. NULL and empty texts hold nothing. Items come in blocks of bounded size, each compared with
    all documents in one pass without a shuffle. No documents or no items give no rows.
    """
    rows = docs.select("doc_id", "text")
    out = "found array<struct<item_id: long, coverage: double, n_tiles: int, longest: int>>"
    parts = []
    for block in _blocks(items, block_bytes):

        def run(texts: list[bytes | None], block=block) -> dict[str, list]:
            names = ("item_id", "coverage", "n_tiles", "longest")
            held = Block(**block.value)
            return {"found": [[dict(zip(names, m)) for m in matches(t, held, coverage)] for t in texts]}

        parts.append(map_texts(rows, run, out).selectExpr("doc_id", "inline(found)"))
    if not parts:
        return rows.limit(0).selectExpr(
            "doc_id", "CAST(NULL AS long) item_id", "0D coverage", "0 n_tiles", "0 longest"
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def without_leaks(
    docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of `docs` into which no item leaks, with all their columns."""
    for block in _blocks(items, block_bytes):

        def keep(texts: list[bytes | None], block=block) -> list[bool]:
            held = Block(**block.value)
            return [not matches(t, held, coverage) for t in texts]

        docs = filter_texts(docs, keep)
    return docs
