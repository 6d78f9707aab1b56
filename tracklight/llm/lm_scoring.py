"""LM scoring by cross-entropy difference between a target and a background model.

Both are class bigram models over the whole vocabulary of the corpus: each common word is a class of its
own, all other words are one class, and such a word costs what its class costs after the word before,
and its own share of the class. Shares are counted over all texts and looked up by a join, so the
vocabulary grows with the corpus; what tasks hold does not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import map_texts, pieces
from tracklight.session import shared_dir

#: Classes: the most frequent words but one, and one class for the rest. A model has at most the square of
#: this many class bigrams, so its table of losses takes 4 bytes times that (17 MB) in a task.
CLASSES = 2_048
#: Of the other words, the most frequent so many are looked up in the task, the rest by a join.
NEAR_WORDS = 100_000
#: Different words that a task counts before it passes them on.
_HELD_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return (text or b"").lower().split()


def vocabulary(docs: DataFrame, size: int = CLASSES) -> dict[bytes, int]:
    """Numbers 1, 2, .. of the `size` - 1 most frequent words of all texts; ties go by code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for piece in pieces(batch):
                for text in piece.column("text").cast(pa.binary()).to_pylist():
                    held.update(words_of(text))
                    if len(held) > _HELD_WORDS:
                        yield _counted(held)
                        held = Counter()
        yield _counted(held)

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size - 1).collect()
    return {r.word.encode(): i + 1 for i, r in enumerate(top)}


def _counted(held: Counter) -> pa.RecordBatch:
    words = pa.array(list(held), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_pydict({"word": words, "n": pa.array(held.values(), pa.int64())})


def _numbers(own: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.get, own, repeat(0)), np.int64, len(own))


def _cells(numbers: np.ndarray, size: int) -> np.ndarray:
    """Class bigrams of a text; the first word follows the class of the rest."""
    before = np.concatenate([[0], numbers[:-1]])
    return before * size + numbers


def counts(docs: DataFrame, known: dict[bytes, int], size: int = CLASSES) -> DataFrame:
    """(cell, word, background, target): class bigrams, and words without a class of their own, counted
    in all texts and in those with `is_target`. A row has either a cell or a word."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def words(rare: dict[bytes, list[int]]) -> pa.RecordBatch:
        n = np.array(list(rare.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict(
            {"cell": pa.nulls(len(n), pa.int64()), "word": pa.array(list(rare), pa.binary()).cast(pa.string()),
             "background": pa.array(n[:, 0]), "target": pa.array(n[:, 1])}
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size * size), np.int32)
        rare: dict[bytes, list[int]] = {}
        for batch in batches:
            for piece in pieces(batch):
                target = piece.column("is_target").to_pylist()
                for t, text in zip(target, piece.column("text").cast(pa.binary()).to_pylist()):
                    own = words_of(text)
                    numbers = _numbers(own, held.value)
                    cells, n = np.unique(_cells(numbers, size), return_counts=True)
                    total[0, cells] += n.astype(np.int32)
                    if t:
                        total[1, cells] += n.astype(np.int32)
                    for k in np.flatnonzero(numbers == 0).tolist():
                        at = rare.setdefault(own[k], [0, 0])
                        at[0] += 1
                        at[1] += t
                    if len(rare) > _HELD_WORDS:
                        yield words(rare)
                        rare = {}
        yield words(rare)
        cells = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(cells), "word": pa.nulls(len(cells), pa.string()),
             "background": pa.array(total[0, cells].astype(np.int64)),
             "target": pa.array(total[1, cells].astype(np.int64))}
        )

    found = docs.select("is_target", "text").mapInArrow(count, "cell long, word string, background long, target long")
    return found.groupBy("cell", "word").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def log_probabilities(cells: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Natural logs of P(class | class before) for all cells, by Witten-Bell interpolation.

    A context with n words, in t different classes, trusts its own counts by n / (n + t) and else the
    share of the class in all words, to which one is added for every class.
    """
    table = np.zeros(size * size)
    table[cells] = counts
    table = table.reshape(size, size)
    words = table.sum(0)
    low = (words + 1) / (words.sum() + size)
    n, t = table.sum(1), np.maximum((table > 0).sum(1), 1)
    for row, kinds, total in zip(table, t, n):  # in place: the table is the largest thing held
        row += kinds * low
        row /= total + kinds
    return np.log(table, out=table).ravel().astype(np.float32)


def _written(df: DataFrame) -> DataFrame:
    """`df` read again from the folder that the cluster shares."""
    folder = shared_dir(df.sparkSession, "lm")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def score_documents(
    docs: DataFrame, is_target: DataFrame, size: int = CLASSES, near_words: int = NEAR_WORDS
) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, difference) for each whole text of `docs`.

    `is_target` has the doc_id of every document in the target model; the background model counts all
    documents. Both share the vocabulary and the way of smoothing. Losses are in nats a word; the
    difference is target less background, so less means nearer to the target. NULL and empty texts
    have no words and losses of 0. A row with a NULL id is background only; repeated rows count each
    time. Only doc_id and text are read. No rows give no rows.

    A word's share of its class is (its count + 1) / (words of the class + different words of it).
    `size` and `near_words` bound what a task holds; all words count at any value of the second.
    """
    rows = docs.select("doc_id", "text")
    known = vocabulary(rows, size)
    targets = is_target.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True))
    # Always a merge join: the plan, and what it shuffles, shall not change with the size of the labels.
    marked = rows.join(targets.hint("merge"), "doc_id", "left").select(F.coalesce("is_target", F.lit(False)).alias("is_target"), "text")
    # Tables of words are written as Parquet, which packs them better than a checkpoint does.
    found = _written(counts(marked, known, size))
    # At most size * size rows of 20 bytes; kept as Arrow, since the driver would hold pandas' copy as well.
    classes = found.where("cell IS NOT NULL").select(F.col("cell").cast("int"), "target", "background").toArrow()
    cells = classes["cell"].to_numpy()
    models = [log_probabilities(cells, classes[c].to_numpy(), size) for c in ("target", "background")]
    del classes, cells
    rare = found.where("word IS NOT NULL").select("word", "target", "background")
    kinds, *sums = rare.agg(F.count("word"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("target", "background")]).first()

    def share(n, of: int):
        return F.log((F.lit(float(of + kinds))) / (F.col(n) + 1))

    losses = rare.select("word", share("target", sums[0]).alias("t"), share("background", sums[1]).alias("b"), "background")
    near = losses.orderBy(F.desc("background"), "word").limit(near_words).select("word", "t", "b").toArrow()
    places = {word.encode(): k for k, word in enumerate(near["word"].to_pylist())}
    near_loss = np.stack([near["t"].to_numpy(), near["b"].to_numpy()])
    held = docs.sparkSession.sparkContext.broadcast((known, *models, places, near_loss))
    del models, places

    def run(texts: list[bytes | None]) -> dict[str, list]:
        numbered, target, background, places, near_loss = held.value
        out = {"n_words": [], "t": [], "b": [], "mark": [], "far": []}
        for text in texts:
            own = words_of(text)
            numbers = _numbers(own, numbered)
            at = _cells(numbers, size) if len(numbers) else numbers
            total = np.array([-m[at].sum(dtype=np.float64) for m in (target, background)])
            far, near, times = [], [], []
            for word, n in Counter(own[k] for k in np.flatnonzero(numbers == 0).tolist()).items():
                place = places.get(word)
                if place is None:
                    far.append({"word": word.decode(), "n": n})
                else:
                    near.append(place)
                    times.append(n)
            if near:
                total += near_loss[:, near] @ np.array(times, float)
            values = (len(own), *total.tolist(), xxhash.xxh64_intdigest(text or b"") >> 1, far)
            for name, value in zip(out, values):
                out[name].append(value)
        return out

    # Equal rows have equal results, so they are added up under one key and come apart at the end.
    key = ["doc_id", "mark"]
    own = _written(map_texts(rows, run, "n_words long, t double, b double, mark long, far array<struct<word: string, n: long>>"))
    texts = own.select(*key, F.lit(1).cast("long").alias("copies"), "n_words", "t", "b")
    far = own.select(*key, F.inline("far")).join(losses.select("word", "t", "b"), "word")
    none = F.lit(0).cast("long")
    far = far.select(*key, none.alias("copies"), none.alias("n_words"), (F.col("n") * F.col("t")).alias("t"), (F.col("n") * F.col("b")).alias("b"))
    added = texts.unionByName(far).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("copies", "n_words", "t", "b")])
    mean = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    return added.select(
        "doc_id",
        F.expr("n_words div copies").alias("n_words"),
        mean("t").alias("target_loss"),
        mean("b").alias("background_loss"),
        (mean("t") - mean("b")).alias("difference"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    ).drop("_copy")
