"""Toxicity: class-conditional Kneser-Ney models, compared per word.

Each class has a bigram model with absolute discounts. What a bigram does not get goes to the word by
its number of different contexts in the class; what a word does not get goes to its stem (its first
letters), also by class; what a stem does not get goes to the counts of both classes together, and
there it is the same for both. So a rare expression moves a score only as far as some class has seen
it or its stem more often than the shared counts explain.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import checkpointed, in_fold, map_texts

#: Of each class at most so many labelled rows are learnt from, in the order of a hash of their id;
#: one in CALIBRATE of these is kept back to set the scale of the scores. Both classes give the same
#: number of rows, so that counts compare.
FIT_ROWS = 6_000
CALIBRATE = 4
THRESHOLD = 0.3
STEM = 4
DISCOUNT = 0.75
#: Rarer bigrams and words are left to what they back off to.
MIN_BIGRAM, MIN_WORD = 20, 10
_WORD = re.compile(r"\w+")


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode().lower())


@dataclass
class Model:
    words: dict[str, int]  # number of a word; words come before stems in the arrays
    stems: dict[str, int]
    low: np.ndarray  # (2, entries): probability of the entry without context, by class
    rest: np.ndarray  # (2, entries): what the entry as a context leaves to `low`
    bigrams: np.ndarray  # sorted: context times entries plus word
    direct: np.ndarray  # (2, bigrams): discounted share of the bigram in its context
    scale: np.ndarray  # weights of the features of a text, and the constant

    def ratios(self, text: bytes | None) -> list[float]:
        """How much likelier a text is as a toxic one, per word: figures as listed in RATIOS."""
        own = words_of(text)
        if not own or not len(self.low[0]):
            return [0.0] * len(RATIOS)
        numbers = list(map(self.words.get, own))
        unknown = len(self.low[0]) - 1
        for i, n in enumerate(numbers):
            if n is None:
                numbers[i] = self.stems.get(own[i][:STEM], unknown)
        at = np.array(numbers)
        p = self.low[:, at]
        if len(at) > 1:
            p[:, 1:] *= self.rest[:, at[:-1]]
            if len(self.bigrams):
                keys = at[:-1] * len(self.low[0]) + at[1:]
                place = np.minimum(np.searchsorted(self.bigrams, keys), len(self.bigrams) - 1)
                known = self.bigrams[place] == keys
                p[:, 1:] += np.where(known, self.direct[:, place], 0.0)
        log_ratio = np.log(p[1] / p[0])
        common = self.low[:, at].mean(0) > COMMON
        excess = np.maximum(log_ratio - MARKED, 0.0)
        kinds = np.unique(at, return_index=True)[1]
        return [
            float(log_ratio.mean()),
            float(log_ratio[common].mean()) if common.any() else 0.0,
            float(10 * excess.mean()),
            float(10 * excess[kinds].mean()),
        ]

    def scores(self, texts: list[bytes | None]) -> list[float]:
        x = _with_one([self.ratios(t) for t in texts])
        return (1 / (1 + np.exp(-np.clip(x @ self.scale, -500, 500)))).tolist()


#: The mean over the words of log P(word | toxic) - log P(word | ordinary), the same over common
#: words (where it tells the classes' languages apart, not their tone), and the mean of what goes
#: beyond MARKED, over all words and over different ones.
RATIOS = ("words", "common", "marked", "marked_kinds")
COMMON, MARKED = 0.003, 2.0


def _with_one(ratios: list[list[float]]) -> np.ndarray:
    r = np.array(ratios, dtype=float).reshape(-1, len(RATIOS))
    return np.hstack([r, np.ones((len(r), 1))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, slightly drawn to zero."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.1 * w
        curve = (x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def _discounted(counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """By class (rows): discounted shares of the counts, the rest dealt by `shared` (rows or one row)."""
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    kept = np.maximum(counts - DISCOUNT, 0) / total
    rest = 1 - kept.sum(1, keepdims=True)
    return kept + rest * shared


def _model(bigrams, words, stems, contexts) -> Model:
    """Put the counts together. Each input has columns n0, n1 (ordinary, toxic) beside its names."""

    def counts(table) -> np.ndarray:
        return table[["n0", "n1"]].to_numpy(dtype=float).T.reshape(2, -1)

    if not len(stems):
        return Model({}, {}, np.zeros((2, 0)), np.zeros((2, 0)), np.zeros(0, int), np.zeros((2, 0)), np.zeros(len(RATIOS) + 1))
    stem_counts = counts(stems)
    pooled = stem_counts.sum(0) + 1  # one more for stems that were never seen
    pooled = np.append(pooled, 1.0) / (pooled.sum() + 1)
    stem_p = _discounted(np.hstack([stem_counts, np.zeros((2, 1))]), pooled)
    number = {s: i for i, s in enumerate(stems["stem"])}
    word_counts = counts(words)
    of_stem = np.array([number[w[:STEM]] for w in words["w"]], dtype=int)
    # Kept words take their part of the stem's probability by shared counts; the rest of a stem's
    # words share what is left, alike in both classes.
    part = word_counts.sum(0) / stem_counts.sum(0)[of_stem] if len(words) else np.zeros(0)
    word_total = np.maximum(contexts[["k0", "k1"]].sum().to_numpy(dtype=float)[:, None], 1)
    kept = np.maximum(word_counts - DISCOUNT, 0) / word_total
    left = np.maximum(1 - kept.sum(1, keepdims=True), 1e-9)
    low = np.hstack([kept + left * stem_p[:, of_stem] * part, left * stem_p])
    numbered = {w: i for i, w in enumerate(words["w"])}
    size = low.shape[1]
    rest = np.ones((2, size))
    named = contexts[contexts["h"].isin(numbered.keys())]
    at = named["h"].map(numbered).to_numpy(dtype=int)
    by_context = named[["c0", "c1"]].to_numpy(dtype=float).T
    direct, keys = np.zeros((2, 0)), np.zeros(0, int)
    kept_bigrams = bigrams[bigrams["h"].isin(numbered.keys()) & bigrams["w"].isin(numbered.keys())]
    if len(kept_bigrams):
        h = kept_bigrams["h"].map(numbered).to_numpy(dtype=int)
        w = kept_bigrams["w"].map(numbered).to_numpy(dtype=int)
        totals = np.zeros((2, size))
        totals[:, at] = by_context
        direct = np.maximum(counts(kept_bigrams) - DISCOUNT, 0) / np.maximum(totals[:, h], 1)
        for c in (0, 1):
            rest[c] -= np.bincount(h, direct[c], size)
        order = np.argsort(h * size + w)
        keys, direct = (h * size + w)[order], direct[:, order]
    stem_at = {s: len(words) + i for s, i in number.items()}
    return Model(numbered, stem_at, low, np.maximum(rest, 1e-9), keys, direct, np.zeros(len(RATIOS) + 1))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold, at most `fit_rows` of each class.

    Counts are made by Spark; what comes to the driver is bounded by the words of the sample. NULL
    labels are not learnt. Without both classes the score is one constant.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~in_fold("doc_id", 4, 2))
    )
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect() if r.label in (0, 1)}
    order = F.xxhash64("doc_id")
    chosen = None
    fit_rows = min(fit_rows, *[sizes.get(c, 0) for c in (0, 1)])
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(order, "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("scale", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = checkpointed(texts.select("label", "scale", "text"))

    def pairs(batch: list[bytes | None]) -> dict[str, list]:
        found = []
        for t in batch:
            own = words_of(t)
            found.append([{"h": h, "w": w, "n": n} for (h, w), n in Counter(zip(["", *own], own)).items()])
        return {"found": found}

    def by_class(value) -> list:
        return [F.sum(F.when(F.col("label") == c, value).otherwise(0)).alias(f"n{c}") for c in (0, 1)]

    counted = map_texts(texts.where("NOT scale").select("label", "text"), pairs, "found array<struct<h: string, w: string, n: long>>")
    counted = counted.select("label", F.inline("found"))
    bigrams = checkpointed(counted.groupBy("h", "w").agg(*by_class(F.col("n"))))
    seen = [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)]
    words = bigrams.groupBy("w").agg(*seen)  # a word counts once for each of its contexts
    stems = words.groupBy(F.substring("w", 1, STEM).alias("stem")).agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)])
    contexts = bigrams.groupBy("h").agg(
        *[F.sum(f"n{c}").alias(f"c{c}") for c in (0, 1)],
        *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)],
    )
    model = _model(
        bigrams.where(F.col("n0") + F.col("n1") >= MIN_BIGRAM).orderBy("h", "w").toPandas(),
        words.where(F.col("n0") + F.col("n1") >= MIN_WORD).orderBy("w").toPandas(),
        stems.orderBy("stem").toPandas(),
        contexts.orderBy("h").toPandas(),
    )
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def ratios(batch: list[bytes | None]) -> dict[str, list]:
        own = Model(**held.value)
        return {"found": [own.ratios(t) for t in batch]}

    got = map_texts(texts.where("scale").select("label", "text"), ratios, "found array<double>").toPandas()
    y = got["label"].to_numpy(dtype=float)
    x = _with_one([list(r) for r in got["found"]])
    order = np.lexsort([*x.T, y])
    per_class = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    total = max(1, sum(sizes.values()))
    weight = np.where(y == 1, sizes.get(1, 0) / total / per_class[1], sizes.get(0, 0) / total / per_class[0])
    if len(sizes) < 2 or len(np.unique(y)) < 2:
        rate = (sizes.get(1, 0) + 0.5) / (total + 1)
        model.scale[-1] = np.log(rate / (1 - rate))
    else:
        model.scale = _logistic(x[order], y[order], weight[order] * len(y))
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from the threshold on) to the columns of `docs`.

    `text` goes. For a NULL or empty text all ratios are 0. Rows are scored one by one, so repeated rows
    get equal scores. A column named score or predicted gives way.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the fit sample

    def run(texts: list[bytes | None]) -> dict[str, list]:
        scores = Model(**held.value).scores(texts)
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_texts(docs, run, "score double, predicted int")
