"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees, boosted in turn for one feature after the other,
add up to a lookup table per feature; trees over pairs of features then add a table per pair. A score
is the logistic function of the sum of the table entries that a text's bins point to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import filter_texts, in_fold, map_texts

#: At most so many labelled rows are learnt from, in the order of a hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 6
RATE, MIN_ROWS, SHRINK = 0.2, 8, 2.0

FEATURES = (
    "log_words", "word_length", "distinct", "top_word", "repeats", "lines", "line_repeats",
    "letters", "digits", "symbols", "pipes", "upper", "odd_ends", "stops", "short_words", "other",
)
_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
_DIGITS, _SPACE = b"0123456789", b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_COMMON_MARKS = b".,;:!?'\"()-"
_SYMBOLS = bytes(set(range(33, 127)) - set(_LOWER + _UPPER + _DIGITS + _COMMON_MARKS))
_ENDS = frozenset(_SYMBOLS)


def features(text: bytes | None) -> list[float]:
    """Figures about a whole text, as listed in FEATURES. NULL is an empty text."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    some = max(1, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words[1:], words))
    lines = [line for line in text.split(b"\n") if line]

    def share(kind: bytes) -> float:
        return (len(text) - len(text.translate(None, kind))) / size

    letters = share(_LOWER + _UPPER + _HIGH)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / some,
        len(counts) / some,
        max(counts.values(), default=0) / some,
        repeats / some,
        len(lines) / some,
        1.0 - len(set(lines)) / max(1, len(lines)),
        letters,
        share(_DIGITS),
        share(_SYMBOLS),
        text.count(b"|") / some,
        share(_UPPER),
        sum(w[-1] in _ENDS for w in words) / some,
        share(b".!?") * size / some,
        sum(len(w) <= 3 for w in words) / some,
        max(0.0, 1.0 - letters - share(_DIGITS + _SPACE + _SYMBOLS + _COMMON_MARKS)),
    ]


@dataclass
class Gam:
    edges: list[np.ndarray]  # inner bin edges of each feature
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, rows: np.ndarray) -> np.ndarray:
        cut = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(self.edges)]
        return np.stack(cut, axis=1) if cut else np.zeros((len(rows), 0), int)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        cut = self.bins(rows)
        total = np.full(len(rows), self.base)
        for i, t in enumerate(self.tables):
            total += t[cut[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[cut[:, i], cut[:, j]]
        return 1.0 / (1.0 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The cut of a row of bins that gains most: bins below it go left; 0 if none gains."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(left_g):
        return 0, 0.0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain[(left_n < MIN_ROWS) | (n.sum() - left_n < MIN_ROWS)] = 0
    at = int(np.argmax(gain))
    return (at + 1, float(gain[at])) if gain[at] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values that a tree of this depth over ordered bins gives to each bin."""
    cut = _best_cut(g, h, n)[0] if depth else 0
    if not cut:
        return np.full(len(g), RATE * g.sum() / (h.sum() + SHRINK))
    return np.concatenate(
        [_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)]
    )


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts one feature, then each side by the other; its values and its gain."""
    best, most = np.zeros_like(g), 0.0
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        cut, _ = _best_cut(a.sum(1), b.sum(1), c.sum(1))
        if not cut:
            continue
        out, gain = np.zeros_like(a), -_gain(a.sum(), b.sum())
        for side in (slice(0, cut), slice(cut, None)):
            sums = [x[side].sum(0) for x in (a, b, c)]
            out[side] = _tree(*sums, depth=1)
            inner = _best_cut(*sums)[0]
            for part in (slice(0, inner), slice(inner, None)):
                gain += _gain(sums[0][part].sum(), sums[1][part].sum())
        if gain > most:
            best, most = (out.T if turned else out), gain
    return best, most


def fit(rows: np.ndarray, labels: np.ndarray) -> Gam:
    """Boost the tables on the rows given. Without both labels the score is one constant."""
    mean = (labels.sum() + 0.5) / (len(labels) + 1.0)
    edges = [
        np.unique(np.quantile(rows[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.zeros(0)
        for i in range(len(FEATURES))
    ]
    model = Gam(edges, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(np.unique(labels)) < 2:
        return model
    cut = model.bins(rows)
    total = np.full(len(rows), model.base)

    def sums(index: np.ndarray, size: int) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return [np.bincount(index, w, size) for w in (labels - p, p * (1 - p), None)]

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            step = _tree(*sums(cut[:, i], len(t)))
            t += step
            total += step[cut[:, i]]

    def pair_sums(i: int, j: int) -> list[np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        return [x.reshape(shape) for x in sums(cut[:, i] * shape[1] + cut[:, j], shape[0] * shape[1])]

    gains = [
        (_pair_tree(*pair_sums(i, j))[1], i, j)
        for i in range(len(edges))
        for j in range(i + 1, len(edges))
    ]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            step, _ = _pair_tree(*pair_sums(i, j))
            t += step
            total += step[cut[:, i], cut[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Gam:
    """Learn from at most `fit_rows` labelled rows outside the held-out fold.

    Only features and labels of those rows come to the driver, 16 numbers a row. Labels that are
    NULL are not learnt; of several labels of an id each counts.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(~in_fold("doc_id", 5, 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def run(batch: list[bytes | None]) -> dict[str, list]:
        return {"features": [features(t) for t in batch]}

    got = map_texts(texts, run, "features array<double>").toPandas()
    rows = np.array(got["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort([*rows.T, got["label"].to_numpy(dtype=int)])  # sums repeat to the last bit
    return fit(rows[order], got["label"].to_numpy(dtype=float)[order])


def score_documents(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from the threshold on) to the columns of `docs`.

    `text` goes. NULL and empty texts are scored as texts without words; rows are scored one by one,
    so repeated rows get equal scores. A column named score or predicted gives way.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # some ten thousand numbers at most

    def run(texts: list[bytes | None]) -> dict[str, list]:
        rows = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        scores = Gam(**held.value).scores(rows)
        return {"score": scores.tolist(), "predicted": (scores >= threshold).astype("int32").tolist()}

    return map_texts(docs, run, "score double, predicted int")


def accepted(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the model scores at the threshold or above, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def keep(texts: list[bytes | None]) -> list[bool]:
        rows = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        return (Gam(**held.value).scores(rows) >= threshold).tolist()

    return filter_texts(docs, keep)
