"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; a lookup table gives each bin a value, and a few more tables
give one to each pair of bins of two features that interact. Tables are learnt by cyclic boosting:
rounds over all features, in each step a tree of a few leaves on one feature is added to its table;
then the same over the pairs that the residuals speak for most. A score is the logistic of a sum of
table entries. Fitting takes a bounded sample of labelled rows; scoring is one pass over the texts.

Defined cases
- null or empty text: all features zero; it gets a score like any other.
- Null doc_id: never held out. Labels that are null or neither 0 nor 1 are not used; a document with
  both labels counts once for each, and one with several texts by the text of the least hash. No labels of
  both kinds: the score is the share of ones (0.5 without any label). Repeated rows: a result each. Empty
  table: no rows.
- Columns other than doc_id and text are not read; ``accepted`` passes them through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: At most so many labels are used to fit the model (those of the smallest hashes of doc_id).
SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS = 32, 200, 60, 6
RATE, SMOOTH = 0.1, 1.0

FEATURES = (
    "words", "word_bytes", "upper", "symbols", "digits", "line_feeds", "stops", "not_ascii", "distinct_words",
    "top_word", "repeated_lines", "short_words", "marked_words", "top_byte", "entropy", "long_words",
)

_UPPER, _DIGIT, _ALPHA = np.arange(65, 91), np.arange(48, 58), np.r_[65:91, 97:123, 128:256]
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"])
_STOPS = np.frombuffer(b".,;:?", np.uint8)
_MARKS = frozenset(_SYMBOL.tolist())


def features(text: str) -> tuple[float, ...]:
    """The numbers that a score rests on, all from the text alone."""
    data = text.encode()
    words = data.split()
    if not words:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [line for line in data.split(b"\n") if line]
    n, dark = len(words), int(lengths.sum())
    share = counts / dark
    share[[9, 10, 11, 12, 13, 32]] = 0
    some = share[share > 0]
    return (
        math.log1p(n), dark / n, counts[_UPPER].sum() / max(1, counts[_ALPHA].sum()), share[_SYMBOL].sum(), share[_DIGIT].sum(), counts[10] / n,
        counts[_STOPS].sum() / n, share[128:].sum(), len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines),
        np.count_nonzero(lengths <= 3) / n, sum(k for w, k in seen.items() if w[-1] in _MARKS) / n, some.max(), float(-(some * np.log2(some)).sum()),
        np.count_nonzero(lengths > 20) / n,
    )


def table_of(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Bin edges and table of each feature, tables of pairs, and the constant."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    constant: float

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.constant)
        for k, table in enumerate(self.tables):
            total += table[at[k]]
        for i, j, table in self.pairs:
            total += table[at[i], at[j]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree of ``depth`` levels on one feature, as the step it gives each bin."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if depth and len(a):
        gain = _gain(a, b) + _gain(g.sum() - a, h.sum() - b)
        at = int(gain.argmax())
        if gain[at] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate((_tree(g[: at + 1], h[: at + 1], depth - 1), _tree(g[at + 1 :], h[at + 1 :], depth - 1)))
    return np.full(len(g), g.sum() / (h.sum() + SMOOTH))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on either feature: its gain and the step it gives each pair of bins."""
    total_g, total_h = g.sum(), h.sum()
    cg, ch = g.cumsum(0).cumsum(1)[:-1, :-1], h.cumsum(0).cumsum(1)[:-1, :-1]
    row_g, row_h = g.sum(1).cumsum()[:-1, None], h.sum(1).cumsum()[:-1, None]
    col_g, col_h = g.sum(0).cumsum()[None, :-1], h.sum(0).cumsum()[None, :-1]
    parts = [(cg, ch), (row_g - cg, row_h - ch), (col_g - cg, col_h - ch), (total_g - row_g - col_g + cg, total_h - row_h - col_h + ch)]
    gain = sum(_gain(a, b) for a, b in parts)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [a[i, j] / (b[i, j] + SMOOTH) for a, b in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - _gain(total_g, total_h)), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns the tables from features and labels of 0 and 1."""
    ones = float(y.mean()) if len(y) else 0.5
    if not len(y) or ones in (0.0, 1.0):
        return Model([], [], [], 40.0 * (2 * ones - 1))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], math.log(ones / (1 - ones)))
    at = model.bins(x)
    total = np.full(len(y), model.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)), 2)
            table += step
            total += step[at[k]]
    g, h = slopes()
    size = [len(t) for t in model.tables]
    both = {(i, j): at[i] * size[j] + at[j] for i in range(len(size)) for j in range(i + 1, len(size)) if size[i] > 1 < size[j]}
    sums = lambda i, j, v: np.bincount(both[i, j], v, size[i] * size[j]).reshape(size[i], size[j])
    ranked = sorted(both, key=lambda p: -_cross(sums(*p, g), sums(*p, h))[0])[:PAIRS]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = RATE * _cross(sums(i, j, g), sums(i, j, h))[1]
            table += step
            total += step.ravel()[both[i, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    The sample of labels is small enough to broadcast by its own bound; only its documents' features,
    not their texts, come to the driver, one row for each label."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).distinct()
    # A threshold of hashes leaves about twice the sample; the order picks the sample among those.
    rate = min(1.0, 2 * sample / max(1, known.count()))
    known = known.where(F.shiftrightunsigned(F.xxhash64("_id"), 32) <= F.lit(int(rate * 0xFFFFFFFF))).orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(table_of(batch.column(3).to_pylist())), pa.list_(pa.float64()))], ["id", "quality", "h", "x"])

    rows = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.col("_id").cast("string").alias("id"), "quality", F.xxhash64("text").alias("h"), "text")
    found = rows.mapInArrow(run, "id string, quality int, h long, x array<double>").groupBy("id", "quality").agg(F.min_by("x", F.struct("h", "x")).alias("x")).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, found["quality"].to_numpy()])  # the same model however rows arrive
    return fit(x[order], found["quality"].to_numpy(np.float64)[order])


def scorer(docs: DataFrame, model: Model):
    """``model`` as a column function of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(table_of([None if t is None else t for t in texts])))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text)."""
    score = scorer(docs, learn(docs, labels, sample))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good ones, with their columns as they are."""
    return docs.where(scorer(docs, learn(docs, labels, sample))("text") >= 0.5)
