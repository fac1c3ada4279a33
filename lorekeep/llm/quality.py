"""Text quality by a generalised additive model with pairwise interactions.

Each feature gets a lookup table over its bins, learned by cyclic boosting: in
every round each feature in turn is given one shallow tree on the current
residuals, and the tree's leaf values are added to that feature's table.  Then
the feature pairs that explain most of what is left get small two-way tables
in the same way.  A score is a sum of looked-up bins, so scoring is a few
vectorised additions per batch, next to the pass that extracts the features.

The model is fitted on at most ``FIT_BOUND`` labelled rows (taken by hash
order, so the same at every partitioning); scoring reads every whole text.

Defined results: null and empty texts have all features zero and are scored
like any other; a very long text is scored whole; repeated rows are scored
each; rows without an id are scored and count as not held out; labels
other than 0 and 1 are ignored and a repeated label counts once, the larger
value winning.  With no usable labels, or one class only, every score is the
share of label 1 (0.5 without labels).  Other columns are left alone.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are used to fit the model.
FIT_BOUND = 20_000
FOLDS = 5
#: Scores from here on are good.
KEEP_SCORE = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "bang", "pipe", "symbol", "stop", "comma",
    "non_ascii", "distinct_words", "top_word", "same_as_last", "line_words", "distinct_lines", "caps_words",
)

_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_DIGIT, _SYMBOL = string.digits.encode(), rb"#$%&*@^~<>{}[]=+\/_`"
_ASCII = bytes(range(128))


def features(text: bytes) -> list[float]:
    """The features of one UTF-8 text, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(text), len(words)

    def share(chars: bytes) -> float:
        return (size - len(text.translate(None, chars))) / size

    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        share(_UPPER),
        share(_DIGIT),
        text.count(b"!") / n,
        text.count(b"|") / n,
        share(_SYMBOL),
        text.count(b".") / n,
        text.count(b",") / n,
        1.0 - share(_ASCII),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        n / len(lines),
        len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / n,
    ]


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t or b"") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


# --- the model -------------------------------------------------------------


@dataclass
class QualityModel:
    """An intercept, a table for each feature, and tables for some pairs of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for the rows of a feature matrix."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in self.pairs.items():
            total += table[
                np.searchsorted(self.coarse[f], x[:, f], side="right"),
                np.searchsorted(self.coarse[g], x[:, g], side="right"),
            ]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))


def _best_cut(grad: np.ndarray, hess: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a row of bins; gain 0 if none helps."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    all_g, all_h = grad.sum(), hess.sum()
    gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
    gain = np.where((h >= least) & (all_h - h >= least), gain, 0.0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of a tree that is grown best cut first."""
    spans = [(0, len(grad))]
    while len(spans) < leaves:
        gain, cut, span = max(
            (*_best_cut(grad[a:b], hess[a:b], ridge, least), (a, b)) for a, b in spans
        )
        if gain <= 0:
            break
        spans.remove(span)
        spans += [(span[0], span[0] + cut), (span[0] + cut, span[1])]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of one axis whose sides are each cut along the other axis."""
    best = (0.0, np.zeros_like(grad))
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for at in range(1, len(g)):
            values, gain = np.zeros_like(g), -whole
            for side in (slice(0, at), slice(at, None)):
                gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
                if hs.sum() < least:
                    break
                extra, cut = _best_cut(gs, hs, ridge, least)
                gain += gs.sum() ** 2 / (hs.sum() + ridge) + extra
                for part in (slice(0, cut), slice(cut, None)) if extra > 0 else (slice(None),):
                    values[side, part] = gs[part].sum() / (hs[part].sum() + ridge)
            else:
                if gain > best[0]:
                    best = (gain, values.T if turned else values)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1,
    bins: int = 48, pair_bins: int = 8, leaves: int = 3, ridge: float = 1.0, least: float = 2.0,
) -> QualityModel:
    """Fit on a feature matrix and 0/1 labels; deterministic."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return QualityModel(float(np.log((share * 1e6 + 1) / ((1 - share) * 1e6 + 1))))
    model = QualityModel(float(np.log(share / (1 - share))))
    model.edges = [_edges(c, bins) for c in x.T]
    model.coarse = [_edges(c, pair_bins) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T, strict=True)]
    total = np.full(len(y), model.intercept)

    def slopes(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))
        return np.bincount(cells, y - p, n), np.bincount(cells, p * (1 - p), n)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) > 1:
                step = rate * _tree(*slopes(fine[f], len(table)), leaves, ridge, least)
                table += step
                total += step[fine[f]]

    def grid(f: int, g: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)
        return coarse[f] * shape[1] + coarse[g], shape

    ranked = []
    for f, g in combinations(range(x.shape[1]), 2):
        cells, shape = grid(f, g)
        if min(shape) > 1:
            grad, hess = slopes(cells, shape[0] * shape[1])
            ranked.append((_pair_tree(grad.reshape(shape), hess.reshape(shape), ridge, least)[0], f, g))
    for gain, f, g in sorted(ranked, key=lambda r: (-r[0], r[1:]))[:n_pairs]:
        if gain > 0:
            model.pairs[f, g] = np.zeros(grid(f, g)[1])
    for _ in range(pair_rounds):
        for (f, g), table in model.pairs.items():
            cells, shape = grid(f, g)
            grad, hess = slopes(cells, shape[0] * shape[1])
            step = rate * _pair_tree(grad.reshape(shape), hess.reshape(shape), ridge, least)[1]
            table += step
            total += step.ravel()[cells]
    return model


# --- on DataFrames ---------------------------------------------------------


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    bound: int = FIT_BOUND,
) -> QualityModel:
    """Learn from labelled rows outside fold 0, at most ``bound`` of them."""
    usable = (
        labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(label_col).cast("double").alias("y"))
    )
    # The smallest hashes, so the choice doesn't depend on partitions; at most ``bound`` rows of 16 bytes.
    sample = F.broadcast(usable.orderBy(F.xxhash64("id"), "id").limit(bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(2).cast(pa.large_binary()).to_pylist())
            rows = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(sample, "id").select("id", "y", "text").mapInArrow(run, "id long, y double, x array<double>")
    # A document that is there more than once counts once, so no more than ``bound`` rows arrive.
    got = rows.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.y", "r.x").toPandas()
    got = got.sort_values("id")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(1).cast(pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(at).cast(pa.large_binary()).to_pylist())
            yield batch.filter(pa.array(shared.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
