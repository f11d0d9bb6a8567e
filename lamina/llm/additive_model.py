"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned by quantiles.  Cyclic boosting visits one feature after another and adds a small step of a shallow tree over that
feature's bins to its lookup table; then the pairs with the largest interaction gain get tables of their own in the same way, from
trees with one cut in each feature.  A score is the logistic of the intercept plus one table cell for each feature and pair, so a batch is
scored by a few vectorised lookups.  Every table can be read as a curve or a heat map.

Without labels every score is 0.5; with labels of one class it is that class's smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import arrow_text as at
from lamina.llm import labelled
from lamina.llm.common import bounded, held_out
from lamina.llm.text_stats import fresh, statistics

BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2 = 32, 8, 120, 40, 6, 0.1, 5.0
#: A text with at least this score is predicted to have label 1.
THRESHOLD = 0.7


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between quantiles; equal values never part."""
    u = np.unique(v)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return g / (h + L2)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of the tree with at most 2**depth leaves over the ordered bins."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + L2) + gr**2 / (hr + L2)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + L2) + 1e-12:
        return out
    out[:k], out[k:] = _shallow_tree(g[:k], h[:k], depth - 1), _shallow_tree(g[k:], h[k:], depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree with one cut in each of the two features."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, c_h = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = cg[-1, -1] - a - b - c, ch[-1, -1] - ah - bh - c_h
    gain = sum(x**2 / (y + L2) for x, y in ((a, ah), (b, bh), (c, c_h), (d, dh)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    t = np.empty_like(g)
    t[: i + 1, : j + 1], t[: i + 1, j + 1 :] = _leaf(a[i, j], ah[i, j]), _leaf(b[i, j], bh[i, j])
    t[i + 1 :, : j + 1], t[i + 1 :, j + 1 :] = _leaf(c[i, j], c_h[i, j]), _leaf(d[i, j], dh[i, j])
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + L2)), t


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """x: features by row, y: labels 0 or 1."""
    if not len(x):
        return AdditiveModel(0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    f = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(f)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(x), model.intercept)

    def grad() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(f):
            g, h = grad()
            n = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            z += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(f)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[a] * size[b] + coarse[b]
        g, h = grad()
        return cell, np.bincount(cell, g, size[a] * size[b]).reshape(size[a], size[b]), np.bincount(cell, h, size[a] * size[b]).reshape(size[a], size[b])

    ranked = sorted(((_quadrants(*grids(a, b)[1:])[0], a, b) for a in range(f) for b in range(a + 1, f)), key=lambda r: (-r[0], r[1], r[2]))
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(model.pairs):
            cell, g, h = grids(a, b)
            step = RATE * _quadrants(g, h)[1]
            model.pair_tables[i] += step
            z += step.ravel()[cell]
    return model


def scored(docs: DataFrame, model: AdditiveModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1 as its last column, with underscores before its name where docs has it.

    Narrow; the model, a few KB, travels with the task."""
    bounded(docs.sparkSession)
    name = fresh(docs, name)

    def run(batches):
        for batch in batches:
            stats = statistics(at.column(batch, text_col))
            x = np.column_stack([stats[c] for c in labelled.FEATURES]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)]))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of documents; null and empty texts are scored as texts without words."""
    model = fit(*labelled.sample(documents, labels))
    out = scored(documents.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id"), labelled.FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
