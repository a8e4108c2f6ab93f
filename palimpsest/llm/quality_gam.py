"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting: round after round, each feature in turn gets one shallow tree on its
bins, added with a small step to that feature's lookup table; afterwards the strongest feature
pairs get two-dimensional tables the same way. Scoring is bin lookup and addition.

Only the fit uses a sample: at most ``max_rows`` labelled rows, the lowest by a hash of doc_id.
Every document is scored, on its whole text. Features come from the text alone.

Defined results: a null or empty text has all-zero features and a score like any other; label
rows with a null quality are ignored; with no usable label, or one class only, every score is the
training share of label 1 (0.5 without labels); repeated documents get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .measures import measure
from .text import Texts, chunks

FEATURES = ("log_words", "word_length", "symbols", "bangs", "pipes", "digits", "upper", "high", "stops", "unique", "duplicate_lines", "repeats", "line_words", "capitals", "longest_word")


def features(t: Texts) -> np.ndarray:
    """One row of ``FEATURES`` per document (float64)."""
    m = measure(t)
    words, size, lines = (np.maximum(m[k], 1).astype(float) for k in ("n_words", "n_bytes", "n_lines"))
    columns = [
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_bangs"] / words, m["n_pipes"] / words, m["n_digits"] / size,
        m["n_upper"] / np.maximum(m["n_upper"] + m["n_lower"], 1), m["n_high"] / size, m["n_stops"] / words, m["n_unique"] / words,
        m["n_dup_lines"] / lines, m["n_repeat_words"] / words, np.log1p(words / lines), m["n_capital"] / words, np.log1p(m["longest_word"]),
    ]
    return np.column_stack(columns)


@dataclass
class Gam:
    """Lookup tables: ``main[f][bin]`` and ``pairs[k] = (f, g, table[bin, bin])`` on the log-odds scale."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    main: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        z = np.full(len(x), self.bias)
        for f, (cut, table) in enumerate(zip(self.cuts, self.main, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], "right")]
        for f, g, table in self.pairs:
            z += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges, midway between neighbouring values near the quantiles."""
    u = np.unique(v)
    if len(u) < 2:
        return np.empty(0)
    at = np.unique(np.searchsorted(u, np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])).clip(1, len(u) - 1))
    return (u[at - 1] + u[at]) / 2


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Newton step of each bin by a tree of ``depth`` over ordered bins with gradient and Hessian sums."""
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge)
        k = int(np.argmax(gain))
        if gain[k] > g.sum() ** 2 / (h.sum() + ridge) + 1e-12:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, ridge), _tree(g[k + 1 :], h[k + 1 :], depth - 1, ridge)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Best two-cut tree (four quadrants) on a grid: Newton steps and gain."""
    n, m = g.shape
    ca, cb = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, cut = -1.0, None
    part = lambda c: (q := c[:-1, :-1], c[:-1, -1:] - q, c[-1:, :-1] - q, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + q)
    gain = sum(a * a / (b + ridge) for a, b in zip(part(ca), part(cb), strict=True))
    if gain.size:
        cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = float(gain[cut])
    step = np.zeros((n, m))
    if cut is not None:
        i, j = cut[0] + 1, cut[1] + 1
        for rows in (slice(0, i), slice(i, n)):
            for cols in (slice(0, j), slice(j, m)):
                step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return step, best


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, grid: int = 8, rounds: int = 150, pair_rounds: int = 50, n_pairs: int = 8, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """Fit the tables by cyclic boosting of depth-2 trees on the logistic loss."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Gam(float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    n_features = x.shape[1]
    model = Gam(float(np.log(y.mean() / (1 - y.mean()))), [_cuts(x[:, f], bins) for f in range(n_features)])
    model.main = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            g, h = slopes()
            k = len(model.main[f])
            step = rate * _tree(np.bincount(b, g, k), np.bincount(b, h, k), 2, ridge)
            model.main[f] += step
            z += step[b]
    model.coarse = [_cuts(x[:, f], grid) for f in range(n_features)]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse)]
    g, h = slopes()

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell = coarse[i] * shape[1] + coarse[j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((-_cross(*sums(i, j), ridge)[1], i, j) for i in range(n_features) for j in range(i)))
    chosen = [(i, j) for _, i, j in ranked[:n_pairs]]
    tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), table in zip(chosen, tables, strict=True):
            g, h = slopes()
            step = rate * _cross(*sums(i, j), ridge)[0]
            table += step
            z += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, t) for (i, j), t in zip(chosen, tables, strict=True)]
    return model


def is_held_out(doc_id: str = "doc_id"):
    """The fixed fold that no fit sees: crc32 of the decimal doc_id is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Gam:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold (the driver gets only their features)."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
        .select("doc_id", F.col("quality").cast("double").alias("quality")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # of a doc_id that repeats, the text with the least hash is learnt from
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in chunks(b.column(2)):
                x = features(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, schema).toArrow()
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    x = got.column(2).combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(order) else np.empty((0, len(FEATURES)))
    return fit(x[order], got.column(1).to_numpy()[order])


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in chunks(b.column(2)):
                s = model.score(features(t))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(run, schema)
