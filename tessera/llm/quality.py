"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text's surface (shares of character classes, repetition, lengths) are cut into
quantile bins. Cyclic boosting takes the features in turn, and adds to the feature's lookup table a
small step of a shallow tree's fit to the residuals over its bins; then the pairs of features that
best explain what is left get tables of their own, boosted by shallow trees that split either feature. A score is the logistic of
a sum of table look-ups, done for a batch at a time.

The model is fitted on at most FIT_ROWS labelled documents, chosen by a hash of their id: the bound on
what comes to the driver. Everything else runs over all documents, map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, table, tidy, utf8

FIT_ROWS, BINS, PAIR_BINS = 20_000, 48, 8
FEATURES = ["log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper", "lower", "digit", "high", "comma_stop", "inner_punct", "symbol", "pipe", "mark", "newline", "space_run", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "upper_words", "symbol_words", "line_bytes", "entropy"]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)), b",.", b";:'\"()-", b"#$%&*+<=>@^_`~\\/[]{}", b"|", b"!?", b"\n"], 1):
    _CLASS[list(_chars)] = _i


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text's are all 0."""
    out = np.zeros((len(texts), len(FEATURES)))
    w = Words(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    kind = _CLASS[raw]
    doc_of_byte = np.repeat(np.arange(len(texts)), sizes + 1)
    counts = np.bincount(doc_of_byte * 16 + kind, minlength=16 * len(texts)).reshape(-1, 16)
    lengths = w.ends - w.starts
    n_words = np.diff(w.bounds)
    doc_of_word = np.repeat(np.arange(len(texts)), n_words)

    def per_doc(values) -> np.ndarray:
        return np.bincount(doc_of_word, values, len(texts))

    has = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (1, 2, 6)]
    ups, lows, marks = (c[w.ends] - c[w.starts] for c in has)
    size, n = np.maximum(sizes, 1), np.maximum(n_words, 1)
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(n_words)
    out[:, 2] = per_doc(lengths) / n
    out[:, 3], out[:, 4] = per_doc(lengths > 14) / n, per_doc(lengths <= 2) / n
    out[:, 5:15] = counts[:, 1:11] / size[:, None]
    out[:, 15] = np.maximum(sizes - per_doc(lengths) - n_words + 1, 0) / size
    out[:, 20], out[:, 21] = per_doc((ups >= 2) & (lows == 0)) / n, per_doc(marks > 0) / n
    lines = counts[:, 10] + 1
    out[:, 22] = np.log1p(sizes / lines)
    for i, t in enumerate(texts):
        a, b = w.bounds[i], w.bounds[i + 1]
        if a == b:
            out[i] = 0
            continue
        h, many = np.unique(w.hash[a:b], return_counts=True)
        out[i, 16], out[i, 17] = len(h) / (b - a), many.max() / (b - a)
        pairs = w.hash[a : b - 1] * np.uint64(3) + w.hash[a + 1 : b]
        out[i, 18] = len(np.unique(pairs)) / max(1, len(pairs))
        each = t.split(b"\n")
        out[i, 19] = len(set(each)) / len(each)
        p = counts[i, :11] / counts[i, :11].sum()
        out[i, 23] = -(p[p > 0] * np.log(p[p > 0])).sum()
    return out


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values of a shallow regression tree over ordered bins: best splits one after the other."""
    cuts, n = [0, len(gradient)], len(gradient)
    least = min(5.0, 0.05 * weight.sum())  # of the weight, in a leaf
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        s = np.arange(a + 1, b)
        left, right = w[s] - w[a], w[b] - w[s]
        v = (g[s] - g[a]) ** 2 / (left + 1) + (g[b] - g[s]) ** 2 / (right + 1) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
        v = np.where((left >= least) & (right >= least), v, 0)
        i = int(v.argmax())
        return float(v[i]), int(s[i])

    while len(cuts) <= leaves:
        best = max((gain(a, b) for a, b in zip(cuts, cuts[1:], strict=False)), default=(0.0, 0))
        if best[0] <= 0:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(n)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The values of a shallow regression tree over a grid of two features' bins: the best splits, of either, one after the other."""
    least = min(5.0, 0.05 * weight.sum())
    whole = (0, gradient.shape[0], 0, gradient.shape[1])

    def sums(r: tuple[int, int, int, int]) -> tuple[float, float]:
        return gradient[r[0] : r[1], r[2] : r[3]].sum(), weight[r[0] : r[1], r[2] : r[3]].sum()

    def best(r: tuple[int, int, int, int]) -> tuple:
        g, w = sums(r)
        found = (0.0, r, r)
        for axis in (0, 1):
            a, z = r[2 * axis : 2 * axis + 2]
            gl, wl = (np.cumsum(x[r[0] : r[1], r[2] : r[3]].sum(1 - axis))[:-1] for x in (gradient, weight))
            v = gl**2 / (wl + 1) + (g - gl) ** 2 / (w - wl + 1) - g**2 / (w + 1)
            v = np.where((wl >= least) & (w - wl >= least), v, 0)
            if len(v) and v.max() > found[0]:
                at = a + 1 + int(v.argmax())
                low, high = list(r), list(r)
                low[2 * axis + 1], high[2 * axis] = at, at
                found = (float(v.max()), tuple(low), tuple(high))
        return found

    parts = [whole]
    while len(parts) < leaves:
        splits = [best(r) for r in parts]
        k = max(range(len(parts)), key=lambda i: splits[i][0])
        if splits[k][0] <= 0:
            break
        parts[k : k + 1] = splits[k][1:]
    out = np.zeros(gradient.shape)
    for r in parts:
        g, w = sums(r)
        out[r[0] : r[1], r[2] : r[3]] = g / (w + 1)
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: bin look-ups, added up."""
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for a, b, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1) -> Model:
    """Boost the tables of single features, then those of the n_pairs best pairs. Without both labels: the share of 1."""

    def edges(bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)

    e, pe = edges(BINS), edges(PAIR_BINS)
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = Model(e, float(np.log(share / (1 - share))), [np.zeros(len(k) + 1) for k in e], pe)
    if not 0 < y.sum() < len(y):
        return m
    bins = [np.searchsorted(k, c, side="right") for k, c in zip(e, x.T, strict=True)]
    z = np.full(len(y), m.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-3)

    for _ in range(rounds):
        for k, b in enumerate(bins):
            r, h = residual()
            n = len(m.tables[k])
            step = rate * np.clip(_tree(np.bincount(b, r, n), np.bincount(b, h, n)), -4, 4)
            m.tables[k] += step
            z += step[b]
    coarse = [np.searchsorted(k, c, side="right") for k, c in zip(pe, x.T, strict=True)]
    r, h = residual()
    found = []
    for a in range(len(pe)):
        for b in range(a + 1, len(pe)):
            n = (len(pe[a]) + 1) * (len(pe[b]) + 1)
            cell = coarse[a] * (len(pe[b]) + 1) + coarse[b]
            g, w = np.bincount(cell, r, n), np.bincount(cell, h, n)
            found.append((float((g**2 / (w + 5)).sum()), a, b))
    for _, a, b in sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:n_pairs]:
        m.pairs.append((a, b, np.zeros((len(pe[a]) + 1, len(pe[b]) + 1))))
    for _ in range(pair_rounds):
        for a, b, t in m.pairs:
            r, h = residual()
            cell = coarse[a] * t.shape[1] + coarse[b]
            step = rate * np.clip(_pair_tree(np.bincount(cell, r, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape)), -4, 4)
            t += step
            z += step.ravel()[cell]
    return m


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _features(texts: DataFrame, keys: str) -> DataFrame:
    """(key, text) -> (key, x): the features, as an array."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column(1))
            x = np.concatenate([features(texts[i:j]) for i, j in slices(texts)]) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=[keys.split()[0], "x"])

    return texts.mapInArrow(tidy(run), f"{keys}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", fold: int | None = 1) -> Model:
    """Fit on labelled documents whose crc32(doc_id) mod 3 isn't `fold` (None: on all).

    Rows with a null label or id are passed over. Of more than fit_rows labelled rows those with the
    smallest hashes of their id are taken. Ids that are repeated with different labels count with each.
    """
    y = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    if fold is not None:
        y = y.where(remainder(F.col("_id")) != fold)
    n = y.count()
    if n > fit_rows:
        y = y.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = _features(d.join(y, "_id").select(F.struct("_id", "_y").alias("k"), "text"), "k struct<_id:bigint,_y:int>").select("k._id", "k._y", "x").limit(2 * fit_rows).toArrow()
    order = np.lexsort((rows["_y"].to_numpy(), rows["_id"].to_numpy()))
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit(x, rows["_y"].to_numpy().astype(float)[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row; null texts score as empty ones. Nothing but the text enters a score.

    Equal texts score alike, repeated rows stay, an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column(1))
            s = [shared.value.score(features(texts[i:j])) for i, j in slices(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(tidy(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose text scores `least` or more (a null text as an empty one; repeated rows alike)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column(place))
            s = [shared.value.score(features(texts[i:j])) for i, j in slices(texts)]
            yield b.filter(pa.array(np.concatenate(s) >= least)) if s else b

    return docs.mapInArrow(tidy(run), docs.schema)


def op6_additive_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
