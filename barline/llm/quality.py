"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers of a text are put into bins. Boosting goes round the features in turn, each time fitting a shallow tree to one
binned feature and adding it to that feature's table; then round the best pairs. A score is the sigmoid of a sum of table
entries, so that scoring is a bin look-up and an addition for each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import kernels
from barline.llm.scratch import cut

#: Labelled rows that training takes at most: those of least hash of their id.
TRAIN_ROWS = 20_000
FEATURES = ("log_words", "upper", "digits", "symbols", "exclamations", "bars", "stops", "lines", "word_length", "repetition", "vocabulary", "wide", "marked_words")

_KIND = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 exclamation, 5 bar, 6 stop, 7 line end, 8 space, 9 first byte of a wide character, 10 its rest
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[33], _KIND[124], _KIND[10] = 4, 5, 7
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
_KIND[kernels.SPACE] = 8
_KIND[10] = 7
_KIND[0xC0:], _KIND[0x80:0xC0] = 9, 10
KINDS = 11


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The numbers of FEATURES for each row; of an empty row all are 0."""
    rows = len(off) - 1
    kind = _KIND[buf]
    counts = np.bincount(np.repeat(np.arange(rows) * KINDS, np.diff(off)) + kind, minlength=rows * KINDS).reshape(rows, KINDS)
    start, end, before = kernels.word_spans(buf, off)
    words = np.diff(before)
    hashes = kernels.word_hashes(buf, start)
    # a word that ends in a symbol, a bar or an exclamation mark
    marked = np.add.reduceat(np.append(np.isin(kind[end - 1], (3, 4, 5)), False).astype(np.int64), np.minimum(before[:-1], len(end))) * (words > 0)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)], float).reshape(rows)
    shingle = np.array([len(s) for s in kernels.shingles(buf, off)], float).reshape(rows)
    w, n = np.maximum(words, 1), np.maximum(np.diff(off), 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 9], 1)
    out = np.column_stack(
        [
            np.log1p(words), counts[:, 1] / letters, counts[:, 2] / n, counts[:, 3] / n, counts[:, 4] / w, counts[:, 5] / w, counts[:, 6] / w, counts[:, 7] / w,
            (n - counts[:, 7] - counts[:, 8]) / w, shingle / np.maximum(words - 4, 1), distinct / w**0.8, counts[:, 9] / n, marked / w,
        ]
    )
    out[np.diff(off) == 0] = 0
    return out


@dataclass
class Model:
    """edges: inner bin borders of each feature; pairs and their coarser edges; tables by feature and by pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    planes: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.planes, strict=True):
            total += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a tree of that depth on ordered bins, from each bin's gradient and curvature."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)
    return out


def _plane(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps of the best cross of one border on each axis, and its gain."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ga, gb = a[-1, -1], b[-1, -1]
    quads = [(a, b), (a[:, -1:] - a, b[:, -1:] - b), (a[-1:] - a, b[-1:] - b), (ga - a[:, -1:] - a[-1:] + a, gb - b[:, -1:] - b[-1:] + b)]
    gain = sum(x**2 / (y + ridge) for x, y in quads)[:-1, :-1]
    out = np.zeros_like(g)
    if not gain.size:
        return out, 0.0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    for (x, y), at in zip(quads, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        out[at] = x[i, j] / (y[i, j] + ridge)
    return out, float(gain[i, j] - ga**2 / (gb + ridge))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1, bins: int = 32, pairs: int = 6) -> Model:
    """Cyclic boosting of the log-odds of y (0 or 1). No rows, or one class: the constant (rows + 1 class counts)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    width = x.shape[1]
    borders = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) if len(x) else np.zeros(0) for j in range(width)]
    model = Model(float(np.log(share / (1 - share))), borders(bins), [], borders(8), [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(x) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)
    state = lambda: ((p := 1 / (1 + np.exp(-total))), y - p, p * (1 - p))[1:]
    for _ in range(rounds):
        for j in range(width):
            g, h = state()
            n = len(model.tables[j])
            step = rate * np.clip(_tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), 2), -3, 3)
            model.tables[j] += step
            total += step[at[j]]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(rough[i] * b + rough[j], v, a * b).reshape(a, b)

    g, h = state()
    found = sorted(((_plane(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)[:pairs]
    model.pairs = [(i, j) for gain, i, j in found if gain > 0]
    model.planes = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = state()
            step = rate * np.clip(_plane(grid(i, j, g), grid(i, j, h))[0], -3, 3)
            model.planes[k] += step
            total += step[rough[i], rough[j]]
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = kernels.byte_view(batch.column(1))
        for a, b in kernels.slices(off):
            x = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "x": lists})


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, any more columns).

    labels (doc_id, quality 0 or 1): learned from where crc32(doc_id as text) mod 5 is not 0 and both are there, at most
    train_rows of them, those of least hash of their id; of several labels for a doc_id the least. Only the text enters a
    score. Null and empty texts have a score like any other. A null doc_id is not held out. Without labels the score is 0.5.
    """
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    measured = cut(docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>"), "features")
    known = labels.where(~out & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = measured.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(train_rows).select("x", "y").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    model = fit(x, rows.column("y").to_numpy().astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(model.score(values))})

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
