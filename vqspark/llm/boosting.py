"""Gradient-boosted trees for two classes, from sums over all rows: in numpy for arrays, as Spark passes for tables.

Values are told apart at the bounds of a fixed grid; a column's cuts are the quantiles of all its values on that grid. Rows
that are alike by their cuts are one row with a weight. A level of all trees takes one pass that sums gradients by node,
column and bin, as whole numbers: the same rows give the same trees, however they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 5
INNER = 2**DEPTH - 1
#: Whole numbers up to 512, 512ths up to 1, and an eighth of a power of two above.
GRID = np.r_[np.arange(512) / 512, np.arange(1, 512), 512 * 2 ** (np.arange(8 * 54) / 8)]
#: Gradients count in this fraction, probabilities of thresholds in that one.
FINE, STEPS = 1 << 24, 1 << 16
#: Trees after which the rows' scores are written, and tasks whose sums the driver adds up itself.
WRITTEN, DIRECT = 8, 32


@dataclass
class Trees:
    """Full trees by level: node k has children 2k + 1 (at most the cut) and 2k + 2."""

    base: float = 0.0
    columns: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Scores by the trees from the given one on; the base counts with the first."""
        total = np.full(len(x), 0.0 if first else self.base)
        for k in range(first, len(self.leaves)):
            total += self.leaves[k][self.node(x, k, DEPTH) - INNER]
        return total

    def node(self, x: np.ndarray, k: int, depth: int) -> np.ndarray:
        """The rows' nodes in a tree, so many levels down; a tree that is still growing has no leaves yet."""
        rows = np.arange(len(x))
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.columns[k][node]] > self.cuts[k][node])
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.raw(x))


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def cells(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(GRID, x, side="left").astype("<u2")


def quantile_cells(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of a column's different cells in order with their counts: all, if they are few, else the last ones of equal parts."""
    if len(cell) <= BINS:
        return cell[:-1]
    ranks = np.linspace(0, 1, BINS + 1)[1:-1] * n.sum()
    return np.unique(cell[np.searchsorted(np.cumsum(n), ranks)])


def bins(cell: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, cell[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def gradients(model: Trees, x: np.ndarray, y: np.ndarray, n: np.ndarray, level: int, raw: np.ndarray) -> np.ndarray:
    """Sums by node of a level, column and bin of gradient, its slope and rows; `raw` is the score of the trees before."""
    p = _logistic(raw)
    weights = [np.rint((p - y) * FINE) * n, np.rint(p * (1 - p) * FINE) * n, n]
    node = (model.node(x, len(model.leaves), level) - (2**level - 1)) * BINS
    out = np.empty((2**level, x.shape[1], BINS, 3), dtype=np.int64)
    for j in range(x.shape[1]):
        for k, w in enumerate(weights):
            out[:, j, :, k] = np.bincount(node + x[:, j], w, 2**level * BINS).reshape(-1, BINS)
    return out


def grow(counts: list[tuple[int, int]], cut: list[int], sums: Callable[[list[Trees], int], list[np.ndarray]]) -> list[Trees]:
    """Newton boosting on the logistic loss: one model for each pair of numbers of rows and of hits, with bins for cuts.

    `cut` has each column's number of cuts; `sums` gives the sums of a level for all models. Models of one class stay bare.
    """
    models = []
    for n, hits in counts:
        mean = (hits + 1) / (n + 2)
        models.append(Trees(base=float(np.log(mean / (1 - mean)))))
    learning = [k for k, (n, hits) in enumerate(counts) if 0 < hits < n]
    for _ in range(TREES if learning else 0):
        for m in (models[k] for k in learning):
            m.columns.append(np.zeros(INNER, dtype=np.int64))
            m.cuts.append(np.full(INNER, np.inf))
        for level in range(DEPTH):
            found = sums(models, level)
            for k in learning:
                leaves = _level(models[k], found[k], level, cut)
                if level == DEPTH - 1:
                    models[k].leaves.append(leaves)
    return models


def _level(model: Trees, sums: np.ndarray, level: int, cut: list[int]) -> np.ndarray:
    """Cuts the nodes of a level and returns the values of what they are cut into."""
    values = np.empty(2 * len(sums))
    for k, s in enumerate(sums):
        whole = s[0].sum(axis=0)
        left = s.cumsum(axis=1)[:, :-1]
        right = whole - left
        gain = sum((side[..., 0] / FINE) ** 2 / (side[..., 1] / FINE + 1) for side in (left, right)) - (whole[0] / FINE) ** 2 / (whole[1] / FINE + 1)
        gain[(left[..., 2] < LEAST) | (right[..., 2] < LEAST) | (np.arange(BINS - 1) >= np.array(cut)[:, None])] = 0
        j, b = divmod(int(gain.argmax()), BINS - 1)
        sides = [whole, np.zeros_like(whole)]
        if gain[j, b] > 1e-6:
            model.columns[-1][len(sums) - 1 + k], model.cuts[-1][len(sums) - 1 + k] = j, b
            sides = [left[j, b], right[j, b]]
        values[2 * k : 2 * k + 2] = [-side[0] / (side[1] + FINE) * RATE for side in sides]
    return values


def valued(model: Trees, edges: list[np.ndarray]) -> Trees:
    """A model over bins as one over values."""
    cuts = [np.array([GRID[min(edges[j][int(b)], len(GRID) - 1)] if np.isfinite(b) else b for j, b in zip(*pair, strict=True)]) for pair in zip(model.columns, model.cuts, strict=True)]
    return Trees(model.base, model.columns, cuts, model.leaves)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Trees:
    """Trees of rows in memory, with weights if given."""
    n = np.ones(len(y), dtype=np.int64) if n is None else n
    cell = cells(x)
    edges = []
    for column in cell.T:
        value, at = np.unique(column, return_inverse=True)
        edges.append(quantile_cells(value, np.bincount(at, n)))
    binned = bins(cell, edges)
    raw: dict = {}

    def sums(models: list[Trees], level: int) -> list[np.ndarray]:
        done = len(models[0].leaves)
        if done not in raw:
            raw.update({done: models[0].raw(binned)})
        return [gradients(models[0], binned, y, n, level, raw[done])]

    return valued(grow([(int(n.sum()), int(n[y == 1].sum()))], [len(e) for e in edges], sums)[0], edges)


def fit_table(rows: DataFrame, width: int, folds: int) -> tuple[Trees, DataFrame]:
    """Trees of all rows, and how many of each group reach each probability by trees that haven't seen their fold.

    `rows` has fold and y (integers), kind (an integer, the group), cells (16-bit numbers of `width` columns) and n, the
    weight. The second result has kind, step (of 1 / STEPS), n and hits.
    """
    rows = durable(rows.groupBy("fold", "y", "kind", "cells").agg(F.sum("n").alias("n")))
    edges = _edges(rows, width)
    key = ("fold", "y", "kind", "bins")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = bins(_matrix(batch.column("cells"), width, "<u2"), edges)
                yield pa.record_batch([*(batch.column(k) for k in key[:3]), pa.array([r.tobytes() for r in found], pa.binary()), batch.column("n")], names=[*key, "n"])

    alike = durable(rows.mapInArrow(binned, "fold int, y int, kind int, bins binary, n bigint").groupBy(*key).agg(F.sum("n").alias("n")))
    totals = {r.fold: (r.n, r.hits) for r in alike.groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("hits")).collect()}
    counts = [tuple(sum(v[i] for f, v in totals.items() if f != k) for i in (0, 1)) for k in range(folds + 1)]
    held = alike.withColumn("raw", F.lit(None).cast("array<double>"))
    written = 0

    def sums(models: list[Trees], level: int) -> list[np.ndarray]:
        nonlocal held, written
        done = max(len(m.leaves) for m in models)
        if not level and done >= written + WRITTEN:
            held, written = durable(held.mapInArrow(_scores(models, width, written), held.schema)), done
        parts = held.mapInArrow(_sums(models, width, written, level), "cell int, g bigint, h bigint, n bigint")
        if held.rdd.getNumPartitions() > DIRECT:
            parts = parts.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n")))
        out = np.zeros((len(models) * 2**level * width * BINS, 3), dtype=np.int64)
        found = parts.toArrow()
        np.add.at(out, found.column("cell").to_numpy(), np.stack([found.column(c).to_numpy() for c in ("g", "h", "n")], axis=1))
        return list(out.reshape(len(models), 2**level, width, BINS, 3))

    models = grow(counts, [len(e) for e in edges], sums)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, fold = _matrix(batch.column("bins"), width), batch.column("fold").to_numpy()
                p = np.zeros(len(x))
                for k in range(folds):
                    if (fold == k).any():
                        p[fold == k] = models[k].probability(x[fold == k])
                n = batch.column("n").to_numpy()
                yield pa.record_batch([batch.column("kind"), pa.array((p * STEPS).astype(np.int32)), pa.array(n), pa.array(n * batch.column("y").to_numpy())], names=["kind", "step", "n", "hits"])

    steps = alike.mapInArrow(reached, "kind int, step int, n bigint, hits bigint").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return valued(models[-1], edges), steps


def _matrix(column: pa.Array, width: int, kind: str = "u1") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Cuts by column, from the counts of all cells: the grid bounds what comes to the driver."""
    size = len(GRID) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                at = _matrix(batch.column("cells"), width, "<u2") + np.arange(width) * size
                np.add.at(total, at, batch.column("n").to_numpy()[:, None])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    found = rows.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(width * size, dtype=np.int64)
    n[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return [quantile_cells(np.flatnonzero(c), c[c > 0]) for c in n.reshape(width, size)]


def _raw(batch: pa.RecordBatch, x: np.ndarray, models: list[Trees], written: int) -> np.ndarray:
    """Scores by all models; those of the trees up to `written` come with the rows."""
    new = np.stack([m.raw(x, written) for m in models], axis=1)
    return new + batch.column("raw").flatten().to_numpy().reshape(new.shape) if written else new


def _scores(models: list[Trees], width: int, written: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = _raw(batch, _matrix(batch.column("bins"), width), models, written)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * len(models)), pa.array(raw.reshape(-1)))
                yield pa.record_batch([*batch.columns[:-1], lists], names=batch.schema.names)

    return work


def _sums(models: list[Trees], width: int, written: int, level: int):  # noqa: ANN202
    """A task's sums for all models: of the model of a fold without that fold's rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 2**level, width, BINS, 3), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("bins"), width)
            fold, y, n = (batch.column(c).to_numpy() for c in ("fold", "y", "n"))
            raw = _raw(batch, x, models, written)
            for k, m in enumerate(models):
                if len(m.columns) > len(m.leaves):
                    use = np.flatnonzero(fold != k)
                    total[k] += gradients(m, x[use], y[use], n[use], level, raw[use, k])
        total = total.reshape(-1, 3)
        at = np.flatnonzero(total[:, 2])
        yield pa.record_batch([pa.array(at.astype(np.int32)), *(pa.array(total[at, c]) for c in range(3))], names=["cell", "g", "h", "n"])

    return work


def threshold(probability: np.ndarray, truth: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The lowest probability above which the held-back precision (with half a miss assumed) is reached; over 1 if none is.

    With `n`, an entry stands for so many rows, `truth` of which are hits.
    """
    order = np.argsort(-probability, kind="stable")
    p, hit = probability[order], np.cumsum(truth[order])
    good = hit / (np.cumsum((np.ones(len(p)) if n is None else n)[order]) + 0.5) >= precision
    good &= np.r_[p[1:] != p[:-1], True] if len(p) else good
    return float(p[np.flatnonzero(good)[-1]]) if good.any() else 2.0
