"""Calibration by layer and side: second moments, transforms from them, schedules, samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import constants as C
from ..session import ship
from .codec import EPS, codec, lists, map_vectors, matrix, roundtrip
from .segments import channel_sums, group_rows


def static_scores(df: DataFrame, example: str, column: str = "vec", queries: DataFrame | None = None) -> DataFrame:
    """layer, side, ch, score: mean over examples of an example's mean squared activation.

    With queries (layer, the example and q) those of the key side are the queries', which is what keys are met by.
    """
    if queries is not None:
        met = queries.select("layer", example, F.lit("key").alias("side"), F.col("q").alias(column))
        df = df.filter("side <> 'key'").select("layer", example, "side", column).unionByName(met)
    sums = channel_sums(df, column, ["layer", "side", example], lambda x, _: x * x)
    each = sums.select("layer", "side", example, "ch", (F.col("total") / F.col("n")).alias("m"))
    return each.groupBy("layer", "side", "ch").agg(F.avg("m").alias("score"))


def second_moments(df: DataFrame, keys: list[str], column: str = "vec", unit: bool = True) -> DataFrame:
    """keys, i, j, value: uncentred second moments; a task sends one matrix for each key."""
    ship(df.sparkSession)
    types = dict(df.dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(column))
            if unit:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            d = x.shape[1]
            i, j = (v.reshape(-1).astype(np.int32) for v in np.meshgrid(np.arange(d), np.arange(d), indexing="ij"))
            for rows in (lambda groups: (np.flatnonzero(groups == g) for g in range(groups.max() + 1)))(group_rows(batch, keys)[1]):
                at = pa.array(np.full(d * d, rows[0]))
                yield pa.record_batch([*(batch.column(k).take(at) for k in keys), pa.array(i), pa.array(j), pa.array((x[rows].T @ x[rows]).reshape(-1)), pa.array(np.full(d * d, len(rows)))], names=[*keys, "i", "j", "part", "n"])

    sums = df.mapInArrow(partial, ", ".join(f"{k} {types[k]}" for k in keys) + ", i int, j int, part double, n bigint")
    return sums.groupBy(*keys, "i", "j").agg((F.sum("part") / F.sum("n")).alias("value"))


MERGED = 32


def covariance(df: DataFrame, keys: list[str], column: str = "vec", unit: bool = True) -> DataFrame:
    """keys, i, j, value, n: sample covariances of all pairs of coordinates (null for a single row).

    Every task keeps a count, means and centred co-moments for each key and merges what comes; tasks' results are merged in
    two levels, so that no group takes more than MERGED of them in at a time and nothing is cancelled out of large sums.
    """
    ship(df.sparkSession)
    types = dict(df.dtypes)
    state = ", ".join(f"{k} {types[k]}" for k in keys) + ", slot int, n double, mean array<double>, co array<double>"

    def merged(a: tuple, b: tuple) -> tuple:
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(column))
            if unit:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            first, at = group_rows(batch, keys)
            for g, row in enumerate(first):
                own = x[at == g]
                label = tuple(batch.column(k)[int(row)].as_py() for k in keys)
                mean = own.mean(axis=0)
                new = (float(len(own)), mean, (own - mean).T @ (own - mean))
                held[label] = merged(held[label], new) if label in held else new
        slot = TaskContext.get().partitionId()
        for label, (n, mean, co) in held.items():
            yield pa.record_batch([*(pa.array([v], batch_type) for v, batch_type in zip(label, kinds, strict=True)), pa.array([slot], pa.int32()), pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([co.reshape(-1).tolist()], pa.list_(pa.float64()))], names=[*keys, "slot", "n", "mean", "co"])

    def fold(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("slot").to_pylist(), part.column("n").to_pylist(), part.column("mean").to_pylist(), part.column("co").to_pylist(), strict=True))
        states = [(n, np.array(mean), np.array(co).reshape(len(mean), -1)) for _, n, mean, co in rows]
        n, mean, co = reduce(merged, states)
        one = part.slice(0, 1)
        return pa.table([*(one.column(k) for k in keys), pa.array([rows[0][0] // MERGED], pa.int32()), pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([co.reshape(-1).tolist()], pa.list_(pa.float64()))], names=[*keys, "slot", "n", "mean", "co"])

    kinds = [f.type for f in to_arrow_schema(df.select(*keys).schema)]
    level = df.filter(F.col(column).isNotNull()).select(*keys, column).mapInArrow(partial, state)
    level = level.groupBy(*keys, F.floor(F.col("slot") / MERGED).alias("up")).applyInArrow(lambda t: fold(t), state)
    level = level.groupBy(*keys).applyInArrow(lambda t: fold(t), state)
    d = F.size("mean")
    cells = level.select(*keys, "n", d.alias("d"), F.posexplode("co").alias("at", "co"))
    value = F.when(F.col("n") > 1, F.col("co") / (F.col("n") - 1))
    return cells.select(*keys, F.expr("at div d").cast("int").alias("i"), (F.col("at") % F.col("d")).cast("int").alias("j"), value.alias("value"), F.col("n").cast("bigint").alias("n"))


def transforms(moments: DataFrame, keys: list[str], kind: str = "pca", floor: float = 1e-6) -> DataFrame:
    """keys, forward and inverse (rows laid end to end) from d x d moments: `pca`, `whiten` or `second_hadamard`."""
    ship(moments.sparkSession)
    types = dict(moments.dtypes)

    def solve(pdf):  # noqa: ANN001, ANN202
        d = int(pdf["i"].max()) + 1
        m = np.zeros((d, d))
        m[pdf["i"], pdf["j"]] = pdf["value"]
        w, e = np.linalg.eigh((m + m.T) / 2)
        w, e = np.maximum(w[::-1], floor), e[:, ::-1]
        e = e * np.where(e[np.abs(e).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
        if kind == "whiten":
            forward, inverse = (e / np.sqrt(w)).T, e * np.sqrt(w)
        else:
            forward = C.hadamard(d) @ e.T if kind == "second_hadamard" else e.T
            inverse = forward.T
        row = pdf[keys].iloc[:1].copy()
        row["forward"], row["inverse"] = [forward.reshape(-1).tolist()], [inverse.reshape(-1).tolist()]
        return row

    return moments.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {types[k]}" for k in keys) + ", forward array<double>, inverse array<double>")


def orthogonality(transforms: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Frobenius distance of M M' from the identity, for every stored matrix."""
    cells = transforms.select(*keys, F.posexplode("forward").alias("at", "v")).select(*keys, F.expr(f"at div {d}").alias("i"), (F.col("at") % d).alias("k"), "v")
    other = cells.withColumnsRenamed({"i": "j", "v": "u"})
    gram = cells.join(other, [*keys, "k"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("g"))
    return gram.groupBy(*keys).agg(F.sqrt(F.sum((F.col("g") - (F.col("i") == F.col("j")).cast("double")) ** 2)).alias("distance"))


def transformed_moments(transforms: DataFrame, moments: DataFrame, keys: list[str], d: int) -> DataFrame:
    """keys, k, l, value: moments in the coordinates of a transform, as two products of d x d tables."""
    cells = transforms.select(*keys, F.posexplode("forward").alias("at", "f")).select(*keys, F.expr(f"at div {d}").alias("k"), (F.col("at") % d).alias("i"), "f")
    half = cells.join(moments.select(*keys, "i", "j", "value"), [*keys, "i"]).groupBy(*keys, "k", "j").agg(F.sum(F.col("f") * F.col("value")).alias("value"))
    other = cells.select(*keys, F.col("k").alias("l"), F.col("i").alias("j"), "f")
    return half.join(other, [*keys, "j"]).groupBy(*keys, "k", "l").agg(F.sum(F.col("f") * F.col("value")).alias("value"))


def layer_bit_schedule(metrics: DataFrame, share: float, low: float, high: float) -> DataFrame:
    """The layers of the largest mean metric (over heads) get the high width; ties go to the lower layer."""
    means = metrics.groupBy("layer").agg(F.avg("metric").alias("metric"))
    n = F.bround(F.count("*").over(Window.partitionBy()) * share)
    order = Window.orderBy(F.desc("metric"), "layer")  # one row per layer
    return means.withColumn("bits", F.when(F.row_number().over(order) <= n, high).otherwise(low))


def strided_sample(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Every stride-th row by key, at most `most`."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_n", F.row_number().over(w.orderBy(order)) - 1).withColumn("_all", F.count("*").over(w))
    stride = F.greatest(F.expr(f"_all div {most}"), F.lit(1))
    return rows.filter((F.col("_n") % stride == 0) & (F.col("_n") / stride < most)).drop("_n", "_all")


def search_transforms(df: DataFrame, candidates: list[np.ndarray], widths: list[float], keys: list[str]) -> DataFrame:
    """keys, choice and score: the candidate (an orthogonal matrix) of the least error relative to the first one's.

    The score is the mean over widths of mean squared errors over those of candidate 0; the lower candidate wins ties.
    At a fractional width each candidate first gets its high-width coordinates, those whose error falls most, and scales
    that fit best. All candidates are tried on a batch in one pass; a row leaves its errors alone.
    """
    d = len(candidates[0])
    whole = {f"{k}_{b}": codec("custom", d, b, transform=m, inverse=m.T) for k, m in enumerate(candidates) for b in widths if b == int(b)}
    means = roundtrip(df, "vec", whole).groupBy(*keys).agg(*[F.avg(f"sse_{n}").alias(n) for n in whole]) if whole else None
    for b in (b for b in widths if b != int(b)):
        own = _fractional_errors(df, candidates, b, keys)
        means = own if means is None else means.join(own, keys)
    name = lambda k, b: F.col(f"`{k}_{b}`")
    relative = lambda k: sum(name(k, b) / F.greatest(name(0, b), F.lit(1e-30)) for b in widths) / len(widths)
    best = F.array_min(F.array(*[F.struct(relative(k).alias("score"), F.lit(k).alias("choice")) for k in range(len(candidates))]))
    return means.select(*keys, best.alias("best")).select(*keys, "best.choice", "best.score")


def _fractional_errors(df: DataFrame, candidates: list[np.ndarray], bits: float, keys: list[str]) -> DataFrame:
    """keys and a column for each candidate: one pass for the gains of all their coordinates, one for their errors."""
    d, n_all = len(candidates[0]), len(candidates)
    low, high, n = C.resolve_bits(bits, d)
    forward = np.vstack(candidates).T

    def snapped(x: np.ndarray, width: int) -> np.ndarray:
        c = np.array(C.codebook(d, width)[0])
        return c[np.searchsorted((c[1:] + c[:-1]) / 2, x)]

    def turned(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS) @ forward

    gains = channel_sums(df, "vec", keys, lambda x, _: (lambda y: (y - snapped(y, low)) ** 2 - (y - snapped(y, high)) ** 2)(turned(x)))
    place = F.row_number().over(Window.partitionBy(*keys, F.expr(f"ch div {d}")).orderBy(F.desc("total"), "ch"))
    masks = gains.withColumn("on", place <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch", "on"))).alias("m")).select(*keys, F.col("m.on").alias("on"))

    def errors(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        y = turned(x)
        hat = np.where(matrix(batch.column("on")) > 0, snapped(y, high), snapped(y, low))
        split = lambda v: v.reshape(len(x), n_all, d)
        fit, size = (split(y) * split(hat)).sum(-1), (split(hat) ** 2).sum(-1)
        norm = (x * x).sum(1, keepdims=True)
        return {"errors": lists(norm * (1 - fit**2 / np.maximum(size, EPS)))}

    rows = map_vectors(df.join(masks, keys), "vec", "errors array<double>", errors)
    return rows.groupBy(*keys).agg(*[F.avg(F.get("errors", F.lit(k))).alias(f"{k}_{bits}") for k in range(n_all)])
