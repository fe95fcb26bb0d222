"""Kinds that look at a whole segment: statistics are aggregated by segment key, turned into metadata and joined back.

Statistics leave a task as one partial sum for each segment and channel; no task gathers a segment's vectors. Metadata
(masks, permutations, centres, choices) is one row per segment, joined by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import ship
from .codec import EPS, Codec, Coder, apply, codec, fresh, lists, map_vectors, matrix, of_codec

KEYS = ["seq_id", "layer", "side", "segment_id"]


def channel_sums(df: DataFrame, column: str, keys: list[str], work: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], most: bool = False) -> DataFrame:
    """keys, ch, total, n: sums (or the most) over a segment's rows of what `work` gives for every row and channel."""
    ship(df.sparkSession)
    types = dict(df.dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = work(matrix(batch.column(column)), batch)
            first, at = group_rows(batch, keys)
            sums = np.full((len(first), values.shape[1]), -np.inf if most else 0.0)
            (np.maximum if most else np.add).at(sums, at, values)
            n, d = sums.shape
            taken = pa.array(np.repeat(first, d))
            yield pa.record_batch([*(batch.column(k).take(taken) for k in keys), pa.array(np.tile(np.arange(d, dtype=np.int32), n)), pa.array(sums.reshape(-1)), pa.array(np.repeat(np.bincount(at, minlength=n), d).astype(np.int64))], names=[*keys, "ch", "part", "rows"])

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ch int, part double, rows bigint"
    return df.filter(F.col(column).isNotNull()).mapInArrow(partial, schema).groupBy(*keys, "ch").agg((F.max if most else F.sum)("part").alias("total"), F.sum("rows").alias("n"))


def group_rows(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every group of equal keys (nulls are equal), and each row's group number."""
    at = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode")
        # numbers stay dense, so they can't overflow however many keys there are
        at = np.unique(at * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return np.unique(at, return_index=True)[1], at


def channel_scores(df: DataFrame, policy: str, bits: float, keys: list[str] | None = None, column: str = "vec", static: DataFrame | None = None, power: float = 1.0, weight: str | None = None, energy: str | None = None) -> DataFrame:
    """keys, ch, score under an outlier policy.

    `dynamic_absmean`: mean size. `error_gain`: mean squared error at the low less that at the high width, per channel.
    `attention_error_gain`: positive error gains weighted by a column of token weights, and by one of channel weights
    (`energy`) if given. `static_score`: a table by layer,
    side and channel. `sensitivity_error_gain`: positive gain times a power of the static score. With `head_` in front,
    each head chooses for itself.
    """
    keys = list(keys or KEYS)
    if policy.startswith("head_"):
        policy, keys = policy.removeprefix("head_"), [*keys, "head"]
    if policy == "static_score":
        return df.select(*keys).distinct().join(static.select("layer", "side", "ch", "score"), ["layer", "side"]).select(*keys, "ch", "score")
    if policy == "dynamic_absmean":
        sums = channel_sums(df, column, keys, lambda x, _: np.abs(x))
    else:
        weighted = policy == "attention_error_gain"

        def gains(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            low, high, _ = C.resolve_bits(bits, x.shape[1])
            errors = [(x - m.decode(*m.encode(x))) ** 2 for m in (codec("mse", x.shape[1], b) for b in (low, high))]
            out = errors[0] - errors[1]
            if not weighted:
                return out
            out = np.maximum(out, 0) * batch.column(weight).to_numpy(zero_copy_only=False)[:, None]
            return out * matrix(batch.column(energy)) if energy else out

        sums = channel_sums(df, column, keys, gains)
    scores = sums.select(*keys, "ch", (F.col("total") / F.col("n")).alias("score"))
    if policy == "sensitivity_error_gain":
        scores = scores.join(static.select("layer", "side", "ch", F.col("score").alias("held")), ["layer", "side", "ch"])
        scores = scores.select(*keys, "ch", (F.greatest("score", F.lit(0.0)) * F.pow(F.greatest("held", F.lit(0.0)), F.lit(power))).alias("score"))
    return scores


def select_channels(scores: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys and mask: the n channels of the highest scores, the lower channel on ties."""
    ranked = scores.withColumn("on", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ch")) <= n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch", "on"))).alias("m")).select(*keys, F.col("m.on").alias("mask"))


def joint_channels(scores: DataFrame, n_total: int, d: int, keys: list[str] | None = None) -> DataFrame:
    """One budget for a segment's keys and values: scores, not negative and over their side's mean, ranked together.

    Every side gets one channel at least and d - 1 at most: its best channel always comes first, its last one never.
    """
    keys = [k for k in (keys or KEYS) if k != "side"]
    side = Window.partitionBy(*keys, "side")
    rows = scores.withColumn("score", F.greatest("score", F.lit(0.0)))
    rows = rows.withColumn("score", F.col("score") / F.greatest(F.avg("score").over(side), F.lit(1e-30)))
    rows = rows.withColumn("place", F.row_number().over(side.orderBy(F.desc("score"), "ch")))
    order = Window.partitionBy(*keys).orderBy((F.col("place") > 1).cast("int"), (F.col("place") == d).cast("int"), F.desc("score"), "side", "ch")
    rows = rows.withColumn("on", (F.row_number().over(order) <= n_total) & (F.col("place") < d))
    return rows.groupBy(*keys, "side").agg(F.array_sort(F.collect_list(F.struct("ch", "on"))).alias("m")).select(*keys, "side", F.col("m.on").alias("mask"))


def _by_mask(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    patterns, at = np.unique(mask, axis=0, return_inverse=True)
    for k, pattern in enumerate(patterns):
        yield pattern.astype(bool), np.flatnonzero(at.reshape(-1) == k)


def encode_split(df: DataFrame, masks: DataFrame, bits: float, kinds: tuple[str, str] = ("mse", "mse"), keys: list[str] | None = None, column: str = "vec", policy: str = "blend") -> DataFrame:
    """df with vec_hat: regular channels at the low, masked ones at the high width, each in their own dimension."""
    keys = list(keys or KEYS)

    def work(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        low, high, _ = C.resolve_bits(bits, x.shape[1], policy)
        out = np.zeros_like(x)
        for pattern, rows in _by_mask(matrix(batch.column("mask"))):
            for channels, width, kind in ((np.flatnonzero(~pattern), low, kinds[0]), (np.flatnonzero(pattern), high, kinds[1])):
                if len(channels) > 1:
                    part = x[np.ix_(rows, channels)]
                    m = codec(kind, len(channels), width)
                    out[np.ix_(rows, channels)] = m.decode(*m.encode(part))
                elif len(channels):
                    out[np.ix_(rows, channels)] = x[np.ix_(rows, channels)]
        return {"vec_hat": lists(out)}

    return map_vectors(df.join(masks, keys), column, "vec_hat array<double>", work)


def encode_fractional(df: DataFrame, bits: float, policy: str = "dynamic_absmean", kinds: tuple[str, str] = ("mse", "mse"), keys: list[str] | None = None, d: int = 64, allocation: str = "blend", **options) -> DataFrame:  # noqa: ANN003
    """Fractional widths end to end: scores, mask, split. A whole width is plain `kinds[1]`."""
    keys = list(keys or KEYS) + (["head"] if policy.startswith("head_") else [])
    low, high, n = C.resolve_bits(bits, d, allocation)
    if n == 0:
        m = codec(kinds[1], d, low)
        return map_vectors(df, "vec", "vec_hat array<double>", lambda x, _: {"vec_hat": lists(m.decode(*m.encode(x)))})
    scores = channel_scores(df, policy, bits, [k for k in keys if k != "head"] if policy.startswith("head_") else keys, **options)
    return encode_split(df, select_channels(scores, keys, n), bits, kinds, keys, policy=allocation)


def split_codes(df: DataFrame, masks: DataFrame, bits: float, keys: list[str], d: int = 64, allocation: str = "blend") -> tuple[DataFrame, DataFrame]:
    """What fractional plain codes store: rows with packed codes and a scale for each sub-space, and one row of metadata for
    each segment (dim, low, high, places of the outliers in ascending order), without which they can't be read."""
    low, high, n = C.resolve_bits(bits, d, allocation)
    regular, outlier = codec("mse", d - n, low), codec("mse", n, high)

    def packed(codes: np.ndarray, width: int) -> pa.Array:
        flat = (codes.astype(np.int64)[:, :, None] >> np.arange(width) & 1).astype(np.uint8).reshape(len(codes), -1)
        return pa.array([r.tobytes() for r in np.packbits(flat, axis=1, bitorder="little")], pa.binary())

    def work(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        on, out = matrix(batch.column("mask")) > 0, {}
        for name, part, m in (("regular", x[~on], regular), ("outlier", x[on], outlier)):
            codes, scale = m.encode(part.reshape(len(x), -1))
            out |= {name: packed(codes, m.bits), f"{name}_scale": pa.array(scale)}
        return out

    rows = map_vectors(df.join(masks, keys), "vec", "regular binary, regular_scale double, outlier binary, outlier_scale double", work).drop("vec", "mask")
    places = F.filter(F.transform("mask", lambda m, i: F.when(m, i.cast("smallint"))), lambda i: i.isNotNull())
    return rows, masks.select(*keys, F.lit(d).alias("dim"), F.lit(low).alias("low"), F.lit(high).alias("high"), places.alias("outliers"))


def join_codes(codes: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """vec_hat from what `split_codes` has made, of any widths and dimensions; codes without their segment are an error."""
    ship(codes.sparkSession)
    held = codes.join(segments, keys, "left").withColumn("outliers", F.coalesce("outliers", F.raise_error(F.lit("codes without their segment")).cast("array<smallint>")))
    names = [c for c in codes.columns if c not in ("regular", "regular_scale", "outlier", "outlier_scale")]
    types = dict(held.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", vec_hat array<double>"

    def unpacked(column: pa.Array, n: int, width: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        return np.unpackbits(flat, axis=1, bitorder="little")[:, : n * width].reshape(len(column), n, width) @ (1 << np.arange(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = [None] * batch.num_rows
            n = batch.column("outliers").to_pylist()
            shapes = list(zip(batch.column("dim").to_pylist(), map(len, n), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True))
            for shape in set(shapes):
                d, count, low, high = shape
                rows = np.array([i for i, s in enumerate(shapes) if s == shape])
                some = batch.take(pa.array(rows))
                on, hat = np.zeros((len(rows), d), dtype=bool), np.empty((len(rows), d))
                on[np.arange(len(rows))[:, None], np.array([n[i] for i in rows])] = True
                for name, part, m in (("regular", ~on, codec("mse", d - count, low)), ("outlier", on, codec("mse", count, high))):
                    hat[part] = m.decode(unpacked(some.column(name), m.d, m.bits), some.column(f"{name}_scale").to_numpy()).reshape(-1)
                for i, v in zip(rows, hat, strict=True):
                    out[i] = v
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "vec_hat"])

    return held.mapInArrow(run, schema)


def pick_by_segment(errors: DataFrame, keys: list[str], names: list[str], prefix: str = "sse_") -> DataFrame:
    """keys and kind: the candidate of the least summed error; the first one wins ties."""
    sums = errors.groupBy(*keys).agg(*[F.sum(prefix + n).alias(n) for n in names])
    least = F.array_min(F.array(*[F.struct(F.col(n).alias("e"), F.lit(i).alias("i")) for i, n in enumerate(names)]))["i"]
    return sums.select(*keys, F.element_at(F.array(*[F.lit(n) for n in names]), least + 1).alias("kind"))


def uniform(df: DataFrame, bits: int, axis: str = "token", keys: list[str] | None = None, column: str = "vec") -> DataFrame:
    """Symmetric whole numbers: one scale per vector, or per channel over the positions of (keys, head)."""
    if bits < 2:
        raise ValueError("uniform codes need two bits")
    most = (1 << bits - 1) - 1
    if axis == "token":
        return df.withColumn("scale", F.array_max(F.transform(column, F.abs)) / most).withColumn("vec_hat", F.transform(column, lambda x: F.when(F.col("scale") == 0, 0.0).otherwise(F.round(x / F.col("scale")) * F.col("scale"))))
    return apply(df, uniform_coder(df, bits, axis, list(keys or KEYS), column))


def uniform_coder(df: DataFrame, bits: int, axis: str, keys: list[str], column: str = "vec") -> Coder:
    """Whole numbers, halves away from zero."""
    if bits < 2:
        raise ValueError("uniform codes need two bits")
    most = (1 << bits - 1) - 1

    def snap(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
        steps = x / np.where(scale == 0, 1, scale)
        return np.where(scale == 0, 0, np.trunc(steps + np.copysign(0.5, steps)) * scale)

    if axis == "token":
        return Coder(lambda x, _: snap(x, np.abs(x).max(axis=1, keepdims=True) / most))
    keys, name = [*keys, "head"], fresh("scales")
    peaks = channel_sums(df, column, keys, lambda x, _: np.abs(x), most=True)
    scales = peaks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch", (F.col("total") / most).alias("s")))).alias("m")).select(*keys, F.col("m.s").alias(name))
    return Coder(lambda x, batch: snap(x, matrix(batch.column(name))), ((scales, tuple(keys)),))


def centers(df: DataFrame, keys: list[str], column: str = "vec") -> DataFrame:
    """keys and the mean vector over their rows."""
    means = channel_sums(df, column, keys, lambda x, _: x).select(*keys, "ch", (F.col("total") / F.col("n")).alias("m"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch", "m"))).alias("c")).select(*keys, F.col("c.m").alias("center"))


def centered(df: DataFrame, bits: int, keys: list[str] | None = None) -> DataFrame:
    """Residuals from the mean over positions are coded; the mean is metadata of (keys, head)."""
    return apply(df, centered_coder(df, bits, list(keys or KEYS)))


def centered_coder(df: DataFrame, bits: int, keys: list[str]) -> Coder:
    keys, name = [*keys, "head"], fresh("center")

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        c, m = matrix(batch.column(name)), codec("mse", x.shape[1], bits)
        return c + m.decode(*m.encode(x - c))

    return Coder(work, ((centers(df, keys).withColumnRenamed("center", name), tuple(keys)),))


def rms_scales(df: DataFrame, keys: list[str], column: str = "vec") -> DataFrame:
    """keys and per-channel root mean square over its geometric mean; ones for a segment with a single position."""
    sums = channel_sums(df, column, keys, lambda x, _: x * x)
    rms = sums.withColumn("r", F.greatest(F.sqrt(F.col("total") / F.col("n")), F.lit(EPS)))
    rows = rms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ch", "r"))).alias("a"), F.exp(F.avg(F.log("r"))).alias("g"), F.max("n").alias("n"))
    return rows.select(*keys, F.transform("a.r", lambda r: F.when(F.col("n") <= 1, 1.0).otherwise(r / F.col("g"))).alias("rms"))


def rms_rotation(df: DataFrame, bits: int, keys: list[str] | None = None, kind: str = "mse") -> DataFrame:
    return apply(df, rms_coder(df, bits, list(keys or KEYS), kind))


def rms_coder(df: DataFrame, bits: int, keys: list[str], kind: str = "mse") -> Coder:
    name = fresh("rms")

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        r, m = matrix(batch.column(name)), codec(kind, x.shape[1], bits)
        return m.decode(*m.encode(x / r)) * r

    return Coder(work, ((rms_scales(df, keys).withColumnRenamed("rms", name), tuple(keys)),))


def outlier_order(df: DataFrame, keys: list[str], block: int, column: str = "vec") -> DataFrame:
    """keys and `dealt`: channels by falling mean size, dealt round-robin to blocks."""
    scores = channel_sums(df, column, keys, lambda x, _: np.abs(x))
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "ch")) - 1).withColumn("d", F.count("*").over(Window.partitionBy(*keys)))
    blocks = F.greatest(F.ceil(F.col("d") / block), F.lit(1))
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("place") % blocks).alias("b"), (F.col("place") / blocks).cast("int").alias("i"), "ch"))).alias("a")).select(*keys, F.col("a.ch").alias("dealt"))


def flattened(x: np.ndarray, dealt: np.ndarray, bits: int, block: int, seed: int = 0) -> np.ndarray:
    """Vectors coded after Hadamard blocks over channels in the order of `dealt`."""
    d = x.shape[1]
    flat, mix, hat = Codec(d, bits, "norm", np.eye(d)), C.block_hadamard(d, block, seed), np.empty_like(x)
    for order, rows in _groups(dealt.astype(np.int64)):
        y = x[rows][:, order] @ mix.T
        hat[np.ix_(rows, order)] = flat.decode(*flat.encode(y)) @ mix
    return hat


def plain_hat(x: np.ndarray, bits: int, seed: int = 0) -> np.ndarray:
    m = codec("mse", x.shape[1], bits, seed)
    return m.decode(*m.encode(x))


def hadamard_coder(df: DataFrame, bits: int, keys: list[str], block: int = 16, margin: float | None = None) -> Coder:
    """Codes behind Hadamard blocks; with a margin, by row, only where the plain error times it is beaten."""
    name = fresh("dealt")

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        hat = flattened(x, matrix(batch.column(name)), bits, block)
        if margin is None:
            return hat
        base = plain_hat(x, bits)
        better = ((x - hat) ** 2).sum(1) < margin * ((x - base) ** 2).sum(1)
        return np.where(better[:, None], hat, base)

    return Coder(work, ((outlier_order(df, keys, block).withColumnRenamed("dealt", name), tuple(keys)),))


def outlier_hadamard(df: DataFrame, bits: int, mode: str = "always", margin: float = 1.0, keys: list[str] | None = None, block: int = 16, seed: int = 0) -> DataFrame:
    """Sizes are evened out by Hadamard blocks over dealt channels, then coded.

    mode `always`; `segment` keeps plain codes unless the segment's error falls; `vector` decides by row (margin times the
    plain error must be beaten; `selector` tells). Errors of both come from one pass.
    """
    keys = list(keys or KEYS)

    def work(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        hat, base = flattened(x, matrix(batch.column("dealt")), bits, block, seed), plain_hat(x, bits)
        return {"flat": lists(hat), "plain": lists(base), "sse_flat": pa.array(((x - hat) ** 2).sum(1)), "sse_plain": pa.array(((x - base) ** 2).sum(1))}

    rows = map_vectors(df.join(outlier_order(df, keys, block), keys), "vec", "flat array<double>, plain array<double>, sse_flat double, sse_plain double", work)
    if mode == "always":
        chosen = rows.withColumn("selector", F.lit(True))
    elif mode == "vector":
        chosen = rows.withColumn("selector", F.col("sse_flat") < margin * F.col("sse_plain"))
    else:
        picked = rows.groupBy(*keys).agg((F.sum("sse_flat") < F.sum("sse_plain")).alias("selector"))
        chosen = rows.join(picked, keys)
    return chosen.withColumn("vec_hat", F.when(F.col("selector"), F.col("flat")).otherwise(F.col("plain"))).drop("flat", "plain", "dealt", "sse_flat", "sse_plain")


def _groups(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    patterns, at = np.unique(values, axis=0, return_inverse=True)
    for k, pattern in enumerate(patterns):
        yield pattern, np.flatnonzero(at.reshape(-1) == k)


def rotated_outliers(df: DataFrame, bits: float, keys: list[str] | None = None, **options) -> DataFrame:  # noqa: ANN003
    return apply(df, rotated_coder(df, bits, list(keys or KEYS), **options))


def rotated_coder(df: DataFrame, bits: float, keys: list[str], shared: bool = False, seed: int = 0, d: int = 64, transform: np.ndarray | None = None, transforms: dict | None = None, weighted: bool = False) -> Coder:
    """High width for the rotated coordinates whose error it lowers most; least-squares scale.

    `shared` chooses one set of coordinates for both sides of a segment, by scores over their side's mean. `transforms`
    has a matrix by (layer, side) or by side. `weighted` multiplies gains by squared norms and the columns `weight` and `energy`.
    """
    low, high, n = C.resolve_bits(bits, d)
    forward, name = C.rotation(d, seed) if transform is None else transform, fresh("mask")

    def cuts(width: int) -> tuple[np.ndarray, np.ndarray]:
        c = np.array(C.codebook(d, width)[0])
        return c, (c[1:] + c[:-1]) / 2

    def snap(y: np.ndarray, width: int) -> np.ndarray:
        c, middles = cuts(width)
        return c[np.searchsorted(middles, y)]

    def turned(x: np.ndarray, batch: pa.RecordBatch, back: bool = False) -> np.ndarray:
        if not transforms:
            return x @ (forward if back else forward.T)
        out = np.empty_like(x)
        labels = list(zip(batch.column("layer").to_pylist(), batch.column("side").to_pylist(), strict=True))
        for label in set(labels):
            rows, m = [i for i, k in enumerate(labels) if k == label], transforms.get(label, transforms.get(label[1], forward))
            out[rows] = x[rows] @ (m if back else m.T)
        return out

    def unit(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return turned(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS), batch)

    def gains(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        y = unit(x, batch)
        out = (y - snap(y, low)) ** 2 - (y - snap(y, high)) ** 2
        if not weighted:
            return out
        return np.maximum(out, 0) * (x * x).sum(1, keepdims=True) * batch.column("weight").to_numpy(zero_copy_only=False)[:, None] * matrix(batch.column("energy"))

    scores = channel_sums(df, "vec", keys, gains).select(*keys, "ch", (F.col("total") / F.col("n")).alias("score"))
    if shared:
        mean = F.avg("score").over(Window.partitionBy(*keys))
        both = [k for k in keys if k != "side"]
        summed = scores.withColumn("score", F.greatest("score", F.lit(0.0)) / F.greatest(mean, F.lit(1e-30))).groupBy(*both, "ch").agg(F.sum("score").alias("score"))
        masks = df.select(*keys).distinct().join(select_channels(summed, both, n), both)
    else:
        masks = select_channels(scores, keys, n)

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        y = unit(x, batch)
        hat = turned(np.where(matrix(batch.column(name)) > 0, snap(y, high), snap(y, low)), batch, back=True)
        fit = (x * hat).sum(1) / np.maximum((hat * hat).sum(1), EPS)
        return hat * fit[:, None]

    return Coder(work, ((masks.withColumnRenamed("mask", name), tuple(keys)),))


def rotation_bank(df: DataFrame, bits: int, size: int = 4, choose: str = "vector", keys: list[str] | None = None) -> DataFrame:
    """The best of `size` rotations by vector or by segment: rotation_id and vec_hat. One rotation is the plain kind."""
    if not 1 <= size <= 256:
        raise ValueError("a bank has 1 to 256 rotations")
    keys = list(keys or KEYS)

    def work(x: np.ndarray, _: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [codec("mse", x.shape[1], bits, seed) for seed in range(size)]
        hats = np.stack([m.decode(*m.encode(x)) for m in made])
        errors = ((hats - x) ** 2).sum(-1)
        best = errors.argmin(0)
        return {"errors": lists(errors.T.copy()), "rotation_id": pa.array(best.astype(np.int32)), "vec_hat": lists(hats[best, np.arange(len(x))])}

    rows = map_vectors(df, "vec", "errors array<double>, rotation_id int, vec_hat array<double>", work)
    if choose == "vector":
        return rows.drop("errors")
    sums = rows.groupBy(*keys).agg(*[F.sum(F.get("errors", F.lit(k))).alias(f"e{k}") for k in range(size)])
    picked = sums.select(*keys, F.array_min(F.array(*[F.struct(F.col(f"e{k}").alias("e"), F.lit(k).alias("k")) for k in range(size)]))["k"].alias("rotation_id"))

    def one(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, out = batch.column("rotation_id").to_numpy(), np.empty_like(x)
        for k in np.unique(ids):
            m = codec("mse", x.shape[1], bits, int(k))
            out[ids == k] = m.decode(*m.encode(x[ids == k]))
        return {"vec_hat": lists(out)}

    return map_vectors(df.join(picked, keys), "vec", "vec_hat array<double>", one)


def bank_coder(bits: int, size: int = 4) -> Coder:
    """The best of `size` rotations for every row."""

    def work(x: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        hats = np.stack([plain_hat(x, bits, seed) for seed in range(size)])
        return hats[((hats - x) ** 2).sum(-1).argmin(0), np.arange(len(x))]

    return Coder(work)


def head_rotation(df: DataFrame, bits: int) -> DataFrame:
    """Every head has its own rotation."""
    return apply(df, head_coder(bits))


def head_coder(bits: int) -> Coder:
    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        heads, out = batch.column("head").to_numpy(), np.empty_like(x)
        for h in np.unique(heads):
            out[heads == h] = plain_hat(x[heads == h], bits, 100 + int(h))
        return out

    return Coder(work)


PLACE = ["seq_id", "layer", "side", "segment_id", "pos"]


def head_hadamard(df: DataFrame, bits: int, heads: int = 2, seed: int = 0) -> DataFrame:
    """Heads are mixed at each position by a signed Hadamard transform, coded, and mixed back: one row per head again."""
    return mixed_heads(df, lambda rows: map_vectors(rows, "vec", "vec_hat array<double>", lambda x, _: {"vec_hat": lists(plain_hat(x, bits))}), heads, seed)


def mixed_heads(df: DataFrame, code: Callable[[DataFrame], DataFrame], heads: int = 2, seed: int = 0) -> DataFrame:
    """df with vec_hat: `code` (from vec to vec_hat) works on heads mixed by position.

    The number of heads is a parameter (a power of two above one); positions that lack a head are coded as they are.
    """
    if heads < 2 or heads & (heads - 1):
        raise ValueError("heads must be a power of two above one")
    h, slot = C.signed_hadamard(heads, seed), ["head", "vec"]

    def mixed(rows: DataFrame, column: str, back: bool) -> DataFrame:
        """PLACE, head and the mixed column, of the positions that have all heads."""
        m = h.T if back else h
        flat = rows.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("head", column))).alias("r")).filter(F.size("r") == heads)
        flat = flat.select(*PLACE, F.col("r.head").alias("heads"), F.flatten(f"r.{column}").alias("flat"))
        turn = lambda x, _: {"mixed": lists(np.einsum("gh,nhd->ngd", m, x.reshape(len(x), heads, -1)).reshape(len(x), -1))}
        made = map_vectors(flat, "flat", "mixed array<double>", turn)
        n = (F.size("mixed") / heads).cast("int")
        each = made.select(*PLACE, F.posexplode("heads").alias("i", "head"), "mixed").select(*PLACE, "head", F.slice("mixed", F.col("i") * n + 1, n).alias(column))
        return each

    whole = mixed(df.select(*PLACE, *slot), "vec", False)
    alone = df.join(whole.select(*PLACE).distinct(), PLACE, "left_anti").select(*PLACE, *slot)
    coded = code(whole.withColumn("joint", F.lit(True)).unionByName(alone.withColumn("joint", F.lit(False))))
    back = mixed(coded.filter("joint").select(*PLACE, "head", "vec_hat"), "vec_hat", True)
    return df.join(back.unionByName(coded.filter("not joint").select(*PLACE, "head", "vec_hat")), [*PLACE, "head"]).select(*df.columns, "vec_hat")


def hadamard_residual(df: DataFrame, bits: float, keys: list[str] | None = None, d: int = 64, seed: int = 3) -> DataFrame:
    return apply(df, residual_coder(df, bits, list(keys or KEYS), d, seed))


def residual_coder(df: DataFrame, bits: float, keys: list[str], d: int = 64, seed: int = 3, weights: str | None = None) -> Coder:
    """Whole bits for all, and signs of the n largest Hadamard coefficients of the residual (by segment) with one scale.

    `weights` is a column of coefficient weights that sizes are multiplied by when the n are chosen.
    """
    name = fresh("mask")
    low, _, n = C.resolve_bits(bits, d)
    h, m = C.signed_hadamard(d, seed), codec("mse", d, low)

    def rest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base = m.decode(*m.encode(x))
        size = np.maximum(np.linalg.norm(x - base, axis=1, keepdims=True), EPS)
        return base, size, (x - base) / size @ h.T

    def sizes(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        c = np.abs(rest(x)[2])
        return c * matrix(batch.column(weights)) if weights else c

    masks = select_channels(channel_sums(df, "vec", keys, sizes).select(*keys, "ch", F.col("total").alias("score")), keys, n)

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        base, size, c = rest(x)
        on = matrix(batch.column(name)) > 0
        level = (np.abs(c) * on).sum(1, keepdims=True) / np.maximum(on.sum(1, keepdims=True), 1)
        return base + (np.where(c >= 0, 1.0, -1.0) * on * level) @ h * size

    return Coder(work, ((masks.withColumnRenamed("mask", name), tuple(keys)),))


def squared_error(column: str = "vec", hat: str = "vec_hat") -> F.Column:
    return F.aggregate(F.zip_with(column, hat, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
