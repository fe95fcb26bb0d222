"""Every kind by name: from rows with `vec` to rows with `vec_hat`, for whole, fractional and raw widths.

A kind is a coder (see `codec.Coder`) put together from those of this package: at a fractional width two of them, one for
each sub-space of channels. Kinds that choose between codings do so by segment: one pass over the rows codes all candidates
and leaves their errors, which are summed to one choice for each segment (the first on ties); a second pass codes each row
the way of its segment. The error is the mean squared one or, where queries are given, that of attention.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from . import attention as A
from . import segments as S
from .codec import EPS, SCALES, Codec, Coder, apply, codec, fresh, lists, map_vectors, matrix, of_codec, prod_parts, sphere_blocks, with_metadata

#: Widths from which rows stay as they are.
RAW_BITS = 16
#: Rotations of a bank, and the first one of values where sides don't share theirs.
BANK, VALUE_SEED = 4, 500
GAINED = {"regular_gain_mse": "gain_mse", "regular_half_gain_mse": "half_gain_mse", "regular_selected_gain_mse": "selected_gain_mse", "regular_clipped_gain_mse": "clipped_gain_mse"}
LEARNED = ("learned_mse_block2", "learned_unit_mse_block2")


@dataclass(frozen=True)
class Setting:
    """What kinds need beside rows and a width.

    `q` holds queries (see `attention`), of which the last t positions count. `policy` and `allocation` choose channels at
    fractional widths; `policies` sets them by side. `transforms` and `rotations` are a matrix or a rotation's number by
    (layer, side): calibration results, so their number doesn't grow with the rows.
    """

    d: int = 64
    keys: tuple[str, ...] = tuple(S.KEYS)
    q: DataFrame | None = None
    t: int = 1
    policy: str = "dynamic_absmean"
    allocation: str = "blend"
    policies: dict[str, str] = field(default_factory=dict)
    transforms: dict[tuple, np.ndarray] = field(default_factory=dict)
    rotations: dict[tuple, int] = field(default_factory=dict)
    block: int = 16
    margin: float = 0.95
    entropy_limit: float = 0.8
    value_layer: int = 16
    options: dict = field(default_factory=dict)


def _roundtrip(df: DataFrame, m: Codec) -> DataFrame:
    return apply(df, of_codec(m))


def by_layer(df: DataFrame, bits: int, d: int, transforms: dict[tuple, np.ndarray], rotations: dict[tuple, int]) -> DataFrame:
    return apply(df, layer_coder(bits, d, transforms, rotations))


def layer_coder(bits: int, d: int, transforms: dict[tuple, np.ndarray], rotations: dict[tuple, int]) -> Coder:
    """Rows coded under the transform of their layer and side; without one, under the usual rotation."""
    made = {k: codec("custom", d, bits, transform=m, inverse=m.T) for k, m in transforms.items()}
    made |= {k: codec("mse", d, bits, seed) for k, seed in rotations.items()}
    usual = codec("mse", d, bits)

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty_like(x)
        for key, rows in _row_groups(batch, ["layer", "side"]):
            m = made.get(key, usual)
            out[rows] = m.decode(*m.encode(x[rows]))
        return out

    return Coder(work)


def _row_groups(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Values of the columns and the rows that have them."""
    first, at = S.group_rows(batch, columns)
    for group, row in enumerate(first):
        yield tuple(batch.column(c)[int(row)].as_py() for c in columns), np.flatnonzero(at == group)


def halves(masks: tuple[DataFrame, tuple[str, ...], str], regular: Coder, outlier: Coder) -> Coder:
    """Channels in and out of a segment's mask through a coder each. `masks`: a table, its keys and its column of masks."""
    table, keys, name = masks
    low, high = regular.work, outlier.work

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        on, out = matrix(batch.column(name)) > 0, np.empty_like(x)
        for part, code in ((~on, low), (on, high)):
            out[part] = code(x[part].reshape(len(x), -1), batch).reshape(-1)
        return out

    return Coder(work, ((table, keys), *regular.metadata, *outlier.metadata))


def sub_space(df: DataFrame, masks: tuple[DataFrame, tuple[str, ...], str], outlier: bool) -> DataFrame:
    """df with the channels in (or out of) the mask as vec: what statistics of a sub-space are made from."""
    table, keys, name = masks

    def cut(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"part": lists(x[(matrix(batch.column(name)) > 0) == outlier].reshape(len(x), -1))}

    return map_vectors(df.join(table, list(keys)), "vec", "part array<double>", cut).drop("vec", name).withColumnRenamed("part", "vec")


def _with_queries(df: DataFrame, at: Setting) -> DataFrame:
    """df with `met`: the probability and the vector of every query that sees the row's position in its head.

    A position meets the t last queries of its head's group: a handful.
    """
    place = ["seq_id", "layer", "head", "pos"]
    probs = A.attention_probs(at.q, df.filter("side = 'key'"), at.t)
    seen = probs.select(*A.QUERY, "kv_head", "pos", "p").join(at.q.select(*A.QUERY, "kv_head", "q"), [*A.QUERY, "kv_head"])
    met = seen.withColumnRenamed("kv_head", "head").groupBy(*place).agg(F.collect_list(F.struct("p", "q")).alias("met"))
    return df.join(met, place, "left")


def candidate_errors(df: DataFrame, coders: dict[str, Coder], at: Setting) -> DataFrame:
    """keys and, for each candidate in order, `error` (an array) and `spare`: one pass over the rows codes them all.

    error: mean of p (s - s')^2 over queries and key positions, or mean over value positions of the mean squared
    probability times the squared error; null without queries, and for segments that none meets. spare: squared error.
    """
    keys, works, by_query = list(at.keys), [c.work for c in coders.values()], at.q is not None
    rows = with_metadata(_with_queries(df, at) if by_query else df, *coders.values())

    def work(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        gaps = [code(x, batch) - x for code in works]
        plain = np.stack([(g * g).sum(1) for g in gaps], axis=1)
        if not by_query:
            return {"error": lists(np.zeros_like(plain)), "n": pa.array(np.zeros(len(x), dtype=np.int64)), "spare": lists(plain)}
        met = batch.column("met")
        row = np.repeat(np.arange(len(x)), pa.compute.fill_null(pa.compute.list_value_length(met), 0).to_numpy(zero_copy_only=False))
        held = met.flatten()
        p, q = held.field("p").to_numpy(zero_copy_only=False), matrix(held.field("q")) if len(row) else np.zeros((0, x.shape[1]))
        count, key = np.bincount(row, minlength=len(x)), np.array(batch.column("side").to_pylist()) == "key"
        weight = np.bincount(row, p * p, len(x)) / np.maximum(count, 1)
        scored = np.stack([np.bincount(row, p * ((q * g[row]).sum(1) * A.SCALING) ** 2, len(x)) for g in gaps], axis=1)
        error = np.where(key[:, None], scored, weight[:, None] * plain)
        return {"error": lists(error), "n": pa.array(np.where(key, count, count > 0).astype(np.int64)), "spare": lists(plain)}

    made = map_vectors(rows, "vec", "error array<double>, n bigint, spare array<double>", work)
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c in ("error", "spare") for i in range(len(works))]
    total = made.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("spare").alias("rows"), *sums)
    mean = lambda c, n: F.array(*[F.col(f"{c}_{i}") / F.col(n) for i in range(len(works))])
    return total.select(*keys, F.when(F.col("n") > 0, mean("error", "n")).alias("error"), mean("spare", "rows").alias("spare"))


def choices(df: DataFrame, coders: dict[str, Coder], at: Setting) -> DataFrame:
    """keys and `choice`: the number of the candidate that codes the segment best; without queries, by squared error."""
    errors = candidate_errors(df, coders, at).withColumn("by", F.coalesce("error", "spare"))
    return errors.select(*at.keys, (F.array_position("by", F.array_min("by")) - 1).cast("int").alias("choice"))


def chosen(coders: dict[str, Coder], table: DataFrame, keys: tuple[str, ...], name: str = "choice") -> Coder:
    """Every row coded once, by the coder whose number its segment has in the table; nulls take the first."""
    works, column = [c.work for c in coders.values()], fresh(name)

    def work(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        number, out = pa.compute.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False), np.empty_like(x)
        for k in np.unique(number):
            rows = np.flatnonzero(number == k)
            out[rows] = works[k](x[rows], batch.take(pa.array(rows)))
        return out

    return Coder(work, ((table.withColumnRenamed(name, column), keys), *(m for c in coders.values() for m in c.metadata)))


def pick(df: DataFrame, coders: dict[str, Coder], at: Setting) -> Coder:
    """The coder of the least error of each segment: one pass before the choice, one after."""
    return chosen(coders, choices(df, coders, at), at.keys)


def channel_masks(df: DataFrame, bits: float, at: Setting) -> DataFrame:
    """keys and mask under the setting's policy, or each side's own; joint policies share one budget between the sides.

    Joint choices need both sides at one width and dimension, as here by construction; a segment with one side alone
    gets its own budget.
    """
    keys = list(at.keys)
    _, _, n = C.resolve_bits(bits, at.d, at.allocation)
    if at.policies:
        parts = [channel_masks(df.filter(F.col("side") == side), bits, replace(at, policy=at.policies.get(side, at.policy), policies={})) for side in ("key", "value")]
        return reduce(DataFrame.unionByName, parts)
    policy, joint = at.policy, at.policy.startswith("joint_")
    policy = policy.removeprefix("joint_")
    rows, options = df, dict(at.options)
    if policy == "attention_error_gain":
        if at.q is None:
            policy = "error_gain"
        else:
            rows, options = attention_weighted(df, at), options | {"weight": "weight", "energy": "energy"}
    scores = S.channel_scores(rows, policy, bits, keys, **options)
    if not joint:
        return S.select_channels(scores, keys, n)
    both = [k for k in keys if k != "side"]
    pairs = df.select(*keys).distinct().groupBy(*both).agg(F.count("*").alias("sides"))
    known = scores.join(pairs, both)
    alone = S.select_channels(known.filter("sides = 1").select(*scores.columns), keys, n)
    return S.joint_channels(known.filter("sides = 2").select(*scores.columns), 2 * n, at.d, keys).select(*alone.columns).unionByName(alone)


def attention_weighted(df: DataFrame, at: Setting, turn: np.ndarray | None = None) -> DataFrame:
    """df with `weight` (mean probability of a key, mean squared one of a value) and `energy`: of a key the mean squared
    coordinates of its head's queries, turned if a matrix is given; ones for a value. Without queries both are one."""
    keys = df.filter("side = 'key'")
    place = ["seq_id", "layer", "head", "pos"]
    weights = [A.token_weights(at.q, keys, squared=side == "value", t=at.t).withColumn("side", F.lit(side)) for side in ("key", "value")]
    turned = map_vectors(at.q, "q", "y array<double>", lambda x, _: {"y": lists((x if turn is None else x @ turn.T) ** 2)})
    # One vector for each head: sums by channel, then one array again.
    cells = turned.select(*A.HEAD, F.posexplode("y").alias("ch", "y")).groupBy(*A.HEAD, "ch").agg(F.avg("y").alias("y"))
    energy = cells.groupBy(*A.HEAD).agg(F.array_sort(F.collect_list(F.struct("ch", "y"))).alias("m"))
    energy = energy.select("seq_id", "layer", F.col("kv_head").alias("head"), F.lit("key").alias("side"), F.col("m.y").alias("energy"))
    out = df.join(weights[0].unionByName(weights[1]), [*place, "side"], "left").join(energy, ["seq_id", "layer", "head", "side"], "left")
    ones = F.array_repeat(F.lit(1.0), at.d)
    return out.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "energy": F.coalesce("energy", ones)})


def attention_scaled(df: DataFrame, bits: int, d: int, at: Setting, masks: DataFrame | None = None) -> DataFrame:
    """Keys decoded with the factor that fits their scores best; values, and keys that no query meets, as plain codes.

    With `masks`, df has the regular channels alone and queries are cut to the same channels.
    """
    m = codec("mse", d, bits)
    coded = map_vectors(df, "vec", "vec_hat array<double>, unit_hat array<double>", lambda x, _: (lambda c, s: {"vec_hat": lists(m.decode(c, s)), "unit_hat": lists(m.unit(c))})(*m.encode(x)))
    if at.q is None:
        return coded.drop("unit_hat")
    q = at.q
    if masks is not None:
        on = masks.filter("side = 'key'").select("seq_id", "layer", "mask")
        q = q.join(on, ["seq_id", "layer"]).withColumn("q", F.filter("q", lambda x, i: ~F.get("mask", i))).drop("mask")
    factors = A.attention_scale(q, coded.filter("side = 'key'"), at.t).withColumn("side", F.lit("key"))
    out = coded.join(factors, ["seq_id", "layer", "head", "pos", "side"], "left")
    scaled = F.when(F.col("attention_scale").isNotNull(), F.transform("unit_hat", lambda x: x * F.col("attention_scale"))).otherwise(F.col("vec_hat"))
    return out.withColumn("vec_hat", scaled).select(*df.columns, "vec_hat")


def weighted_residual(df: DataFrame, bits: float, at: Setting) -> Coder:
    """Hadamard residuals whose coefficients, for keys, are chosen by the sum of p |q| |r| in that basis; else by size."""
    if at.q is None:
        return S.residual_coder(df, bits, list(at.keys), at.d)
    h = C.signed_hadamard(at.d, 3)

    def weights(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        met, out = batch.column("met"), np.ones_like(x)
        size = pa.compute.fill_null(pa.compute.list_value_length(met), 0).to_numpy(zero_copy_only=False)
        held, row = met.flatten(), np.repeat(np.arange(len(x)), size)
        if len(row):
            sums = np.zeros_like(x)
            np.add.at(sums, row, held.field("p").to_numpy(zero_copy_only=False)[:, None] * np.abs(matrix(held.field("q")) @ h.T))
            key = (np.array(batch.column("side").to_pylist()) == "key") & (size > 0)
            out[key] = sums[key]
        return {"weights": lists(out)}

    rows = map_vectors(_with_queries(df, at), "vec", "weights array<double>", weights)
    return S.residual_coder(rows, bits, list(at.keys), at.d, weights="weights")


#: Kinds of the regular channels, of the outliers and of all channels, where these aren't the same.
PARTS = {kind: (gained, "mse", "mse") for kind, gained in GAINED.items()} | {
    "regular_outlier_hadamard_mse": ("outlier_hadamard_mse", "mse", "mse"), "outlier_only_hadamard_mse": ("mse", "outlier_hadamard_mse", "mse"),
    "rms_regular_gain_mse": ("rms_gain_mse", "rms_rotation_mse", "rms_rotation_mse"), "calibrated_rotation_mse": ("mse", "mse", "calibrated_rotation_mse"),
    "regular_attention_scale_mse": ("attention_scale_mse", "mse", "attention_scale_mse"),
}
#: Kinds that choose by segment: their candidates, and whether attention decides.
CHOICES = {
    "auto_mse": (("mse", "unit_mse", "selected_gain_mse", "learned_unit_mse_block2"), False), "attention_auto_mse": (("mse", "gain_mse", "unit_mse", "learned_unit_mse_block2"), True),
    "adaptive_regular_gain_mse": (("mse", "regular_gain_mse"), False), "attention_adaptive_regular_gain_mse": (("mse", "regular_gain_mse"), True),
    "adaptive_outlier_hadamard_mse": (("mse", "outlier_hadamard_mse"), False), "attention_outlier_hadamard_mse": (("mse", "outlier_hadamard_mse"), True),
    "attention_adaptive_outlier_hadamard_mse": (("mse", "outlier_hadamard_mse"), True), "attention_hadamard_residual_mse": (("mse", "hadamard_residual_mse"), True),
    "attention_adaptive_rotated_outlier_mse": (("mse", "attention_rotated_outlier_mse"), True),
    "attention_adaptive_paired_rotated_outlier_mse": (("mse", "attention_paired_rotated_outlier_mse"), True),
    "segment_rotation_bank_mse": (tuple(f"rotation_{k}" for k in range(BANK)), False), "attention_rotation_bank_mse": (tuple(f"rotation_{k}" for k in range(BANK)), True),
}
#: Kinds that entropy routes: the kind of low entropy and the sides that are routed.
GUARDED = {"entropy_guarded_outlier_hadamard_mse": ("outlier_hadamard_mse", ("value",)), "entropy_guarded_paired_rotated_outlier_mse": ("paired_rotated_outlier_mse", ("key", "value"))}
ROTATED = ("rotated_outlier_mse", "paired_rotated_outlier_mse", "shared_rotated_outlier_mse", "calibrated_rotated_outlier_mse", "attention_rotated_outlier_mse", "attention_paired_rotated_outlier_mse")


def _kind_at(kind: str, bits: int) -> str:
    """What a kind that goes by the width of its sub-space stands for."""
    if kind in ("distortion_regime_mse", "gain_unit_regime_mse"):
        return "gain_mse" if bits <= 2 else "learned_unit_mse_block2" if kind.startswith("distortion") else "unit_mse"
    return kind


def whole_coder(df: DataFrame, kind: str, bits: int, d: int, at: Setting) -> Coder:
    """A kind at a whole width, on all channels of df or on those of a sub-space."""
    kind, keys = _kind_at(kind, bits), list(at.keys)
    if d == 1:
        return Coder(lambda x, _: x)  # a single channel stays as it is
    if kind in LEARNED:
        return of_codec(codec(kind, d, bits, blocks=sphere_blocks(df.sparkSession, d, bits).centers if d % 2 == 0 and bits <= 4 else None))
    if kind in SCALES or kind == "mse_block2" or kind.startswith("lowbit_"):
        return of_codec(codec(kind, d, bits))
    if kind.startswith("rotation_") and kind.removeprefix("rotation_").isdigit():
        return of_codec(codec("mse", d, bits, int(kind.removeprefix("rotation_"))))
    made: dict[str, Callable[[], Coder]] = {
        "outlier_hadamard_mse": lambda: S.hadamard_coder(df, bits, keys, at.block),
        "vector_adaptive_outlier_hadamard_mse": lambda: S.hadamard_coder(df, bits, keys, at.block, 1.0),
        "margin_vector_outlier_hadamard_mse": lambda: S.hadamard_coder(df, bits, keys, at.block, at.margin),
        "rotation_bank_mse": lambda: S.bank_coder(bits, BANK),
        "head_rotation_mse": lambda: S.head_coder(bits),
        "centered_mse": lambda: S.centered_coder(df, bits, keys),
        "rms_rotation_mse": lambda: S.rms_coder(df, bits, keys),
        "rms_gain_mse": lambda: S.rms_coder(df, bits, keys, "gain_mse"),
        "scheduled_rotation_mse": lambda: layer_coder(bits, d, {}, at.rotations),
        "calibrated_rotation_mse": lambda: layer_coder(bits, d, at.transforms, {}),
        "uniform_token": lambda: S.uniform_coder(df, bits, "token", keys),
        "uniform_channel": lambda: S.uniform_coder(df, bits, "channel", keys),
        "prod": lambda: Coder(lambda x, _: prod_parts(x, bits)[-1]),
    }
    if kind not in made:
        raise ValueError(f"unknown kind {kind}")
    if kind == "prod" and bits < 2:
        raise ValueError("product codes need two bits")
    return made[kind]()


def coder(df: DataFrame, kind: str, bits: float, at: Setting, held: dict | None = None) -> Coder:
    """The coder of a kind for the rows of df. `held` keeps masks, so that candidates of one choice share them."""
    held = {} if held is None else held
    low, high, n = C.resolve_bits(bits, at.d, at.allocation)
    if kind == "bitwidth_attention_outlier_hadamard_mse":
        kind = "outlier_hadamard_mse" if low <= 2 else "attention_outlier_hadamard_mse"
    if kind == "rate_regime_mse":
        kind = "gain_mse" if bits < 3 else "learned_unit_mse_block2"
    if kind == "attention_rotation_bank_mse" and at.q is None:
        kind = "rotation_bank_mse"
    if n == 0 and kind in ("hadamard_residual_mse", "attention_hadamard_residual_mse", "attention_weighted_hadamard_residual_mse", "shared_rotated_outlier_mse"):
        kind = "mse"
    if kind in CHOICES:
        names, by_attention = CHOICES[kind]
        return pick(df, {k: coder(df, k, bits, at, held) for k in names}, at if by_attention else replace(at, q=None))
    if kind in GUARDED:
        name, sides = GUARDED[kind]
        return coder(df, "mse", bits, at, held) if at.q is None else entropy_route(df, at, coder(df, name, bits, at, held), coder(df, "mse", bits, at, held), sides)
    if kind in ROTATED:
        return _rotated(df, kind, bits, at)
    if kind == "hadamard_residual_mse":
        return S.residual_coder(df, bits, list(at.keys), at.d)
    if kind == "attention_weighted_hadamard_residual_mse":
        return weighted_residual(df, bits, at)
    parts = PARTS.get(kind, (kind, kind, kind))
    if n == 0:
        return whole_coder(df, parts[2], low, at.d, at)
    own = replace(at, keys=(*at.keys, "head")) if kind == "head_rotation_mse" else at  # each head has its own outliers
    key = (bits, own.keys)
    if key not in held:
        table = channel_masks(df, bits, own)
        name = fresh("mask")
        held[key] = (table.withColumnRenamed("mask", name), tuple(c for c in table.columns if c != "mask"), name)
    masks = held[key]
    return halves(masks, whole_coder(sub_space(df, masks, False), parts[0], low, at.d - n, own), whole_coder(sub_space(df, masks, True), parts[1], high, n, own))


def _rotated(df: DataFrame, kind: str, bits: float, at: Setting) -> Coder:
    """High widths for rotated coordinates; a whole width is plain. Sides have a rotation each unless they are paired."""
    low, _, n = C.resolve_bits(bits, at.d)
    keys = list(at.keys)
    if kind == "calibrated_rotated_outlier_mse":
        return S.rotated_coder(df, bits, keys, d=at.d, transforms=at.transforms) if n else layer_coder(low, at.d, at.transforms, {})
    if n == 0:
        return of_codec(codec("mse", at.d, low))
    own = {} if "paired" in kind or "shared" in kind else {"value": C.rotation(at.d, VALUE_SEED)}
    if kind.startswith("attention") and at.q is not None:
        return S.rotated_coder(attention_weighted(df, at, C.rotation(at.d, 0)), bits, keys, d=at.d, transforms=own, weighted=True)
    return S.rotated_coder(df, bits, keys, d=at.d, transforms=own, shared="shared" in kind)


def entropy_route(df: DataFrame, at: Setting, low: Coder, high: Coder, sides: tuple[str, ...]) -> Coder:
    """`low` for segments (of these sides) whose attention entropy ratio is at most the limit, `high` for all others."""
    ratios = A.entropy_ratio(A.attention_probs(at.q, df.filter("side = 'key'"), at.t), ["seq_id", "layer"])
    every = F.explode(F.array(*map(F.lit, sides))).alias("side")
    good = ratios.filter(F.col("entropy_ratio") <= at.entropy_limit).select("seq_id", "layer", F.lit(1).alias("choice"), every)
    segments = df.select("seq_id", "layer", "side").distinct().join(good, ["seq_id", "layer", "side"], "left")
    return chosen({"high": high, "low": low}, segments, ("seq_id", "layer", "side"))


def _split_by(df: DataFrame, condition, one: Callable[[DataFrame], DataFrame], other: Callable[[DataFrame], DataFrame]) -> DataFrame:  # noqa: ANN001
    columns = [*df.columns, "vec_hat"]
    return one(df.filter(condition)).select(*columns).unionByName(other(df.filter(~condition)).select(*columns))


def encode_kind(df: DataFrame, kind: str, bits: float, at: Setting | None = None) -> DataFrame:
    """df with vec_hat under any kind of the catalogue; df has seq_id, layer, side, segment_id, head, pos and vec.

    Widths of RAW_BITS and more keep rows as they are. At a fractional width, channels are split and each sub-space is coded
    by the kind at its own whole width; kinds that choose do so for both sub-spaces together, kinds of heads mask by head.
    Attention kinds without queries choose by squared error. An unknown kind, or a width that a kind can't have, is an error
    before any job. An empty table gives an empty one; rows with a null vector have a null vec_hat.
    """
    at = at or Setting()
    if bits >= RAW_BITS:
        return df.withColumn("vec_hat", F.col("vec"))
    low, high, n = C.resolve_bits(bits, at.d, at.allocation)
    go = lambda k, rows: encode_kind(rows, k, bits, at)
    if kind == "hadamard_rate_regime_mse":
        return go("learned_unit_mse_block2", df) if bits >= 3 else _split_by(df, F.col("side") == "value", lambda r: go("margin_vector_outlier_hadamard_mse", r), lambda r: go("mse", r))
    if kind == "rate_hadamard_value_mse":
        value = "margin_vector_outlier_hadamard_mse" if bits < 3 else "outlier_hadamard_mse"
        there = (F.col("side") == "value") if bits < 3 else (F.col("side") == "value") & (F.col("layer") >= at.value_layer)
        return _split_by(df, there, lambda r: go(value, r), lambda r: go("mse", r))
    if kind == "head_hadamard_mse":
        return S.mixed_heads(df, lambda rows: go("mse", rows))
    if kind == "attention_scale_mse":
        # Without the queries of its channels a sub-space has plain codes.
        return apply(df, coder(df, "mse", bits, at)) if n else attention_scaled(df, low, at.d, at).select(*df.columns, "vec_hat")
    if kind == "regular_attention_scale_mse":
        return _regular_scaled(df, bits, at) if n else go("attention_scale_mse", df)
    return apply(df, coder(df, kind, bits, at))


def _regular_scaled(df: DataFrame, bits: float, at: Setting) -> DataFrame:
    """Regular channels by attention scale, outliers plain: their rows are cut apart and laid together again."""
    low, high, n = C.resolve_bits(bits, at.d, at.allocation)
    masks = channel_masks(df, bits, at)

    def cut(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        on = matrix(batch.column("mask")) > 0
        return {"lo": lists(x[~on].reshape(len(x), -1)), "hi": lists(x[on].reshape(len(x), -1))}

    def merge(x: np.ndarray, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        on, out = matrix(batch.column("mask")) > 0, np.empty_like(x)
        out[~on], out[on] = matrix(batch.column("lo_hat")).reshape(-1), S.plain_hat(matrix(batch.column("hi")), high).reshape(-1)
        return {"vec_hat": lists(out)}

    rows = map_vectors(df.join(masks, list(at.keys)), "vec", "lo array<double>, hi array<double>", cut).withColumnsRenamed({"vec": "whole", "lo": "vec"})
    scaled = attention_scaled(rows, low, at.d - n, at, masks).withColumnRenamed("vec_hat", "lo_hat")
    return map_vectors(scaled.drop("vec"), "whole", "vec_hat array<double>", merge).withColumnRenamed("whole", "vec").select(*df.columns, "vec_hat")


#: Presets of plain integer baselines: kinds of keys and values, and their width.
PRESETS = {"naive_int4": ("uniform_token", "uniform_token", 4), "per_channel_keys_int4": ("uniform_channel", "uniform_token", 4)}


def encode_preset(df: DataFrame, name: str, at: Setting | None = None) -> DataFrame:
    key, value, bits = PRESETS[name]
    return _split_by(df, F.col("side") == "key", lambda r: encode_kind(r, key, bits, at), lambda r: encode_kind(r, value, bits, at))


def encode_protected(flagged: DataFrame, kind: str, bits: float, at: Setting | None = None, targets: str = "both") -> DataFrame:
    """Rows with is_raw (see `protection.protect`): those of the target sides stay raw, the rest is coded."""
    stays = F.col("is_raw") if targets == "both" else F.col("is_raw") & (F.col("side") == targets)
    return _split_by(flagged, F.coalesce(stays, F.lit(False)), lambda r: r.withColumn("vec_hat", F.col("vec")), lambda r: encode_kind(r, kind, bits, at))


def encode_scheduled(df: DataFrame, schedule: list[tuple], at: Setting | None = None) -> DataFrame:
    """Rows by a schedule of (layer, side, bits, kind): one pass for each distinct (bits, kind).

    A layer and side of the rows that the schedule lacks is an error; so are two entries for one.
    """
    known = [(layer, side) for layer, side, _, _ in schedule]
    if len(known) != len(set(known)):
        raise ValueError("a layer and side stands twice in the schedule")
    there = {tuple(r) for r in df.select("layer", "side").distinct().collect()}  # one row for each layer and side
    if missing := sorted(there - set(known), key=repr):
        raise ValueError(f"no schedule for {missing}")
    parts = []
    for bits, kind in sorted({(b, k) for _, _, b, k in schedule}):
        where = [(F.col("layer") == layer) & (F.col("side") == side) for layer, side, b, k in schedule if (b, k) == (bits, kind)]
        parts.append(encode_kind(df.filter(reduce(lambda a, b: a | b, where)), kind, bits, at).select(*df.columns, "vec_hat"))
    return reduce(DataFrame.unionByName, parts)


def relative_error(column: str = "vec", hat: str = "vec_hat") -> F.Column:
    """Squared error over the squared norm."""
    return S.squared_error(column, hat) / F.greatest(F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x), F.lit(EPS))
