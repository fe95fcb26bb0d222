"""Encoding and decoding of vector tables: one Arrow map for all data-oblivious kinds.

A kernel takes the unit vectors of a batch in the coordinates of a transform, finds the nearest centroid of every
coordinate by bisection of midpoints (the lower one on ties), and decodes again where a kind's scale depends on it. Rows
are independent, so results don't depend on partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import constants as C
from ..session import ship

SCALES = {
    "mse": "norm", "unit_mse": "unit", "lsq_unit_mse": "unit", "lsq_mse": "lsq", "gain_mse": "gain", "half_gain_mse": "half", "clipped_gain_mse": "clipped",
    "selected_gain_mse": "selected", "dot_gain_mse": "dot", "hadamard_mse": "norm", "srht_mse": "norm",
}
EPS = float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class Codec:
    """What a kind does to vectors of dimension d at a whole bit width."""

    d: int
    bits: int
    scale: str = "norm"
    transform: np.ndarray | None = None
    inverse: np.ndarray | None = None
    blocks: np.ndarray | None = None
    project: bool = False

    @property
    def forward(self) -> np.ndarray:
        return C.rotation(self.d, 0) if self.transform is None else self.transform

    @property
    def back(self) -> np.ndarray:
        return self.forward.T if self.inverse is None else self.inverse

    def assign(self, y: np.ndarray) -> np.ndarray:
        if self.blocks is not None:
            pairs = y.reshape(len(y), -1, self.blocks.shape[1])
            return np.stack([((pairs[:, k, None, :] - self.blocks) ** 2).sum(-1).argmin(-1) for k in range(pairs.shape[1])], axis=1).astype(np.int16)
        c = np.array(C.codebook(self.d, self.bits)[0])
        return np.searchsorted((c[1:] + c[:-1]) / 2, y).astype(np.int16)

    def centroids(self, codes: np.ndarray) -> np.ndarray:
        if self.blocks is not None:
            return self.blocks[codes].reshape(len(codes), -1)
        return np.array(C.codebook(self.d, self.bits)[0])[codes]

    def unit(self, codes: np.ndarray) -> np.ndarray:
        """Decoded directions, before scales."""
        x = self.centroids(codes) @ self.back.T
        if self.scale == "unit" or self.project:
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
        g = {"gain": lambda: C.gain(self.d, self.bits), "half": lambda: 1 + (C.gain(self.d, self.bits) - 1) / 2, "dot": lambda: C.gain(self.d, self.bits, 1.0)}.get(self.scale)
        return x * g() if g else x

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and scale of every row; a zero vector has the scale of the smallest norm."""
        norm = np.maximum(np.linalg.norm(x, axis=1), EPS)
        codes = self.assign(x / norm[:, None] @ self.forward.T)
        scale = norm
        if self.scale in ("lsq", "clipped", "selected"):
            hat = self.unit(codes)
            fit = (x * hat).sum(1) / np.maximum((hat * hat).sum(1), EPS)
            most = C.gain(self.d, self.bits)
            if self.scale == "lsq":
                scale = fit
            elif self.scale == "clipped":
                scale = norm * np.clip(fit / norm, 1, most)
            else:
                errors = [((x - hat * (norm * g)[:, None]) ** 2).sum(1) for g in (1, most)]
                scale = np.where(errors[1] <= errors[0], norm * most, norm)
        return codes, scale

    def decode(self, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return self.unit(codes) * scale[:, None]


def codec(kind: str, d: int, bits: int, seed: int = 0, transform: np.ndarray | None = None, inverse: np.ndarray | None = None, blocks: np.ndarray | None = None) -> Codec:
    """The codec of a kind by name; errors (a width, a power of two, half a pair of transforms) come before any job."""
    if (transform is None) != (inverse is None) and kind == "custom":
        raise ValueError("a transform needs its inverse")
    if transform is not None and transform.shape != (d, d):
        raise ValueError(f"transform must have shape {(d, d)}")
    if kind.startswith("lowbit_"):
        kind = kind.removeprefix("lowbit_") if bits <= 2 else "mse"
    if kind in ("mse_block2", "learned_mse_block2", "learned_unit_mse_block2"):
        if d % 2 or not 0 < 2 * bits <= (16 if kind == "mse_block2" else 8):
            raise ValueError("block codes need an even dimension and few enough bits")
        if kind == "mse_block2":
            c = np.array(C.codebook(d, bits)[0])
            blocks = np.stack(np.meshgrid(c, c, indexing="ij"), axis=-1).reshape(-1, 2)
        elif blocks is None:
            raise ValueError("learned block codes need their fitted blocks")
        return Codec(d, bits, "unit" if "unit" in kind else "norm", C.rotation(d, seed), None, blocks)
    if kind not in SCALES and kind != "custom":
        raise ValueError(f"unknown kind {kind}")
    if transform is None:
        transform = C.transform({"hadamard_mse": "hadamard", "srht_mse": "srht"}.get(kind, "rotation"), d, seed)
    return Codec(d, bits, SCALES.get(kind, "norm"), transform, inverse, blocks)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def map_vectors(df: DataFrame, column: str, outputs: str, work: Callable[[np.ndarray, pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """df with more columns, worked out on whole Arrow batches; rows with a null vector get nulls."""
    ship(df.sparkSession)
    names = df.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + outputs
    more = to_arrow_schema(StructType.fromDDL(outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(column).is_valid()
            some = batch.filter(valid)
            made = work(matrix(some.column(column)), some) if some.num_rows else {}
            if some.num_rows:
                yield pa.record_batch([*some.columns, *made.values()], names=[*names, *made])
            rest = batch.filter(pc.invert(valid))
            if rest.num_rows:
                yield pa.record_batch([*rest.columns, *(pa.nulls(rest.num_rows, f.type) for f in more)], names=[*names, *more.names])

    return df.mapInArrow(run, schema)


Work = Callable[[np.ndarray, pa.RecordBatch], np.ndarray]


@dataclass(frozen=True)
class Coder:
    """Decoded vectors from the vectors of a batch and its columns.

    `metadata` holds tables of what the work reads beside the vectors, one row for each segment, with the columns that they
    are joined on. Their other columns have names of their own (see `fresh`), so that coders can meet on the same rows.
    """

    work: Work
    metadata: tuple[tuple[DataFrame, tuple[str, ...]], ...] = ()


_numbers = itertools.count()


def fresh(name: str) -> str:
    return f"_{name}_{next(_numbers)}"


def of_codec(m: Codec) -> Coder:
    return Coder(lambda x, _: m.decode(*m.encode(x)))


def with_metadata(df: DataFrame, *coders: Coder) -> DataFrame:
    """df joined with the tables of all coders; a table that several share comes once."""
    tables = {id(table): (table, keys) for c in coders for table, keys in c.metadata}
    for table, keys in tables.values():
        df = df.join(table, list(keys))
    return df


def apply(df: DataFrame, coder: Coder) -> DataFrame:
    """df with vec_hat."""
    work = coder.work
    return map_vectors(with_metadata(df, coder), "vec", "vec_hat array<double>", lambda x, batch: {"vec_hat": lists(work(x, batch))}).select(*df.columns, "vec_hat")


def encode(df: DataFrame, column: str, made: Codec) -> DataFrame:
    """df with codes and scale."""
    return map_vectors(df, column, "codes array<smallint>, scale double", lambda x, _: dict(zip(("codes", "scale"), (lambda c, s: (lists(c, pa.int16()), pa.array(s)))(*made.encode(x)), strict=True)))


def decode(codes: DataFrame, made: Codec, name: str = "vec_hat") -> DataFrame:
    return map_vectors(codes, "codes", f"{name} array<double>", lambda c, b: {name: lists(made.decode(c.astype(np.int64), b.column("scale").to_numpy()))})


def roundtrip(df: DataFrame, column: str, makers: dict[str, Codec]) -> DataFrame:
    """df with the squared error of every codec in one pass: `sse` by name."""
    names = list(makers)

    def work(x: np.ndarray, _: pa.RecordBatch) -> dict[str, pa.Array]:
        return {f"sse_{n}": pa.array(((x - makers[n].decode(*makers[n].encode(x))) ** 2).sum(1)) for n in names}

    return map_vectors(df, column, ", ".join(f"sse_{n} double" for n in names), work)


def apply_transform(df: DataFrame, column: str, forward: np.ndarray, name: str = "rotated") -> DataFrame:
    return map_vectors(df, column, f"{name} array<double>", lambda x, _: {name: lists(x @ forward.T)})


def pack(codes: DataFrame, bits: int) -> DataFrame:
    """codes as little-endian bit strings, one per row; codes out of range are an error."""

    def work(c: np.ndarray, _: pa.RecordBatch) -> dict[str, pa.Array]:
        c = c.astype(np.int64)
        if not 1 <= bits <= 8 or c.min() < 0 or c.max() >> bits:
            raise ValueError("codes don't fit the width")
        flat = (c[:, :, None] >> np.arange(bits) & 1).astype(np.uint8).reshape(len(c), -1)
        return {"packed": pa.array([r.tobytes() for r in np.packbits(flat, axis=1, bitorder="little")], pa.binary())}

    return map_vectors(codes, "codes", "packed binary", work)


def unpack(packed: DataFrame, bits: int, n: int) -> DataFrame:
    """`codes_back` from packed rows of n codes; a wrong length is an error."""
    ship(packed.sparkSession)
    names = packed.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in packed.dtypes) + ", codes_back array<smallint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("packed").to_pylist():
                if raw is not None and len(raw) != -(-n * bits // 8):
                    raise ValueError("packed row has a wrong length")
                out.append(None if raw is None else np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits) @ (1 << np.arange(bits)))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.int16()))], names=[*names, "codes_back"])

    return packed.mapInArrow(run, schema)


def prod_parts(x: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Codes, scale, signs, residual norm and decoded vectors of product codes."""
    d = x.shape[1]
    base, sketch = Codec(d, bits - 1, "norm", C.rotation(d, seed)), np.random.default_rng(seed + 17).standard_normal((d, d))
    codes, scale = base.encode(x)
    hat = base.decode(codes, scale)
    rest = x - hat
    signs = np.where(rest @ sketch.T >= 0, 1.0, -1.0)
    size = np.linalg.norm(rest, axis=1)
    return codes, scale, signs, size, hat + np.sqrt(np.pi / 2) / d * size[:, None] * (signs @ sketch)


def prod_encode(df: DataFrame, column: str, bits: int, seed: int = 0) -> DataFrame:
    """Codes of one bit less, signs of a Gaussian sketch of the residual, and its norm: unbiased inner products."""
    if bits < 2:
        raise ValueError("product codes need two bits")

    def work(x: np.ndarray, _: pa.RecordBatch) -> dict[str, pa.Array]:
        codes, scale, signs, size, hat = prod_parts(x, bits, seed)
        return {"codes": lists(codes, pa.int16()), "scale": pa.array(scale), "signs": lists(signs.astype(np.int8), pa.int8()), "resid_norm": pa.array(size), "vec_hat": lists(hat)}

    return map_vectors(df, column, "codes array<smallint>, scale double, signs array<tinyint>, resid_norm double, vec_hat array<double>", work)


def l2_norm(column: str) -> F.Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x * x))


def dot(a, b) -> F.Column:  # noqa: ANN001
    """Inner product of two array columns, in SQL functions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Farthest pairs that are looked at for each empty centroid.
POOL = 16


@dataclass(frozen=True)
class Blocks:
    """Fitted block centroids, the rounds that were taken, and how far centroids moved in the last one."""

    centers: np.ndarray
    rounds: int
    moved: float


def product_blocks(d: int, bits: int) -> np.ndarray:
    """Pairs of scalar centroids."""
    c = np.array(C.codebook(d, bits)[0])
    return np.stack(np.meshgrid(c, c, indexing="ij"), axis=-1).reshape(-1, 2)


def lloyd_blocks(samples: DataFrame, start: np.ndarray, most_rounds: int = 60, least_move: float = 1e-7) -> Blocks:
    """Lloyd's rounds over the pairs in the lists of `y`; a task sends sums for each centroid, the driver holds centroids.

    A centroid that no pair is nearest to goes to the pair that is farthest from all centroids; several take one after the
    other from the POOL farthest pairs for each.
    Samples without any pair leave the start as it is.
    """
    ship(samples.sparkSession)
    levels, centers, moved, k = len(start), start.copy(), 0.0, 0

    def pairs_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)

    def nearest(pairs: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = (pairs**2).sum(1)[:, None] - 2 * pairs @ held.T + (held**2).sum(1)
        at = apart.argmin(1)
        return at, apart[np.arange(len(pairs)), at]

    for k in range(1, most_rounds + 1):
        held = centers

        def sums(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, levels))
            for batch in batches:
                pairs = pairs_of(batch)
                near = nearest(pairs, held)[0]
                total += [np.bincount(near, w, levels) for w in (None, pairs[:, 0], pairs[:, 1])]
            yield pa.record_batch([pa.array(np.arange(levels)), pa.array(total[0].astype(np.int64)), pa.array(total[1]), pa.array(total[2])], names=["k", "n", "a", "b"])

        rows = samples.mapInArrow(sums, "k bigint, n bigint, a double, b double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
        centers = held.copy()
        for r in rows:
            if r.n:
                centers[r.k] = r.a / r.n, r.b / r.n
        empty = sorted(set(range(levels)) - {r.k for r in rows if r.n})
        if len(empty) == levels:
            return Blocks(start, k, 0.0)
        if empty:

            def far(batches: Iterator[pa.RecordBatch], held: np.ndarray = held, most: int = POOL * len(empty)) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    pairs = pairs_of(batch)
                    apart = nearest(pairs, held)[1]
                    top = np.argsort(-apart, kind="stable")[:most]
                    yield pa.record_batch([pa.array(apart[top]), pa.array(pairs[top, 0]), pa.array(pairs[top, 1])], names=["apart", "a", "b"])

            found = samples.mapInArrow(far, "apart double, a double, b double").distinct().orderBy(F.desc("apart"), "a", "b").limit(POOL * len(empty)).collect()
            pool, apart = np.array([(r.a, r.b) for r in found]), np.array([r.apart for r in found])
            for at in empty[: len(pool)]:
                centers[at] = pool[apart.argmax()]
                apart = np.minimum(apart, ((pool - centers[at]) ** 2).sum(1))
        moved = float(np.abs(centers - held).max())
        if moved < least_move:
            break
    return Blocks(centers, k, moved)


def fit_blocks(df: DataFrame, column: str, bits: int, seed: int = 0, most_rounds: int = 60) -> np.ndarray:
    """Block centroids for the rotated unit vectors of a table, from pairs of scalar centroids on."""

    def coordinates(x: np.ndarray, _: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"y": lists(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS) @ C.rotation(x.shape[1], seed).T)}

    samples = map_vectors(df.select(column).filter(F.col(column).isNotNull()), column, "y array<double>", coordinates).select("y").persist()
    try:
        first = samples.select(F.size("y")).first()
        return lloyd_blocks(samples, product_blocks(first[0] if first else 2, bits), most_rounds).centers
    finally:
        samples.unpersist()


#: Random unit vectors that blocks are fitted on where no data are to be looked at; each gives d / 2 pairs.
SPHERE_SAMPLES = 16_384
_sphere: dict[tuple[int, int], Blocks] = {}


def sphere_blocks(spark: SparkSession, d: int, bits: int, n: int = SPHERE_SAMPLES) -> Blocks:
    """Block centroids for pairs of coordinates of uniform unit vectors: a constant of d and bits, fitted once a process."""
    if (d, bits) not in _sphere:
        samples = sphere_samples(spark, d, n).select(F.col("vec").alias("y")).persist()
        try:
            _sphere[d, bits] = lloyd_blocks(samples, product_blocks(d, bits))
        finally:
            samples.unpersist()
    return _sphere[d, bits]


def sphere_samples(spark: SparkSession, d: int, n: int, seed: int = 0) -> DataFrame:
    """n random unit vectors, made where they are used: what a codebook that knows no data is fitted on."""
    rows = spark.range(n).select(F.array(*[F.randn(seed * d + k) for k in range(d)]).alias("vec"))
    return rows.select(F.transform("vec", lambda x: x / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, y: a + y * y))).alias("vec"))
