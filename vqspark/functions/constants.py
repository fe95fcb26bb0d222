"""Constants of a dimension and a bit width: codebooks and transforms. Their size doesn't depend on data."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession

GRID = 20_001


def coordinate_density(x: np.ndarray, d: int) -> np.ndarray:
    """Density of a coordinate of a uniform unit vector in d dimensions, which is a symmetric beta on (-1, 1)."""
    log = math.lgamma(d / 2) - math.lgamma((d - 1) / 2) - math.log(math.pi) / 2
    inside = np.maximum(1 - x * x, 0)
    with np.errstate(divide="ignore"):
        return np.where(inside > 0, np.exp(log + (d - 3) / 2 * np.log(np.where(inside > 0, inside, 1))), 0)


@lru_cache(maxsize=64)
def codebook(d: int, bits: int) -> tuple[tuple[float, ...], float]:
    """Lloyd-Max centroids for a coordinate of a unit vector, ascending and symmetric, and the expected squared error.

    Cell means come from running integrals (trapezoid) of the density and of x times it. Zero bits give the centroid 0.
    """
    if d < 2 or not 0 <= bits <= 12:
        raise ValueError("dimension must be 2 or more, bits from 0 to 12")
    x = np.linspace(-1, 1, GRID)
    p = coordinate_density(x, d)
    p /= np.trapezoid(p, x)
    running = lambda f: np.r_[0, np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(x))]
    mass, moment, energy = running(p), running(p * x), float(np.trapezoid(p * x * x, x))
    if bits == 0:
        return (0.0,), energy
    c = quantile_centroids(d, bits)
    for _ in range(200):
        cuts = np.r_[-1, (c[1:] + c[:-1]) / 2, 1]
        w, m = np.diff(np.interp(cuts, x, mass)), np.diff(np.interp(cuts, x, moment))
        new = np.where(w > 0, m / np.where(w > 0, w, 1), c)
        new = (new - new[::-1]) / 2
        moved, c = np.abs(new - c).max(), new
        if moved < 1e-12:
            break
    near = c[np.searchsorted((c[1:] + c[:-1]) / 2, x)]
    return tuple(c.tolist()), float(np.trapezoid((x - near) ** 2 * p, x))


def quantile_centroids(d: int, bits: int) -> np.ndarray:
    """Quantiles of a normal coordinate with variance 1 / d: a start for the codebook, or a rough one itself."""
    n = 1 << bits
    return np.clip([NormalDist().inv_cdf((k + 0.5) / n) / math.sqrt(d) for k in range(n)], -1 + 1e-12, 1 - 1e-12)


def gain(d: int, bits: int, power: float = 0.5) -> float:
    """What decoded vectors lack in norm (power 1/2) or inner products lack in size (power 1), on average."""
    return max(1 - d * codebook(d, bits)[1], 1.2e-7) ** -power


@lru_cache(maxsize=64)
def rotation(d: int, seed: int) -> np.ndarray:
    """A uniform orthogonal matrix: QR of a Gaussian one, with signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def sign_vector(d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, d) * 2.0 - 1


def hadamard(d: int) -> np.ndarray:
    """Entry (i, j) is the parity of the common bits of i and j, over the square root of d."""
    if d < 1 or d & (d - 1):
        raise ValueError("a Hadamard transform needs a power of two")
    both = np.arange(d)[:, None] & np.arange(d)
    return (1 - 2.0 * (np.bitwise_count(both) % 2)) / math.sqrt(d)


def signed_hadamard(d: int, seed: int) -> np.ndarray:
    return hadamard(d) * sign_vector(d, seed)


def srht(d: int, seed: int) -> np.ndarray:
    """A signed Hadamard transform with its rows in a random order."""
    return signed_hadamard(d, seed)[np.random.default_rng(seed + 1).permutation(d)]


def block_hadamard(d: int, block: int, seed: int) -> np.ndarray:
    """Hadamard blocks along the diagonal with random signs; a tail that is no power of two takes an orthogonal block."""
    out = np.zeros((d, d))
    for a in range(0, d, block):
        n = min(block, d - a)
        if n & (n - 1):
            q, r = np.linalg.qr(hadamard(1 << (n - 1).bit_length())[:n, :n] + 1e-9 * np.eye(n))
            out[a : a + n, a : a + n] = q * np.where(np.diag(r) < 0, -1.0, 1.0)
        else:
            out[a : a + n, a : a + n] = hadamard(n)
    return out * sign_vector(d, seed)


def transform(name: str, d: int, seed: int = 0) -> np.ndarray:
    """`identity`, `rotation`, `hadamard` or `srht`; rows give the coordinates."""
    return {"identity": lambda: np.eye(d), "rotation": lambda: rotation(d, seed), "hadamard": lambda: signed_hadamard(d, seed), "srht": lambda: srht(d, seed)}[name]()


def codebook_table(spark: SparkSession, d: int, widths: list[int]) -> DataFrame:
    rows = [(d, b, i, c) for b in widths for i, c in enumerate(codebook(d, b)[0])]
    return spark.createDataFrame(rows, "dim int, bits int, idx int, centroid double")


def resolve_bits(bits: float, d: int, policy: str = "blend") -> tuple[int, int, int]:
    """Low and high whole widths and how many channels get the high one; halves round to even."""
    low = math.floor(bits)
    if low == bits:
        return low, low, 0
    high, share = (low + 1, bits - low) if policy == "blend" else (low + 2, (bits - low) / 2)
    return low, high, round(share * d)
