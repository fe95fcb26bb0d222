"""Numpy helpers over the bytes of an Arrow string column: words, hashes and five-word shingles.

All functions take one flat byte array and document offsets, so that a batch of texts is worked on at once.
Null texts count as empty. `slices` keeps the working memory bounded whatever the batch holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
SHINGLE_WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on salt alone."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([salt], dtype=U64))
        return mix(base) | U64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i below n."""
    p = 0x5851F42D4C957F2D
    inverse = pow(p, -1, 1 << 64)
    up, down = np.full(n, p, dtype=U64), np.full(n, inverse, dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return seeds(256, 77)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `most` bytes together, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums S and factors f: (S[end] - S[start]) * f[start] depends on the bytes from start to end alone."""
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return sums, down


#: Spans over this many bytes are hashed one by one.
LONG_SPAN = 512
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number, with zeros after the end: a view, not a copy."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies; other salts give independent ones.

    Eight bytes at a time are taken into a state that is mixed in between, so no family of texts collides by its form.
    """
    at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        out = mix(left.astype(U64) + seeds(1, 101 + salt))
        words = eights(data)
        live = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
        while len(live):
            take = np.minimum(left[live], 8)
            out[live] = mix((out[live] ^ (words[at[live]] & _LOW[take])) + U64(0x9E3779B97F4A7C15))
            at[live] += 8
            left[live] -= take
            live = live[left[live] > 0]
    for i in np.flatnonzero(left > LONG_SPAN):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run without ASCII white space (0x20, 0x09 to 0x0D)."""
    inside = np.ones(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS, salts: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """Row and hash (by each salt) of each `size`-word shingle in order; a shorter text is one shingle, one without words none."""
    starts, ends, row = word_spans(data, offsets)
    made = [_joined(spans_hash(data, starts, ends, salt), row, size, salt) for salt in salts]
    return made[0][0], *(value for _, value in made)


def _joined(words: np.ndarray, row: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the shingles of hashed words."""
    factor = seeds(size, 5 + salt)
    n = len(words)
    with np.errstate(over="ignore"):
        if n >= size:
            whole = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
            long = sum(words[whole + k] * factor[k] for k in range(size))
        else:
            whole, long = np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.empty(0, dtype=np.int64)
        count = np.diff(np.r_[first, n])
        few = first[count < size]
        have = count[count < size]
        short = np.zeros(len(few), dtype=U64)
        for k in range(size - 1):
            use = have > k
            short[use] += words[few[use] + k] * factor[k]
        short = mix(short + have.astype(U64))
    at = np.r_[whole, few]
    order = np.argsort(at, kind="stable")
    return row[at][order], mix(np.r_[long, short])[order]


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, value) once, sorted by both."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.empty(0, dtype=bool)
    return row[keep], value[keep]
