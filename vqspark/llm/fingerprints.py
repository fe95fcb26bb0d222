"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A paragraph is a line, cut after words whose hash says so (one in PARAGRAPH_WORDS): cuts move along with the words, so an
inserted or lost word changes its own paragraph only. A paragraph that a text repeats counts by its
occurrences, so that texts are sets of digests. Every digest goes to one cell in each of three parts of a table; a cell
holds a count, the exclusive or of its digests and that of their checks. Tables of two versions subtract cell by cell; what
both have cancels out, and peeling (take a digest from a cell that has just one, drop it from its other cells) recovers
the digests that differ. If peeling ends early, larger tables are tried, until it succeeds.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import textops as T
from .common import partitions, table

PARAGRAPH_WORDS = 8
#: Cells of the sketch that is kept as the fingerprint; a retry has four times the cells.
CELLS, GROWTH, PARTS = 24, 4, 3


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and digest of every paragraph; equal paragraphs of a row have different digests by occurrence."""
    starts, ends, row = T.word_spans(data, offsets)
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    line = np.cumsum(data == 10)[starts]
    words = T.spans_hash(data, starts, ends)
    last = words % np.uint64(PARAGRAPH_WORDS) == 0
    head = np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | last[:-1]]
    first = np.flatnonzero(head)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.r_[first, len(starts)]))
    with np.errstate(over="ignore"):
        digest = T.mix(np.add.reduceat(words * (T.mix(place.astype(np.uint64) + np.uint64(11)) | np.uint64(1)), first))
        row = row[first]
        order = np.lexsort((digest, row))
        r, d = row[order], digest[order]
        new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (d[1:] != d[:-1])])
        nth = np.arange(len(d)) - np.repeat(new, np.diff(np.r_[new, len(d)]))
        return r, T.mix(d + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Sketches:
    """Tables of n rows with a number of cells each."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, dtype=np.int32)
        self.key, self.check = np.zeros(n * cells, dtype=np.uint64), np.zeros(n * cells, dtype=np.uint64)

    def places(self, row: np.ndarray, key: np.ndarray) -> Iterator[np.ndarray]:
        part = self.cells // PARTS
        for k, salt in enumerate(T.seeds(PARTS, 31 + self.cells)):
            with np.errstate(over="ignore"):
                yield row * self.cells + k * part + (T.mix(key ^ salt) % np.uint64(part)).astype(np.int64)

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> None:
        check = T.mix(key + np.uint64(0xA24BAED4963EE407)) & np.uint64(0xFFFFFFFF)
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int32), row.shape)
        for at in self.places(row, key):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.n = self.n
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and sign of each difference, and which rows were recovered whole. Empties the tables."""
        rows, keys, signs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int32)]
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            one = one[(T.mix(self.key[one] + np.uint64(0xA24BAED4963EE407)) & np.uint64(0xFFFFFFFF)) == self.check[one]]
            if not len(one):
                break
            row, key, sign = one // self.cells, self.key[one], self.count[one]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            once = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
            row, key, sign = row[once], key[once], sign[once]
            self.add(row, key, -sign)
            rows.append(row)
            keys.append(key)
            signs.append(sign)
        left = (self.count != 0) | (self.key != 0)
        whole = ~left.reshape(self.n, self.cells).any(axis=1)
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(signs), whole

    def strings(self) -> list[str]:
        """Each row's table: counts, digests and checks, in base 64."""
        count = self.count.astype("<i2").reshape(self.n, self.cells).view(np.uint8)
        key, check = self.key.astype("<u8").reshape(self.n, self.cells).view(np.uint8), self.check.astype("<u4").reshape(self.n, self.cells).view(np.uint8)
        packed = np.hstack([count, key, check])
        return [b64encode(r.tobytes()).decode() for r in packed]

    @classmethod
    def parse(cls, strings: list[str]) -> Sketches:
        out = cls(len(strings), CELLS)
        raw = np.array([np.frombuffer(b64decode(s), dtype=np.uint8) for s in strings], dtype=np.uint8).reshape(len(strings), CELLS * 14)
        for name, kind, a, b in (("count", "<i2", 0, 2), ("key", "<u8", 2, 10), ("check", "<u4", 10, 14)):
            part = np.ascontiguousarray(raw[:, a * CELLS : b * CELLS])
            setattr(out, name, part.view(kind).reshape(-1).astype(getattr(out, name).dtype))
        return out


def sketches(row: np.ndarray, key: np.ndarray, n: int, cells: int = CELLS) -> Sketches:
    out = Sketches(n, cells)
    out.add(row, key, 1)
    return out


def differences(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest and sign (1: only old, -1: only new) of all paragraphs that differ, row by row; both sides by row."""
    rows, keys, signs = [], [], []
    todo, cells = np.arange(n), CELLS
    while len(todo):
        again = []
        for group in np.array_split(todo, max(1, len(todo) * cells >> 20)):
            tables = []
            for row, key in (old, new):
                place = np.searchsorted(group, row)
                here = np.flatnonzero((place < len(group)) & (group[np.minimum(place, len(group) - 1)] == row))
                tables.append(sketches(place[here], key[here], len(group), cells))
            r, k, s, whole = tables[0].minus(tables[1]).peel()
            use = whole[r]
            rows.append(group[r[use]])
            keys.append(k[use])
            signs.append(s[use])
            again.append(group[~whole])
        todo, cells = np.concatenate(again), cells * GROWTH
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (rows, keys, signs))


def likeness(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Shared paragraphs over all paragraphs of both, from the sketches' differences; 1 where neither has any."""
    row, _, _ = differences(old, new, n)
    apart = np.bincount(row, minlength=n)
    both = np.bincount(old[0], minlength=n) + np.bincount(new[0], minlength=n)
    return np.where(both == 0, 1.0, (both - apart) / np.maximum(both + apart, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null and wordless texts have the sketch of no paragraphs."""

    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            for a, b in T.slices(offsets):
                row, key = paragraphs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(sketches(row, key, b - a).strings())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, fingerprint string")


def changed_paragraphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, removed and added (digests) for documents of both tables, by doc_id; null ids meet nothing."""
    ship(old.sparkSession)
    pairs = old.select("doc_id", F.col("text").alias("old")).join(new.select("doc_id", F.col("text").alias("new")), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [paragraphs(*T.text_bytes(batch.column(c))) for c in ("old", "new")]
            row, key, sign = differences(*sides, batch.num_rows)
            lists = [[np.sort(key[(row == r) & (sign == s)]).view(np.int64) for r in range(batch.num_rows)] for s in (1, -1)]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["doc_id", "removed", "added"])

    return pairs.mapInArrow(work, "doc_id bigint, removed array<bigint>, added array<bigint>")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in order of doc_id within partitions, each partition ending with the row that follows it (`ahead`).

    Every text moves once. Ranges come from quantiles of doc_id (one value for each partition); a range starts with one of
    them, so the row that must also go to the range before it is known without another pass. Null ids come first, rows
    with equal ids by text; after the last row comes the first.
    """
    n = partitions(docs.sparkSession)
    least = -(1 << 63)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(least)).alias("_key"))
    found = rows.agg(F.percentile_approx("_key", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("cuts"), F.min("_key").alias("low")).first()
    cuts = sorted(set(found.cuts or []) - {found.low})
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    # Binary search: how many cuts aren't above the key.
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(held, low + step - 1) <= F.col("_key")), low + step).otherwise(low))
    rows = rows.withColumn("_range", at)
    leads = F.when(F.col("_key") == F.lit(found.low), F.lit(len(cuts))).when((F.col("_range") > 0) & (F.get(held, F.col("_range") - 1) == F.col("_key")), F.col("_range") - 1)
    own, extra = F.struct(F.col("_range").alias("to"), F.lit(False).alias("ahead")), F.struct(leads.alias("to"), F.lit(True).alias("ahead"))
    dealt = rows.withColumn("_deal", F.explode(F.filter(F.array(own, extra), lambda x: x["to"].isNotNull())))
    dealt = dealt.select("doc_id", "text", "_key", F.col("_deal.ahead").alias("ahead"), F.col("_deal.to").alias("_to"))
    return dealt.repartitionById(len(cuts) + 1, F.col("_to")).sortWithinPartitions("ahead", "_key", F.col("text").asc_nulls_first()).select("doc_id", "text", "ahead"), len(cuts) + 1


PAIRED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs bigint"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str]] = []
    size, ahead = 0, None
    for batch in batches:
        for doc_id, text, is_ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead")), strict=True):
            if is_ahead:
                ahead = (text or "") if ahead is None else ahead
                continue
            held.append((doc_id, text or ""))
            size += len(text or "")
            if size >= T.STEP_BYTES and len(held) > 1:
                yield _compared(held[:-1], [t for _, t in held[1:]])
                held, size = held[-1:], len(held[-1][1])
    if held:
        yield _compared(held, [t for _, t in held[1:]] + [ahead or ""])


def _compared(rows: list[tuple[int | None, str]], following: list[str]) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    n = len(rows)
    own, changed, after = (paragraphs(*T.text_bytes(pa.array(x, pa.string()))) for x in (texts, edited, following))
    sides = [sketches(*own, n).strings(), sketches(*changed, n).strings()]
    return pa.record_batch(
        [
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            *map(pa.array, sides),
            pa.array(likeness(own, changed, n)),
            pa.array(likeness(own, after, n)),
            pa.array(np.bincount(own[0], minlength=n).astype(np.int64)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs"],
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like each other they are."""
    rows, _ = with_next(table(spark, sf_dir, "documents"))
    return rows.mapInArrow(_compare, PAIRED)
