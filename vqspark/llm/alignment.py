"""Alignment of two tokenizers' tokens: groups between common token ends, links of overlapping tokens, corpus counts.

Texts are coded in slices that no token of a tokenizer crosses (pre-tokens of a byte-level BPE; words of a piece model whose
pieces never hold a word mark after another character), with a cache by slice. Ends of both codings are marked on the bytes,
so groups and links of a whole batch follow from sums over the marks.

A text of more than FRAGMENT bytes is cut into byte ranges, each a row of its own. The tokens that end in a range are a
fragment: an open prefix (up to the first common end), closed groups, and an open suffix (after the last one). Fragments of
neighbours compose associatively: the suffix of one and the prefix of the next become a group, or a longer open part where
a range has no common end. A tree of compositions in Spark tasks ends with one fragment for each text; see `Fragment`.

Corpus counts are summed from the different pairs of a slice of texts. They go back to the texts by broadcast if there are
at most BROADCAST_PAIRS of them (counted), else by a join on pairs of slices.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe
from . import textops as T
from .common import durable, table, trim

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Longer texts are composed of byte ranges of this length; so many fragments meet in a step of the tree.
FRAGMENT, FAN = 1 << 16, 8
#: The most pairs whose counts are broadcast: 16 bytes and a flag each.
BROADCAST_PAIRS = 4_000_000
MARK = "▁"


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_byte_level(path: str) -> tuple[dict[bytes, int], list[tuple[int, int]]]:
    """Ids by bytes, and the pairs of ids that merge in the order of their ranks, from a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, ids = byte_letters(), model["vocab"]
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    if any(ids[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        raise ValueError("ids don't follow the order of merges")
    return {bytes(letters[c] for c in token): i for token, i in ids.items()}, [(ids[a], ids[b]) for a, b in pairs]


class ByteLevel(bpe.Encoder):
    """Ids by a list of merges: a pair merges if the list has it, not if its bytes happen to be a token."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int]]) -> None:
        super().__init__(ranks)
        self.merges = merges

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.array(self.merges, dtype=np.int64).reshape(-1, 2).T
        return _pair_table(a << 20 | b, np.arange(256, 256 + len(self.merges)))

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        return {pair: 256 + i for i, pair in enumerate(self.merges)}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """One slice of any length, with a heap of pairs by rank and place."""
        from heapq import heapify, heappop, heappush

        ids, n = [int(x) for x in self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merged.get((ids[i], ids[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (s := self.merged.get((ids[left], ids[right]))) is not None:
                    heappush(heap, (s, left, ids[left], ids[right]))
        return tuple(x for x in ids if x >= 0)


def _pair_table(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The open hash table that the encoder looks pairs up in."""
    held, to = np.full(bpe.TABLE, -1, dtype=np.int64), np.full(bpe.TABLE, bpe.NONE, dtype=np.int32)
    at = bpe._slot(keys)
    while len(keys):
        free = held[at] < 0
        held[at[free]] = keys[free]  # where several meet, the last one stays
        mine = held[at] == keys
        to[at[mine]] = ranks[mine]
        keys, ranks, at = keys[~mine], ranks[~mine], (at[~mine] + 1) % bpe.TABLE
    return held, to


class Pieces(bpe.Encoder):
    """Ids of slices that start with a space, by the piece model's own library, which adds that space."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("pieces cross words")
        self.tokens = bpe.Spelling([bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)])
        self.names_count, self.space = len(names), self.model.piece_to_id(MARK)
        self.cache = bpe._Cache(bpe.CACHE_ENTRIES)

    def _merge_each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = self.model.encode([p[1:].decode() for p in pieces], num_threads=1)
        made = [ids or [self.space] for ids in made]  # a space alone
        return np.array([i for ids in made for i in ids], dtype=np.int32), np.array([len(ids) for ids in made])

    def _merge_many(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._merge_each(pieces)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        return tuple(self._merge_each([piece])[0].tolist())


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where slices of a piece model start: texts, and spaces that follow neither a space nor a word mark."""
    space = data == 32
    free = space.copy()
    free[1:] &= ~space[:-1]
    free[3:] &= ~((data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2))
    free[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(free)


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    size = np.diff(offsets)
    more = np.r_[0, np.cumsum(size > 0)]
    out = np.full(len(data) + int(more[-1]), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(more[1:], size)] = data
    return out, offsets + more


@dataclass
class Side:
    """One tokenizer's tokens of some texts, laid end to end: ids, their lengths in bytes, and tokens before each text."""

    ids: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def bytes_of_rows(self) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(self.size, dtype=np.int64)][self.first])

    def rows(self, keep: np.ndarray) -> Side:
        count = np.diff(self.first)
        taken = np.repeat(keep, count)
        return Side(self.ids[taken], self.size[taken], np.r_[0, np.cumsum(count[keep])])

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's tokens and the bytes at which they end."""
        a, b = self.first[row], self.first[row + 1]
        return self.ids[a:b], np.cumsum(self.size[a:b], dtype=np.int64)


def encode_side(encoder: bpe.Encoder, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> Side:
    ids, counts = encoder.ids(data, starts) if len(starts) else (np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))
    tokens = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    return Side(ids, encoder.tokens.count[ids].astype(np.int64), tokens[np.searchsorted(starts, offsets)])


def spells(encoder: bpe.Encoder, side: Side, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text spell it."""
    size = np.diff(offsets)
    good = side.bytes_of_rows() == size
    held = side.rows(good)
    found = np.frombuffer(encoder.tokens.runs(held.ids, np.array([len(held.ids)]))[0], dtype=np.uint8)
    wrong = np.flatnonzero(found != data[np.repeat(good, size)])
    if len(wrong):
        row = np.flatnonzero(good)
        good[row[np.searchsorted(np.cumsum(size[good]), wrong, side="right")]] = False
    return good


@lru_cache(maxsize=1)
def names(most: int) -> bpe.Spelling:
    """Decimal numbers below `most` with a comma, a bar or a semicolon after them: number, number + most, number + 2 most."""
    return bpe.Spelling([f"{i}{sign}".encode() for sign in ",|;" for i in range(most)])


@dataclass
class Aligned:
    """Groups and links of tokens that end at 1..total, where both sides have an end at total."""

    text: bytes
    text_at: np.ndarray
    groups: np.ndarray
    link_row: np.ndarray
    link_key: np.ndarray


def align(a_ids: np.ndarray, a_end: np.ndarray, b_ids: np.ndarray, b_end: np.ndarray, bounds: np.ndarray, most: int = 1 << 16) -> Aligned:
    """`bounds`: where texts (or closed runs) end, each a common end. Links are keys of an A id and a B id (see `pair`)."""
    total = int(bounds[-1]) if len(bounds) else 0
    marks = np.zeros((2, total + 1), dtype=bool)
    marks[0, a_end], marks[1, b_end] = True, True
    common = marks[0] & marks[1]
    before_a, before_b = np.cumsum(marks[0], dtype=np.int64), np.cumsum(marks[1], dtype=np.int64)
    cuts = np.flatnonzero(common)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    # Tokens in the order of groups, A before B in each.
    order = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    order[np.arange(len(a_ids)) + np.r_[0, before_b[cuts]][a_group]] = a_ids + most * common[a_end].astype(np.int64)
    order[np.arange(len(b_ids)) + before_a[cuts][b_group]] = b_ids + 2 * most * common[b_end].astype(np.int64)
    text, text_at = names(most).runs(order, before_a[bounds] + before_b[bounds])
    groups = np.diff(np.r_[0, np.searchsorted(cuts, bounds, side="right")])
    ends = np.flatnonzero(marks[0] | marks[1])  # a link for each stretch between two ends of any side
    key = pair(a_ids[before_a[ends] - marks[0, ends]], b_ids[before_b[ends] - marks[1, ends]])
    return Aligned(text, text_at, groups, np.searchsorted(bounds, ends), key)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 16 | b


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their counts."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


_INTS = {"a": np.int32, "b": np.int32, "a_end": np.int64, "b_end": np.int64}


def _open(**parts: np.ndarray) -> dict[str, np.ndarray]:
    return {name: np.asarray(parts.get(name, ()), dtype=kind) for name, kind in _INTS.items()}


def _split(part: dict[str, np.ndarray], low: int, high: int) -> dict[str, np.ndarray]:
    """The tokens that end after `low` and not after `high`."""
    out = {}
    for side in "ab":
        end = part[f"{side}_end"]
        at = slice(np.searchsorted(end, low, side="right"), np.searchsorted(end, high, side="right"))
        out |= {side: part[side][at], f"{side}_end": end[at]}
    return out


@dataclass
class Fragment:
    """The tokens that end in a byte range: open prefix, closed groups (text, links), open suffix.

    Without a common end (`cut` is false) all tokens are the prefix. The range that starts a text has an empty prefix and a
    cut at its start. `(x + y) + z` equals `x + (y + z)`.
    """

    cut: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: bytes = b""
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    prefix: dict[str, np.ndarray] = field(default_factory=_open)
    suffix: dict[str, np.ndarray] = field(default_factory=_open)

    @staticmethod
    def of(tokens: dict[str, np.ndarray], start: int, first: bool) -> Fragment:
        """Of tokens whose ends lie after `start`."""
        cuts = np.intersect1d(tokens["a_end"], tokens["b_end"], assume_unique=True)
        if first:
            cuts = np.r_[start, cuts]
        if not len(cuts):
            return Fragment(prefix=tokens)
        out = Fragment(cut=True, prefix=_split(tokens, start, cuts[0]), suffix=_split(tokens, cuts[-1], np.iinfo(np.int64).max))
        return out._closing(_split(tokens, cuts[0], cuts[-1]), int(cuts[0]))

    def _closing(self, part: dict[str, np.ndarray], start: int) -> Fragment:
        """With groups closed after those that are."""
        if not len(part["a"]):
            return self
        made = align(part["a"], part["a_end"] - start, part["b"], part["b_end"] - start, part["a_end"][-1:] - start)
        keys, times = tally(np.r_[self.keys, made.link_key], np.r_[self.times, np.ones(len(made.link_key), dtype=np.int64)])
        return Fragment(self.cut, self.n_a + len(part["a"]), self.n_b + len(part["b"]), self.n_groups + int(made.groups[0]), self.text + made.text, keys, times, self.prefix, self.suffix)

    def __add__(self, other: Fragment) -> Fragment:
        joined = lambda x, y: {name: np.r_[x[name], y[name]] for name in _INTS}
        if not other.cut:
            grown = joined(self.suffix if self.cut else self.prefix, other.prefix)
            return Fragment(self.cut, self.n_a, self.n_b, self.n_groups, self.text, self.keys, self.times, self.prefix if self.cut else grown, grown if self.cut else _open())
        if not self.cut:
            return Fragment(True, other.n_a, other.n_b, other.n_groups, other.text, other.keys, other.times, joined(self.prefix, other.prefix), other.suffix)
        middle = joined(self.suffix, other.prefix)
        start = min(int(middle[f"{s}_end"][0] - 1) for s in "ab" if len(middle[s])) if len(middle["a"]) or len(middle["b"]) else 0
        left = self._closing(middle, start)
        keys, times = tally(np.r_[left.keys, other.keys], np.r_[left.times, other.times])
        return Fragment(True, left.n_a + other.n_a, left.n_b + other.n_b, left.n_groups + other.n_groups, left.text + other.text, keys, times, self.prefix, other.suffix)

    def row(self) -> dict:
        return {"cut": self.cut, "n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_groups, "text": self.text, "keys": self.keys, "times": self.times, **{f"{p}_{n}": getattr(self, p)[n] for p in ("prefix", "suffix") for n in _INTS}}

    @staticmethod
    def read(row: dict) -> Fragment:
        parts = {p: _open(**{n: row[f"{p}_{n}"] for n in _INTS}) for p in ("prefix", "suffix")}
        return Fragment(row["cut"], row["n_a"], row["n_b"], row["n_groups"], row["text"], np.asarray(row["keys"], dtype=np.int64), np.asarray(row["times"], dtype=np.int64), **parts)


#: A slice of texts: a value for each text, the slice's pairs with the number of its texts that hold them, and for each
#: text (from `at`) places in `pairs` and how often the text has that link. Or a byte range of one long text: `part`.
BLOCK = "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, sha array<string>, pairs array<bigint>, docs array<bigint>, at array<bigint>, place array<int>, times array<int>"
PART = "nth bigint, start bigint, a array<int>, a_end array<bigint>, b array<int>, b_end array<bigint>"
_OPEN_SQL = ", ".join(f"{p}_{n} array<{'int' if k is np.int32 else 'bigint'}>" for p in ("prefix", "suffix") for n, k in _INTS.items())
FRAGMENTS = f"block bigint, nth bigint, doc_id bigint, cut boolean, n_a bigint, n_b bigint, n_groups bigint, text binary, keys array<bigint>, times array<bigint>, {_OPEN_SQL}"


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows under a schema as Spark writes it; what a row lacks is null."""
    made = [(name, pa.list_(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    return pa.record_batch([pa.array([r.get(name) for r in rows], kind) for name, kind in made], names=[name for name, _ in made])


def _block_row(doc_ids: list, good: np.ndarray, made: Aligned, n_a: np.ndarray, n_b: np.ndarray) -> dict:
    """A row of BLOCK; `made`, n_a and n_b are of the texts that are `good`, the others have no tokens."""
    n = len(good)
    to = np.flatnonzero(good)
    pairs, inverse = np.unique(made.link_key, return_inverse=True)
    found, times = np.unique(to[made.link_row] * len(pairs) + inverse, return_counts=True) if len(to) else (np.empty(0, np.int64), np.empty(0, np.int64))
    place = found % max(1, len(pairs))
    whole = np.zeros((3, n), dtype=np.int64)
    whole[:, to] = n_a, n_b, made.groups
    sha = np.full(n, "", dtype=object)
    sha[to] = [hashlib.sha256(made.text[s : e - 1]).hexdigest() for s, e in zip(made.text_at, made.text_at[1:], strict=False)]
    return {
        "doc_id": doc_ids, "n_a": whole[0], "n_b": whole[1], "n_groups": whole[2], "sha": list(sha), "pairs": pairs, "docs": np.bincount(place, minlength=len(pairs)),
        "at": np.searchsorted(found, np.arange(n + 1) * max(1, len(pairs))), "place": place.astype(np.int32), "times": times.astype(np.int32),
    }


def _encoders(byte_level, pieces) -> tuple[ByteLevel, Pieces]:  # noqa: ANN001  Spark broadcasts
    """A worker's encoders; their caches last from task to task."""
    if not _held or _held[0] != (byte_level.id, pieces.id):
        _held[:] = [(byte_level.id, pieces.id), ByteLevel(*byte_level.value), Pieces(pieces.value)]
    return _held[1], _held[2]


_held: list = []


class _Handle:
    """A broadcast with a number that stays the same on executors."""

    def __init__(self, spark: SparkSession, value, number: str) -> None:  # noqa: ANN001
        self.held, self.id = spark.sparkContext.broadcast(value), number

    @property
    def value(self):  # noqa: ANN201
        return self.held.value


def coded(docs: DataFrame, byte_level_path: str, pieces_path: str, fragment: int = FRAGMENT) -> DataFrame:
    """Rows of BLOCK for slices of texts, and of PART for byte ranges of texts over `fragment` bytes."""
    spark = docs.sparkSession
    ship(spark)
    with open(pieces_path, "rb") as file:
        model = file.read()
    byte_level, pieces = _Handle(spark, load_byte_level(byte_level_path), byte_level_path), _Handle(spark, model, hashlib.sha256(model).hexdigest())
    schema = f"{BLOCK}, {PART}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _encoders(byte_level, pieces)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            whole, offsets = T.text_bytes(batch.column("text"))
            for i, j in T.slices(offsets):
                data, at = with_space(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                a = encode_side(first, data, at, bpe.piece_spans(data, at)[0])
                b = encode_side(second, data, at, word_starts(data, at))
                good = (np.diff(at) > 0) & spells(first, a, data, at) & spells(second, b, data, at)
                long = good & (np.diff(at) > fragment)
                ids = batch.column("doc_id").slice(i, j - i).to_pylist()
                out = []
                for row in np.flatnonzero(long):
                    (x, x_end), (y, y_end) = a.of(row), b.of(row)
                    tokens = _open(a=x, a_end=x_end, b=y, b_end=y_end)
                    for nth, start in enumerate(range(0, int(at[row + 1] - at[row]), fragment)):
                        out.append({"block": block, "doc_id": [ids[row]], "nth": nth, "start": start, **_split(tokens, start, start + fragment)})
                    block += 1
                short = np.flatnonzero(~long)
                if len(short):
                    held_a, held_b = a.rows(good & ~long), b.rows(good & ~long)
                    ends = [np.cumsum(s.size, dtype=np.int64) for s in (held_a, held_b)]
                    made = align(held_a.ids, ends[0], held_b.ids, ends[1], np.cumsum(np.diff(at)[good & ~long]))
                    out.append({"block": block} | _block_row([ids[k] for k in short], good[short], made, np.diff(held_a.first), np.diff(held_b.first)))
                    block += 1
                yield _batch(out, schema)
            trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, schema)


def composed(parts: DataFrame) -> DataFrame:
    """Rows of BLOCK from those of PART: leaves in one map, then a tree of FAN fragments a step, one fragment a text."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = Fragment.of(_open(**{n: row[n] for n in _INTS}), row["start"], row["nth"] == 0)
                yield _batch([{"block": row["block"], "nth": row["nth"], "doc_id": row["doc_id"][0], **made.row()}], FRAGMENTS)

    def step(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["nth"])
        whole = Fragment.read(rows[0])
        for row in rows[1:]:
            whole = whole + Fragment.read(row)
        return pa.Table.from_batches([_batch([{"block": rows[0]["block"], "nth": rows[0]["nth"] // FAN, "doc_id": rows[0]["doc_id"], **whole.row()}], FRAGMENTS)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = Fragment.read(row)
                n = len(made.keys)
                yield _batch([{"block": row["block"], "doc_id": [row["doc_id"]], "n_a": [made.n_a], "n_b": [made.n_b], "n_groups": [made.n_groups], "sha": [hashlib.sha256(made.text[:-1]).hexdigest()], "pairs": made.keys, "docs": np.ones(n, np.int64), "at": [0, n], "place": np.arange(n, dtype=np.int32), "times": made.times.astype(np.int32)}], BLOCK)

    longest = parts.agg(F.max("nth")).first()[0]
    if longest is None:
        return parts.select(*[c.split()[0] for c in BLOCK.split(", ")]).limit(0)
    spread = parts.repartition("block", "nth") if longest else parts
    level = spread.select("block", "doc_id", "nth", "start", *_INTS).mapInArrow(leaves, FRAGMENTS)
    while longest > 0:
        level = level.groupBy("block", F.floor(F.col("nth") / FAN).alias("up")).applyInArrow(step, FRAGMENTS)
        longest //= FAN
    return level.mapInArrow(finish, BLOCK)


def _summed(row: dict, number: np.ndarray, best: np.ndarray) -> dict[str, np.ndarray]:
    """Links, best links and summed counts of a block's texts."""
    at, place, times = np.asarray(row["at"]), np.asarray(row["place"], dtype=np.int64), np.asarray(row["times"], dtype=np.int64)
    sums = [np.r_[0, np.cumsum(x)] for x in (times, times * best[place], times * number[place])]
    return {name: x[at[1:]] - x[at[:-1]] for name, x in zip(("n_links", "n_best", "count_sum"), sums, strict=True)}


OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _out(row: dict, number: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    sums = _summed(row, number, best)
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], sums["n_links"], sums["n_best"], sums["count_sum"]]
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(row["sha"], pa.string())], names=[c.split()[0] for c in OUT.split(", ")])


def align_tokenizers(docs: DataFrame, byte_level_path: str | None = None, pieces_path: str | None = None, fragment: int = FRAGMENT, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE of a JSON file over a space and the text, B a piece model over the text, to which it adds the
    space. Texts that are null or empty, or that either's tokens don't spell (as those with a word mark), have no tokens:
    zeros and an empty digest. Rows that repeat an id or a text are documents of their own. An empty table gives an empty
    one. docs needs doc_id and text; other columns are not looked at.
    """
    spark = docs.sparkSession
    made = durable(coded(docs, byte_level_path or public_tokenizers.path(BYTE_LEVEL), pieces_path or public_tokenizers.path(PIECES), fragment))
    columns = [c.split()[0] for c in BLOCK.split(", ")]
    short = made.filter("nth is null").select(*columns)
    blocks = short.unionByName(durable(composed(made.filter("nth is not null"))))
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    counts = durable(counts)
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("a", F.shiftright("pair", 16)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if counts.count() <= broadcast_pairs:
        held = ranked.toArrow()
        order = np.argsort(pair_ids := held.column("pair").to_numpy())
        found = spark.sparkContext.broadcast((pair_ids[order], held.column("n").to_numpy()[order], held.column("best").to_numpy()[order]))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, number, best = found.value
            for batch in batches:
                for row in batch.to_pylist():
                    at = np.searchsorted(known, np.asarray(row["pairs"], dtype=np.int64))
                    yield _out(row, number[at], best[at])

        return blocks.mapInArrow(looked_up, OUT)
    # Slices ask for their own pairs, so a frequent pair comes once a slice, not once a text.
    asked = blocks.select("block", F.posexplode("pairs").alias("i", "pair")).join(ranked, "pair")
    answers = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "n", "best"))).alias("x")).select("block", F.col("x.n").alias("n"), F.col("x.best").alias("best"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _out(row, np.asarray(row["n"] or [], dtype=np.int64), np.asarray(row["best"] or [], dtype=bool))

    return blocks.join(answers, "block", "left").mapInArrow(joined, OUT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over all documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align_tokenizers(table(spark, sf_dir, "documents"))
