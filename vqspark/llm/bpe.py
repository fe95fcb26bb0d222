"""Byte-level BPE encoding and decoding with a public vocabulary of ranks.

Pre-tokenisation works on arrays of code points. A table gives each code point its class, and a table of transition
functions gives each its step of a small automaton (it knows how many letters of a contraction are still to come).
Transition functions compose associatively, so blocks of them are scanned side by side and then joined, and the state
before every code point follows without a regular expression or a loop over text. Token starts are then a matter of
neighbouring classes and states. The slices between them go through pair merging, with a cache by slice.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from base64 import b64decode
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import textops as T
from .common import table, trim

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Slices that a worker keeps with their ids.
CACHE_ENTRIES = 300_000
#: Slices up to the last width are merged many at a time, in arrays of these widths; longer ones one by one.
WIDTHS = (8, 16, 40)
KEY = (1 << 63) - 1
#: Slots of the table of pairs, and the rank of a pair that doesn't join.
TABLE, NONE = 1 << 21, 1 << 30
#: Code points that are scanned side by side.
BLOCK = 128

OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
#: What may follow an apostrophe in the pattern's contractions: fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, by the Unicode tables that the pattern's own library uses."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    patterns = [(k, regex.compile(p)) for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+"))]
    for first in range(0, sys.maxunicode + 1, 0x800):
        if 0xD800 <= first <= 0xDFFF:
            continue
        text = "".join(map(chr, range(first, first + 0x800)))
        for kind, pattern in patterns:
            for m in pattern.finditer(text):
                out[first + m.start() : first + m.end()] = kind
    out[0x20] = SPACE
    out[0x27] = QUOTE
    return out


# States: 0 none, 1 and 2 so many letters of a contraction to come, 3 a contraction has just ended.
# A transition function is a byte: bits 2s and 2s + 1 hold the state that follows s.


def _function(*to: int) -> int:
    return sum(t << 2 * s for s, t in enumerate(to))


RESET, LETTER_STEP, OPEN_ONE, OPEN_TWO = _function(0, 0, 0, 0), _function(0, 3, 1, 0), _function(1, 1, 1, 1), _function(2, 2, 2, 2)


@lru_cache(maxsize=1)
def compositions() -> np.ndarray:
    """[f, g]: the function that applies f and then g."""
    f, g = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    out = np.zeros((256, 256), dtype=np.uint8)
    for s in range(4):
        middle = f >> 2 * s & 3
        out |= ((g >> 2 * middle & 3) << 2 * s).astype(np.uint8)
    return out.reshape(-1)


def scan(functions: np.ndarray) -> np.ndarray:
    """Composition of each function with all before it: columns of blocks step together, then blocks are joined."""
    table_of = compositions()
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table_of[(int(out[i - 1]) << 8) | int(out[i])]
        return out
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, _function(0, 1, 2, 3), dtype=np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        grid[i] = table_of[(grid[i - 1].astype(np.uint16) << 8) | grid[i]]
    before = scan(grid[-1])[:-1]
    grid[:, 1:] = table_of[(before.astype(np.uint16)[None, :] << 8) | grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. `points`: code points of texts laid end to end; `firsts`: where texts start."""
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=bool)
    kind = classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[firsts[firsts < n]] = True
    edge[n] = True
    new = edge[:n]
    last = edge[1:]
    before = np.r_[np.uint8(255), kind[:-1]]
    before[new] = 255
    after = np.r_[kind[1:], np.uint8(255)]
    after[last] = 255
    one, two = np.r_[points[1:], 0], np.r_[points[2:], 0, 0][:n]
    # An apostrophe heads a contraction if it starts a token: after neither punctuation nor a space that it belongs to.
    heads = (kind == QUOTE) & (before != OTHER) & (before != QUOTE) & (before != SPACE)
    short, long = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for word in CONTRACTIONS:
        if len(word) == 1:
            short |= (one == ord(word)) & ~last
        else:
            long |= (one == ord(word[0])) & (two == ord(word[1])) & ~last & ~np.r_[last[1:], True]
    step = np.full(n, RESET, dtype=np.uint8)
    step[kind == LETTER] = LETTER_STEP
    step[heads & short] = OPEN_ONE
    step[heads & long] = OPEN_TWO
    step[new & (kind == LETTER)] = RESET
    states = scan(step) & 3
    state = np.r_[np.uint8(0), states[:-1]]
    state[new] = 0
    # Classes as the main alternatives see them: an apostrophe is punctuation.
    group, prior = kind.copy(), before.copy()
    group[kind == QUOTE], prior[before == QUOTE] = OTHER, OTHER
    blank = (group == SPACE) | (group == BLANK)
    prior_blank = (prior == SPACE) | (prior == BLANK)
    word = ~blank
    after_word = ~((after == SPACE) | (after == BLANK) | (after == 255))
    starts = new.copy()
    # A run of letters, numbers or punctuation starts a token unless one space before it does.
    starts |= word & (prior != group) & (prior != SPACE)
    starts[word & (state != 0) & (state != 3)] = False
    starts[new] = True
    starts |= word & (state == 3)
    # White space: a run starts a token, and so does its last character if a word follows a longer run.
    starts |= blank & ~prior_blank
    starts |= blank & prior_blank & after_word
    # A single white space other than a space stands alone, so what follows it starts anew; prior != SPACE covers that.
    return starts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Ids of slices by merging, always, the adjacent pair of the lowest rank; ids are cached by slice."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.tokens = Spelling(self.vocabulary)
        self.names = Spelling([f"{i},".encode() for i in range(len(self.vocabulary))])
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.cache = _Cache(CACHE_ENTRIES)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """One slice. A heap holds the pairs, so that long slices stay affordable."""
        from heapq import heapify, heappop, heappush

        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts there; 0 once it is merged away
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its parts has changed
            end[i], end[middle] = stop, 0
            if stop < n:
                left[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (j := left[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices of `data`, laid end to end, and how many ids each slice has."""
        ends = np.r_[starts[1:], len(data)]
        keys, marks = self.hashes(data, starts, ends)
        at = self.cache.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.cache.entries + len(new) > CACHE_ENTRIES:
                self.cache = _Cache(max(CACHE_ENTRIES, len(new) + len(keys)))
                missing = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
            raw, size = data.tobytes(), ends - starts
            width = np.searchsorted(WIDTHS, size[missing[first]])
            for w in range(len(WIDTHS) + 1):
                group = np.flatnonzero(width == w)
                for cut in range(0, len(group), 1 << 14):
                    some = group[cut : cut + (1 << 14)]
                    pieces = [raw[starts[i] : ends[i]] for i in missing[first[some]]]
                    self.cache.add(new[some], marks[missing[first[some]]], *(self._merge_many(pieces, WIDTHS[w]) if w < len(WIDTHS) else self._merge_each(pieces)))
            at[missing] = self.cache.find(keys[missing])
        ids, counts = self.cache.values(at)
        other = np.flatnonzero(self.cache.mark[at] != marks)  # the entry is another slice's: same key, other mark
        if len(other):
            return self._replaced(ids, counts, other, [data[starts[i] : ends[i]].tobytes() for i in other])
        return ids, counts

    @staticmethod
    def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each slice in the cache, and an independent hash that tells slices of one key apart."""
        return T.spans_hash(data, starts, ends).view(np.int64) & KEY, T.spans_hash(data, starts, ends, salt=1)

    def _replaced(self, ids: np.ndarray, counts: np.ndarray, which: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The slices at `which` merged on their own, in place of what the cache gave."""
        runs = np.split(ids, np.cumsum(counts)[:-1])
        for i, piece in zip(which, pieces, strict=True):
            runs[i] = np.array(self.merge(piece), dtype=np.int32)
        return np.concatenate(runs), np.array([len(r) for r in runs])

    def _merge_each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.merge(p) for p in pieces]
        return np.array(list(chain.from_iterable(found)), dtype=np.int32), np.array([len(x) for x in found])

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table from a pair of ids to the rank of their joined bytes."""
        ranks, keys, values = self.ranks, array("q"), array("q")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        keys, values = np.array(keys), np.array(values)
        held, to = np.full(TABLE, -1, dtype=np.int64), np.full(TABLE, NONE, dtype=np.int32)
        at = _slot(keys)
        while len(keys):
            free = held[at] < 0
            held[at[free]] = keys[free]  # where several meet, the last one stays
            mine = held[at] == keys
            to[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) % TABLE
        return held, to

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        held, to = self.pairs
        key = a.astype(np.int64) << 20 | b
        at = _slot(key)
        out = np.full(len(key), NONE, dtype=np.int32)
        left = np.arange(len(key))
        while len(left):
            seen = held[at]
            hit = seen == key
            out[left[hit]] = to[at[hit]]
            on = ~hit & (seen >= 0)
            left, key, at = left[on], key[on], (at[on] + 1) % TABLE
        return out

    def _merge_many(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merging of many short slices at once: each round joins the pair of the lowest rank of every slice."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(raw)) - np.repeat(ends - size, size)
        ids = np.full((n, width + 2), -1, dtype=np.int32)
        ids[row, column] = self.byte_ids[raw]
        whole = np.array([self.ranks.get(p, -1) for p in pieces])
        rank = np.full((n, width + 2), NONE, dtype=np.int32)
        inner = (column + 1 < size[row]) & (whole[row] < 0)
        r, c = row[inner], column[inner]
        rank[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        after = np.tile(np.arange(1, width + 3, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int16), (n, 1))
        rows = np.flatnonzero(whole < 0)
        while len(rows):
            i = rank[rows].argmin(axis=1)
            best = rank[rows, i]
            go = best < NONE
            rows, i, best = rows[go], i[go], best[go]
            if not len(rows):
                break
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = best, -1
            rank[rows, j] = NONE
            after[rows, i], before[rows, np.minimum(k, width + 1)] = k, i
            inside = k < size[rows]
            rank[rows, i] = NONE
            rr, ii = rows[inside], i[inside]
            rank[rr, ii] = self._rank(ids[rr, ii], ids[rr, k[inside]])
            p = before[rows, i]
            back = p >= 0
            rr, pp = rows[back], p[back]
            rank[rr, pp] = self._rank(ids[rr, pp], ids[rr, i[back]])
        alive = ids >= 0
        alive[whole >= 0, 1:] = False
        ids[whole >= 0, 0] = whole[whole >= 0]
        return ids[alive], alive.sum(axis=1)


class _Cache:
    """Ids by the hash of a slice, with a mark that tells whether it is that slice: an open hash table into one array of ids."""

    def __init__(self, most: int) -> None:
        self.size = 1 << (2 * most).bit_length()
        self.held = np.full(self.size, -1, dtype=np.int64)
        self.to = np.zeros(self.size, dtype=np.int32)
        self.start, self.count = np.zeros(most, dtype=np.int32), np.zeros(most, dtype=np.int32)
        self.mark = np.zeros(most, dtype=np.uint64)
        self.pool, self.used, self.entries = np.zeros(1 << 20, dtype=np.int32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        at, out, left = keys & (self.size - 1), np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        while len(left):
            seen = self.held[at]
            hit = seen == keys
            out[left[hit]] = self.to[at[hit]]
            on = ~hit & (seen >= 0)
            left, keys, at = left[on], keys[on], (at[on] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, marks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys that aren't held, with their marks and their ids laid end to end."""
        n = len(keys)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.used : self.used + len(ids)] = ids
        entry = np.arange(self.entries, self.entries + n, dtype=np.int32)
        self.start[entry], self.count[entry], self.mark[entry] = self.used + np.cumsum(counts) - counts, counts, marks
        self.used, self.entries = self.used + len(ids), self.entries + n
        at = keys & (self.size - 1)
        while len(keys):
            free = self.held[at] < 0
            self.held[at[free]] = keys[free]  # where several meet, the last one stays
            mine = self.held[at] == keys
            self.to[at[mine]] = entry[mine]
            keys, entry, at = keys[~mine], entry[~mine], (at[~mine] + 1) & (self.size - 1)

    def values(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[entries]
        return self.pool[laid(self.start[entries], counts)], counts


def laid(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of ranges, one range after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Spelling:
    """Byte strings by number, and the joined strings of runs of numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.count = np.array([len(x) for x in strings], dtype=np.int32)
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def runs(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All strings of ids joined, and the byte offsets of the runs that end at `ends`."""
        counts = self.count[ids]
        return self.data[laid(self.start[ids], counts)].tobytes(), np.r_[0, np.cumsum(counts, dtype=np.int64)][np.r_[0, ends]]


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * 0x9E3779B97F4A7C1 >> 21) & (TABLE - 1)).astype(np.int64)


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of the texts, and how many pre-tokens lie before each text."""
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
    starts = at[token_starts(points, np.searchsorted(at, offsets[:-1]))]
    return starts, np.searchsorted(starts, offsets)


SCHEMA = "doc_id bigint, ids array<int>, offsets array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary_path: str | None = None, keep_ids: bool = True, keep_offsets: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, ids, offsets, n_tokens, ids_sha256, decoded_sha256.

    `docs` needs doc_id and text; other columns are not looked at. offsets holds the byte at which each token's bytes
    start, so that any token can be found in its text. A null text counts as empty: no ids, digests of the empty string.
    The decoded digest is taken over the bytes that the ids give, never over the text. Without `keep_ids`, ids and
    offsets are null, without `keep_offsets` the latter. The vocabulary (below 1 MB) is read by the driver and broadcast.
    """
    ship(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary_path or public_tokenizers.path(VOCABULARY)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column("text"))
            for a, b in T.slices(offsets):
                part, n = data[offsets[a] : offsets[b]], b - a
                starts, first = piece_spans(part, offsets[a : b + 1] - offsets[a])
                ids, counts = encoder.ids(part, starts)
                ends = np.r_[0, np.cumsum(counts, dtype=np.int64)][first]
                numbers, number_at = encoder.names.runs(ids, ends[1:])
                decoded, decoded_at = encoder.tokens.runs(ids, ends[1:])
                ids_sha = [hashlib.sha256(numbers[s : max(s, e - 1)]).hexdigest() for s, e in zip(number_at, number_at[1:], strict=False)]
                decoded_sha = [hashlib.sha256(decoded[s:e]).hexdigest() for s, e in zip(decoded_at, decoded_at[1:], strict=False)]
                lists = [pa.nulls(n, pa.list_(pa.int32()))] * 2
                if keep_ids:
                    cut = pa.array(ends.astype(np.int32))
                    lists[0] = pa.ListArray.from_arrays(cut, pa.array(ids))
                    if keep_offsets:
                        size = encoder.tokens.count[ids]
                        where = np.cumsum(size, dtype=np.int64) - size - np.repeat(decoded_at[:-1], np.diff(ends))
                        lists[1] = pa.ListArray.from_arrays(cut, pa.array(where.astype(np.int32)))
                yield pa.record_batch([batch.column("doc_id").slice(a, n), *lists, pa.array(np.diff(ends)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "ids", "offsets", "n_tokens", "ids_sha256", "decoded_sha256"])
            trim()

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


_held: list[tuple[int, Encoder]] = []


def _encoder(ranks) -> Encoder:  # noqa: ANN001  a Spark broadcast
    """A worker's encoder; its cache lasts from task to task."""
    value = ranks.value
    if not _held or _held[0][0] != len(value):
        _held[:] = [(len(value), Encoder(value))]
    return _held[0][1]


def decode(tokens: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and the text that `ids` give; null ids give a null text, bytes that aren't UTF-8 a replacement sign."""
    ship(tokens.sparkSession)
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(vocabulary_path or public_tokenizers.path(VOCABULARY)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(ranks).vocabulary
        for batch in batches:
            texts = [None if ids is None else b"".join([vocabulary[i] for i in ids]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(table(spark, sf_dir, "documents"), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
