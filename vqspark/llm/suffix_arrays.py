"""Suffix arrays in numpy: refinement by doubling, to the end or to a given length, and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a big-endian number, with zeros after the end."""
    padded = np.r_[text, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their suffixes, and the words that the order began with.

    Ranks by h bytes give ranks by 2h: a group of equal rank is ordered by the rank h further on; where three ranks fit into
    a word also by that 2h further on, which gives ranks by 3h. Only groups with several members are touched again.
    """
    n = len(text)
    words = words8(text)
    order = np.argsort(words)
    ordered = words[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, dtype=bool)
    rank = np.zeros(n + 1, dtype=np.int32 if n < 1 << 31 else np.int64)  # from 1 on; what lies behind the end has 0
    if n:
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0))
    bits, h = n.bit_length(), 8
    steps = 2 if 3 * bits < 64 else 1
    while True:
        several = np.flatnonzero(~head | ~np.r_[head[1:], True]) if n else head
        if not len(several):
            break
        at = order[several]
        key = rank[at].astype(np.int64)
        for k in range(1, steps + 1):
            key <<= bits
            key |= rank[np.minimum(at + k * h, n)]
        turn = np.argsort(key)
        key, at = key[turn], at[turn]
        order[several] = at
        new = np.r_[True, key[1:] != key[:-1]]
        head[several] = new
        rank[at] = np.maximum.accumulate(np.where(new, several + 1, 0))
        h *= steps + 1
    return order, words


def common_prefixes(text: np.ndarray, order: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of what each suffix in order has in common with the one before it.

    Kasai's walk: from a position to the next one the length shrinks by one at most. The stretches given by starts and
    lengths (which cover the text) are walked side by side.
    """
    n = len(text)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int32)
    held = np.zeros(len(starts), dtype=np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    live = len(starts)
    for i in range(int(lengths[0]) if len(lengths) else 0):
        while live and lengths[live - 1] <= i:
            live -= 1
        p = starts[:live] + i
        j = place[p]
        q = order[np.maximum(j - 1, 0)]
        h = np.where(j > 0, np.maximum(held[:live] - 1, 0), 0)
        going = np.flatnonzero(j > 0)
        while len(going):
            a, b = p[going] + h[going], q[going] + h[going]
            room = n - np.maximum(a, b)
            a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
            differ = words[a] ^ words[b]
            same = np.full(len(going), 8)
            for k in range(8):
                same -= differ >= np.uint64(1 << (8 * k))
            step = np.minimum(same, np.maximum(room, 0))
            h[going] += step
            going = going[(step == 8) & (h[going] < most)]
        held[:live] = np.minimum(h, most)
        out[j] = held[:live]
    return out


def ordered_by_prefix(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The given positions in order of their suffixes' first `length` bytes, and where those bytes differ from the ones before.

    The suffix array as far as `length` bytes need it: ranks by h bytes of two positions give the rank by up to 2h. As no
    two suffixes need be told apart beyond, no common prefixes have to be walked: those of `length` bytes have one rank.
    Sorted are whole numbers that hold the ranks and, where it fits, the position, so that no order has to be looked up.
    """
    n = len(text)
    bits = int(n).bit_length()
    place = np.arange(n, dtype=np.uint64)
    # The first ranks: as many bytes as a word holds, by their numbers among the different bytes of the text.
    used = np.flatnonzero(np.bincount(text, minlength=256))
    wide = max(1, int(len(used)).bit_length())
    symbol = np.zeros(256, dtype=np.uint64)
    symbol[used] = np.arange(1, len(used) + 1)
    symbols = symbol[text]
    h = max(1, min(length, (64 - bits) // wide))
    key = np.zeros(n, dtype=np.uint64)
    for k in range(h):
        key <<= np.uint64(wide)
        key[: max(n - k, 0)] |= symbols[k:]
    if h >= length:
        key, place = key[at], at.astype(np.uint64)
    order, head = _sorted(key, place, bits, h * wide)
    while h < length:
        rank = np.zeros(n + length, dtype=np.uint64)  # from 1 on; what lies behind the end has 0
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1, dtype=np.uint64), np.uint64(0)))
        step = min(h, length - h)
        h += step
        if h >= length:
            place = at.astype(np.uint64)
            key = rank[at] << np.uint64(bits) | rank[at + step]
        else:
            key = rank[:n] << np.uint64(bits) | rank[step : n + step]
        order, head = _sorted(key, place, bits, 2 * bits)
    return order, head


def _sorted(key: np.ndarray, place: np.ndarray, bits: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of `bits` bits in order of keys of `wide` bits, and where a new key starts."""
    if bits + wide <= 64:
        key = np.sort(key << np.uint64(bits) | place)
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        key >>= np.uint64(bits)
    else:
        turn = np.argsort(key)
        key, order = key[turn], place[turn].astype(np.int64)
    return order, np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
