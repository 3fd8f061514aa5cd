"""Shingles of many texts at once, and what the sets of two blocks of texts have in common: NumPy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Meetings that are expanded at once.
_MEETINGS_AT_ONCE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_order(x: np.ndarray) -> np.ndarray:
    """Places of small numbers in their order, equal ones as they stand."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def shingles(texts: pa.BinaryArray, k: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted and distinct: 64-bit hashes of each ``k`` neighbouring words, which are runs of a-z, of texts
    of ``least_words`` words or more."""
    parts = [x.as_py() + b" " for x in texts]  # a text's last word ends with it
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])
    letter = np.concatenate([[False], (data >= 97) & (data <= 122)])
    start, stop = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])
    text = np.searchsorted(ends, start, "right")
    word, left, at = np.zeros(len(start), np.uint64), np.arange(len(start)), start.copy()
    while len(left):
        word[left] = word[left] * np.uint64(0xD6E8FEB86659FD93) + data[at]
        at += 1
        more = at < stop[left]
        left, at = left[more], at[more]
    word = _mixed(word)
    many = max(len(start) - k + 1, 0)
    gram = np.zeros(many, np.uint64)
    for i in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[i : i + many]
    gram = _mixed(gram)
    enough = np.bincount(text, minlength=len(parts)) >= least_words
    held = (text[:many] == text[k - 1 : k - 1 + many]) & enough[text[:many]]
    text, gram = text[:many][held], gram[held]
    order = np.argsort(gram)
    order = order[in_order(text[order])]
    text, gram = text[order], gram[order]
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])])[: len(text)]
    return text[fresh], gram[fresh]


class Block:
    """Sets of a block of texts. In ``gram``, text after text, the members of each set from rare to common; ``by_gram`` are
    their places in the order of the hashes, ``sorted`` the hashes in it."""

    def __init__(self, gram: np.ndarray, size: np.ndarray, overlap: float) -> None:
        self.gram, self.size, self.first = gram, size.astype(np.int64), np.cumsum(size, dtype=np.int64) - size
        self.text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.by_gram = np.argsort(gram).astype(np.int32)
        self.sorted = gram[self.by_gram]
        #: Members that a text must share with a larger one; how many of them must stand among the first ``reach``.
        self.need = np.maximum(np.ceil(overlap * self.size - 1e-9).astype(np.int64), 1)
        self.sure = (self.need + 2) // 3
        self.reach = self.size - self.need + self.sure
        self.early = np.flatnonzero((np.arange(len(gram)) < np.repeat(self.first + self.reach, self.size))[self.by_gram]).astype(np.int32)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.sorted >> np.uint64(42)] = True

    @cached_property
    def members(self) -> np.ndarray:
        """Sorted hashes of all (text, member)."""
        return np.sort(_mixed(self.gram ^ _mixed(self.text.astype(np.uint64))))


def in_common(small: Block, large: Block, overlap: float, *, same: bool, ties: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of small, text of large, shared) with at least ``overlap`` of the smaller set shared; only sets of ``small``
    that are smaller than those of ``large``, with ``ties`` also equal ones. ``same``: both are one block, and of equal sets
    the first counts as smaller.

    A set that shares ``need`` members shares ``sure`` of them among its first ``reach``, as only ``need - sure`` come after.
    The first are met with all members of the larger set and counted; for what reaches ``sure`` the rest is looked up."""
    asked = small.sorted[small.early]
    early = np.flatnonzero(large.seen[asked >> np.uint64(42)])
    asked = asked[early]
    low = np.searchsorted(large.sorted, asked)
    hit = np.flatnonzero(large.sorted[np.minimum(low, len(large.sorted) - 1)] == asked)
    order, low = small.by_gram[small.early[early[hit]]], low[hit]
    many = np.searchsorted(large.sorted, asked[hit], "right") - low
    turn = in_order(small.text[order])
    order, low, many = order[turn], low[turn], many[turn]
    whose, upto = small.text[order].astype(np.int64), np.cumsum(many)
    ends = np.append(np.flatnonzero(whose[1:] != whose[:-1]) + 1, len(whose))  # a step has all meetings of its texts
    at = 0
    while at < len(order):
        most = np.searchsorted(upto, (upto[at - 1] if at else 0) + _MEETINGS_AT_ONCE, "right")
        last = max(np.searchsorted(ends, most, "right") - 1, np.searchsorted(ends, at, "right"))
        to = int(ends[last])
        n = many[at:to]
        a = np.repeat(whose[at:to], n)
        b = large.text[large.by_gram[np.arange(len(a)) + np.repeat(low[at:to] - (np.cumsum(n) - n), n)]]
        at = to
        key = np.sort(a * len(large.size) + b)
        turns = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared, key = np.diff(np.append(turns, len(key))), key[turns]
        a, b = key // len(large.size), key % len(large.size)
        kept = shared >= small.sure[a]
        a, b, shared = a[kept], b[kept], shared[kept]
        fits = small.size[a] < large.size[b]
        if ties:
            fits |= (small.size[a] == large.size[b]) & ((a < b) if same else True)
        a, b, shared = a[fits], b[fits], shared[fits]
        rest = small.need[a] - small.sure[a]
        if rest.sum():
            members = large.members
            for s in range(0, len(a), 1 << 14):
                r = rest[s : s + (1 << 14)]
                pair = np.repeat(np.arange(s, s + len(r)), r)
                nth = np.arange(len(pair)) - np.repeat(np.cumsum(r) - r, r)
                asked = _mixed(small.gram[small.first[a[pair]] + small.reach[a[pair]] + nth] ^ _mixed(b[pair].astype(np.uint64)))
                found = members[np.minimum(np.searchsorted(members, asked), len(members) - 1)] == asked
                shared[s : s + len(r)] += np.bincount(pair[found] - s, minlength=len(r))
        kept = (shared >= small.need[a]) & (shared / small.size[a] >= overlap)
        yield a[kept], b[kept], shared[kept]
