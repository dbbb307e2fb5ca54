"""Order of suffixes in a block of texts: difference-cover blockwise construction, in numpy (used by operator 12).

A block is a run of short texts. Its suffixes that have at least DEPTH bytes before the end of their text are sorted one
bucket of common first bytes at a time, so the arrays of a sort are those of a bucket, not of the block. A bucket is sorted
by PERIOD bytes only. Suffixes that still tie are told apart by ranks that were worked out before for a sample: the
positions whose residue modulo PERIOD lies in a difference cover. For any two residues a and b the cover has some d with
a + d and b + d both in it, so two tied suffixes are compared by the ranks of the two samples d bytes further on.
"""

from __future__ import annotations

import numpy as np

#: Length up to which suffixes are told to be equal or not.
DEPTH = 100
PERIOD = 64
#: Every residue modulo 64 is a difference of two of these.
COVER = (0, 1, 3, 8, 18, 34, 40, 44, 53)
#: Zero bytes behind each text, so that no name of 16 bytes reaches into the next one.
PAD = 16
BUCKET = 1 << 16


def _shifts() -> np.ndarray:
    """For residues a and b the least d with a + d and b + d in the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    a, b, d = np.ogrid[:PERIOD, :PERIOD, :PERIOD]
    both = inside[(a + d) % PERIOD] & inside[(b + d) % PERIOD]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


SHIFT = _shifts()


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number whose order is theirs; zeros behind the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = len(range(k, n, 8))
        out[k::8] = np.frombuffer(padded, ">u8", m, k)
    return out


#: Names and places below this many bits share one 64-bit word, which sorts faster than an order is looked up.
SMALL = 21


def _ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks from 1 in the order of the pairs (a[i], b[i]); equal pairs have one. Both must be below 2^32."""
    n, bits = len(a), np.uint64(SMALL)
    new = np.ones(n, bool)
    if n < 1 << SMALL and (not n or max(int(a.max()), int(b.max())) < 1 << SMALL):
        packed = np.sort(((a << bits | b) << bits) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << SMALL) - 1)).astype(np.int64)
        packed >>= bits
        new[1:] = packed[1:] != packed[:-1]
        return _ranked(order, new)
    key = a << np.uint64(32) | b
    order = np.argsort(key)
    key = key[order]
    new[1:] = key[1:] != key[:-1]
    return _ranked(order, new)


def _behind(x: np.ndarray, k: int) -> np.ndarray:
    """x[i + k], 0 behind the end."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


class Block:
    """Texts laid side by side with PAD zeros behind each. begin and length tell where they lie."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.words = words_at(data)
        name = names(self.words >> np.uint64(48), self.words >> np.uint64(32) & np.uint64(0xFFFF))
        for k in (4, 8):
            name = names(name, _behind(name, k))
        self.name16 = name
        inside = ragged(begin, length)
        if not data[inside].all():
            # texts have zeros of their own: an end comes before them
            left = np.zeros(len(data), np.uint64)
            left[inside] = np.minimum(np.repeat(begin + length, length) - inside, 16)
            self.name16 = names(self.name16, left)
        self.rank = self._sample_ranks(len(data), begin, length)

    def _name64(self, at: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
        """Names of the 64 bytes at positions; where `end` is given, what lies behind it counts as nothing."""

        def name(k: int) -> np.ndarray:
            own = self.name16[at + k] if end is None else self.name16[np.minimum(at + k, len(self.name16) - 1)]
            return own if end is None else np.where(at + k < end, own, np.uint64(0))

        return names(names(name(0), name(16)), names(name(32), name(48)))

    def _sample_ranks(self, n: int, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each position of the sample the rank of its suffix up to its text's end; 0 elsewhere."""
        rank = np.zeros(n + 1, np.uint64)
        at = ragged(begin, length)
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        mine = inside[at % PERIOD]
        at, end = at[mine], np.repeat(begin + length, length)[mine]
        if not len(at):
            return rank
        rank[at] = self._name64(at, end)
        reach = PERIOD
        while reach < length.max():  # a position one period on is in the sample, too
            rank[at] = names(rank[at], np.where(at + reach < end, rank[np.minimum(at + reach, n)], np.uint64(0)))
            reach *= 2
        return rank

    def _ties(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of positions within groups (ascending numbers) that tie on PERIOD bytes: partitions about pivots, all groups at once."""
        order, live = np.arange(len(at)), np.arange(len(at))
        while len(live):
            own, g = at[order[live]], group[live]
            new = np.ones(len(live), bool)
            new[1:] = g[1:] != g[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(live)))
            pivot = np.repeat(own[first + size // 2], size)
            shift = SHIFT[own % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank[own + shift].astype(np.int64) - self.rank[pivot + shift].astype(np.int64))
            key = np.repeat(np.arange(len(first)), size) * 3 + side + 1
            moved = np.argsort(key, kind="stable")
            order[live] = order[live][moved]
            key = key[moved]
            # groups keep their places, so numbers of places tell the new ones apart and stay ascending
            edge = np.ones(len(live), bool)
            edge[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(live)))
            group[live] = live[np.repeat(start, size)]
            open_ = np.repeat((size > 1) & (key[start] % 3 != 1), size)
            live = live[open_]
        return order

    def equal_classes(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of positions, class number for each) bucket by bucket: positions whose first DEPTH bytes are equal, and that aren't alone, share a class. All must have DEPTH bytes before their text's end."""
        lead = self.name16[at]
        splitters = np.sort(lead)[BUCKET::BUCKET]
        bucket = np.searchsorted(np.unique(splitters), lead, side="right")
        dealt = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[dealt], np.arange(int(bucket.max(initial=0)) + 2))
        return [self._classes(at, dealt[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]

    def _classes(self, at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name = self._name64(at[members])
        order = np.argsort(name)
        members, name = members[order], name[order]
        same = name[1:] == name[:-1]
        tied = np.append(same, False) | np.append(False, same)
        members, name = members[tied], name[tied]
        if not len(members):
            return members, members
        members = members[self._ties(at[members], name.astype(np.int64))]
        # neighbours in the order of suffixes: a class is a stretch of them without a difference within DEPTH bytes
        own = at[members]
        here, there = own[:-1], own[1:]
        same = name[1:] == name[:-1]
        for array, k in ((self.name16, PERIOD), (self.name16, PERIOD + 16), (self.words, DEPTH - 8)):
            same &= array[here + k] == array[there + k]
        number = np.zeros(len(members), np.int64)
        number[1:] = np.cumsum(~same)
        tied = np.append(same, False) | np.append(False, same)
        return members[tied], number[tied]
