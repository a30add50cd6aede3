"""A logarithmic family of suffix arrays.

A batch of strings gets a suffix array: its suffixes of at least ``span`` bytes, in order of their string's key and then of their first
``span`` bytes. It is merge-scanned against the level arrays for suffixes of one key that agree in ``span`` bytes, and becomes a level
itself; levels of about equal size are merged, so that n batches leave about log n levels, and a suffix is
merged about log n times. Strings of different keys can't agree, so a scan looks only at keys that both have.

Of suffixes that agree a level keeps one, and of its text the bytes of those: the others are marked, and whatever agrees with them later agrees with it. So what is held grows with the different windows, eight bytes for each
(sixteen beyond 2**31) and their text, however often they come. Windows are only cut out a block at a time; the suffixes of a key that has more than a block's are ordered by doubling: ranks of 1, 2, 4 ... bytes.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 15


def small(x: np.ndarray, most: int) -> np.ndarray:
    """``x``, whose values are at most ``most``, in four bytes each if they fit."""
    return x.astype(np.int32 if most < 1 << 31 else np.int64)


def ranked(x: np.ndarray) -> np.ndarray:
    """The place of each value among the different ones; values that aren't much more than there are places need no sorting."""
    most = int(x.max()) + 1
    if most > 4 * len(x):
        return np.unique(x, return_inverse=True)[1]
    there = np.zeros(most, bool)
    there[x] = True
    return (np.cumsum(there) - 1)[x]


def doubled(text: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The order of the suffixes ``at`` of ``text`` by their first ``span`` bytes: pairs of ranks of half as many bytes are ranked, until no two are equal or ``span`` is reached."""
    n, length = len(text), 1
    rank = text.astype(np.int64)
    while 2 * length <= span and (length == 1 or rank.max() < n - 1):
        pair = rank * (rank.max() + 2)
        pair[: n - length] += rank[length:] + 1
        rank = ranked(pair)
        length *= 2
    # the rest of the span overlaps what is ranked
    last = ranked(rank[at] * (rank.max() + 1) + rank[at + max(0, span - length)])
    return np.argsort(last.astype(np.uint16) if last.max() < 1 << 16 else last, kind="stable")


class Level:
    """Suffixes in order: ``at`` into ``text``, and ``owner``, the number given to each when added; those of ``keys[i]`` are from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, text: np.ndarray, keys: np.ndarray, starts: np.ndarray, at: np.ndarray, owner: np.ndarray):
        self.text, self.keys, self.starts, self.at, self.owner = text, keys, starts, at, owner

    def windows(self, of: np.ndarray | slice, span: int) -> np.ndarray:
        """The first ``span`` bytes of the suffixes numbered ``of``. Equal length makes trailing zero bytes harmless."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, span)
        return np.ascontiguousarray(view[self.at[of]]).view(f"S{span}").ravel()

    def kept(self, mask: np.ndarray, span: int) -> Level:
        """Of the suffixes those in ``mask``, with no more text than they need."""
        sizes = np.add.reduceat(np.append(mask, False), self.starts[:-1], dtype=np.int64) if len(self.keys) else np.zeros(0, np.int64)
        sizes = np.where(np.diff(self.starts) > 0, sizes, 0)
        at, owner, text = self.at[mask], self.owner[mask], self.text
        used = np.zeros(len(text) + 1, np.int32)
        np.add.at(used, at, 1)
        np.subtract.at(used, at.astype(np.int64) + span, 1)
        needed = np.cumsum(used[:-1]) > 0
        if needed.sum() < 0.9 * len(text):
            at = (np.cumsum(needed) - 1)[at]
            text = text[needed]
        has = sizes > 0
        return Level(text, self.keys[has], np.concatenate([[0], np.cumsum(sizes[has])]), small(at, len(text)), owner)

    def lower(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, span: int) -> np.ndarray:
        """For each window, how many of the level's suffixes come before it, from ``low`` to ``high``: a binary search of all at once."""
        low, high = low.copy(), high.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            mid = (low[todo] + high[todo]) // 2
            less = self.windows(mid, span) < wanted[todo]
            low[todo[less]] = mid[less] + 1
            high[todo[~less]] = mid[~less]


class SuffixIndex:
    """Levels of suffix arrays; :meth:`add` tells for each suffix whether it agrees with any other in ``span`` bytes."""

    def __init__(self, span: int):
        self.span = span
        self.clear()

    def clear(self) -> None:
        self.levels: list[Level] = []
        self.numbers = 0
        self.repeated = np.zeros(0, bool)

    def add(self, strings: list[bytes], keys: list[int] | None = None) -> list[int]:
        """Adds a batch. Returns for each string the number of its first suffix; those of a string are numbered on end. Without ``keys`` all strings have one.

        ``self.repeated[number]`` tells whether a suffix is repeated among all that were added so far.
        """
        span = self.span
        counts = np.array([max(0, len(x) - span + 1) for x in strings], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        base = self.numbers
        self.numbers += int(starts[-1])
        if self.numbers > len(self.repeated):
            self.repeated = np.append(self.repeated, np.zeros(max(self.numbers, 2 * len(self.repeated)) - len(self.repeated), bool))
        numbers = (base + starts[:-1]).tolist()
        if not starts[-1]:
            return numbers
        text = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in strings])])[:-1]
        at = np.arange(starts[-1]) + np.repeat(begin - starts[:-1], counts)
        key = np.repeat(np.array(keys, np.int64) if keys is not None else np.zeros(len(strings), np.int64), counts)
        by_key = np.argsort(key, kind="stable")
        own, edges = np.unique(key[by_key], return_index=True)
        edges = np.append(edges, len(at))
        new = Level(text, own, edges, small(at[by_key], len(text)), small(base + by_key, self.numbers))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            order = a + (np.argsort(new.windows(slice(a, b), span), kind="stable") if b - a <= BLOCK else doubled(text, new.at[a:b], span))
            new.at[a:b], new.owner[a:b] = new.at[order], new.owner[order]
        new = new.kept(self.scan_within(new), span)
        for level in self.levels:
            found = self.scan(level, new)[1]
            if found.any():
                new = new.kept(~found, span)
        while self.levels and len(self.levels[-1].at) <= 2 * len(new.at):
            new = self.merged(self.levels.pop(), new)
        if len(new.at):
            self.levels.append(new)
        return numbers

    def scan_within(self, level: Level) -> np.ndarray:
        """Marks neighbours in order that agree, of one key; returns which suffixes are the first of those that agree."""
        first_of = np.ones(len(level.at), bool)
        for first in range(0, len(level.at) - 1, BLOCK):
            of = np.arange(first, min(first + BLOCK + 1, len(level.at)))
            x = level.windows(of, self.span)
            same = np.flatnonzero(x[1:] == x[:-1])
            same = same[~np.isin(of[same] + 1, level.starts)]
            self.repeated[level.owner[of[same]]] = True
            self.repeated[level.owner[of[same] + 1]] = True
            first_of[of[same] + 1] = False
        return first_of

    def scan(self, level: Level, new: Level) -> tuple[np.ndarray, np.ndarray]:
        """Marks what agrees in two levels; returns where each of ``new`` stands in ``level``, and whether it agrees with what stands there."""
        found = np.zeros(len(new.at), bool)
        place = np.empty(len(new.at), np.int32 if len(level.at) < 1 << 31 else np.int64)
        where = np.searchsorted(level.keys, new.keys)
        for key, i, a, b in zip(new.keys, where.tolist(), new.starts[:-1].tolist(), new.starts[1:].tolist(), strict=True):
            place[a:b] = level.starts[i]
            if i == len(level.keys) or level.keys[i] != key:
                continue
            low, high = int(level.starts[i]), int(level.starts[i + 1])
            for first in range(a, b, BLOCK):
                of = slice(first, min(first + BLOCK, b))
                x = new.windows(of, self.span)
                place[of] = at = level.lower(np.full(len(x), low), np.full(len(x), high), x, self.span)
                inside = np.flatnonzero(at < high)
                same = inside[level.windows(at[inside], self.span) == x[inside]]
                found[first + same] = True
                self.repeated[new.owner[of][same]] = True
                self.repeated[level.owner[at[same]]] = True
        return place, found

    def merged(self, old: Level, new: Level) -> Level:
        """One level of both, none of whose suffixes agree, in order: those of ``new`` go where they stand in ``old``."""
        to = self.scan(old, new)[0].astype(np.int64)
        to += np.arange(len(to))
        total = len(old.at) + len(new.at)
        rest = np.ones(total, bool)
        rest[to] = False
        text = np.concatenate([old.text, new.text])
        at, owner = (np.empty(total, np.int32 if most < 1 << 31 else np.int64) for most in (len(text), self.numbers))
        at[to], owner[to] = new.at, new.owner
        at[to] += len(old.text)
        at[rest], owner[rest] = old.at, old.owner
        keys = np.union1d(old.keys, new.keys)
        sizes = np.zeros(len(keys), np.int64)
        for level in (old, new):
            sizes[np.searchsorted(keys, level.keys)] += np.diff(level.starts)
        return Level(text, keys, np.concatenate([[0], np.cumsum(sizes)]), at, owner)
