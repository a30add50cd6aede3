"""A minimal acyclic automaton of words with token ids as outputs, in flat arrays that can be memory-mapped.

States that accept the same suffixes are one state. Each arc carries how many words come before it in sorted
order, so that a word's path adds up to its rank (minimal perfect hashing), and the rank selects its ids.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping

import numpy as np


def compiled(words: Mapping[bytes, tuple[int, ...]]) -> bytes:
    """The automaton of ``words`` as bytes (incremental construction from sorted words)."""
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[dict[int, int]] = []

    def frozen(node: list) -> int:
        """The number of the state equal to ``node`` = [final, {byte: state}]."""
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(final)
            final.append(node[0])
            arcs.append(dict(node[1]))
        return register[key]

    path: list[list] = [[False, {}]]  # of the last word; not frozen yet
    last = b""
    ordered = sorted(words)
    for word in ordered:
        same = len(os.path.commonprefix([last, word]))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = frozen(node)
        for _ in word[same:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = frozen(node)
    root = frozen(path[0])

    below = [0] * len(final)  # states are numbered children first
    for s, out in enumerate(arcs):
        below[s] = final[s] + sum(below[t] for t in out.values())
    first = np.zeros(len(arcs) + 1, np.int32)
    first[1:] = np.cumsum([len(x) for x in arcs])
    label, to, skip = (np.zeros(first[-1], np.int32) for _ in range(3))
    for s, out in enumerate(arcs):
        before = int(final[s])
        for i, (byte, t) in enumerate(sorted(out.items()), first[s]):
            label[i], to[i], skip[i] = byte, t, before
            before += below[t]
    ids = [words[w] for w in ordered]
    start = np.zeros(len(ids) + 1, np.int32)
    start[1:] = np.cumsum([len(x) for x in ids])
    parts = [np.array([root], np.int32), first, label, to, skip, np.array(final, np.int32), start, np.array([i for x in ids for i in x], np.int32)]
    return np.array([len(p) for p in parts], np.int32).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Looks words up in a compiled automaton, which is mapped from a file that is already unlinked."""

    def __init__(self, raw: bytes):
        handle, path = tempfile.mkstemp(suffix=".fst")
        with os.fdopen(handle, "wb") as out:
            out.write(raw)
        mapped = np.memmap(path, np.int32, mode="r")
        os.unlink(path)
        at, parts = 8, []
        for n in mapped[:8].tolist():
            parts.append(mapped[at : at + n])
            at += n
        root, first, label, to, skip, final, self.start, self.ids = parts
        self.root, self.states = int(root[0]), len(final)
        # memoryviews of the mapped arrays: their items come out as plain ints
        self.first, self.label, self.to, self.skip, self.final = (memoryview(x) for x in (first, label, to, skip, final))

    def __len__(self) -> int:
        return len(self.start) - 1

    def rank(self, word: bytes) -> int:
        """The word's place in sorted order, or -1."""
        first, label, to, skip = self.first, self.label, self.to, self.skip
        s, rank = self.root, 0
        for byte in word:
            low, high = first[s], first[s + 1]
            while low < high:
                mid = (low + high) >> 1
                if label[mid] < byte:
                    low = mid + 1
                else:
                    high = mid
            if low == first[s + 1] or label[low] != byte:
                return -1
            rank += skip[low]
            s = to[low]
        return rank if self.final[s] else -1

    def get(self, word: bytes) -> list[int] | None:
        rank = self.rank(word)
        return None if rank < 0 else self.ids[self.start[rank] : self.start[rank + 1]].tolist()
