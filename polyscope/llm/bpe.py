"""Byte-level BPE with a compiled lexicon of frequent words; every other word is merged exactly.

The pieces of a text are those of the vocabulary file's own pre-tokenizer. Text between single spaces is cut
first: a space between two characters that aren't white space always starts a piece, so that such stretches
can be looked up whole. Any other text goes through the pattern as one.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import regex
import tiktoken

from .lexicon import Lexicon, compiled

#: The split of byte-level BPE's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches kept by a worker; at this number it forgets them all and goes on.
REMEMBERED = 700_000
#: White space of so many characters is merged by our own loop: a pattern with a look-ahead steps back over it character by character, and that of the Rust path keeps a step of each.
LONG_GAP = 100_000


def byte_of() -> dict[str, int]:
    """The byte for each character in a byte-level vocabulary: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def has_long_gap(text: str) -> bool:
    """Whether a text holds ``LONG_GAP`` characters of white space on end; each character is looked at once."""
    return len(text) >= LONG_GAP and any(len(x[0]) >= LONG_GAP for x in re.finditer(r"\s{64}\s*+", text))


class Vocabulary:
    """The vocabulary and merges of a tokenizers file of byte-level BPE."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without normalizer or prefix space is supported")
        to_byte = byte_of()
        ids = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items()}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges = {}  # pair of ids: (rank, id)
        for rank, (a, b) in enumerate(pairs):
            left, right = (bytes(to_byte[c] for c in x) for x in (a, b))
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        #: Rust merging of a piece, where ids follow the order of merges (the same result as merged(), faster).
        self.fast = None
        if all(new == 256 + rank for rank, new in self.merges.values()) and len(pairs) == len(self.merges) and sorted(self.single) == list(range(256)):
            self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank is merged, leftmost first, until none is left."""
        single, get = self.single, self.merges.get
        ids = [single[b] for b in word]
        if len(ids) > 64:
            return self.merged_long(ids)
        found = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, x in enumerate(found):
                if x is not None and (best is None or x < best):
                    best, at = x, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]))
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]))

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for pieces of any length."""
        import heapq

        get, n = self.merges.get, len(ids)
        before, after, ids = list(range(-1, n - 1)), [*range(1, n), -1], list(ids)
        heap = [(x[0], i, ids[i], ids[i + 1], x[1]) for i in range(n - 1) if (x := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (x := get((ids[k], ids[m]))) is not None:
                    heapq.heappush(heap, (x[0], k, ids[k], ids[m], x[1]))
        return [x for x in ids if x >= 0]


class Encoder:
    """Encodes whole texts; ``raw_lexicon`` holds the compiled frequent words."""

    def __init__(self, vocabulary: Vocabulary, raw_lexicon: bytes | None = None, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.lexicon = Lexicon(raw_lexicon) if raw_lexicon else None
        self.pattern = regex.compile(PATTERN)
        self.shared = list(range(max(vocabulary.bytes_of) + 1))  # one int object for each id
        self.known: dict[str, tuple[int, ...]] = {}
        self.odd: set[str] = set()  # stretches at which white space meets a space

    def piece(self, piece: str) -> list[int]:
        word = piece.encode()
        if len(word) == 1:
            return [self.vocabulary.single[word[0]]]
        ids = self.lexicon.get(word) if self.lexicon else None
        if ids is not None:
            return ids
        if self.vocabulary.fast is None or (len(piece) >= LONG_GAP and piece.isspace()):
            return self.vocabulary.merged(word)
        return self.vocabulary.fast(piece)

    def whole(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.piece(p)]

    def plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        if not text:
            return []
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        distinct = set(rest)
        known = self.known
        new = [x for x in distinct if x not in known]
        if new:
            if len(known) + len(new) > self.remembered:
                known.clear()
                self.odd.clear()
                new = list(distinct)
            shared = self.shared
            for x in new:
                if not x or x[0].isspace() or x[-1].isspace():
                    self.odd.add(x)
                    known[x] = ()
                else:
                    known[x] = tuple([shared[i] for i in self.whole(" " + x)])
        if self.odd and not self.odd.isdisjoint(distinct) or not first or first[-1].isspace():
            return self.whole(text)
        return [*self.whole(first), *chain.from_iterable(map(known.__getitem__, rest))]

    def encode_directly(self, text: str) -> list[int]:
        """The same ids without lexicon, where how words are found doesn't matter."""
        special, fast = self.vocabulary.special, self.vocabulary.fast
        if not fast or has_long_gap(text):
            return self.encode(text)
        if self.vocabulary.split_special is None or not any(x in text for x in special):
            return fast(text)
        return [i for part in self.vocabulary.split_special.split(text) for i in ([special[part]] if part in special else fast(part))]

    def encode(self, text: str) -> list[int]:
        special = self.vocabulary.special
        if self.vocabulary.split_special is None or not any(x in text for x in special):
            return self.plain(text)
        return [i for part in self.vocabulary.split_special.split(text) for i in ([special[part]] if part in special else self.plain(part))]


def lexicon_of(vocabulary: Vocabulary, words: list[str]) -> bytes:
    """The automaton of the pieces that ``words`` have after a space, with the ids that merging gives."""
    pattern = regex.compile(PATTERN)
    pieces = {p.encode() for w in words for p in pattern.findall(" " + w)}
    return compiled({p: tuple(vocabulary.merged(p)) for p in pieces if p})
