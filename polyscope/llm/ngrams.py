"""Hashed character n-grams of batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

from .common import U64, mixed


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each text starts (one more at the end)."""
    raw = [x.encode("utf-32-le", "surrogatepass") for x in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), np.uint32), starts


def hashed(chars: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character (those over a text's end count for no text)."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        code = np.full(n, order, U64)
        for i in range(order):
            code = code * U64(0x100000001B3) + chars[i : i + n]
        return (mixed(code) >> U64(64 - bits)).astype(np.int64)


def spans(starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one n-gram of each text."""
    return starts[:-1], np.maximum(starts[:-1], starts[1:] - order + 1)


class Presence:
    """Tells the distinct buckets of one text after another without sorting: each n-gram writes its number into its bucket's slot, and those whose number stays are one for each bucket."""

    def __init__(self, bits: int):
        self.slot = np.zeros(1 << bits, np.int32)

    def of(self, code: np.ndarray) -> np.ndarray:
        number = np.arange(len(code), dtype=np.int32)
        self.slot[code] = number
        return code[self.slot[code] == number]
