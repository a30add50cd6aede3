"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are cut into full sequences and a rest. The rests are dealt into groups at random (a hash of the
document), and each group packs its own, largest first, into the first bin with room; a tree over the bins' free capacity,
each inner node holding the larger of its two, finds that bin in logarithmic time. Bins that stay loose after that are
dissolved: their rests are cut into powers of two, which fit the remaining gaps and one another without loss. Sequences of a
power of two need no padding, so what is left of a group at last does not either, if it is one.

A document that is null or empty is its end token alone. Rows with the same doc_id are documents of their own.
Full sequences go straight to the result; a group holds the sizes of its rests and no token, ``PER_GROUP`` of them on
average. Only doc_id and text are read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, written
from .op2_bpe import encoder_from, encoder_parts

LENGTH, PER_GROUP, LOOSE = 1024, 8_000, 32
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


class Bins:
    """Bins with the first of enough room found by a tournament over their free capacity."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.size = capacity, 1 << max(0, (max(most, 1) - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)
        self.used = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < length:
                at += 1
        offset = self.capacity - tree[at]
        tree[at] -= length
        found = at - self.size
        self.used = max(self.used, found + 1)
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return found, offset


def packed(lengths: list[int], capacity: int = LENGTH, loose: int = LOOSE) -> list[list[tuple[int, int, int, int]]]:
    """For each length its pieces (start, length, bin, offset): whole, or cut if its bin stayed loose."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = Bins(capacity, len(lengths))
    first = {i: bins.put(lengths[i]) for i in order}
    free = [bins.tree[bins.size + b] for b in range(bins.used)]
    # a bin that is a power of two needs no padding either
    open_bins = {b for b, f in enumerate(free) if f > loose and (capacity - f) & (capacity - f - 1)}
    kept = [i for i in order if first[i][0] not in open_bins]
    cut = [i for i in order if first[i][0] in open_bins]
    number: dict[int, int] = {}
    for b in sorted({first[i][0] for i in kept}):
        number[b] = len(number)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for i in kept:
        out[i].append((0, lengths[i], number[first[i][0]], first[i][1]))
    pieces = []
    for i in cut:
        start = 0
        for bit in reversed(range(lengths[i].bit_length())):
            if lengths[i] >> bit & 1:
                pieces.append((1 << bit, i, start))
                start += 1 << bit
    pieces.sort(key=lambda x: -x[0])
    again = Bins(capacity, len(number) + len(cut) + 1)
    for b, n in number.items():
        again.tree[again.size + n] = free[b]
    for at in reversed(range(1, again.size)):
        again.tree[at] = max(again.tree[2 * at], again.tree[2 * at + 1])
    for length, i, start in pieces:
        b, offset = again.put(length)
        out[i].append((start, length, b, offset))
    return out


def power_cuts(length: int) -> list[tuple[int, int]]:
    """(start, length) of the powers of two that make up ``length``, largest first."""
    out, start = [], 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, per_group: int = PER_GROUP, end_id: int = 0, seed: int = 7) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    parts = encoder_parts(docs, path, text, words=0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_from(parts)
        for batch in batches:
            rows = []
            for doc, x, row in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ids = encoder.encode_directly(x)
                ids.append(end_id)
                raw = np.array(ids, "<u4")
                for start in range(0, len(ids) - length + 1, length):
                    rows.append((doc, start, length, zlib.crc32(raw[start : start + length]), len(ids), row, None))
                if rest := len(ids) % length:
                    start = len(ids) - rest
                    crcs = [zlib.crc32(raw[start : start + rest])]
                    crcs += [zlib.crc32(raw[start + s : start + s + n]) for s, n in power_cuts(rest)]
                    rows.append((doc, start, rest, crcs[0], len(ids), row, crcs[1:]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.list_(pa.int64())], strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "cut_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = written(rows.mapInArrow(cut, PIECE + ", cut_crc32 array<long>"), "pieces")
    full = pieces.filter(F.col("cut_crc32").isNull())
    rests = pieces.filter(F.col("cut_crc32").isNotNull())
    groups = max(1, math.ceil(rests.count() / per_group))
    dealt = rests.withColumn("part", F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(groups)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row"], kind="stable").reset_index(drop=True)
        out = []
        for r, found in zip(pdf.itertuples(), packed(pdf["length"].tolist(), length), strict=True):
            at = {s: i for i, (s, _) in enumerate(power_cuts(r.length))} if len(found) > 1 else {}
            for start, n, b, offset in found:
                crc = r.cut_crc32[at[start]] if at else r.ids_crc32
                # groups' sequences lie below zero, full ones above: no number is given twice
                out.append((r.doc_id, r.start + start, n, crc, r.doc_tokens, -1 - (r.part + groups * b), offset))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    loose = dealt.groupBy("part").applyInPandas(fit, schema)
    whole = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(loose)
