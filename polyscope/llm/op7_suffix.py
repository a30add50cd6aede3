"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

Every byte covered by a string of ``span`` bytes that also starts elsewhere goes. Which windows of ``span`` bytes repeat is found so:

1. A window's key is the least hash of its ``GRAM``-byte strings, so equal windows have equal keys, and keys route windows to shards. Neighbouring windows with
   one key form a run; runs come to about one for 80 bytes. Runs whose key comes only once can't repeat and stay where they are.
2. The bytes of all others go to their key's shard, batch by batch. Of equal strings one goes on: the others repeat as a whole, and it does too. Where a key has
   several strings, or one in which the key's bytes recur, they go into the shard's family of suffix arrays (suffix_index): a batch of them
   (of bounded bytes) gets a suffix array, ordered by key and bytes, is merge-scanned against the levels for windows that agree in all ``span`` bytes, and becomes a level; levels of about equal size merge.
   All of this compares bytes; hashes only route.
3. Each document drops the union of its repeated windows.

Documents are packed into chunks, so a text moves compressed, and by its chunk's id. A chunk that holds a string more than once passes one row for it on, so a passage's copies don't meet in one task. Null
texts are empty; texts shorter than ``span`` lose nothing; long texts are hashed a segment at a time. Rows with one doc_id are documents of their own, so
a repeated row is a repeat. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, mixed, nullable, packed, unpacked, written
from .suffix_index import SuffixIndex

SPAN, GRAM, SEGMENT, PLACE_BITS, BATCH = 200, 40, 1 << 19, 20, 1024
#: Bytes of texts in a chunk, and of strings in a shard.
CHUNK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
#: Bytes of strings that go into a shard's family at a time, and of different strings of a key that are told apart before.
BATCH_BYTES = 4 << 20
#: A run: how often its string comes in its chunk (0: it repeats, as an equal one there goes on), its first and last window in the chunk's bytes, and whether the key's bytes recur in it.
RUN = ["route", "n", "chunk", "lo", "hi", "own"]

_random = np.random.default_rng(20240607)
#: Two tables of random odd values for bytes, and the base of the rolling hash with its inverse modulo 2**64.
BYTES = [_random.integers(0, 1 << 63, 256, np.uint64) * U64(2) + U64(1) for _ in range(2)]
BASE = int(_random.integers(1 << 62, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of substrings from sums of byte values times powers, modulo 2**64."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, SEGMENT), powers(INVERSE, SEGMENT)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[which][data] * self.up[: len(data)], out=out[1:])
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs_of(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the runs of windows within [bounds[i], bounds[i+1]): key, fingerprint, first and last window start (in ``data``), and whether
    the key's string comes up more than once there, as it must where a run's own windows repeat.

    Of several least hashes the leftmost and the rightmost are found, by their places in the low bits.
    """
    if len(data) < span:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    with np.errstate(over="ignore"):
        s = hasher.sums(data, 0)
        n = len(data) - gram + 1
        g, place, low = mixed((s[gram:] - s[:-gram]) * hasher.down[:n]), np.arange(n, dtype=np.uint64), U64((1 << PLACE_BITS) - 1)
        left = sliding_min(g & ~low | place, span - gram + 1) & low
        right = low - (sliding_min(g & ~low | (low - place), span - gram + 1) & low)
        key = g[left.astype(np.int64)]
        size = np.diff(bounds)
        doc = np.repeat(np.arange(len(size)), size)
        inside = np.flatnonzero(doc[: len(key)] == doc[span - 1 : span - 1 + len(key)])
        if not len(inside):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        k, d = key[inside], doc[inside]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
        lo, hi = inside[new], inside[np.append(new[1:], len(inside)) - 1]
        s = hasher.sums(data, 1)
        fp = mixed((s[hi + span] - s[lo]) * hasher.down[lo] + (hi - lo).astype(np.uint64))
    return k[new].view(np.int64), fp.view(np.int64), lo, hi, (left[lo] != right[hi]).astype(np.int64)


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null as empty."""
    values = values.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(bounds: np.ndarray, span: int, most: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first byte, bounds) of stretches of about ``most`` bytes. A longer row is cut; its cuts share span - 1 bytes, so every window lies in one."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1
        if end > row:
            yield row, int(bounds[row]), bounds[row : end + 1]
            row = end
            continue
        for first in range(int(bounds[row]), max(int(bounds[row + 1]) - span + 1, int(bounds[row]) + 1), most):
            yield row, first, np.array([first, min(first + most + span - 1, int(bounds[row + 1]))])
        row += 1


def runs_in(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, span: int, gram: int) -> list[np.ndarray]:
    """RUN without chunk, of a chunk's texts. Equal strings, found by fingerprint and compared by bytes, leave one with n = 2."""
    got = []
    for _, first, own in segments(bounds, span):
        key, fp, lo, hi, recurs = runs_of(data[own[0] : own[-1]], own - own[0], hasher, span, gram)
        got.append((key, fp, lo + first, hi + first, recurs))
    key, fp, lo, hi, recurs = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 5
    n, route = np.ones(len(key), np.int64), key.copy()
    order = np.lexsort((fp, key))
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(fp[order]) != 0)])[: len(order)])
    ends = np.append(starts[1:], len(order))
    several = np.flatnonzero(ends - starts > 1)
    raw = data.tobytes() if len(several) else b""
    for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
        group = order[a:b].tolist()
        string = raw[lo[group[0]] : hi[group[0]] + span]
        for i in group[1:]:
            if raw[lo[i] : hi[i] + span] == string:
                n[i], n[group[0]] = 0, 2
    route[n == 0] = mixed(lo[n == 0].astype(np.uint64)).view(np.int64)  # decided: it goes anywhere
    return [route, n, lo, hi, recurs]


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams runs in order of route, and drops those of keys that come once and don't recur."""
    held, going = np.zeros((len(RUN), 0), np.int64), None
    for batch in batches:
        x = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        if not x.shape[1]:
            continue
        starts = np.flatnonzero(np.concatenate([[True], np.diff(x[0]) != 0]))
        size = np.diff(np.append(starts, x.shape[1]))
        many = np.add.reduceat(x[1], starts) > 1
        if going is not None and x[0, 0] == going:
            many[0] = True
        # of the last key a single run waits for what the next batch has; others go on
        wait = 0 if many[-1] else int(size[-1])
        going = int(x[0, -1]) if many[-1] else None
        keep = np.repeat(many, size) | (x[1] == 0) | (x[5] == 1)
        if wait:
            keep[-wait:] = False
        held = x[:, x.shape[1] - wait :]
        if keep.any():
            yield pa.record_batch([pa.array(c) for c in x[:, keep]], names=RUN)
    rest = held[:, (held[1] == 0) | (held[5] == 1)]
    if rest.shape[1]:
        yield pa.record_batch([pa.array(c) for c in rest], names=RUN)


def search(batches: Iterator[pa.RecordBatch], span: int = SPAN, size: int = BATCH, index: SuffixIndex | None = None) -> Iterator[pa.RecordBatch]:
    """Streams the strings of a shard (route, n, chunk, lo, own, bytes) in order of route. Out: chunk, lo, hi of the windows that repeat."""
    index = index or SuffixIndex(span)
    queue: list[tuple[bytes, bool, int, int, int]] = []  # strings to be added: bytes, whether known to repeat as a whole, chunk, lo, key
    added: list[tuple[int, int, int, int]] = []  # number of the first suffix, windows, chunk, lo, of strings not known to
    group: dict[bytes, list] = {}  # of the key at hand: whether it repeats, chunk, lo, own
    now, out, spilled, held, waiting = None, [], False, 0, 0  # whether the key has strings in the family; bytes of its others, and of the queue

    def add() -> None:
        nonlocal waiting
        waiting = 0
        for first, (raw, whole, chunk, lo, _) in zip(index.add([x[0] for x in queue], [x[4] for x in queue]), queue, strict=True):
            if not whole:
                added.append((first, len(raw) - span + 1, chunk, lo))
        queue.clear()

    def finish() -> None:
        """Passes the key's strings on, if they may hold windows that others have; equal ones that come later are found there."""
        nonlocal held, waiting
        for raw, (whole, chunk, lo, own) in group.items():
            if whole:
                out.append((chunk, lo, lo + len(raw) - span))
            if len(group) > 1 or spilled or own and not whole:
                queue.append((raw, whole, chunk, lo, now))
                waiting += len(raw)
                if len(queue) >= size or waiting >= BATCH_BYTES:
                    add()
        group.clear()
        held = 0

    def batch_of() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["chunk", "lo", "hi"])
            out.clear()

    for batch in batches:
        for route, n, chunk, lo, own, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if route != now:
                finish()
                now, spilled = route, False
            seen = group.get(raw)
            if seen is None:
                if held + len(raw) > BATCH_BYTES and len(group) > 1:
                    finish()
                    spilled = True
                group[raw] = [n > 1, chunk, lo, own]
                held += len(raw)
            else:
                seen[0] = True
                out.append((chunk, lo, lo + len(raw) - span))
        yield from batch_of()
    finish()
    if queue:
        add()
    for first, windows, chunk, lo in added:
        flags = np.concatenate([[False], index.repeated[first : first + windows], [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        out += [(chunk, lo + int(a), lo + int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    yield from batch_of()
    pa.default_memory_pool().release_unused()


def repeated_windows(chunks: DataFrame, span: int = SPAN, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, size: int = BATCH) -> DataFrame:
    """chunk, lo, hi: first and last start, in the chunk's bytes, of windows that repeat."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                route, n, lo, hi, own = runs_in(*utf8(unpacked(raw).column("text").combine_chunks()), hasher, span, gram)
                for first in range(0, len(route), 1 << 17):
                    part = slice(first, first + (1 << 17))
                    yield pa.record_batch([pa.array(x[part]) for x in (route, n, np.full(len(route), chunk), lo, hi, own)], names=RUN)
        pa.default_memory_pool().release_unused()  # a worker stays for later tasks

    schema = ", ".join(f"{c} long" for c in RUN)
    found = chunks.select("chunk", "rows").mapInArrow(runs, schema)
    kept = written(found.repartition("route").sortWithinPartitions("route").mapInArrow(candidates, schema), "runs")
    asked = kept.filter("n > 0")
    total = asked.agg(F.sum(F.col("hi") - F.col("lo") + span)).first()[0] or 0

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of a chunk's runs."""
        names = ["route", "n", "chunk", "lo", "own"]
        strings: list[bytes] = []
        if left.num_rows and right.num_rows:
            raw = utf8(unpacked(left.column("rows")[0]).column("text").combine_chunks())[0].tobytes()
            strings = [raw[a : b + span] for a, b in zip(right.column("lo").to_pylist(), right.column("hi").to_pylist(), strict=True)]
        return right.select(names).append_column("bytes", pa.array(strings, pa.binary()))

    strings = chunks.select("chunk", "rows").groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(cut, "route long, n long, chunk long, lo long, own long, bytes binary")
    shards = max(1, -(-total // shard_bytes))
    partial = strings.repartition(shards, "route").sortWithinPartitions("route").mapInArrow(lambda batches: search(batches, span, size), "chunk long, lo long, hi long")
    return kept.filter("n = 0").select("chunk", "lo", "hi").unionByName(partial)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, keep_text: bool = False, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, size: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also ``kept``, the text that is left
    (without characters of which some bytes are gone), and the document's other columns as ``doc``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("doc")] if keep_text else []))
    if keep_text:
        rows = rows.withColumn("doc", F.col("doc").cast(nullable(rows.schema["doc"].dataType)))
    chunks = packed(rows, chunk_bytes)
    marks = repeated_windows(chunks, span, gram, shard_bytes, size)

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        table = unpacked(left.column("rows")[0])
        data, bounds = utf8(table.column("text").combine_chunks())
        lo, end = right.column("lo").to_numpy(), right.column("hi").to_numpy() + span
        order = np.argsort(lo, kind="stable")
        lo, end = lo[order], np.maximum.accumulate(end[order]) if len(lo) else end
        row = np.searchsorted(bounds, lo, "right") - 1  # of rows that start at one byte the last: the others are empty
        new = np.flatnonzero(np.concatenate([[True], (lo[1:] > end[:-1]) | (row[1:] != row[:-1])])[: len(lo)])
        first, last, row = lo[new], end[np.append(new[1:], len(lo)) - 1] if len(lo) else end, row[new]
        spans = np.bincount(row, minlength=len(bounds) - 1)
        removed = np.bincount(row, last - first, minlength=len(bounds) - 1).astype(np.int64)
        kept, at = [], 0
        for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), spans.tolist(), strict=True):
            edges = [a, *np.stack([first[at : at + n], last[at : at + n]], axis=1).ravel().tolist(), b]
            kept.append(b"".join(data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            at += n
        out = {"doc_id": table.column("id"), "n_bytes": pa.array(np.diff(bounds).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if keep_text:
            out |= {"kept": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), "doc": table.column("doc")}
        return pa.table(out)

    schema = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept", "string").add("doc", rows.schema["doc"].dataType)
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(drop, schema)
