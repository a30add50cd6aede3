"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (lower case, cut at ASCII white space; in scripts that are written without spaces, Han, kana, Thai, Lao, Khmer and Burmese, each character is a word; a text of fewer words is one shingle). A shingle weighs its
count times idf, where idf falls from 1 to ``FLOOR``, in ``STEPS`` steps, with the share of documents that have it: the range is narrow, so that a large group of
near copies doesn't lower its members' similarity by its own size. Document frequencies of all documents
are kept for ``2**IDF_BITS`` hashed buckets, which bounds what is broadcast.

``BANDS x ROWS`` weighted samples are drawn from each text, each with random variates of its own for every shingle; equal samples in all rows of a band make candidates. Exact
copies are taken together first. Candidates are verified by exact weighted Jaccard similarity: each band's members against its least
one, and members of a band that are then still in different components against each other, in blocks of bounded size,
so no link is left out within a band and no band's members meet in one task. Links make up classes by connected
components. Up to there only ids and hashes are moved; then the texts of candidates, found by a hash of their ids, are.

A pair at the threshold escapes all bands with a chance of about (1 - 0.8**4)**18 = 8e-5. Null and empty texts, and texts of white space, have no shingles: they link only
with exact copies, if not null. Rows with one doc_id are taken as one document, which is linked if any of its texts is; rows with a null doc_id are returned as a class of their own,
with class_id null. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, added_up, blocks, gathered, met, mixed, written
from .components import components
from .ngrams import Presence
from .op7_suffix import Hasher, utf8

WORDS, SIMILARITY, BANDS, ROWS, IDF_BITS, WIDTH, FLOOR, SEED = 5, 0.8, 18, 4, 20, 4096, 0.8, 11
#: Members of a band, and bytes of their texts, that are compared at a time; buckets of ids by which texts are looked up.
BLOCK, BLOCK_BYTES, BUCKETS = 512, 8 << 20, 1 << 20
VARIATE_BITS = 14
#: Steps of idf.
STEPS = 31


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Whether each byte is the first, and whether it is the last, of a character of a script without spaces; None if there is no such character."""
    # fixed values: the UTF-8 of U+3000 to U+9FFF, of Thai and Lao, of Khmer, of Burmese, and of the planes of rarer Han characters
    high = np.flatnonzero(data >= 0xE0)
    high = high[high + 2 < len(data)]
    if not len(high):
        return None
    a, b = data[high], data[high + 1]
    wide = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    of = (a >= 0xE3) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b == 0x9E) | (b == 0x9F) | (b >= 0x80) & (b <= 0x82)) | wide
    if not of.any():
        return None
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[high[of]] = True
    last[high[of] + 2 + wide[of]] = True
    return first[:-1], last[:-1]


def shingles(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of the rows whose bytes are within ``bounds``; repeats included."""
    with np.errstate(over="ignore"):
        gap = data <= 32
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds[bounds < len(data)]] = True
        begins, ends = np.concatenate([[True], gap[:-1]]) | edge[:-1], np.concatenate([gap[1:], [True]]) | edge[1:]
        found = unspaced(data)
        if found:
            first, last = found
            begins |= first
            begins[1:] |= last[:-1]
            ends |= last
            ends[:-1] |= first[1:]
        start, end = np.flatnonzero(~gap & begins), np.flatnonzero(~gap & ends) + 1
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        s = hasher.sums(data, 0)
        word = mixed((s[end] - s[start]) * hasher.down[start] + (end - start).astype(np.uint64))
        row = np.searchsorted(bounds, start, "right") - 1
        n = len(word) - words + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(words):
            out = mixed(out + word[i : i + len(out)] * U64(2 * i + 3))
        whole = row[: len(out)] == row[words - 1 : words - 1 + len(out)]
        rows, hashes = row[: len(out)][whole], out[whole]
        # rows with fewer words: their words in order
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(first, len(row)))
        few = np.flatnonzero(size < words)
        if len(few):
            more = np.zeros(len(few), np.uint64)
            for i in range(words - 1):
                has = size[few] > i
                more[has] = mixed(more[has] + word[first[few[has]] + i] * U64(2 * i + 3))
            rows, hashes = np.concatenate([rows, row[first[few]]]), np.concatenate([hashes, mixed(more + size[few].astype(np.uint64))])
            order = np.argsort(rows, kind="stable")
            rows, hashes = rows[order], hashes[order]
        return rows, hashes


def runs(texts: pa.Array, hasher: Hasher, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row from there, hash) of the shingles of runs of rows. A row's shingles are never in two runs."""
    data, bounds = utf8(pc.utf8_lower(texts.fill_null("")))
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (1 << 17), "right")) - 1)
        yield row, *shingles(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row], hasher, words)
        row = end


def parts(row: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last-plus-one place of each row in ``row``, which is in order."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    return zip(first.tolist(), np.append(first[1:], len(row))[: len(first)].tolist(), strict=True)


def counted(texts: pa.Array, hasher: Hasher, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, distinct hash, count) in order of both, of runs of rows. A row's shingles are never in two runs."""
    for row, r, h in runs(texts, hasher, words):
        h = h.copy()
        for a, b in parts(r):
            h[a:b].sort()
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])[: len(r)])
        yield r[new] + row, h[new], np.diff(np.append(new, len(r)))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def idf_of(docs: DataFrame, bits: int, words: int, floor: float) -> np.ndarray:
    """The idf of each bucket, from all documents; ``docs``: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, distinct, counts = Hasher(), Presence(bits), np.zeros((1 << bits) + WIDTH, np.int64)
        for batch in batches:
            counts[1 << bits] += batch.num_rows
            for _, r, h in runs(batch.column(0), hasher, words):
                code = bucket(h, bits)
                for a, b in parts(r):
                    counts[distinct.of(code[a:b])] += 1
        yield blocks(counts, WIDTH)

    got = gathered(added_up(docs.select("text").mapInArrow(count, "block long, counts binary"), WIDTH), (1 << bits) + WIDTH, WIDTH)
    df, n = np.maximum(got[: 1 << bits], 1), got[1 << bits]
    share = np.log((n + 1) / np.minimum(df, n + 1)) / np.log(n + 2)
    return (floor + (1 - floor) * np.round(share * STEPS) / STEPS).astype(np.float32)


class Sampler:
    """Improved consistent weighted samples. The variates r, c and beta of a shingle in a sample are one of 2**VARIATE_BITS drawn triples, picked by a hash of the shingle that each sample has of its own.

    Of shingles that a sample gives one triple and that weigh the same, the least hash wins, in every text alike. For ``levels``, weights that most shingles have, what a
    triple comes to is worked out beforehand.
    """

    def __init__(self, samples: int, seed: int = SEED, levels: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.factor = (rng.integers(0, 1 << 63, samples, np.uint64) * U64(2) + U64(1))[:, None]
        r, c = (rng.gamma(2, 1, 1 << VARIATE_BITS) for _ in range(2))
        beta = rng.random(1 << VARIATE_BITS)
        # ln a = ln c - r (t - beta + 1) with t = floor(ln w / r + beta)
        self.r, self.beta, self.base = (x.astype(np.float32) for x in (r, beta, np.log(c) + r * beta - r))
        self.levels = np.zeros(0) if levels is None else levels
        t = np.floor(np.log(self.levels).astype(np.float32)[:, None] / self.r + self.beta)
        self.t, self.a = t.ravel(), (self.base - self.r * t).ravel()
        #: Shingles at a time; what is computed for them stays in the processor's cache.
        self.width, self.shift, self.row = 256, U64(64 - VARIATE_BITS), np.arange(samples)
        self.space = [np.empty(samples * self.width, kind) for kind in (np.int64, np.float32, np.float32, np.float32)]

    def least(self, h: np.ndarray, of: np.ndarray, known: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least ln a of each sample, with its shingle's hash and t; ``of`` are the levels' numbers of known weights, and ln w of others."""
        best, samples = None, len(self.row)
        width = -(-len(h) // -(-len(h) // self.width))
        for first in range(0, len(h), width):
            last = min(first + width, len(h))
            place, r, t, a = (x[: samples * (last - first)].reshape(samples, last - first) for x in self.space)
            z = place.view(np.uint64)
            np.multiply(h[first:last], self.factor, out=z)
            np.right_shift(z, self.shift, out=z)
            if known:
                np.add(place, of[first:last] << VARIATE_BITS, out=place)
                self.a.take(place, out=a, mode="clip")
                at = a.argmin(axis=1)
                found = a[self.row, at], h[first:last][at], self.t[place[self.row, at]]
            else:
                self.r.take(place, out=r, mode="clip")
                self.beta.take(place, out=a, mode="clip")
                np.divide(of[first:last], r, out=t)
                np.add(t, a, out=t)
                np.floor(t, out=t)
                self.base.take(place, out=a, mode="clip")
                np.multiply(r, t, out=r)
                np.subtract(a, r, out=a)
                at = a.argmin(axis=1)
                found = a[self.row, at], h[first:last][at], t[self.row, at]
            best = found if best is None else self.lower(best, found)
        return best

    @staticmethod
    def lower(one: tuple, other: tuple) -> tuple:
        less = (other[0] < one[0]) | (other[0] == one[0]) & (other[1] < one[1])
        return tuple(np.where(less, x, y) for x, y in zip(other, one, strict=True))

    def draw(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A 64-bit name for each sample of one text; ``h`` in ascending order, so that ties go to the least."""
        if len(self.levels):
            level = np.minimum(np.searchsorted(self.levels, weight), len(self.levels) - 1)
            known = self.levels[level] == weight
        else:
            known = np.zeros(len(h), bool)
        found = []
        if known.any():
            found.append(self.least(h[known], level[known], True))
        if not known.all():
            found.append(self.least(h[~known], np.log(weight[~known]).astype(np.float32), False))
        _, at, t = found[0] if len(found) == 1 else self.lower(*found)
        return mixed(at + t.astype(np.int64).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes in order, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0]
    common = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def weighed(texts: pa.Array, idf: np.ndarray, bits: int, words: int, hasher: Hasher) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes in order, weights) of each text's shingles."""
    out = [(np.zeros(0, np.uint64), np.zeros(0))] * len(texts)
    for r, h, n in counted(texts, hasher, words):
        weight = n * idf[bucket(h, bits)].astype(np.float64)
        for a, b in parts(r):
            out[r[a]] = h[a:b], weight[a:b]
    return out


class Weigher:
    """Texts as weighted shingles, of which the last few are kept."""

    def __init__(self, idf: np.ndarray, bits: int, words: int):
        self.idf, self.bits, self.words, self.hasher = idf, bits, words, Hasher()
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, key: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.kept:
            if len(self.kept) >= 256:
                self.kept.clear()
            self.kept[key] = weighed(pa.array([text], pa.string()), self.idf, self.bits, self.words, self.hasher)[0]
        return self.kept[key]


def alike(vectors: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, component: np.ndarray, bands: np.ndarray, band: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows, one of side 0 and one of side 1, that are in different components, alike, and have no band in common that is less than ``band``.

    Linked ones are joined as they are found, so what is one component already isn't told again. One row is compared with all others at once.
    ``bands`` has a row for each text, of zeros where nothing is known of it.
    """
    size = np.array([len(h) for h, _ in vectors])
    rows = np.flatnonzero(size > 0)
    if not len(rows):
        return []
    # side 1 first: one run of columns
    rows = rows[np.argsort(side[rows], kind="stable")[::-1]]
    _, col = np.unique(np.concatenate([vectors[i][0] for i in rows]), return_inverse=True)
    weight = np.concatenate([vectors[i][1] for i in rows])
    start = np.concatenate([[0], np.cumsum(size[rows])])
    total = np.add.reduceat(weight, start[:-1])
    group, bands, dense, out = component[rows].copy(), bands[rows], np.zeros(col.max() + 1), []
    ones = int(side[rows].sum())
    own = np.repeat(np.arange(ones), size[rows[:ones]])
    for i in range(ones, len(rows)):
        others = (group[:ones] != group[i]) & (np.minimum(total[:ones], total[i]) >= similarity * np.maximum(total[:ones], total[i]) * (1 - 1e-9))
        at = np.flatnonzero(others)
        same = (bands[at] == bands[i]) & (bands[at] != 0)
        at = at[~(same & (bands[at] < band)).any(axis=1)]
        if not len(at):
            continue
        mine = slice(start[i], start[i + 1])
        dense[col[mine]] = weight[mine]
        if len(at) * 4 < ones:
            common = np.array([np.minimum(dense[col[x]], weight[x]).sum() for x in (slice(start[j], start[j + 1]) for j in at)])
        else:
            common = np.bincount(own, np.minimum(dense[col[: start[ones]]], weight[: start[ones]]), minlength=ones)[at]
        dense[col[mine]] = 0
        for j in at[common >= similarity * (total[i] + total[at] - common) * (1 - 1e-9)].tolist():
            if group[j] != group[i] and jaccard(vectors[rows[i]], vectors[rows[j]]) >= similarity:
                group[group == group[j]] = group[i]
                out.append((int(rows[i]), int(rows[j])))
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, whose rows follow each other; the first ``keys`` columns tell groups apart."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in batch.columns[:keys]:
            x = c.to_numpy(zero_copy_only=False)
            changed |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def texts_of(named: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose doc_id is in ``ids``, once for each text. Rows whose ids' hashes are in no bucket of a wanted one don't move; the broadcast has at most BUCKETS rows."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).alias("bucket")
    wanted = written(ids.select(at("doc_id")).distinct(), "buckets")
    near = named.withColumn("bucket", at("doc_id")).join(F.broadcast(wanted), "bucket", "left_semi").drop("bucket")
    return written(near.join(ids.distinct(), "doc_id", "left_semi").distinct(), "texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, bits: int = IDF_BITS, floor: float = FLOOR) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and kept (that of the class); one row for each row of ``docs``."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = base.filter("doc_id is not null")
    idf = spark.sparkContext.broadcast(idf_of(base, bits, words, floor))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, same, size, bands. Equal texts of a batch are sampled once."""
        hasher, sampler, key0 = Hasher(), Sampler(bands * rows, levels=np.unique(idf.value).astype(np.float64)), np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            out: list[np.ndarray | None] = [None] * len(coded.dictionary)
            for r, h, n in counted(coded.dictionary, hasher, words):
                weight = n * idf.value[bucket(h, bits)]
                for a, b in parts(r):
                    name, key = sampler.draw(h[a:b], weight[a:b]).reshape(bands, rows), key0
                    for i in range(rows):
                        key = mixed(key + name[:, i])
                    out[r[a]] = key.view(np.int64)
            of = [None if i is None else out[i] for i in coded.indices.to_pylist()]
            size = pc.binary_length(batch.column(2)).cast(pa.int64()).fill_null(0)
            yield pa.record_batch([batch.column(0), batch.column(1), size, pa.array(of, pa.list_(pa.int64()))], names=["doc_id", "same", "size", "bands"])

    # exact copies, and the several rows of a doc_id, are one node: the least doc_id of the text
    same = F.unhex(F.md5(F.coalesce(F.col("text"), F.concat(F.lit("\0null"), F.col("doc_id").cast("string")))))
    signed = written(named.select("doc_id", same.alias("same"), "text").mapInArrow(sample, "doc_id long, same binary, size long, bands array<long>"), "signed")
    nodes = written(signed.groupBy("same").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n")), "nodes")
    copies = written(met(signed.select("doc_id", "same"), nodes.filter("node < last").select("same", "node", "n"), ["same"]).filter("doc_id <> node").select("doc_id", "node"), "copies")

    marks = nodes.filter("bands is not null").select("node", "size", F.explode("bands").alias("band"))
    hubs = marks.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("high")).filter("hub < high").select("band", "hub")
    shared = written(marks.join(hubs, "band"), "shared")
    involved = texts_of(named, shared.select(F.col("node").alias("doc_id")))

    # each band's members against its least one: a hub's members are dealt into blocks, and the hub's text comes first in each
    pairs = written(shared.filter("node <> hub").groupBy("hub", "node").agg(F.max("size").alias("size")), "pairs")
    spread = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("long")
    of_hub = pairs.groupBy("hub").agg(spread(F.count("*"), F.sum("size")).alias("k"))
    members = pairs.join(of_hub, "hub").select(F.col("node").alias("doc_id"), "hub", F.pmod(F.xxhash64("node"), "k").alias("part"), F.lit(1).alias("side"))
    heads = of_hub.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"), F.lit(0).alias("side"))
    asked = members.unionByName(heads).join(involved, "doc_id").select("hub", "part", "side", "doc_id", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows in order of hub, part and side."""
        hasher, now, own = Hasher(), None, []
        for batch in batches:
            good = []
            vectors = weighed(batch.column(4), idf.value, bits, words, hasher)
            for hub, part, side, node, x in zip(*(c.to_pylist() for c in batch.columns[:4]), vectors, strict=True):
                if (hub, part) != now:
                    now, own = (hub, part), []
                if not side:
                    own.append((x[0].copy(), x[1].copy()))
                elif any(jaccard(y, x) >= similarity for y in own):
                    good.append((node, hub))
            yield pa.record_batch([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = written(asked.repartition("hub", "part").sortWithinPartitions("hub", "part", "side").mapInArrow(verify, "a long, b long"), "near")

    # what is in one band but in different components is compared in blocks: the members of all components but the largest with all members,
    # once for each set of members, and two texts in the least band that they have in common
    found = written(components(links), "components")
    placed = written(shared.select("band", "node", "size").join(found.withColumnRenamed("component", "c"), "node", "left").select("band", "node", "size", F.coalesce("c", "node").alias("c")), "placed")
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    each = placed.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), mark(0).alias("x"), mark(1).alias("y"))
    sets = each.groupBy("band").agg(F.max_by("c", "n").alias("major"), F.count("*").alias("parts"), F.max("n").alias("most"), F.max_by("bytes", "n").alias("most_bytes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    split = sets.filter("parts > 1 and n > 2").groupBy("n", "bytes", "x", "y").agg(F.min("band").alias("band"), F.min_by(F.struct("major", "most", "most_bytes"), "band").alias("m"))
    split = split.select("band", "m.major", spread(F.col("n") - F.col("m.most"), F.col("bytes") - F.col("m.most_bytes")).alias("minors"), spread(F.col("n"), F.col("bytes")).alias("all"))
    of_band = placed.join(split, "band")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of_side = lambda side, i, j: of_band.filter(F.lit(True) if side else F.col("c") != F.col("major")).select("band", "node", "c", F.lit(side).alias("side"), i.alias("i"), "minors", "all").withColumn("j", j).select("band", "i", "j", "side", "node", "c")
    block = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
    dealt = of_side(0, block("minors"), upto("all")).unionByName(of_side(1, upto("minors"), block("all")))
    known = nodes.filter("bands is not null").groupBy("node").agg(F.when(F.count("*") == 1, F.first("bands")).alias("bands"))  # of ids with several texts none
    dealt = dealt.join(known, "node").withColumnRenamed("node", "doc_id").join(involved, "doc_id").select("band", "i", "j", "side", "doc_id", "c", "bands", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows in order of band and blocks."""
        hasher = Hasher()
        for table in grouped(batches, 3):
            side, node, c = (table.column(x).to_numpy() for x in ("side", "doc_id", "c"))
            vectors = weighed(table.column("text").combine_chunks(), idf.value, bits, words, hasher)
            of = np.array([x or [0] * bands for x in table.column("bands").to_pylist()], np.int64)
            got = alike(vectors, side, c, of, table.column("band")[0].as_py(), similarity)
            if got:
                yield pa.record_batch([pa.array(node[[g[i] for g in got]]) for i in (0, 1)], names=["a", "b"])

    more = written(dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(compare, "a long, b long"), "more")
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    classes = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    out = base.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
