"""Filter interaction audit: how much each of several filters removes, alone, after others and in every order.

Exact copies are found in an RDD that is partitioned by texts' xxhash. A partition is a table from fingerprint to a chain of the different texts that have it, each
with its smallest id and the rows that have that id; the bytes decide, so texts of one fingerprint stay apart. A row whose text has a smaller id is not the minimum and fails the last
filter. Before texts move, the same table is kept over stretches of ``HELD_BYTES`` of each input partition: of a text's copies there only those of the smallest id travel with it, the others travel
as an id and a mask, by a hash of the id. So a group of copies that is a third of all documents reaches its partition as a row for each stretch.

Each row gets a mask, one bit for each filter that it fails. Vectors of counts by mask, for all rows, those of good quality and toxic ones, are merged with combineByKey by part of the corpus: 96
numbers a part, in map tasks first. All orders of the filters follow from a part's vectors.

Filters, by letter: A fewer than 200 words; B distinct words fewer than half of them; C more than 2 % of the characters are capitals A to Z; D one of ``#$%&*|``; E the text of a smaller id.
Words are runs of bytes between ASCII white space, case-sensitive.

A null text is empty, a null source the empty string. A row without id neither fails E nor makes others fail. Several rows with one id and one text are no copies of each other. Several labels of an id count if any of them does.
Texts are read whole; other columns are not read. Without documents there is no part, so no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, written

LETTERS = "ABCDE"
COPY = 1 << 4
SYMBOLS = b"#$%&*|"
#: Bytes of texts that a table holds before they move, and that a partition gets.
HELD_BYTES, PARTITION_BYTES = 16 << 20, 32 << 20
CAPITALS = bytes(range(65, 91))
#: Bytes of UTF-8 that begin no character.
CONTINUING = bytes(range(0x80, 0xC0))


def mask_of(raw: bytes) -> int:
    """The filters that a text fails by itself, A to D."""
    words = raw.split()
    code_points = len(raw.translate(None, CONTINUING))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * code_points) << 2 | (symbols > 0) << 3


class Chains:
    """Texts by fingerprint; of each its mask, its smallest id and the parts of the rows with that id."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, raw: bytes, mask: int | None, doc_id: int, parts: Counter) -> Iterator[tuple[int, str, int, int]]:
        """Takes rows in; out go (id, part, mask, rows) of those that are not the minimum."""
        chain = self.of.setdefault(key, [])
        found = next((x for x in chain if x[0] == raw), None)
        if found is None:
            chain.append([raw, mask_of(raw) if mask is None else mask, doc_id, parts])
            self.bytes += len(raw) + 200
        elif doc_id == found[2]:
            found[3] = found[3] + parts
        else:
            more, others = (found[2], found[3]) if doc_id < found[2] else (doc_id, parts)
            if doc_id < found[2]:
                found[2:] = [doc_id, parts]
            for part, n in others.items():
                yield more, part, found[1] | COPY, n

    def minima(self) -> Iterator[tuple[int, bytes, int, int, Counter]]:
        for key, chain in self.of.items():
            for raw, mask, doc_id, parts in chain:
                yield key, raw, mask, doc_id, parts
        self.of, self.bytes = {}, 0


def fingerprint(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw)


def by_id(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode())


def routed(rows: Iterator, held_bytes: int = HELD_BYTES, name=fingerprint) -> Iterator[tuple[int, tuple]]:
    """What moves: (fingerprint, (text, mask, id, parts)) of minima of a stretch, and (a hash of the id, (None, mask, id, parts)) of all other rows."""
    chains = Chains()

    def flush() -> Iterator[tuple[int, tuple]]:
        for key, raw, mask, doc_id, parts in chains.minima():
            yield key, (raw, mask, doc_id, parts)

    for doc_id, text, part in rows:
        raw = (text or "").encode()
        if doc_id is None:
            yield by_id(doc_id), (None, mask_of(raw), None, Counter([part or ""]))
            continue
        for other, of, mask, n in chains.add(name(raw), raw, None, doc_id, Counter([part or ""])):
            yield by_id(other), (None, mask, other, Counter({of: n}))
        if chains.bytes > held_bytes:
            yield from flush()
    yield from flush()


def resolved(pairs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(id, part, mask, rows) of all rows of a partition."""
    chains = Chains()
    for key, (raw, mask, doc_id, parts) in pairs:
        if raw is None:
            for part, n in parts.items():
                yield doc_id, part, mask, n
        else:
            yield from chains.add(key, raw, mask, doc_id, parts)
    for _, _, mask, doc_id, parts in chains.minima():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, mask and rows: the filters that documents fail; rows of one id, part and mask may come as several."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text), F.col(part).cast("string"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    pairs = rows.rdd.mapPartitions(routed).partitionBy(partitions, int)
    return docs.sparkSession.createDataFrame(pairs.mapPartitions(resolved), "doc_id long, part string, mask int, rows long")


def vectors(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> RDD:
    """part and its counts by mask: of all rows, of those labelled good, of those labelled toxic."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = if_small(written(known.filter("good = 1 or toxic = 1"), "audit-labels"))
    rows = found.join(known, "doc_id", "left").select("part", "mask", "rows", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def added(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: added(np.zeros((3, 1 << len(LETTERS)), np.int64), row), added, lambda a, b: a + b)


def audit_rows(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """All orders of the filters over a part's vectors."""
    every = np.arange(1 << len(LETTERS))
    total, good, toxic = counts
    removed_in = {}  # what a filter removes once some others did
    for i in range(len(LETTERS)):
        for before in range(1 << len(LETTERS)):
            fails = every >> i & 1 == 1
            now = fails & (every & before == 0)
            removed_in[i, before] = [int(x[now].sum()) for x in (total, good, toxic)] + [int(total[fails & ~now].sum())]
    orders = list(permutations(range(len(LETTERS))))
    shapley = [sum(removed_in[i, sum(1 << j for j in o[: o.index(i)])][0] for o in orders) for i in range(len(LETTERS))]
    for order in orders:
        before, kept = 0, int(total.sum())
        for step, i in enumerate(order, 1):
            removed, good_lost, toxic_lost, redundant = removed_in[i, before]
            kept, before = kept - removed, before | 1 << i
            yield part, "".join(LETTERS[j] for j in order), step, kept, removed, redundant, int(total[1 << i]), good_lost, toxic_lost, shapley[i]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step."""
    return docs.sparkSession.createDataFrame(vectors(masks(docs, id_col, text, part), labels, id_col).flatMap(lambda x: audit_rows(*x)), SCHEMA)


#: The same rows; every order's steps are worked out from all rows' failures.
SQL = """
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as words from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(words) < 200)::int as a, (100 * len(list_distinct(words)) < 50 * len(words))::int as b,
      (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int as c, regexp_matches(t, '[#$%&*|]')::int as d, coalesce(w.doc_id > min(w.doc_id) over (partition by t), false)::int as e
      from w left join l using (doc_id)),
m as (select part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, a + b + c + d + e as n_fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as y),
o as (select p.y || q.y || r.y || s.y || t.y as filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.y, q.y, r.y, s.y, t.y])) = 5),
k as (select filter_order, step::int as step, filter_order[step] as letter, filter_order[:step - 1] as before from o, range(1, 6) g(step)),
h as (select m.*, k.*, case letter when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end = 1 as here,
      (contains(before, 'A') and fails.A = 1) or (contains(before, 'B') and fails.B = 1) or (contains(before, 'C') and fails.C = 1) or (contains(before, 'D') and fails.D = 1) or (contains(before, 'E') and fails.E = 1) as earlier from m, k),
g as (select part, filter_order, step, letter, coalesce(sum(n) filter (not here and not earlier), 0) as kept, coalesce(sum(n) filter (here and not earlier), 0) as removed, coalesce(sum(n) filter (here and earlier), 0) as redundant,
      coalesce(sum(n) filter (here and n_fails = 1), 0) as unique_fails, coalesce(sum(good) filter (here and not earlier), 0) as good_lost, coalesce(sum(toxic) filter (here and not earlier), 0) as toxic_lost from h group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, letter))::bigint as shapley from g
"""
