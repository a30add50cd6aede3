"""Prefix trie of conversations: which first turns conversations share, and what sharing them would save.

A conversation's first d turns have a digest, two exclusive-ors of 64-bit hashes of each turn with its place, so that digests of all prefixes are running
values over turns in order (:func:`ordered.running`). The smallest conv_id of the conversations that share a prefix owns its node. Who owns a prefix owns all longer
ones of its own turns, so each conversation's first owned depth is found by binary search: each round joins one digest of every conversation with the minima of those prefixes that several conversations
share, and keeps the half of its prefixes that is still in question. The last prefix that was looked at and isn't owned names what the conversation hangs on.

Nodes that one conversation owns are a chain, and the chains are the tree. Chains on which no other hangs hand their totals over to the prefix they hang on and leave, round by round, up to the root; running sums from
each chain's end give all its nodes' totals. Rounds are as many as chains hang on each other.

Prefixes are looked at in segments of ``SPAN``, first by the segments' ends, so no row holds a long conversation's. Conversations that end at one node are listed in runs of ``RUN`` ids, in
order, and then digested as the runs stream by.

Turns are in order of turn (null first), role and text; a null role or text is empty. Rows without conv_id belong to no conversation. Several equal rows are several turns. Texts are hashed whole; other
columns are not read, and an empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, written
from .ordered import running

SPAN, RUN = 1024, 4096


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, at, x, y, bytes: the turns of conversations in order, by their hashes."""
    said = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # texts move only where the order depends on them
    tied = if_small(written(said.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c__"), F.col("turn").alias("t__"), F.lit(True).alias("tied")), "tied"))
    said = said.join(tied, (F.col("conv_id") == F.col("c__")) & F.col("turn").eqNullSafe(F.col("t__")), "left")
    by_text = F.when(F.col("tied"), F.col("text"))
    hashed = said.select("conv_id", "turn", F.when(F.col("tied"), F.col("role")).alias("role"), by_text.alias("text"), F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y"), F.octet_length("text").cast("long").alias("bytes"))
    return running(hashed, "conv_id", [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]).select("conv_id", "at", "x", "y", "bytes")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, d, x, y, bytes of every prefix of every conversation, the empty one included: its digest and the bytes of its last text. ``rows``: conv_id, at, x, y, bytes, and ``convs`` all conv_ids."""
    placed = rows.select("conv_id", "at", F.xxhash64(F.lit(3), "at", "x").alias("x"), F.xxhash64(F.lit(4), "at", "y").alias("y"), "bytes").withColumnRenamed("at", "place")
    return running(placed, "conv_id", [F.col("conv_id"), F.col("place")], xors=("x", "y")).select("conv_id", (F.col("at") + 1).alias("d"), "x", "y", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, m: number of turns) and their turns, where each begins with the first h turns of conversation c - c % 5 and goes on with its own from the h-th on; h = crc32(c) % 9."""
    at = written(turns(rows), "turns")
    own = written(at.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    c = F.col("conv_id")
    convs = own.select("conv_id", "n", (c - c % 5).alias("base"), F.when(c % 5 == 0, F.lit(0)).otherwise(F.crc32(c.cast("string").cast("binary")) % 9).alias("h"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")), "conversations")
    head = at.filter("at < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base").join(convs.filter("taken > 0"), "base").filter("at < taken")
    tail = at.join(if_small(convs), "conv_id").filter("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "at", "x", "y", "bytes"]
    return convs.select("conv_id", "m"), head.select(*columns).unionByName(tail.select(*columns))


def first_owned(state: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id, first (the least depth of ``steps`` that the conversation owns, null for none), parent (owner of the greatest depth of them that it doesn't own). ``state``: conv_id and steps (d, x, y) in order."""
    rows = state.select("conv_id", "steps", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("parent"))
    done = []
    while True:
        rows = written(rows, "search")
        done.append(rows.filter(F.size("steps") == 0).drop("steps"))
        rows = rows.filter(F.size("steps") > 0)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        mid = F.floor((F.size("steps") + 1) / 2).cast("int")
        asked = rows.withColumn("mid", mid).withColumn("s", F.element_at("steps", F.col("mid"))).select("*", "s.d", "s.x", "s.y")
        met = asked.join(shared, ["d", "x", "y"], "left").withColumn("owned", F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True)))
        left = F.when(F.col("owned"), F.slice("steps", F.lit(1), F.col("mid") - 1)).otherwise(F.slice("steps", F.col("mid") + 1, F.size("steps") - F.col("mid")))
        rows = met.select("conv_id", left.alias("steps"), F.when(F.col("owned"), F.col("d")).otherwise(F.col("first")).alias("first"), F.when(F.col("owned"), F.col("parent")).otherwise(F.col("owner")).alias("parent"))


def owners(found: DataFrame, shared: DataFrame, span: int) -> DataFrame:
    """:func:`first_owned` of whole conversations: by the ends of their segments, then within the segment where it lies."""
    step = F.struct("d", "x", "y")
    ends = found.groupBy("conv_id", F.floor(F.col("d") / span).alias("segment")).agg(F.max(step).alias("end"), F.array_sort(F.collect_list(step)).alias("steps"))
    ends = written(ends, "segments")
    coarse = ends.groupBy("conv_id").agg(F.array_sort(F.collect_list("end")).alias("steps"))
    by_end = first_owned(coarse, shared).withColumn("segment", F.floor(F.col("first") / span))
    inside = ends.select("conv_id", "segment", F.slice("steps", F.lit(1), F.size("steps") - 1).alias("steps")).join(by_end.filter("first is not null").select("conv_id", "segment"), ["conv_id", "segment"])
    fine = first_owned(inside, shared).select("conv_id", F.col("first").alias("inner"), F.col("parent").alias("inner_parent"))
    return by_end.join(fine, "conv_id", "left").select("conv_id", F.coalesce("inner", "first").alias("first"), F.coalesce("inner_parent", "parent").alias("parent"))


def ended(ends: DataFrame, run: int = RUN) -> DataFrame:
    """owner, d, ends_sha256 of the conversations that end at each node (owner, d, conv_id)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        kinds = {"owner": pa.int64(), "d": pa.int64(), "first": pa.int64(), "ids": pa.string()}
        out = []
        for batch in batches:
            for owner, d, conv in zip(*(batch.column(x).to_pylist() for x in ("owner", "d", "conv_id")), strict=True):
                if (owner, d) != now or len(ids) == run:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = (owner, d), []
                ids.append(conv)
                if len(out) == 1024:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    out = []
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for owner, d, ids in zip(*(batch.column(x).to_pylist() for x in ("owner", "d", "ids")), strict=True):
                if (owner, d) == now:
                    sha.update(f",{ids}".encode())
                    continue
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (owner, d), hashlib.sha256(ids.encode())
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["owner", "d", "ends_sha256"])
        if now:
            yield pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["owner", "d", "ends_sha256"])

    order = ["owner", "d", "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "owner long, d long, first long, ids string")
    return runs.repartition("owner", "d").sortWithinPartitions("owner", "d", "first").mapInArrow(digested, "owner long, d long, ends_sha256 string")


def climbed(chains: DataFrame) -> DataFrame | None:
    """owner, d, leaves, saved: what the chains that hang on each node bring it, those further down included. ``chains``: conv_id, parent, hangs_at (null at the root), leaves, saved."""
    rest, handed = chains, []
    while True:
        rest = written(rest, "chains")
        waited_for = if_small(written(rest.filter("parent is not null").select(F.col("parent").alias("conv_id")).distinct(), "waited-for"))
        ready = rest.join(waited_for, "conv_id", "left_anti").filter("parent is not null")
        given = written(ready.groupBy(F.col("parent").alias("owner"), F.col("hangs_at").alias("d")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "handed")
        if given.isEmpty():
            return reduce(DataFrame.unionByName, handed).groupBy("owner", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")) if handed else None
        handed.append(given)
        more = if_small(given.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        above = rest.join(waited_for, "conv_id", "left_semi").unionByName(rest.filter("parent is null").join(waited_for, "conv_id", "left_anti"))
        rest = above.join(more, "conv_id", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).select(*chains.columns)


def trie(convs: DataFrame, rows: DataFrame, span: int = SPAN, run: int = RUN) -> DataFrame:
    """The nodes of conversations (conv_id, m) with ``rows`` (conv_id, at, x, y, bytes)."""
    roots = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("d", "x", "y", "bytes")])
    found = written(prefixes(rows).unionByName(roots), "prefixes")
    nodes = written(found.groupBy("d", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "nodes")
    shared = if_small(written(nodes.filter("n_convs > 1").select("d", "x", "y", "owner"), "shared"))
    of = written(owners(found.select("conv_id", "d", "x", "y"), shared, span).join(convs, "conv_id"), "owners")
    ends = of.select(F.when(F.col("first").isNull(), F.col("parent")).otherwise(F.col("conv_id")).alias("owner"), F.col("m").alias("d"), "conv_id")

    chains = of.filter("first is not null").select("conv_id", "m", "first", F.when(F.col("first") > 0, F.col("parent")).alias("parent"), F.when(F.col("first") > 0, F.col("first") - 1).alias("hangs_at"))
    hanging = chains.filter("parent is not null").groupBy(F.col("parent").alias("owner"), F.col("hangs_at").alias("d")).agg(F.count("*").alias("hanging"))
    hanging = written(hanging, "hanging")
    saved = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    crowned = hanging.select(F.col("owner").alias("conv_id"), F.col("d").alias("m"), F.lit(0).cast("long").alias("leaves"))
    weighed = chains.join(crowned, ["conv_id", "m"], "left").join(saved, "conv_id").withColumn("leaves", F.coalesce("leaves", F.lit(1).cast("long")))
    handed = climbed(weighed.select("conv_id", "parent", "hangs_at", "leaves", "saved"))

    # what is known of single nodes: what hangs on them, where chains begin and end, who ends there
    null = F.lit(None).cast("long")
    facts = [
        hanging.select("owner", "d", "hanging", null.alias("leaves"), null.alias("saved"), null.alias("parent"), null.alias("is_end")),
        chains.select(F.col("conv_id").alias("owner"), F.col("first").alias("d"), null.alias("hanging"), null.alias("leaves"), null.alias("saved"), F.coalesce("parent", F.lit(None).cast("long")).alias("parent"), null.alias("is_end")),
        chains.select(F.col("conv_id").alias("owner"), F.col("m").alias("d"), null.alias("hanging"), null.alias("leaves"), null.alias("saved"), null.alias("parent"), F.lit(1).cast("long").alias("is_end")),
    ]
    if handed is not None:
        facts.append(handed.select("owner", "d", null.alias("hanging"), "leaves", "saved", null.alias("parent"), null.alias("is_end")))
    known = reduce(DataFrame.unionByName, facts).groupBy("owner", "d").agg(*[F.max(c).alias(c) for c in ("hanging", "leaves", "saved", "parent", "is_end")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    children = zero("hanging") + 1 - zero("is_end")
    rows = nodes.select("owner", "d", "n_convs", "bytes").join(known, ["owner", "d"], "left").join(ended(ends, run), ["owner", "d"], "left")
    rows = rows.select(
        "owner", "d", F.when(F.col("d") > 0, F.coalesce("parent", "owner")).alias("parent"), "n_convs", children.alias("n_children"), (zero("leaves") + (children == 0).cast("long")).alias("n_leaves"),
        (zero("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    summed = running(rows, "owner", [F.col("owner"), F.col("d").desc()], sums=("n_leaves", "saved_tokens"))
    return summed.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    return trie(*rebuilt(rows))


#: The same rows: prefixes are compared as lists of turns, and each node adds to all nodes above it.
SQL = """
with l as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as said from conversations where conv_id is not null group by 1),
b as (select conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as steps from l),
h as (select conv_id, case when conv_id % 5 = 0 then 0 else xor(list_reduce(list_prepend(4294967295::bigint, steps), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then 3988292384::bigint else 0::bigint end) end), 4294967295::bigint) % 9 end as h from b),
r as (select l.conv_id, case when l.conv_id % 5 = 0 then l.said else list_concat(coalesce(o.said[:h], l.said[:0]), l.said[h + 1:]) end as said from l join h using (conv_id) left join l o on o.conv_id = l.conv_id - l.conv_id % 5),
p as (select conv_id, len(said) as n, d, said[:d] as prefix from r, lateral (select unnest(range(0, len(said) + 1)) as d)),
n as (select d, prefix, min(conv_id) as owner, count(*) as n_convs, coalesce(list(conv_id order by conv_id) filter (n = d), []) as ends, (count(*) - 1) * (case when d > 0 then strlen(prefix[d].text) else 0 end) as saved from p group by 1, 2),
c as (select d - 1 as d, prefix[:d - 1] as prefix, count(*) as n_children from n where d > 0 group by 1, 2),
k as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (d, prefix)),
u as (select up as d, prefix[:up] as prefix, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved from k, lateral (select unnest(range(0, d + 1)) as up) group by 1, 2)
select k.owner as conv_id, k.d::bigint as depth, a.owner as parent_conv_id, k.n_convs, k.n_children, u.n_leaves, u.saved::bigint as saved_tokens, sha256(array_to_string(k.ends, ',')) as ends_sha256
from k join u using (d, prefix) left join n a on a.d = k.d - 1 and a.prefix = k.prefix[:k.d - 1]
"""
