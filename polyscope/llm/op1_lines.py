"""Removal of repeated runs of lines: a suffix array over documents' line sequences, built by distributed prefix doubling.

Lines get ids: ranks of their hashes. Round k sorts the pairs of ranks of the 2**k lines from each position and of the 2**k after
them; a pair's place in that order is its rank, which names and orders the 2**(k+1) lines from there. Suffixes of equal
rank are an interval of the suffix array whose longest common prefix has at least 2**(k+1) lines. Suffixes whose rank is theirs alone are in place and leave; the rest go on until
none is left, or 2**k lines have ``MIN_CHARS`` characters by their newlines alone: longer runs are unions of such stretches. A suffix that isn't the first of its interval, in order of doc_id and line, starts a later copy.

Of a later copy's maximal run, which ends with the longest prefix that an earlier suffix shares, every line goes if the run has ``MIN_CHARS`` characters or more, newlines
between its lines included; the first copy stays whole. A run is the union of its stretches of 2**k lines, so where they have ``MIN_CHARS`` characters each their
intervals say it all. That may not be so where the last line of a prefix is shorter; its interval is then split further (:func:`exact`), by
the ranks of 2**(k-1), 2**(k-2) ... lines that follow, down to each suffix's exact longest prefix shared with an earlier one. A run of more than ``MIN_CHARS`` lines
has as many newlines, so this ends at prefixes of ``MIN_CHARS`` lines.

Ranks are counted before they are joined, with how many suffixes have them, and those of hot lines and runs are joined in many tasks, so a line's copies don't meet in one. Lines that go are intervals, merged before lines are touched.

Lines end at newlines only. Null texts have no lines and stay null; empty ones stay empty. Several rows of one doc_id are several
documents in order of a hash of their texts, and equal ones are one: what happens to one happens to the other. A null doc_id comes before all others. Texts of any length are whole;
other columns are not read, and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import met, written

MIN_CHARS = 24
FIRST = -(1 << 63)
PLACE = ["__d", "__h", "i"]


def place() -> Column:
    return F.struct(*PLACE)


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """__d and __h, which name a document, its text, and all its columns as ``doc``."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("__d"), F.xxhash64(text).alias("__h"), F.col(text).alias("text"), F.struct(*docs.columns).alias("doc"))


def intervals(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """``by``, the first place and the number n of suffixes of each interval of two or more."""
    return suffixes.groupBy(*by).agg(F.min(place()).alias("first"), F.max(place()).alias("last"), F.count("*").alias("n")).filter("first <> last").drop("last")


def ranked(found: DataFrame, by: list[str]) -> DataFrame:
    """With ``rank``, which orders the rows as ``by`` does: partitions are ranges of it, and ids grow with the partition and within it."""
    return written(found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def levels(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> list[DataFrame]:
    """For each k: place, rank, chars, tail and later of the suffixes whose first 2**k lines occur elsewhere too: the characters of those lines and of the last of them, and whether an earlier suffix has them.

    The last k is that where 2**k lines have ``min_chars`` characters by their newlines alone: the stretches of that many lines in a longer run are later copies as it is, and cover it.
    """
    lines = docs.filter(F.col(text).isNotNull()).select("__d", "__h", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    lines = lines.select("__d", "__h", F.col("i").cast("long").alias("i"), F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"), F.length("line").cast("long").alias("chars"))
    names = ranked(intervals(lines, ["x", "y"]), ["x", "y"])
    at = written(met(lines, names, ["x", "y"]).select(*PLACE, "rank", "chars", F.col("chars").alias("tail"), (F.col("first") < place()).alias("later")).distinct(), "suffixes")
    out, n = [], 1
    while not at.isEmpty():
        out.append(at)
        if n > min_chars:
            break
        ahead = lambda c: F.max(c).over(Window.partitionBy("__d", "__h").orderBy("i").rangeBetween(n, n))  # noqa: B023, E731
        pairs = at.select(*PLACE, F.col("rank").alias("x"), ahead("rank").alias("y"), (F.col("chars") + 1 + ahead("chars")).alias("chars"), ahead("tail").alias("tail"))
        pairs = written(pairs.filter("y is not null"), "pairs")
        names = ranked(intervals(pairs, ["x", "y"]), ["x", "y"])
        at = written(met(pairs, names, ["x", "y"]).select(*PLACE, "rank", "chars", "tail", (F.col("first") < place()).alias("later")), "suffixes")
        n *= 2
    return out


def exact(at: list[DataFrame], min_chars: int) -> DataFrame | None:
    """place, n and chars: for suffixes in intervals whose prefix ends with a line of too few characters, the longer prefixes shared with an earlier suffix, the longest included.

    A node of the search is an interval of level k and the ranks r that prolonged its prefix; all its suffixes stay in it as
    sources, and a node is left when none of its suffixes looks for a longer prefix any more.
    """
    upto = [k for k in range(1, len(at)) if 1 << k <= min_chars]
    if not upto:
        return None
    more = [f"r{j}" for j in range(max(upto))]
    node = ["k", "rank", *more]

    def start(k: int) -> DataFrame:
        rows = at[k].filter(F.col("tail") < min_chars)
        longer = at[k + 1].filter("later").select(*PLACE, F.lit(True).alias("longer")) if k + 1 < len(at) else None
        rows = rows.join(longer, PLACE, "left") if longer is not None else rows.withColumn("longer", F.lit(None).cast("boolean"))
        return rows.select(F.lit(k).alias("k"), "rank", *[F.lit(-1).cast("long").alias(r) for r in more], *PLACE, F.lit(1 << k).cast("long").alias("n"), "chars", (F.col("later") & F.col("longer").isNull()).alias("open"))

    def live(rows: DataFrame) -> DataFrame:
        return rows.join(rows.filter("open").select(*node).distinct(), node, "left_semi")

    rows, found = written(live(reduce(DataFrame.unionByName, [start(k) for k in upto])), "nodes"), None
    for j in range(max(upto) - 1, -1, -1):
        if rows.isEmpty():
            break
        step = at[j].select("__d", "__h", F.col("i").alias("at"), F.col("rank").alias("next"), F.col("chars").alias("plus"))
        asked = rows.filter(F.col("k") > j).withColumn("at", F.col("i") + F.col("n")).join(step, ["__d", "__h", "at"]).drop("at")
        asked = written(asked, "asked")
        grown = asked.join(intervals(asked, [*node, "next"]).withColumnRenamed("n", "__n"), [*node, "next"]).drop("__n").withColumn("later", F.col("first") < place())
        grown = written(grown.drop("first"), "grown")
        longer = grown.select("k", "rank", *[F.col("next").alias(r) if r == f"r{j}" else r for r in more], *PLACE, (F.col("n") + (1 << j)).alias("n"), (F.col("chars") + 1 + F.col("plus")).alias("chars"), (F.col("open") & F.col("later")).alias("open"), "later")
        # what another suffix of the node prolongs is found there; it looks no further here, but stays a source
        done = grown.filter("open and later").select(*node, *PLACE, F.lit(True).alias("done"))
        rest = rows.join(done, [*node, *PLACE], "left").withColumn("open", F.col("open") & F.col("done").isNull()).drop("done")
        part = longer.filter("later").select(*PLACE, "n", "chars")
        found = part if found is None else found.unionByName(part)
        rows = written(live(rest.unionByName(longer.drop("later"))), "nodes")
    return found


def repeated_runs(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """__d, __h, low, high: the lines (from 0, up to before ``high``) that go, in intervals that don't touch; ``docs`` is keyed."""
    at = levels(docs, text, min_chars)
    if not at:
        return docs.select("__d", "__h", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).limit(0)
    copies = [x.filter("later").select(*PLACE, F.lit(1 << k).cast("long").alias("n"), "chars") for k, x in enumerate(at)]
    further = exact(at, min_chars)
    copies = reduce(DataFrame.unionByName, copies + ([further] if further is not None else [])).filter(F.col("chars") >= min_chars)
    # of the copies that start at one line the longest says it all
    longest = copies.groupBy(*PLACE).agg((F.col("i") + F.max("n")).alias("end"))
    before = Window.partitionBy("__d", "__h").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    fresh = longest.withColumn("new", F.coalesce((F.max("end").over(before) < F.col("i")).cast("int"), F.lit(1)))
    number = fresh.withColumn("run", F.sum("new").over(Window.partitionBy("__d", "__h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return number.groupBy("__d", "__h", "run").agg(F.min("i").alias("low"), F.max("end").alias("high")).drop("run")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines kept, and lines_before and lines_removed, which replace columns of that name."""
    rows = keyed(docs, id_col, text)
    runs = repeated_runs(rows.select("__d", "__h", "text"), "text", min_chars)
    gone = runs.groupBy("__d", "__h").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("gone"))
    joined = rows.join(gone, ["__d", "__h"], "left").withColumn("lines", F.split("text", "\n", -1))
    upto = lambda j: F.when(j == 0, F.lit(0).cast("long")).otherwise(F.get("gone", j - 1)["high"])
    piece = lambda low, high: F.slice("lines", (low + 1).cast("int"), (high - low).cast("int"))
    size = F.size("lines").cast("long")
    between = F.flatten(F.transform("gone", lambda g, j: piece(upto(j), g["low"])))
    kept = F.array_join(F.concat(between, piece(F.get("gone", F.size("gone") - 1)["high"], size)), "\n")
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["high"] - g["low"])
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c not in (text, "lines_before", "lines_removed")]
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(text)
    out = joined.select(*own, left, F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size).alias("lines_before"), F.coalesce(removed, F.lit(0).cast("long")).alias("lines_removed"))
    return out.select(*[c for c in docs.columns if c not in ("lines_before", "lines_removed")], "lines_before", "lines_removed")


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    rows = deduplicated(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", min_chars)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows for tables whose doc_id is unique and not null: runs of every length up to one line more than MIN_CHARS. Longer runs are the union of
#: those, each of which has MIN_CHARS characters by its newlines alone.
SQL = f"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
s as (select doc_id, l, n, unnest(range(1, len(l) - n + 2)) as i from d, (select unnest(range(1, {MIN_CHARS + 2})) as n) where len(l) >= n),
w as (select doc_id, n, i, list_slice(l, i, i + n - 1) as v from s),
f as (select v, min(struct_pack(doc_id := doc_id, i := i)) as first from w group by v),
r as (select w.doc_id, w.i, w.n from w join f on w.v = f.v
      where f.first < struct_pack(doc_id := w.doc_id, i := w.i) and length(array_to_string(w.v, chr(10))) >= {MIN_CHARS}),
g as (select distinct doc_id, unnest(range(i, i + n)) as i from r),
m as (select doc_id, list(i) as gone from g group by doc_id)
select e.doc_id, case when e.text is null then 0 else len(string_split(e.text, chr(10))) end::bigint as n_lines,
       coalesce(len(m.gone), 0)::bigint as n_removed,
       sha256(case when m.gone is null then coalesce(e.text, '')
         else array_to_string([x for x, j in string_split(e.text, chr(10)) if not list_contains(m.gone, j)], chr(10)) end) as kept_sha256
from documents e left join m on e.doc_id = m.doc_id
"""
