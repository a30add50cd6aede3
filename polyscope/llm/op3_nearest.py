"""Approximate nearest neighbours by largest inner product, in vantage-point trees.

Vectors get one more component, which brings all of a shard to the length of its longest (zero for a query); the
largest inner product is then the least Euclidean distance, and the triangle inequality holds. Vectors are dealt into shards by a
hash, and each shard's tree is built once: a node splits its vectors at the median distance from a vantage point and keeps the range of distances
of each half. A block of queries is searched together: its queries' distances from the vantage points bound those from each leaf; each query sees its nearest leaves first,
then all leaves go by, and a leaf is left out for a query
if ``relax`` times the lower bound of its distances exceeds the query's k-th best. ``relax`` 1 restores exact search; more prunes
sooner. How much a factor loses depends on how lengths and directions are spread, so unless a factor is given, each shard and block of queries takes the largest of ``FACTORS`` with which
``SAMPLE`` of its queries find at least ``TARGET`` of what brute force finds for them, and 1 where none does. Blocks of queries meet every shard, so a task holds one shard's tree and one block. Leaves rank by inner products of the original
vectors in double precision, each summed in one order; scaled distances only prune.

Vectors that are null, zero, of another length than the most common one, or hold null or non-finite components take no part, nor do rows with a null vec_id. Rows with one
vec_id: the query's own vec_id is left out, and of several rows of one vec_id among the nearest, each counts. Ties go to the smaller vec_id.
Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NEAREST, EVERY, SHARD, BLOCK, LEAF = 20, 20, 16_384, 2_048, 128
#: Leaves that each query sees first, its nearest; candidates of a leaf that are few for a query.
AHEAD, FEW = 4, 8
#: A shard's vectors take at most so many bytes; factors that are tried, on so many queries, and the recall that one must have.
SHARD_BYTES, FACTORS, SAMPLE, TARGET = 32 << 20, (8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5, 1.2), 64, 0.97


def usable(rows: DataFrame, id_col: str, vector: str, *more: str) -> DataFrame:
    """vec_id, v (array of doubles) and ``more``, of rows that can be compared."""
    v = F.transform(vector, lambda x: x.cast("double"))
    got = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return got.filter(~bad & F.exists("v", lambda x: x != 0))


class Tree:
    """A vantage-point tree over rows of ``x``; nodes are (vantage, halves with their distance ranges) or leaves of row numbers."""

    def __init__(self, x: np.ndarray, original: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.x, self.original, self.leaf, self.rng = x, original, leaf, np.random.default_rng(seed)
        self.square = np.einsum("ij,ij->i", x, x)
        self.length = np.sqrt(np.einsum("ij,ij->i", original, original))
        self.root = self.built(np.arange(len(x)))

    def built(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return ("leaf", rows)
        vantage = rows[self.rng.integers(len(rows))]
        d = self.distances(self.x[vantage][None], rows)[0]
        half = len(rows) // 2
        order = np.argpartition(d, half)
        inner, outer = order[:half], order[half:]
        return ("node", vantage, *((self.built(rows[h]), d[h].min(), d[h].max()) for h in (inner, outer)))

    def distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", q, q)[:, None] + self.square[rows] - 2 * q @ self.x[rows].T
        return np.sqrt(np.maximum(square, 0))

    def leaves(self, q: np.ndarray, relax: float) -> tuple[list[np.ndarray], np.ndarray]:
        """The leaves' rows, and for each leaf and query the distance that the query's k-th best must have at least for the leaf to be searched."""
        rows, needs = [], []

        def visit(node: tuple, need: np.ndarray) -> None:
            if node[0] == "leaf":
                rows.append(node[1])
                needs.append(need)
                return
            d = self.distances(q, np.array([node[1]]))[:, 0]
            slack = 1e-7 * (1 + d)  # rounding never prunes a tie: a distance near 0 is off by the root of that of its square
            for half, low, high in node[2:]:
                visit(half, np.maximum(need, relax * np.maximum(np.maximum(low - d, d - high), 0) - slack))

        visit(self.root, np.full(len(q), -np.inf))
        return rows, np.stack(needs)

    def search(self, q: np.ndarray, asked: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best for each query (-1 and -inf where there are fewer); ``asked`` are the queries unscaled; candidates with the query's own id are left out."""
        best, far = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        reach = np.full(len(q), np.inf)  # scaled distance of the k-th best
        length = np.sqrt(np.einsum("ij,ij->i", asked, asked))

        def merge(of: np.ndarray, rows: np.ndarray, open_: np.ndarray, count: np.ndarray) -> None:
            """Of the best so far and the rows that are open, ``count`` for each query, the best."""
            i, j = np.nonzero(open_)
            at = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            d, r = np.full((len(of), count.max()), -np.inf), np.full((len(of), count.max()), -1)
            r[i, at] = rows[j]
            # computed again, always in one order: equal vectors have equal scores, whatever block they are in
            for first in range(0, len(i), 1 << 14):
                a, b = i[first : first + (1 << 14)], j[first : first + (1 << 14)]
                d[a, at[first : first + (1 << 14)]] = np.einsum("ij,ij->i", asked[of[a]], self.original[rows[b]], optimize=False)
            all_d, all_r = np.concatenate([far[of], d], axis=1), np.concatenate([best[of], r], axis=1)
            all_id = np.where(all_r >= 0, ids[all_r], np.iinfo(np.int64).max)
            top = np.lexsort((all_id, -all_d), axis=1)[:, :k]
            far[of], best[of] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_r, top, 1)

        def look(rows: np.ndarray, of: np.ndarray) -> None:
            d = asked[of] @ self.original[rows].T
            open_ = d >= far[of, -1:] - 1e-11 * length[of, None] * self.length[rows].max()
            open_ &= own[of][:, None] != ids[rows][None]
            count = open_.sum(axis=1)
            # a query has few candidates once it has seen some leaves: it is sorted with those that have as few
            for low, high in ((0, FEW), (FEW, len(rows))):
                some = np.flatnonzero((count > low) & (count <= high))
                if len(some):
                    merge(of[some], rows, open_[some], count[some])
            of = of[count > 0]
            last = best[of, -1]
            gap = q[of] - self.x[last]
            reach[of] = np.where(last < 0, np.inf, np.sqrt(np.einsum("ij,ij->i", gap, gap)))

        leaves, need = self.leaves(q, relax)
        nearest = np.argsort(need, axis=0, kind="stable")[:AHEAD]
        for at in nearest:
            for leaf in np.unique(at):
                of = np.flatnonzero(at == leaf)
                look(leaves[leaf], of[need[leaf, of] <= reach[of]])
        np.put_along_axis(need, nearest, np.inf, axis=0)  # seen
        for rows, least in zip(leaves, need, strict=True):
            of = np.flatnonzero((least <= reach) & (least < np.inf))
            if len(of):
                look(rows, of)
        return best, far


def tree_of(vectors: np.ndarray) -> Tree:
    """The tree of vectors brought to one length."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    longest = square.max()
    return Tree(np.column_stack([vectors, np.sqrt(np.maximum(longest - square, 0))]) / math.sqrt(longest), vectors)


def scaled(queries: np.ndarray, tree: Tree) -> np.ndarray:
    return np.column_stack([queries, np.zeros(len(queries))]) / tree.length.max()


def tuned(tree: Tree, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The largest factor with which a sample of the queries finds ``TARGET`` of their nearest in the tree."""
    few = np.unique(np.linspace(0, len(queries) - 1, SAMPLE).astype(np.int64))
    q, mine = queries[few], own[few]
    s = np.where(mine[:, None] == ids[None], -np.inf, q @ tree.original.T)
    wanted = min(k, len(ids))
    least = np.partition(s, len(ids) - wanted, axis=1)[:, len(ids) - wanted]
    # as many as there are: a query's own vector is no candidate
    least = np.where(np.isinf(least), np.min(np.where(np.isinf(s), np.inf, s), axis=1), least)
    there = np.minimum(k, (~np.isinf(s)).sum(axis=1)).sum()
    for relax in FACTORS:
        _, far = tree.search(scaled(q, tree), q, mine, ids, k, relax)
        if (far >= (least - 1e-9 * np.abs(least))[:, None]).sum() >= TARGET * there:
            return relax
    return 1.0


def nearest(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = NEAREST, every: int = EVERY, relax: float | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    good = usable(rows, id_col, vector)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0].d, sizes[0].n
    good = good.filter(F.size("v") == d)
    asked = good.filter(F.col("vec_id") % every == 0)
    shards, parts = max(1, math.ceil(n / max(1, min(shard, SHARD_BYTES // (8 * d))))), max(1, math.ceil(n / every / block))
    deal = lambda df, col, count, seed: df.withColumn(col, F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def build(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("vec_id", kind="stable")
        tree = tree_of(np.stack(x["v"].to_numpy()))
        return pd.DataFrame({"shard": [x["shard"].iloc[0]], "tree": [pickle.dumps((x["vec_id"].to_numpy(np.int64), tree), protocol=5)]})

    trees = written(deal(good, "shard", shards, 1).groupBy("shard").applyInPandas(build, "shard long, tree binary"), "trees")
    left = trees.withColumn("part", each(parts))
    right = deal(asked, "part", parts, 2).withColumn("shard", each(shards))

    def search(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, tree = pickle.loads(x["tree"].iloc[0])
        q = q.sort_values("vec_id", kind="stable")
        own, b = q["vec_id"].to_numpy(np.int64), np.stack(q["v"].to_numpy())
        best, scores = tree.search(scaled(b, tree), b, own, ids, k, relax or tuned(tree, b, own, ids, k))
        at, rank = np.nonzero(best >= 0)
        return pd.DataFrame({"query_id": own[at], "vec_id": ids[best[at, rank]], "score": scores[at, rank]})

    keys = ["shard", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
