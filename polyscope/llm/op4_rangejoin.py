"""Near-duplicate vectors of one label by an exact metric range join.

A cosine of at least t is a distance of at most eps = sqrt(2 - 2t) between unit vectors. Equal vectors of a label are taken together first: they are one node. A bounded sample
of the vectors of each label that has more than ``PER_PIVOT``, spread by hash, serves as pivots, one for about ``PER_PIVOT`` vectors, and ``ALL_PIVOTS`` in all or so. A vector's home is the cell of its nearest pivot, and it is replicated to the cell of pivot p
if it may lie within eps of a vector at home there: the triangle inequality gives d(v, p) <= d(v, home) + 2 eps, and
the distance from the plane between the two pivots, at most eps, is narrower yet. A cell joins its home vectors with
all that are in it, independently of others, so that a home vector sees all its neighbours. Where a second sample shows that a vector would go to more than
``COPIES`` cells, or to more than half of them, pivots that are far apart are taken instead, and where those don't do, half the pivots are left out, and so on down to two: spread vectors of many dimensions, which the triangle inequality can't tell apart, are copied once at most. Cells are cut into blocks of at most ``BLOCK`` vectors, packed in a row each, on
either side, so no cell or label meets in one task; in a cell without replicas each two blocks meet once. Two blocks send on counts and a spanning forest of their links,
never pairs. A cosine that differs from t by rounding only is computed again from the original
vectors in one fixed order, so a pair is decided alike in every block and from both sides.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing; nor do vectors of different lengths. A vec_id is
one vector however often it comes: n_links counts other vec_ids, each once. If its rows differ in vector or label it has the links of all of them; those are then listed, node by node. Rows with a null vec_id take no part and are returned with no links. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .op3_nearest import usable

COSINE, PER_PIVOT, ALL_PIVOTS, BLOCK, BLOCK_BYTES = 0.93, 16, 16_384, 2_048, 16 << 20
#: Cells that a vector goes to on average at most where a label has more than two, and vectors of a label that this is measured on, of all labels ``ALL_PIVOTS`` or so.
COPIES, PROBES = 4, 256
#: Pivots of a label that are chosen far apart at most.
SPREAD = 1_024


def reaches(a: np.ndarray, b: np.ndarray, product: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows of ``a`` and ``b`` have at least ``cosine``; ``product`` are those of the unit vectors."""
    close = product >= cosine
    for i, j in zip(*np.nonzero(np.abs(product - cosine) < 1e-12), strict=True):
        u, v = (x / 2.0 ** np.frexp(np.abs(x).max())[1] for x in (a[i], b[j]))  # by powers of two: exact
        close[i, j] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v)) >= cosine
    return close


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cells each unit vector goes to, as a matrix, and its home."""
    square = np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0)
    home = square.argmin(axis=1)
    apart = np.sqrt(np.maximum((pivots**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * pivots @ pivots.T, 0))[home]
    near = square[np.arange(len(x)), home]
    inside = (np.sqrt(square) <= np.sqrt(near)[:, None] + 2 * eps + 1e-9) & (square - near[:, None] <= 2 * (eps + 1e-9) * apart + 1e-9)
    inside[np.arange(len(x)), home] = True
    return inside, home


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x``, ``count`` at most, each the farthest from those before it: they reach every cluster, however few vectors are drawn of it."""
    found, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(found) < min(count, len(x)) and near.max() > 0:
        found.append(int(near.argmax()))
        near = np.minimum(near, np.maximum(2 - 2 * x @ x[found[-1]], 0))
        near[found[-1]] = 0
    return np.array(found)


def fitting(x: np.ndarray, count: int, eps: float) -> np.ndarray:
    """Pivots of the vectors drawn, ``count`` or, where those would copy a vector to many cells, fewer, and two at least if there are: the first ones, as dense as the vectors are, or else
    ones that are far apart. The last of the others are the probes."""
    far = spread(x, min(count, SPREAD))
    while count > 2:
        for rows in (np.arange(count), far[:count]):
            some, probes = np.unique(x[rows], axis=0), np.delete(x, rows, axis=0)[-PROBES:]
            if len(probes) and cells_of(probes, some, eps)[0].sum(axis=1).mean() <= min(COPIES, len(some) / 2):
                return some
        count //= 2
    return np.unique(x[:2], axis=0)


def pivots_of(nodes: DataFrame, eps: float, per_pivot: int) -> dict:
    """Unit vectors by (label, length) of the labels that are cut into cells. What is drawn for all labels together is bounded: about ``ALL_PIVOTS`` pivots, one more for each label, and as many probes."""
    sizes = nodes.groupBy("label", "d").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per = max(per_pivot, math.ceil(total / ALL_PIVOTS))
    wanted = written(sizes.filter(F.col("n") > per).withColumn("pivots", F.greatest(F.lit(2), F.ceil(F.col("n") / per))), "wanted")  # at most ALL_PIVOTS rows
    probes = max(1, min(PROBES, ALL_PIVOTS // max(1, wanted.count())))
    share = (F.col("pivots") + probes) * 1.2 / F.col("n")
    drawn = nodes.select("label", "d", "v", "h1", "h2").join(F.broadcast(wanted), ["label", "d"]).filter(F.pmod(F.xxhash64("h2", "h1"), F.lit(1 << 20)) < F.lit(1 << 20) * share)
    of: dict = {}
    for r in drawn.select("label", "d", "v", "pivots", F.xxhash64("h1", "h2").alias("order")).toLocalIterator():
        of.setdefault((r.label, r.d, r.pivots), []).append((r.order, np.array(r.v)))
    out = {}
    for (label, d, count), rows in of.items():
        x = unit(np.stack([v for _, v in sorted(rows, key=lambda x: x[0])]))
        count = min(count, max(2, len(x) - probes))
        out[label, d] = fitting(x[: count + probes], count, eps)
    return out


def linked(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row."""
    spark = rows.sparkSession
    good = usable(rows, id_col, vector, F.col(label).alias("label")).filter("label is not null")
    named = written(good.select("vec_id", "label", "v", F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64("v", F.lit(2)).alias("h2")), "vectors")
    same = ["label", "h1", "h2"]
    # a node for each vector of a label; head is its least vec_id
    heads = written(named.groupBy(*same).agg(F.min("vec_id").alias("head"), F.any_value("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "heads")
    members = written(named.select("vec_id", *same).distinct().join(heads.select(*same, "node", "head"), same).select("vec_id", "node", "head"), "members")
    # vec_ids of several nodes ("many") count for a node only where all nodes that they are linked with are known
    many = written(members.groupBy("vec_id").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("vec_id", F.lit(True).alias("many")), "many")
    marked = members.join(many, "vec_id", "left")
    weights = marked.groupBy("node").agg(F.sum(F.col("many").isNull().cast("long")).alias("n"), F.max(F.coalesce("many", F.lit(False))).alias("many"))
    nodes = written(heads.join(weights, "node").withColumn("d", F.size("v")), "nodes")
    eps = math.sqrt(2 - 2 * cosine)
    shared = spark.sparkContext.broadcast(pivots_of(nodes, eps, per_pivot))

    def place(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cell and whether it is the home, of each vector."""
        for pdf in pdfs:
            out = []
            for (k, d), part in pdf.groupby(["label", "d"], sort=False):
                p = shared.value.get((k, d))
                if p is None:
                    out.append(part.assign(cell=0, home=True))
                    continue
                inside, home = cells_of(unit(np.stack(part["v"].to_numpy())), p, eps)
                at, cell = np.nonzero(inside)
                out.append(part.iloc[at].assign(cell=cell, home=cell == home[at]))
            if out:
                yield pd.concat(out)

    kind = nodes.schema["label"].dataType.simpleString()
    columns = f"label {kind}, d int, node long, head long, n long, many boolean, v array<double>"
    placed = written(nodes.select("label", "d", "node", "head", "n", "many", "v").mapInPandas(place, f"{columns}, cell int, home boolean"), "placed")
    cell = ["label", "d", "cell"]
    rate = F.greatest(F.lit(1 / block), F.col("d") * 8 / BLOCK_BYTES)
    cut = lambda n: F.ceil(n * rate).cast("long")
    cells = placed.groupBy(*cell).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all")).filter("homes > 0 and all > 1")
    cells = written(cells.select(*cell, cut(F.col("homes")).alias("rows_"), cut(F.col("all")).alias("cols_"), (F.col("homes") == F.col("all")).alias("half")), "cells")
    sided = placed.join(cells, cell)
    deal = lambda c: F.pmod(F.xxhash64("node"), c).alias("b")
    vectors = ["node", "head", "n", "many", "v"]
    both = sided.select(*cell, F.lit(1).alias("side"), deal(F.col("cols_")), *vectors).unionByName(sided.filter("home and not half").select(*cell, F.lit(0).alias("side"), deal(F.col("rows_")), *vectors))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        packed = {c: [pdf[c].to_numpy(np.int64).tobytes()] for c in ("node", "head", "n", "many")}
        return pd.DataFrame({**{c: [first[c]] for c in (*cell, "side", "b")}, **packed, "v": [np.stack(pdf["v"].to_numpy()).tobytes()]})

    blocks = written(both.groupBy(*cell, "side", "b").applyInPandas(pack, f"label {kind}, d int, cell int, side int, b long, node binary, head binary, n binary, many binary, v binary"), "blocks")
    sized = blocks.join(cells, cell)
    zero = F.lit(0).cast("long")
    to = lambda low, high: F.explode(F.sequence(low, high))
    rest = ["half", *vectors]
    left = sized.filter("side = 0").select(*cell, F.col("b").alias("i"), to(zero, F.col("cols_") - 1).alias("j"), *rest).unionByName(sized.filter("half").select(*cell, F.col("b").alias("i"), to(F.col("b"), F.col("cols_") - 1).alias("j"), *rest))
    right = sized.filter("side = 1").select(*cell, to(zero, F.when(F.col("half"), F.col("b")).otherwise(F.col("rows_") - 1)).alias("i"), F.col("b").alias("j"), *rest)

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both come from ``blocks``

    def join(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Counts for home vectors (kind 0), links enough to connect what is linked here (1), and the links of nodes whose vec_ids have several (2)."""
        if not len(a) or not len(b):
            return pd.DataFrame({"kind": [], "node": [], "value": []})
        a, b = a.iloc[0], b.iloc[0]
        an, ah, aw, am, bn, bh, bw, bm = (np.frombuffer(x[c], np.int64) for x in (a, b) for c in ("node", "head", "n", "many"))
        v, w = (np.frombuffer(x["v"], np.float64).reshape(len(n), -1) for x, n in ((a, an), (b, bn)))
        close = reaches(v, w, unit(v) @ unit(w).T, cosine)
        close &= an[:, None] != bn[None]
        twice = bool(a["half"]) and int(key[3]) != int(key[4])
        out = [(np.zeros(len(an)), an, close @ bw)]
        if twice:
            out.append((np.zeros(len(bn)), bn, close.T @ aw))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r in np.flatnonzero(close.any(axis=1)).tolist():
            for c in bh[close[r]].tolist():
                p, q = top(int(ah[r])), top(c)
                if p != q:
                    root[max(p, q)] = min(p, q)
        pairs = [(x, top(x)) for x in list(root)]
        forest = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        out.append((np.ones(len(forest)), forest[:, 0], forest[:, 1]))
        for rows_, own, other in ((am, an, bn), *([(bm, bn, an)] if twice else [])):
            if rows_.any():
                links = close if own is an else close.T
                r, c = np.nonzero(links & (rows_ != 0)[:, None])
                out.append((np.full(len(r), 2), own[r], other[c]))
        return pd.DataFrame({name: np.concatenate([x[i] for x in out]).astype(np.int64) for i, name in enumerate(("kind", "node", "value"))})

    keys = [*cell, "i", "j"]
    found = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(join, "kind int, node long, value long"), "found")
    counts = nodes.select("node", "n").join(found.filter("kind = 0").groupBy("node").agg(F.sum("value").alias("links")), "node", "left").select("node", (F.coalesce("links", zero) + F.col("n")).alias("links"))
    if many.isEmpty():
        per = members.join(counts, "node").select("vec_id", (F.col("links") - 1).alias("links"))
    else:
        # u: such a vec_id, with every node that is its own or linked with one of its own
        own = members.join(many, "vec_id", "left_semi").select(F.col("vec_id").alias("u"), "node")
        seen = written(own.unionByName(own.join(found.filter("kind = 2"), "node").select("u", F.col("value").alias("node"))).distinct(), "seen")
        more = seen.groupBy("node").agg(F.count("*").alias("more"))
        single = members.join(many, "vec_id", "left_anti").join(counts, "node").join(more, "node", "left").select("vec_id", (F.col("links") - 1 + F.coalesce("more", zero)).alias("links"))
        plain = seen.join(nodes.select("node", "n"), "node").groupBy("u").agg(F.sum("n").alias("links"))
        others = seen.join(own.withColumnRenamed("u", "w"), "node").filter("u <> w").select("u", "w").distinct().groupBy("u").agg(F.count("*").alias("others"))
        per = single.unionByName(plain.join(others, "u", "left").select(F.col("u").alias("vec_id"), (F.col("links") + F.coalesce("others", zero)).alias("links")))
    edges = found.filter("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")).unionByName(members.filter("vec_id <> head").select(F.col("vec_id").alias("a"), F.col("head").alias("b")))
    of = components(edges).select(F.col("node").alias("vec_id"), "component")
    out = rows.select(F.col(id_col).cast("long").alias("vec_id")).join(per, "vec_id", "left").join(of, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", zero).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
