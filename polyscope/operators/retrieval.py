"""Memory of vectors: how it is made, its nearest entries by cosine, and injection of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; two blocks meet in a task, as one product of matrices.
BLOCK = 2048
#: Cosines of a product that may differ from those added up in order.
ROUNDING = 1e-9


def sampled(entries: DataFrame, by: str, size: int = 10, seed: str = "memory", key: str = "sample_id") -> DataFrame:
    """``size`` entries of each value of ``by``: those whose id has the least digest with the seed, ties to the smaller id. A task passes on ``size`` of each at most."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.lit(seed), key)), key)
    return entries.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= size).drop("__n")


def mean_vectors(entries: DataFrame, by: str, width: int, vector: str = "key") -> DataFrame:
    """``by``, entries and mean: the means of the vectors' elements, each an aggregate of its own, so that tasks pass on a row for each value of ``by``. Vectors that are null or of another width, or hold a null, don't count."""
    whole = entries.filter((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull()))
    means = [F.avg(F.col(vector)[i]).alias(f"__{i}") for i in range(width)]
    return whole.groupBy(by).agg(F.count("*").alias("entries"), *means).select(by, "entries", F.array(*[f"__{i}" for i in range(width)]).alias("mean"))


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, added up from the first element to the last."""
    return np.add.accumulate(x * y, axis=1)[:, -1]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(flat), -1)


def best_of_block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest of a block of memory for each of a block of queries; both have id and key."""
    q, m = matrix(left["key"]), matrix(right["key"])
    names = np.array(right["id"].to_pylist(), dtype=object)
    order = np.argsort(names, kind="stable")
    m, names = m[order], names[order]
    nq, nm = np.sqrt(in_order(q, q)), np.sqrt(in_order(m, m))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosines = np.where((nq[:, None] != 0) & (nm != 0), (q @ m.T) / (nq[:, None] * nm), 0.0)
    out = {"query_id": [], "sample_id": [], "cosine": []}
    for i, name in enumerate(left["id"].to_pylist()):
        c = cosines[i]
        c[names == name] = -np.inf
        at_least = np.partition(c, -k)[-k] if len(c) > k else -np.inf
        near = np.flatnonzero((c >= at_least - ROUNDING) & (c > -np.inf))
        # those that count are added up in the order of their elements, as everywhere else
        exact = np.where((nq[i] != 0) & (nm[near] != 0), in_order(np.broadcast_to(q[i], (len(near), q.shape[1])), m[near]) / np.where(nq[i] * nm[near] == 0, 1, nq[i] * nm[near]), 0.0)
        for j in np.lexsort((np.arange(len(near)), -exact))[:k]:
            out["query_id"].append(name)
            out["sample_id"].append(names[near[j]])
            out["cosine"].append(float(exact[j]))
    return pa.table({"query_id": pa.array(out["query_id"], pa.string()), "sample_id": pa.array(out["sample_id"], pa.string()), "cosine": pa.array(out["cosine"], pa.float64())})


def cosine_topk(queries: DataFrame, memory: DataFrame, k: int = 3, bucket: str = "layer", block: int = BLOCK) -> DataFrame:
    """The k memory entries of a query's bucket with the largest cosine, without itself; ties go to the smaller id.

    Both have sample_id, ``bucket`` and key (array of doubles of one width). Entries and queries of a bucket are dealt into blocks by a hash of their ids, as many as its size asks for, and each block of queries
    meets each of entries once, as matrices; so a bucket may be as large as it likes. Of what meets, k a query are passed on.
    """
    bucket_ = F.col(bucket)
    sizes = lambda df, name: df.groupBy(bucket_.alias("bucket")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    rows = lambda df: df.filter(F.col("key").isNotNull()).select(bucket_.alias("bucket"), F.col("sample_id").alias("id"), F.col("key").alias("key"))
    # a row for each bucket
    counts = sizes(queries, "nq").join(sizes(memory, "nm"), "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = rows(queries).join(counts, "bucket").select("bucket", own("nq").alias("a"), each("nm").alias("b"), "id", "key")
    m = rows(memory).join(counts, "bucket").select("bucket", each("nq").alias("a"), own("nm").alias("b"), "id", "key")
    by = ["bucket", "a", "b"]
    met = q.groupBy(*by).cogroup(m.groupBy(*by)).applyInArrow(lambda x, y: best_of_block(x, y, k), "query_id string, sample_id string, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "sample_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
