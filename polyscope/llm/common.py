"""What the corpus operators share: reading tables, cutting lineage, adding up blocks of counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from ..sources.shared import bucketed, removed, written, written_at

__all__ = ["bucketed", "removed", "written", "written_at"]

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, a few numbers wide, to be broadcast if it has at most ``rows`` rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nullable(kind: DataType) -> DataType:
    """The type whose fields and elements may all be null, as Arrow tables are told to have them."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType))
    return MapType(nullable(kind.keyType), nullable(kind.valueType)) if isinstance(kind, MapType) else kind


#: A key is hot if it holds more than a thousandth of the rows, and so many at least; its rows are dealt over so many tasks.
HOT_ROWS, SALTS = 10_000, 64


def met(left: DataFrame, right: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """``left.join(right, by)`` where ``right``, a stored table, has a row for each key, and how many rows of ``left`` have it as ``n``, which the result lacks: hot keys' rows don't meet in one task.

    There are at most a thousand hot keys, which are broadcast to tell their rows apart, and whose rows of ``right`` are copied to each of their tasks.
    """
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(total / 1000, HOT_ROWS)
    if most <= least:
        return left.join(right.drop(n), by)
    hot = right.filter(F.col(n) > least).select(*by, F.lit(SALTS).alias("salts__"))
    salted = left.join(F.broadcast(hot), by, "left")
    salted = salted.withColumn("salt__", F.pmod(F.xxhash64(*left.columns), F.coalesce("salts__", F.lit(1))).cast("int")).drop("salts__")
    copied = right.join(F.broadcast(hot), by, "left").withColumn("salt__", F.explode(F.sequence(F.lit(0), F.coalesce("salts__", F.lit(1)) - 1)))
    return salted.join(copied.drop(n, "salts__"), [*by, "salt__"]).drop("salt__")


def as_text(values: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in values.to_pylist()]


def packed(rows: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """chunk, rows (and ``by``, an int): runs of rows that a task reads on end, up to about ``most`` bytes, of one value of ``by``, as compressed Arrow streams.

    A chunk is one row, at a third of its texts' size or so; its id names it wherever its results come back to. The table is bucketed by chunk, so what belongs to a
    chunk comes to where the chunk is.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        number = TaskContext.get().partitionId() << 32

        def row(f: int) -> pa.RecordBatch:
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[f][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for x in held.pop(f):
                    writer.write_batch(x)
            number += 1
            columns = {"chunk": pa.array([number], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            return pa.record_batch(columns | ({by: pa.array([f], pa.int32())} if by else {}))

        for batch in batches:
            step = max(1, batch.num_rows * most // max(most, batch.nbytes))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                of = part.column(by).to_numpy() if by else np.zeros(part.num_rows, np.int32)
                for f in np.unique(of).tolist():
                    held.setdefault(f, []).append(part.filter(pa.array(of == f)))
                    if sum(x.nbytes for x in held[f]) >= most:
                        yield row(f)
        for f in list(held):
            yield row(f)

    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.mapInArrow(pack, "chunk long, rows binary" + (f", {by} int" if by else "")), "packed", "chunk", buckets, dealt=False)


def unpacked(raw: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all()


def added_up(df: DataFrame, width: int) -> DataFrame:
    """Sum ``counts`` (int64 arrays of ``width`` as bytes) by ``block``.

    The blocks are dealt by key and summed one batch at a time, so a task holds one array for each of its
    keys, however many rows arrive. A first round adds within salted keys, so that a key's rows don't all meet
    in one task.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(raw, np.int64)
                if key in sums:
                    sums[key] += got
                else:
                    sums[key] = got.copy()
        if sums:
            yield pa.record_batch({"block": pa.array(list(sums), pa.int64()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "block long, counts binary"
    salted = df.select("block", "counts").repartition("block", F.pmod(F.spark_partition_id(), F.lit(16)))
    return salted.mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)


def blocks(counts: np.ndarray, width: int, first: int = 0) -> pa.RecordBatch | None:
    """The non-zero blocks of ``counts`` as rows for :func:`added_up`."""
    rows = counts.reshape(-1, width)
    used = np.flatnonzero(rows.any(axis=1))
    return pa.record_batch({"block": pa.array(used + first, pa.int64()), "counts": pa.array([rows[i].astype(np.int64).tobytes() for i in used], pa.binary())})


def gathered(summed: DataFrame, size: int, width: int) -> np.ndarray:
    """The array of ``size`` counts that ``added_up`` gives, on the driver; ``size`` is a fixed parameter of the model."""
    out = np.zeros(size, np.int64)
    for row in summed.toLocalIterator():
        out[row.block * width : (row.block + 1) * width] = np.frombuffer(row.counts, np.int64)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))
