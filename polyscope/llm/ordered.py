"""Running values over a table in order: places, sums and exclusive-ors within a key, of which no task needs all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIRST, LAST = 1, 2


def running(rows: DataFrame, key: str, order: list[Column], xors: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``at``, the place of a row within its key (a long, not null) in ``order``, and of the columns ``xors`` and ``sums`` (longs, not null) their values up to and with the row.

    Ranges of key and order are partitions, which are scanned as they stream by. Only a partition's first key can have begun in others, and only
    the last key of those can go on, so what is carried over is a row for each partition.
    """
    values = [*xors, *sums]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", at long, part__ int, edge__ int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, place = batch.column(key).to_numpy(), np.arange(batch.num_rows)
            goes_on = before is not None and keys[0] == before[0]
            new = np.concatenate([[not goes_on], keys[1:] != keys[:-1]])
            start = np.maximum.accumulate(np.where(new, place, -1))
            carried = start < 0
            at = np.where(carried, place + (before[1] + 1 if goes_on else 0), place - start)
            last = [keys[-1], at[-1]]
            for name in values:
                v = batch.column(name).to_numpy()
                if name in xors:
                    total = np.bitwise_xor.accumulate(v)
                    got = total ^ np.where(carried, before[len(last)] if goes_on else 0, np.where(start > 0, total[start - 1], 0))
                else:
                    total = np.cumsum(v)
                    got = total - np.where(carried, -before[len(last)] if goes_on else 0, np.where(start > 0, total[start - 1], 0))
                last.append(got[-1])
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(got, pa.int64()))
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] = FIRST if before is None else 0
            before = last
            if held is not None:
                yield held
            held = pa.record_batch([*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge)], names=[*batch.schema.names, "at", "part__", "edge__"])
        if held is not None:
            edge = held.column("edge__").to_numpy().copy()
            edge[-1] |= LAST
            yield held.set_column(held.schema.get_field_index("edge__"), "edge__", pa.array(edge))

    local = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, schema), "running")
    is_last = F.col("edge__").bitwiseAND(LAST) != 0
    total = {"at": F.sum(F.when(is_last, F.col("at") + 1).otherwise(0)), **{x: F.bit_xor(F.when(is_last, F.col(x)).otherwise(0)) for x in xors}, **{x: F.sum(F.when(is_last, F.col(x)).otherwise(0)) for x in sums}}
    edges = local.filter("edge__ <> 0").groupBy(key, "part__").agg(*[v.alias(f"{k}__c") for k, v in total.items()])
    earlier = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(key, "part__", *[(F.bit_xor(f"{k}__c") if k in xors else F.sum(f"{k}__c")).over(earlier).alias(f"{k}__e") for k in total]).filter("at__e is not null")
    joined = local.join(F.broadcast(carry), [key, "part__"], "left")
    found = {k: F.col(k).bitwiseXOR(F.coalesce(f"{k}__e", F.lit(0))) if k in xors else F.col(k) + F.coalesce(f"{k}__e", F.lit(0)) for k in total}
    return joined.withColumns(found).select(*rows.columns, "at")
