"""Runs as streams: inputs whose id has no successful row yet are processed, and what came of them is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resume_stream(spark: SparkSession, inputs: DataFrame, log: str, checkpoint: str, run: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Processes what is there and ends. ``inputs``: a stream with input_id; ``log``: a Parquet folder, which is the sink's memory."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["input_id"])
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(log)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(batch.sparkSession.read.parquet(log).filter("status = 'success'").select("input_id"), "input_id", "left_anti")
        run(new).write.mode("append").parquet(log)

    return inputs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def attempts(inputs: DataFrame, load: Callable[[], Callable[[dict], dict]], order: str, made: str) -> DataFrame:
    """Tries each input until it succeeds once, by what the stream remembers of its id: a flag in the state store, and no log is read.

    ``inputs``: a stream with input_id; several rows of an id in a batch are tried in ``order``, and rows of ids that have succeeded give nothing. ``load`` makes, once a task, what is called with
    a row and gives values for the columns ``made``, status among them. Rows without input_id are of one id. State grows with the ids, so it belongs into the RocksDB store.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields)
    columns = [c.split()[0] for c in made.split(", ")]
    ready: list[Callable] = []

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.exists and state.get[0]
        rows = pd.concat(list(batches)) if not done else None
        if done:
            return
        if not ready:
            ready.append(load())
        out = []
        for row in rows.sort_values(order).to_dict("records"):
            got = ready[0](row)
            out.append({**row, **{c: got.get(c) for c in columns}})
            if got["status"] == "success":
                done = True
                break
        state.update((done,))
        yield pd.DataFrame(out)

    return inputs.groupBy("input_id").applyInPandasWithState(step, f"{kinds}, {made}", "done boolean", "append", GroupStateTimeout.NoTimeout)


def attempt_stream(inputs: DataFrame, load: Callable[[], Callable[[dict], dict]], order: str, made: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends :func:`attempts` of what is there to a Parquet folder, each batch exactly once, and ends."""
    spark = inputs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    tried = attempts(inputs, load, order, made)
    return tried.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
