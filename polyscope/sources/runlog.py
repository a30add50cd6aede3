"""A log of JSON Lines that runs append to, of which each task's rows appear once or not at all.

A task writes to a file of its own attempt, out of readers' sight, and names it in its commit message when it is complete. On the driver the
messages of all tasks become a commit: a list of files that is written whole, after which the files move to where readers look. A task that is retried, or runs twice, leaves files that no commit
names. Where tasks fail for good, those that ended are committed all the same, so what a run has answered is kept, and the next one goes on from there. Where the driver is lost, :func:`recover` does so.

A log is a folder of ``part-*.jsonl`` files, which any reader of JSON Lines takes; ``_commits`` and ``_staged`` are hidden from it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import store
from .shared import registered


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


def publish(path: str, write: str, files: list[dict], complete: bool) -> None:
    """The commit of a write, then its files where readers look. Doing it again, or going on with it, changes nothing."""
    commit = f"{path}/_commits/{write}.json"
    if f"{write}.json" not in store.listed(f"{path}/_commits"):
        store.write_whole(commit, json.dumps({"write": write, "complete": complete, "files": files}).encode())
    fs, root = store.at(path)
    staged = set(store.listed(f"{path}/_staged/{write}"))
    for f in files:
        if f["file"] in staged:
            fs.move(f"{root}/_staged/{write}/{f['file']}", f"{root}/part-{write}-{f['partition']:05d}.jsonl")
    if write in store.listed(f"{path}/_staged"):
        fs.delete_dir(f"{root}/_staged/{write}")


def recover(path: str) -> int:
    """Ends what a lost driver has left: moves that were still to be made, and complete files of writes without a commit, one for each task. Gives the number of writes; none may be under way."""
    left = store.listed(f"{path}/_staged")
    for write in left:
        if f"{write}.json" in store.listed(f"{path}/_commits"):
            files = json.loads(b"".join(store.pieces(f"{path}/_commits/{write}.json")))["files"]
        else:
            ended = {int(f.split("-")[0]): f for f in reversed(store.listed(f"{path}/_staged/{write}")) if f.endswith(".jsonl")}
            files = [{"partition": p, "file": f, "rows": None} for p, f in sorted(ended.items())]
        publish(path, write, files, False)
    return len(left)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.name = path, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        file = f"{context.partitionId():05d}-{context.taskAttemptId()}.jsonl"
        fs, root = store.at(f"{self.path}/_staged/{self.name}")
        fs.create_dir(root)
        rows = 0
        with fs.open_output_stream(f"{root}/{file}.part") as out:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    out.write(line.encode() + b"\n")
                rows += batch.num_rows
        fs.move(f"{root}/{file}.part", f"{root}/{file}")
        return Written(context.partitionId(), file, rows)

    def ended(self, messages: list, complete: bool) -> None:
        files = [{"partition": m.partition, "file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        publish(self.path, self.name, files, complete)

    def commit(self, messages: list) -> None:
        self.ended(messages, True)

    def abort(self, messages: list) -> None:
        self.ended(messages, False)


class RunLog(DataSource):
    """``df.write.format("runlog").mode("append").save(path)`` of a column of lines."""

    @classmethod
    def name(cls) -> str:
        return "runlog"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite or [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("a log takes lines, and is appended to only")
        return Writer(self.options["path"])


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to the log as JSON Lines, nulls included."""
    registered(rows.sparkSession, RunLog)
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line")).write.format("runlog").mode("append").save(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """write, complete, partition and rows of each file that was committed (rows null where a commit was recovered)."""
    read = spark.read.schema("write string, complete boolean, files array<struct<partition:int,file:string,rows:long>>").json(f"{path}/_commits/*.json")
    return read.select("write", "complete", F.explode("files").alias("f")).select("write", "complete", "f.partition", "f.rows")
