"""Snapshots of a data set, pinned by a lock file, read from a mirror: wrong bytes are refused.

A lock file is a JSON document: ``revision``, and ``files``, each with path, size and sha256. A mirror holds them below ``root``, or ``root``/``revision``.
``spark.read.format("snapshot").option("lock", ...).load(root)`` gives a row for each piece of at most ``PIECE`` bytes of each file: path, revision, size, sha256, piece (from 0) and content. ``allow`` names
patterns of paths, separated by commas, where ``**`` is any path and ``*`` any name; filters on path and size are pushed down too, so that nothing but the files asked for is opened. A partition is a
run of files of ``PARTITION`` bytes or so, or one large file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from . import store
from .shared import registered

PARTITION = 128 << 20
#: Rows of a batch of pieces.
PIECES = 8
SCHEMA = "path string, revision string, size long, sha256 string, piece int, content binary"


def matcher(patterns: str | None) -> re.Pattern:
    """Whole paths that one of the patterns fits; all paths without patterns."""
    stand = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    each = ["".join(stand.get(x) or re.escape(x) for x in re.findall(r"\*\*|.", p.strip(), re.S)) for p in (patterns or "**").split(",") if p.strip()]
    return re.compile(r"(?:" + "|".join(each) + r")\Z", re.S)


def lock_of(path: str) -> dict:
    return json.loads(b"".join(store.pieces(path)))


#: What is asked of a file by filters that are pushed down.
ASKED = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


@dataclass
class Files(InputPartition):
    files: list


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        lock = lock_of(options["lock"])
        self.revision, self.root = lock["revision"], options["path"]
        fits = matcher(options.get("allow"))
        self.files = [f for f in lock["files"] if fits.match(f["path"])]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in ASKED and column in ("path", "size", "sha256"):
                self.files = [x for x in self.files if ASKED[type(f)](x[column], f.value)]
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, held = [], PARTITION
        for f in sorted(self.files, key=lambda f: f["path"]):
            if held >= PARTITION or held + f["size"] > PARTITION:
                out.append([])
                held = 0
            out[-1].append(f)
            held += f["size"]
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "revision": pa.string(), "size": pa.int64(), "sha256": pa.string(), "piece": pa.int32(), "content": pa.binary()}
        batch = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
        rows = []
        for f in partition.files:
            sha, n = hashlib.sha256(), 0
            for i, piece in enumerate(self.pieces(f["path"])):
                sha.update(piece)
                n += len(piece)
                rows.append((f["path"], self.revision, f["size"], f["sha256"], i, piece))
                if len(rows) == PIECES:
                    yield batch(rows)
                    rows = []
            if n == 0:
                rows.append((f["path"], self.revision, 0, f["sha256"], 0, b""))
            if (sha.hexdigest(), n) != (f["sha256"], f["size"]):
                raise ValueError(f"{f['path']} isn't the file that the lock names: {n} bytes, SHA-256 {sha.hexdigest()}")
        if rows:
            yield batch(rows)

    def pieces(self, path: str) -> Iterator[bytes]:
        """Of a mirror of the revision, or else of the only one."""
        below = f"{self.root}/{self.revision}"
        yield from store.pieces(f"{below}/{path}" if store.listed(below) else f"{self.root}/{path}")


class Snapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, root: str, lock: str, allow: str | None = None) -> DataFrame:
    registered(spark, Snapshot)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("snapshot").option("lock", lock)
    return (reader.option("allow", allow) if allow else reader).load(root)


def fetch(spark: SparkSession, root: str, lock: str, out: str, allow: str | None = None) -> DataFrame:
    """Copies a snapshot's files below ``out``: path, size. Each is written beside its place and moved there when its digest is right, so ``out`` never holds part of a file."""
    target = out.rstrip("/")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, sha, n = None, None, None, 0

        def end() -> pa.RecordBatch:
            fs, name = store.at(f"{target}/{now[0]}")
            stream.close()
            if sha.hexdigest() != now[1]:
                raise ValueError(f"{now[0]} was not copied whole")
            fs.move(f"{name}.part", name)
            return pa.record_batch({"path": pa.array([now[0]]), "size": pa.array([n], pa.int64())})

        for batch in batches:
            for path, wanted, content in zip(*(batch.column(c).to_pylist() for c in ("path", "sha256", "content")), strict=True):
                if (path, wanted) != now:
                    if now:
                        yield end()
                    now, sha, n = (path, wanted), hashlib.sha256(), 0
                    fs, name = store.at(f"{target}/{path}")
                    fs.create_dir(name.rpartition("/")[0])
                    stream = fs.open_output_stream(f"{name}.part")
                stream.write(content)
                sha.update(content)
                n += len(content)
        if now:
            yield end()

    return read(spark, root, lock, allow).select("path", "sha256", "content").mapInArrow(keep, "path string, size long")


def write_lock(spark: SparkSession, root: str, out: str, revision: str) -> None:
    """The lock file of what a mirror holds: digests are made where the files are read."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                sha, size = store.digest(f"{root.rstrip('/')}/{path}")
                yield pa.record_batch({"path": pa.array([path]), "size": pa.array([size], pa.int64()), "sha256": pa.array([sha])})

    files = store.below(spark, root).repartition(spark.sparkContext.defaultParallelism, "path")
    rows = files.mapInArrow(digests, "path string, size long, sha256 string").orderBy("path")
    store.write_whole(out, json.dumps({"revision": revision, "files": [r.asDict() for r in rows.toLocalIterator()]}, indent=1).encode())
