"""Files as tasks see them: any file system that pyarrow knows, by path or URI, read in pieces of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Bytes that are read at a time.
PIECE = 1 << 20


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def pieces(path: str, size: int = PIECE) -> Iterator[bytes]:
    store, name = at(path)
    with store.open_input_stream(name) as f:
        while piece := f.read(size):
            yield piece


def digest(path: str) -> tuple[str, int]:
    """SHA-256 and length of a file."""
    sha, n = hashlib.sha256(), 0
    for piece in pieces(path):
        sha.update(piece)
        n += len(piece)
    return sha.hexdigest(), n


def write_whole(path: str, raw: bytes) -> None:
    """A file that appears with all its content or not at all."""
    store, name = at(path)
    store.create_dir(name.rpartition("/")[0])
    with store.open_output_stream(f"{name}.part") as f:
        f.write(raw)
    store.move(f"{name}.part", name)


def listed(path: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none where it doesn't exist."""
    store, name = at(path)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(name, allow_not_found=True)))


def below(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``) and size of all files below it, empty and hidden ones too; folders of one depth are listed side by side."""
    top = root.rstrip("/")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                files, name = at(f"{top}/{folder}")
                found = files.get_file_info(fs.FileSelector(name))
                paths = [f"{folder}{x.base_name}" + ("/" if x.type == fs.FileType.Directory else "") for x in found]
                yield pa.record_batch({"path": pa.array(paths, pa.string()), "size": pa.array([x.size for x in found], pa.int64())})

    folders, out = spark.createDataFrame([("",)], "path string"), []
    while not folders.isEmpty():
        here = written(folders.mapInArrow(look, "path string, size long"), "listed")
        out.append(here.filter(~F.col("path").endswith("/")))
        folders = here.filter(F.col("path").endswith("/")).select("path").repartition(spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, out)


def existing(paths: DataFrame) -> DataFrame:
    """``path`` of the rows whose file or folder exists. ``paths``: path, and at, where it lies; each is looked up by itself."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("at").to_pylist():
                store, name = at(x)
                found.append(store.get_file_info(name).type != fs.FileType.NotFound)
            yield batch.select(["path"]).filter(pa.array(found, pa.bool_()))

    return paths.select("path", "at").mapInArrow(look, "path string")
