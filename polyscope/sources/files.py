"""Readers and writers of the files that an evaluation has."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from . import store


def numbered_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """qas_file, qas_line (from 1) and line of text files. Files are read in splits: a line's number is its place in its split and the lines of the splits before it."""
    where = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(pattern).select(where.alias("at"), F.col("_metadata.file_name").alias("qas_file"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("at.path").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(F.broadcast(splits.select("at", "first", before.alias("before"))), "at")  # a row for each split
    return numbered.select("qas_file", (F.col("id") - F.col("first") + F.col("before") + 1).cast("int").alias("qas_line"), "line")


def question_rows(lines: DataFrame) -> DataFrame:
    """Question rows of numbered lines of JSON: blank lines count but give no row. Values that aren't strings appear as text, as Python would write them; key presence decides the asset."""
    keys = F.json_object_keys("line")
    parsed = F.from_json("line", "question string, answer string, image_path string, image_folder_path string")
    rows = lines.filter(py_strip(F.col("line")) != "").select("qas_file", "qas_line", keys.alias("keys"), parsed.alias("r")).select("qas_file", "qas_line", "keys", "r.*")
    has = lambda k: F.array_contains("keys", k)
    text = lambda c: F.when(~has(c), "").otherwise(F.coalesce(F.col(c), F.lit("None")))
    return rows.select("qas_file", "qas_line", text("question").alias("question"), text("answer").alias("answer"), "image_path", "image_folder_path", has("image_path").alias("has_image_path"), has("image_folder_path").alias("has_folder"))


def read_question_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Question rows of JSON Lines files, with file name and physical line number."""
    return question_rows(numbered_lines(spark, pattern))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``) of all files below it; contents aren't read."""
    return store.below(spark, root).select("path")


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """file, size and sha256 of files of any size: tasks read them in pieces, and no value holds a file."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                sha, size = store.digest(path)
                yield pa.record_batch({"file": pa.array([path.rpartition("/")[2]]), "size": pa.array([size], pa.int64()), "sha256": pa.array([sha])})

    return spark.read.format("binaryFile").load(pattern).select("path").mapInArrow(digests, "file string, size long, sha256 string")


def header_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height, as shown, of a PNG, JPEG or WebP image by its headers; None for anything else. A JPEG's orientation may swap them."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        kind, number = raw[12:16], lambda a, b: int.from_bytes(raw[a:b], "little")
        if kind == b"VP8X":
            return number(24, 27) + 1, number(27, 30) + 1
        if kind == b"VP8L":
            return (number(21, 25) & 0x3FFF) + 1, (number(21, 25) >> 14 & 0x3FFF) + 1
        return (number(26, 28) & 0x3FFF, number(28, 30) & 0x3FFF) if kind == b"VP8 " else None
    if raw[:2] != b"\xff\xd8":
        return None
    at, turned = 2, False
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:  # fill bytes and markers without a segment
            at += 1 if marker == 0xFF else 2
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = (int.from_bytes(raw[at + i : at + i + 2], "big") for i in (5, 7))
            return (height, width) if turned else (width, height)
        if marker == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            turned = orientation(raw[at + 10 : at + 2 + size]) >= 5
        at += 2 + size
    return None


def orientation(tiff: bytes) -> int:
    """The orientation that the first directory of Exif data names, 1 where it names none."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return 1
    number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
    first = number(4, 4)
    for i in range(number(first, 2)):
        entry = first + 2 + 12 * i
        if number(entry, 2) == 0x0112:
            return number(entry + 8, 2)
    return 1


#: Of an image so many bytes are kept to find its headers in.
HEADERS = 16 << 20


def image_sizes(paths: DataFrame) -> DataFrame:
    """path, width, height (null for what is no PNG, JPEG or WebP image) and sha256 of the images that exist; files are read in pieces, and pixels aren't decoded. ``paths``: path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                sha, head, size = hashlib.sha256(), b"", None
                for piece in store.pieces(path):
                    sha.update(piece)
                    if size is None and len(head) < HEADERS:
                        head += piece
                        size = header_size(head)
                columns = [pa.array([path]), pa.array([size and size[0]], pa.int32()), pa.array([size and size[1]], pa.int32()), pa.array([sha.hexdigest()])]
                yield pa.record_batch(columns, names=["path", "width", "height", "sha256"])

    there = store.existing(paths.select("path", F.col("path").alias("at")))
    return there.mapInArrow(read, "path string, width int, height int, sha256 string")


def license_line(spark: SparkSession, readme: str) -> str | None:
    """What a README's first line that starts with "license:" names."""
    lines = spark.read.text(readme, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("pos", "line"))
    found = lines.filter(F.col("line").startswith("license:")).orderBy("pos").select(py_strip(F.regexp_replace("line", "^license:", "")).alias("x")).limit(1).collect()
    return found[0].x if found else None


def write_json_lines(df: DataFrame, path: str, append: bool = False, by: str | None = None) -> None:
    """Rows as JSON Lines; ``by`` deals them into a folder for each of its values, such as a run's."""
    out = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False)
    (out.partitionBy(by) if by else out).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json_document(value: object, path: str) -> None:
    """A small result as one indented JSON document."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def load_config(path: str) -> dict:
    """A JSON or YAML configuration; YAML needs the yaml package."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(raw)
    return json.loads(raw)


def write_provenance(path: str, layout: str, revisions: dict) -> None:
    """Where data came from and when."""
    from datetime import datetime, timezone

    write_json_document({**revisions, "layout": layout, "downloaded_at_utc": datetime.now(timezone.utc).isoformat()}, path)
