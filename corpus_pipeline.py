"""A corpus pipeline: low quality documents go, repeated lines go, one document of each group of near copies stays, repeated
strings go, and the rest is packed into training sequences. Each stage reads what its predecessor wrote.

Null texts pass the first two stages and near_copies as they are, come out of strings as empty ones, and are packed as empty documents, of the separator only; empty texts stay empty. A document that loses its
whole text goes. Repeated rows and rows of one doc_id are documents of their own to quality, lines and strings, and one to near_copies, which keeps or drops all of them; rows without doc_id are always kept there. Of equal texts the smallest
doc_id stays. Documents of a language without enough trusted text, or of none, are never rejected. Further columns, whatever their names, are carried along up to packing. Empty tables give no pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscope.llm.common import if_small, table, written
from polyscope.llm.op1_lines import deduplicated as without_repeated_lines
from polyscope.llm.op5_quality import judged, row_name
from polyscope.llm.op6_minhash import near_duplicates
from polyscope.llm.op7_suffix import deduplicated as without_repeated_strings
from polyscope.llm.op8_packing import pack
from polyscope.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    rejected = if_small(written(judged(docs, table(spark, sf_dir, "labels")).filter(~F.col("kept")).select("h").distinct(), "rejected"))
    return named(docs, row_name("doc_id", "text").alias("h")).join(rejected, "h", "left_anti").select("doc.*")


def named(docs: DataFrame, *more: Column, but: str = "") -> DataFrame:
    """``more``, and all columns of ``docs`` ``but`` one as one, where no name of theirs meets a stage's."""
    return docs.select(F.struct(*[c for c in docs.columns if c != but]).alias("doc"), *more)


def changed(rows: DataFrame, docs: DataFrame, was_empty: Column) -> DataFrame:
    """The columns of ``docs``, of which ``rows`` has doc and the new text, with n_chars of it; documents of which nothing is left go, those that were empty before stay."""
    left = rows.filter(F.col("text").isNull() | (F.col("text") != "") | was_empty)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[(new[c] if c in new else F.col("doc")[c]).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines."""
    return changed(without_repeated_lines(named(docs, F.col("doc_id"), F.col("text"), but="text")), docs, F.col("lines_removed") == 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    copies = if_small(written(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "copies-out"))
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that repeat."""
    found = without_repeated_strings(named(docs, F.col("doc_id"), F.col("text"), but="text"), keep_text=True).select("doc.doc", F.col("kept").alias("text"), "n_removed")
    return changed(found, docs, F.col("n_removed") == 0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("strings", strings), ("packing", packed)]
#: No SQL expresses these stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
