"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .op1_lines import SQL as LINES_SQL
from .op11_audit import SQL as AUDIT_SQL
from .op12_trie import SQL as TRIE_SQL
from .op13_urls import SQL as URLS_SQL


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_lines import digests

    return digests(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_rangejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_rangejoin import linked

    return linked(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_suffix import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_audit import audited

    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_urls import verdicts

    return verdicts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_bpe": op2_bpe,
    "op3_nearest": op3_nearest,
    "op4_rangejoin": op4_rangejoin,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_suffix": op7_suffix,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_audit": op11_audit,
    "op12_trie": op12_trie,
    "op13_urls": op13_urls,
}
SQL: dict[str, str] = {"op1_lines": LINES_SQL, "op11_audit": AUDIT_SQL, "op12_trie": TRIE_SQL, "op13_urls": URLS_SQL}
