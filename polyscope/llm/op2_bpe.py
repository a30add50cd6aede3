"""BPE encoding and decoding through a compiled lexicon of frequent words.

A first pass counts words over all texts (white-space separated; each task reports its most frequent, which is
all that a cache needs, as the lexicon decides how fast a word is encoded and never how). The most frequent become a minimal
acyclic automaton with ids as outputs, which each Python worker maps into memory; every other word is merged exactly.

Null texts are empty: no ids. Texts of any length are encoded whole. Special tokens in a text get their ids, as
the tokenizers library gives them. Only the columns named are read, so others may have any name; repeated rows
give repeated rows, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, lexicon_of
from .common import as_text

#: Words of the lexicon, and words that a task reports for it.
LEXICON_WORDS, TASK_WORDS = 30_000, 4_000


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words: counts of all texts, of which each task passes on its ``TASK_WORDS`` highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for x in as_text(batch.column(0)):
                counts.update(x.split())
            if len(counts) > 2_000_000:  # bounded memory: words seen once so far go
                counts = Counter({w: n for w, n in counts.items() if n > 1})
        top = counts.most_common(TASK_WORDS)
        yield pa.record_batch({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return [r.word for r in top.collect()]


def encoder_parts(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> tuple:
    """What workers make an encoder of, broadcast: the vocabulary file's text and the compiled lexicon (at most ``words`` words)."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    sc = docs.sparkSession.sparkContext
    lexicon = lexicon_of(Vocabulary(raw), frequent_words(docs, text, words)) if words else b""
    return sc.broadcast(raw), sc.broadcast(lexicon)


def encoder_from(parts: tuple) -> Encoder:
    vocabulary, lexicon = parts
    return Encoder(Vocabulary(vocabulary.value), lexicon.value or None)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and its token ids, for use as training data."""
    parts = encoder_parts(docs, path, text, words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_from(parts)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.record_batch({"doc_id": part.column(0), "ids": pa.array([encoder.encode(x) for x in as_text(part.column(1))], pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded_bytes(ids: list[int], bytes_of: list[bytes]) -> bytes:
    """The text of ``ids`` in UTF-8; bytes that aren't UTF-8 become replacement characters."""
    raw = b"".join(map(bytes_of.__getitem__, ids))
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table of doc_id and ids (null ids: empty)."""
    with open(path, encoding="utf-8") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Vocabulary(raw.value).bytes_of
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, x or [])).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """Per document the number of tokens and digests of the ids and of the text decoded from them."""
    parts = encoder_parts(docs, path, text, words)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_from(parts)
        table = encoder.vocabulary.bytes_of
        bytes_of = [table.get(i, b"") for i in range(max(table) + 1)]
        decimal = [str(i) for i in range(max(table) + 1)]
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for x in as_text(batch.column(1)):
                ids = encoder.encode(x)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded_bytes(ids, bytes_of)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(digest, schema)
