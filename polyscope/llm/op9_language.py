"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered over all training texts (whole texts, lower case) as blocks of a fixed table of languages by
buckets, and added up without collecting a key's rows; the matrix of log-probabilities, ``languages x 2**BITS``, is
broadcast, and batches of texts are scored in numpy.

A null text, or one without letters (characters of the Unicode categories L; numerals such as ½ or Ⅷ aren't), is ``und`` with score 0. Rows whose training label is null teach nothing. With no training row at all everything is ``und``.
Ties go to the language first in code-point order. Texts of any length are scored whole, as are repeated rows;
columns other than those named are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_up, as_text, blocks, gathered
from .ngrams import characters, hashed, spans

BITS, ORDERS, WIDTH, SMOOTHING = 15, (1, 2, 3), 4096, 0.5
#: Characters counted or scored at a time.
CHUNK = 2_000_000


def in_chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters (one longer text stands alone), with the first one's number."""
    first = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(x)
    if texts[first:]:
        yield first, texts[first:]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, bits: int, orders: tuple[int, ...], smoothing: float):
        self.languages, self.bits, self.orders = languages, bits, orders
        total = counts.sum(axis=1, keepdims=True)
        #: bucket by language, so that one n-gram's values lie together
        self.log_p = np.ascontiguousarray(np.log((counts + smoothing) / (total + smoothing * counts.shape[1])).T, np.float32)
        self.prior = np.log(docs / docs.sum())

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        best, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return best, score
        for at, part in in_chunks([x.lower() for x in texts]):
            chars, starts = characters(part)
            total = np.tile(self.prior, (len(part), 1))
            for order in self.orders:
                code = hashed(chars, order, self.bits)
                first, last = (np.minimum(x, len(code)) for x in spans(starts, order))
                for k in range(len(self.languages)):
                    sums = np.zeros(len(code) + 1)
                    np.cumsum(self.log_p[code, k], dtype=np.float64, out=sums[1:])
                    total[:, k] += sums[last] - sums[first]
            top = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i, x in enumerate(part):
                if any(map(str.isalpha, x)):
                    best[at + i], score[at + i] = self.languages[top[i]], float(p[i])
        return best, score


def trained(rows: DataFrame, text: str, lang: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING) -> Model:
    """The model of all ``rows`` whose label isn't null; the languages are counted first, on the executors."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull())
    per = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    languages = [x for x, _ in per]
    number, size = {x: i for i, x in enumerate(languages)}, 1 << bits
    width = min(WIDTH, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * size, np.int64)
        for batch in batches:
            texts = [x.lower() for x in as_text(batch.column(0))]
            of = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for at, part in in_chunks(texts):
                chars, starts = characters(part)
                for order in orders:
                    code = hashed(chars, order, bits)
                    first, last = (np.minimum(x, len(code)) for x in spans(starts, order))
                    inside = np.zeros(len(code) + 1, np.int64)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, last, -1)
                    keep = np.cumsum(inside[:-1]) > 0
                    text_of = np.repeat(np.arange(len(part)), np.diff(starts))[: len(code)]
                    counts += np.bincount((of[at + text_of] * size + code)[keep], minlength=len(counts))
        yield blocks(counts, width)

    counts = gathered(added_up(rows.mapInArrow(count, "block long, counts binary"), width), len(languages) * size, width) if languages else np.zeros(0)
    return Model(languages, counts.reshape(len(languages), size).astype(np.float64), np.array([n for _, n in per], np.float64), bits, orders, smoothing)


def held_out_column(doc_id: Column, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == F.lit(fold)


def predicted(docs: DataFrame, model: Model, extra: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns ``extra``, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("text"), *[c.alias(n) for n, c in extra.items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields[1:]}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = shared.value.predict(as_text(batch.column(0)))
            yield pa.record_batch([*batch.columns[1:], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*kinds, "lang_pred", "score"])

    return rows.mapInArrow(predict, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """Learns from the rows outside the fold and predicts all: doc_id, held_out, lang_pred, score."""
    out = held_out_column(F.col(id_col), folds, fold)
    model = trained(docs.filter(~out), text, lang)
    return predicted(docs, model, {"doc_id": F.col(id_col).cast("long"), "held_out": out}, text)
