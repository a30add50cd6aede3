"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of hashed n-grams (lower case, whole texts) is counted in all labelled training rows, by class. The log-count
ratio of a bucket is r = log(p/|p| : q/|q|), and the ``FEATURES`` buckets with the most weight of evidence (|r| times
the share of rows with it) make up the vectors r * presence. Logistic regression with an L2 penalty is then fitted to
about ``FIT_ROWS`` training rows, those with a low hash of doc_id, text and label (equal rows count once there); the counts have no such bound. The weights are one
array of ``2**BITS`` numbers, broadcast.

Empty and null texts get the score of a text without features. A row without label, or whose label is null or neither 0 nor 1,
teaches nothing; a doc_id with several labels counts once for each. Without rows of both classes every score is 0.5's side of the base rate.
Texts of any length are scored whole; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_up, as_text, blocks, gathered, if_small
from .ngrams import Presence, characters, hashed
from .op9_language import held_out_column, in_chunks

BITS, ORDERS, WIDTH = 20, (4, 5, 6), 4096
FEATURES, FIT_ROWS, SMOOTHING, PENALTY, STEPS = 4_000, 20_000, 1.0, 0.1, 300


#: Characters hashed at a time, so that the arrays stay in the processor's cache.
CHUNK = 1 << 16


def grams(texts: list[str], bits: int, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For runs of texts: the first one's number, where each starts, and for each order the bucket of the n-gram from each character.

    The n-grams of a text are those that start before its last ``order - 1`` characters.
    """
    for at, part in in_chunks([f" {x.lower()} " for x in texts], CHUNK):
        chars, starts = characters(part)
        yield at, starts, [hashed(chars, order, bits) for order in orders]


def inside(codes: list[np.ndarray], starts: np.ndarray, i: int, orders: tuple[int, ...]) -> np.ndarray:
    """The buckets of the n-grams of text ``i``, repeats included."""
    return np.concatenate([code[starts[i] : max(starts[i], starts[i + 1] - order + 1)] for code, order in zip(codes, orders, strict=True)])


def present(texts: list[str], bits: int, orders: tuple[int, ...], wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's number, how many, and the distinct (text, bucket) pairs in them, of ``wanted`` buckets, in order."""
    for at, starts, codes in grams(texts, bits, orders):
        found = []
        for code, order in zip(codes, orders, strict=True):
            hit = np.flatnonzero(wanted[code])
            text = np.searchsorted(starts, hit, "right") - 1
            own = hit + order <= starts[text + 1]
            found.append(text[own] << bits | code[hit[own]])
        pairs = np.unique(np.concatenate(found))
        yield at, len(starts) - 1, pairs >> bits, pairs & ((1 << bits) - 1)


class Model:
    """score = logistic(bias + the sum of the weights of the buckets present)."""

    def __init__(self, bits: int, orders: tuple[int, ...], weights: np.ndarray, bias: float):
        self.bits, self.orders, self.weights, self.bias = bits, orders, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        wanted = self.weights != 0
        for at, n, text, code in present(texts, self.bits, self.orders, wanted):
            out[at : at + n] += np.bincount(text, self.weights[code], minlength=n)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fitted(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows of scaled presence, by Nesterov's accelerated gradient; classes weigh the same."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    value = scale[col]
    w, bias, ahead, ahead_bias = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    squares = np.bincount(row, value**2, minlength=len(rows)) + 1
    rate = 1 / (0.25 * float((weight * squares).sum()) + penalty / max(1, len(rows)))
    for step in range(steps):
        margin = np.bincount(row, value * ahead[col], minlength=len(rows)) + ahead_bias
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels)
        new = ahead - rate * (np.bincount(col, value * error[row], minlength=len(scale)) + penalty / max(1, len(rows)) * ahead)
        new_bias = ahead_bias - rate * error.sum()
        ahead, ahead_bias = new + step / (step + 3) * (new - w), new_bias + step / (step + 3) * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def trained(rows: DataFrame, bits: int = BITS, orders: tuple[int, ...] = ORDERS, features: int = FEATURES, fit_rows: int = FIT_ROWS, smoothing: float = SMOOTHING, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """The model of ``rows`` with doc_id, text and label (0 or 1)."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, distinct = np.zeros((2, size), np.int64), np.zeros(WIDTH, np.int64), Presence(bits)
        for batch in batches:
            labels = np.array(batch.column(2).to_pylist(), np.int64)
            docs[:2] += np.bincount(labels, minlength=2)
            for at, starts, codes in grams(as_text(batch.column(1)), bits, orders):
                for i in range(len(starts) - 1):
                    counts[labels[at + i]][distinct.of(inside(codes, starts, i, orders))] += 1
        yield blocks(counts.ravel(), WIDTH)
        yield blocks(docs, WIDTH, 2 * size // WIDTH)

    counts = gathered(added_up(rows.mapInArrow(count, "block long, counts binary"), WIDTH), 2 * size + WIDTH, WIDTH)
    negative, positive, docs = counts[:size], counts[size : 2 * size], counts[2 * size : 2 * size + 2]
    weights = np.zeros(size)
    if not docs.all():
        return Model(bits, orders, weights, 0.0 if not docs.any() else float(20 * np.sign(docs[1] - docs[0])))
    p, q = positive + smoothing, negative + smoothing
    ratio = np.log(p / docs[1]) - np.log(q / docs[0])
    seen = (positive + negative >= 3) * np.abs(ratio) * np.abs(positive / docs[1] - negative / docs[0])
    chosen = np.sort(np.argsort(-seen, kind="stable")[: min(features, int((seen > 0).sum()))])
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = place >= 0
        for batch in batches:
            out: list[bytes] = []
            for _, n, text, code in present(as_text(batch.column(1)), bits, orders, wanted):
                out += [place[x].astype(np.int32).tobytes() for x in np.split(code, np.searchsorted(text, np.arange(1, n)))]
            yield pa.record_batch({"row": batch.column(0), "label": batch.column(2), "places": pa.array(out, pa.binary())})

    # a row is in the sample if the hash of all it holds is low: no task sees the sample's texts together
    named = rows.select(F.xxhash64("doc_id", "text", "label").alias("row"), "text", "label")
    share = fit_rows / int(docs.sum())
    if share < 1:
        named = named.filter(F.col("row") < F.lit(int(share * 2**64) - 2**63))
    got = named.mapInArrow(vectors, "row long, label int, places binary").dropDuplicates(["row"]).collect()  # about fit_rows vectors of at most ``features`` places
    got.sort(key=lambda r: r.row)
    w, bias = fitted([np.frombuffer(r.places, np.int32) for r in got], np.array([r.label for r in got], np.float64), ratio[chosen], penalty, steps)
    weights[chosen] = w * ratio[chosen]
    return Model(bits, orders, weights, bias)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    known = if_small(known)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).join(known, "doc_id").select("doc_id", "text", "label")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns from labelled rows outside the fold and scores all: doc_id, held_out, score, predicted."""
    known = labelled(docs, labels, id_col, text, label)
    model = docs.sparkSession.sparkContext.broadcast(trained(known.filter(~held_out_column(F.col("doc_id"), folds, fold))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.scores(as_text(batch.column(2)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_column(F.col(id_col), folds, fold).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
