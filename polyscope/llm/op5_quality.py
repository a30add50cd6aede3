"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

All n-grams of the trusted texts (whole texts, padded at the start) are counted. Higher order counts, continuation counts of the
lower orders, the discounts D1, D2, D3+ from counts of counts and the weights of backing off are aggregations and
joins of count tables that are sharded by n-gram. A document's perplexity per character then comes from joins with those tables, too: documents are packed into chunks of up to
``CHUNK_BYTES``; a chunk's distinct n-grams go, packed, to the shards that their hashes name, those of each shard are looked up in the tables, longest first, and each chunk gets the
log-probabilities of its own back in order; no model is collected or broadcast. A document whose perplexity
exceeds the limit of its language is rejected. The limit is the ``QUANTILE`` of held-out perplexities of its trusted documents, times ``SLACK``:
n-grams are counted in ``FOLDS`` folds of the trusted texts, and a trusted text is scored with the counts of the other folds. Equal
texts are in one fold and count once. Of too few texts for a quantile (99 for 0.99) the highest perplexity says little, so the limit is then at
least the prediction limit of a further log-perplexity, from their mean and deviation.

Characters are numbered by their frequency in trusted texts. One that isn't in them is the same to the model whichever it is, as no n-gram with it is known; so are those beyond the
``CHARACTERS`` most frequent, the vocabulary of an n-gram's 60-bit key.

Null and empty texts have no perplexity and are kept: there is nothing to judge. A language with fewer than ``LEAST`` held-out trusted
texts has no limit, and nothing of it is rejected; a null language is one of its own.
Equal texts get equal perplexities; repeated rows are judged each by itself. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, as_text, bucketed, if_small, mixed, packed, unpacked, written
from .ngrams import characters
from .op9_language import in_chunks

ORDER, QUANTILE, SLACK, CHUNK_BYTES = 4, 0.99, 1.1, 8 << 20
FOLDS, LEAST = 5, 10
#: Compressed bytes of chunks whose n-grams one shard holds, and shards at most.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 4096
#: The fold number of the model of all folds; model f is that of all folds but f.
ALL = -1
#: A character takes 15 bits of an n-gram's key: the sign before a text, a character that isn't numbered, and the numbered ones.
CHAR_BITS, START, OTHER = 15, 1, 2
CHARACTERS = (1 << CHAR_BITS) - 3


def alphabet(docs: DataFrame, text: str) -> np.ndarray:
    """The number of each code point, by frequency in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0x110000, np.int64)
        for batch in batches:
            for _, part in in_chunks(as_text(batch.column(0))):
                found = np.bincount(characters(part)[0])
                counts[: len(found)] += found
        used = np.flatnonzero(counts)
        yield pa.record_batch({"char": pa.array(used), "n": pa.array(counts[used])})

    found = docs.select(text).mapInArrow(count, "char long, n long").groupBy("char").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "char").limit(CHARACTERS)
    out = np.full(0x110000, OTHER, np.int32)
    for i, row in enumerate(found.select("char").collect()):
        out[row.char] = OTHER + 1 + i
    return out


def keys(texts: list[str], order: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the n-gram that ends at each character (start signs before the first), and where each text starts."""
    chars, starts = characters(texts)
    size = np.diff(starts)
    padded = np.full(len(chars) + (order - 1) * len(texts), START, np.int64)
    at = np.arange(len(chars)) + np.repeat(np.arange(1, len(texts) + 1) * (order - 1), size)
    padded[at] = numbers[chars]
    code = np.zeros(len(at), np.int64)
    for i in range(order):
        code = code << CHAR_BITS | padded[at - (order - 1 - i)]
    return code, starts


def distinct_keys(texts: list[str], order: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs; a bounded number of characters is looked at at a time."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, part in in_chunks(texts, 1_000_000):
        code, n = np.unique(keys(part, order, numbers)[0], return_counts=True)
        found, inverse = np.unique(np.concatenate([found, code]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), minlength=len(found)).astype(np.int64)
    return found, counts


def counted(docs: DataFrame, text: str, order: int, numbers: np.ndarray, folds: int = 0) -> DataFrame:
    """fold, gram and n: how often each n-gram of the highest order occurs in all texts (fold ALL), and in all but those of each fold (column ``fold``)."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(1).to_numpy()
            for f in np.unique(fold).tolist():
                code, n = distinct_keys(as_text(batch.column(0).filter(pa.array(fold == f))), order, shared.value)
                yield pa.record_batch({"fold": pa.array(np.full(len(code), f, np.int32)), "gram": pa.array(code), "n": pa.array(n)})

    rows = docs.select(F.col(text).alias("text"), (F.col("fold") if folds else F.lit(ALL)).cast("int").alias("fold"))
    of = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"n{f}") for f in range(folds)]
    sums = rows.mapInArrow(count, "fold int, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"), *of)
    each = [F.struct(F.lit(ALL).alias("fold"), F.col("n"))] + [F.struct(F.lit(f).alias("fold"), (F.col("n") - F.col(f"n{f}")).alias("n")) for f in range(folds)]
    return sums.select("gram", F.inline(F.array(*each))).filter("n > 0").select("fold", "gram", "n")


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """D1, D2 and D3+ of modified Kneser-Ney smoothing of each fold's model, from how many n-grams occur once to four times."""
    got: dict[int, dict] = {}
    for r in counts.groupBy("fold", F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("k")).collect():
        got.setdefault(r.fold, {})[r.n] = r.k
    out = {}
    for fold, of in got.items():
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            out[fold] = 0.5, 1.0, 1.5  # too few for an estimate
            continue
        y = n1 / (n1 + 2 * n2)
        out[fold] = tuple(min(max(i - (i + 1) * y * b / a, 0.01), i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return out


class Model:
    """``grams``: by order, fold, gram and p of each n-gram seen. ``contexts``: by order, fold, gram and the weight w that its lower order gets. ``seen``: by fold, the
    characters of the uniform distribution. ``numbers``: those of the characters."""

    def __init__(self, grams: dict[int, DataFrame], contexts: dict[int, DataFrame], seen: dict[int, int], numbers: np.ndarray, order: int):
        self.grams, self.contexts, self.seen, self.numbers, self.order = grams, contexts, seen, numbers, order


def by_fold(values: dict[int, float], default: float = 0.0) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for f, v in values.items() for x in (f, float(v))])[F.col("fold")], F.lit(default))


def trained(docs: DataFrame, text: str = "text", order: int = ORDER, folds: int = 0) -> Model:
    """The models of all rows (ALL) and of all rows but a fold's (column ``fold``); every table is sharded by n-gram or context."""
    numbers = alphabet(docs, text)
    mask = lambda k: (1 << (CHAR_BITS * k)) - 1
    counts = {order: written(counted(docs, text, order, numbers, folds), "kn-counts")}
    for k in range(order - 1, 0, -1):  # continuation counts: in how many n-grams one character longer it ends
        counts[k] = written(counts[k + 1].groupBy("fold", F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram")).agg(F.count("*").alias("n")), "kn-counts")
    seen = {r.fold: r.n for r in counts[1].groupBy("fold").agg(F.count("*").alias("n")).collect()}
    uniform = by_fold({f: 1.0 / (n + 1) for f, n in seen.items()})
    lower, grams, contexts = None, {}, {}
    for k in range(1, order + 1):
        d1, d2, d3 = (by_fold({f: d[i] for f, d in found.items()}) for found in [discounts(counts[k])] for i in range(3))
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = F.shiftright("gram", CHAR_BITS)
        of = counts[k].groupBy("fold", ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.sum(d).alias("off"))
        joined = counts[k].select("fold", "gram", "n", ctx.alias("ctx")).join(of, ["fold", "ctx"])
        p = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
        if lower is None:
            full = joined.select("fold", "gram", (p + F.col("off") / F.col("total") * uniform).alias("p"))
        else:
            short = lower.select("fold", F.col("gram").alias("short"), F.col("p").alias("lower_p"))
            full = joined.withColumn("short", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))).join(short, ["fold", "short"])
            full = full.select("fold", "gram", (p + F.col("off") / F.col("total") * F.col("lower_p")).alias("p"))
        lower = grams[k] = written(full, f"kn-{k}")
        contexts[k] = written(of.select("fold", F.col("ctx").alias("gram"), (F.col("off") / F.col("total")).alias("w")), "kn-contexts")
    return Model(grams, contexts, seen, numbers, order)


class Table:
    """int64 keys to float64 values, by hashing into slots; keys that meet in a slot are searched for."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(np.float64)
        self.bits = max(4, int(len(key)).bit_length() + 1)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.slot[self.hashed(self.key)] = np.arange(len(key), dtype=np.int32)
        self.key_at = np.append(self.key, -1)

    def hashed(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values of keys that are there."""
        at = self.slot[self.hashed(key)].astype(np.int64)
        odd = np.flatnonzero(self.key_at[at] != key)
        if len(odd):
            at[odd] = np.searchsorted(self.key, key[odd])
        return self.value[at]


def means(texts: list[str], table: Table, order: int, numbers: np.ndarray) -> list[float | None]:
    """exp of the mean of minus the table's values over each text's n-grams; None for an empty one."""
    out: list[float | None] = []
    for _, part in in_chunks(texts, 1_000_000):
        code, starts = keys(part, order, numbers)
        total = np.zeros(len(code) + 1)
        if len(code):
            np.cumsum(table.get(code), out=total[1:])
        n = np.diff(starts)
        mean = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(n, 1)
        out += [float(np.exp(-m)) if c else None for m, c in zip(mean, n, strict=True)]
    return out


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(grams.view(np.uint64)) >> U64(32)) % U64(shards)).astype(np.int64)


def squeezed(grams: np.ndarray) -> bytes:
    """Ascending int64 as differences, the bytes of one place after another, compressed."""
    return pa.compress(np.diff(grams, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def answered(left: DataFrame, model: Model) -> DataFrame:
    """fold, gram, logp of distinct n-grams (fold, gram): joins with the count tables, of which each takes only what the longer n-grams haven't got."""
    left, out = left.withColumn("back", F.lit(0.0)), []
    for k in range(model.order, 0, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (CHAR_BITS * k)) - 1))
        looked = left.withColumn("key__", short).join(model.grams[k].select("fold", F.col("gram").alias("key__"), "p"), ["fold", "key__"], "left").drop("key__")
        looked = written(looked, "kn-looked")
        out.append(looked.filter("p is not null").select("fold", "gram", (F.col("back") + F.log("p")).cast("float").alias("logp")))
        missed = looked.filter("p is null").select("fold", "gram", "back", F.shiftright(short, CHAR_BITS).alias("key__"))
        weights = model.contexts[k].select("fold", F.col("gram").alias("key__"), "w")
        left = missed.join(weights, ["fold", "key__"], "left").select("fold", "gram", (F.col("back") + F.log(F.coalesce("w", F.lit(1.0)))).alias("back"))
    uniform = -F.log(by_fold({f: n + 1 for f, n in model.seen.items()}, 1.0))
    out.append(left.select("fold", "gram", (F.col("back") + uniform).cast("float").alias("logp")))
    return reduce(DataFrame.unionByName, out)


#: What chunks ask of shards, and what shards know.
ASKED, KNOWN = "shard long, chunk long, fold int, n long, grams binary", "shard long, fold int, n long, grams binary, logp binary"
_KINDS = {"shard": pa.int64(), "chunk": pa.int64(), "fold": pa.int32(), "n": pa.int64(), "grams": pa.binary(), "logp": pa.binary()}


def rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], _KINDS[c]) for i, c in enumerate(names)], names=names)


def packed_answers(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """KNOWN of rows of fold, gram, logp."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fold, gram, logp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        shard, rows = shard_of(gram, shards), []
        order = np.lexsort((gram, fold, shard))
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(shard[order]) != 0) | (np.diff(fold[order]) != 0)])[: len(order)])
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            of = order[a:b]
            rows.append((int(shard[of[0]]), int(fold[of[0]]), len(of), squeezed(gram[of]), logp[of].astype(np.float32).tobytes()))
        yield rows_of(rows, ["shard", "fold", "n", "grams", "logp"])


def answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of a shard: chunk, fold, shard and the log-probabilities in order of the n-grams asked for."""
    parts: dict[int, list] = {}
    for fold, n, grams, logp in zip(*(known.column(c).to_pylist() for c in ("fold", "n", "grams", "logp")), strict=True):
        parts.setdefault(fold, []).append((unsqueezed(grams, n), np.frombuffer(logp, np.float32)))
    tables = {fold: Table(*(np.concatenate(x) for x in zip(*of, strict=True))) for fold, of in parts.items()}
    got = [tables[fold].get(unsqueezed(grams.as_py(), n)).astype(np.float32).tobytes() for fold, n, grams in zip(asked.column("fold").to_pylist(), asked.column("n").to_pylist(), asked.column("grams"), strict=True)]
    return pa.table({"chunk": asked.column("chunk"), "fold": asked.column("fold"), "shard": asked.column("shard"), "logp": pa.array(got, pa.binary())})


def distinct_grams(asked: pa.Table) -> pa.Table:
    """Of a shard: the distinct n-grams (fold, gram)."""
    held: dict[int, list] = {}
    for fold, n, grams in zip(asked.column("fold").to_pylist(), asked.column("n").to_pylist(), asked.column("grams"), strict=True):
        of = held.setdefault(fold, [np.zeros(0, np.int64)])
        of.append(unsqueezed(grams.as_py(), n))
        if sum(map(len, of[1:])) > max(1 << 20, len(of[0])):
            held[fold] = [np.unique(np.concatenate(of))]
    found = {fold: np.unique(np.concatenate(of)) for fold, of in held.items()}
    return pa.table({"fold": pa.array(np.concatenate([np.full(len(x), f, np.int32) for f, x in found.items()])), "gram": pa.array(np.concatenate(list(found.values())))})


def perplexities(rows: DataFrame, model: Model, most: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``rows`` but text, with ``perplexity`` of the model of all, and ``held`` of the model without the row's fold (null where fold is ALL); ``rows`` has text and fold, and no columns chunk, rows, perplexity or held."""
    order, shared = model.order, rows.sparkSession.sparkContext.broadcast(model.numbers)
    chunks = packed(rows, most)
    size = chunks.agg(F.sum(F.octet_length("rows"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(8, -(-size // SHARD_BYTES)))

    def texts_by_fold(table: pa.Table) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """Which rows each model scores: the model of all, all rows; the others, those of their fold."""
        texts, fold = as_text(table.column("text")), table.column("fold").to_numpy()
        yield ALL, np.arange(len(texts)), texts
        for f in np.unique(fold[fold != ALL]).tolist():
            at = np.flatnonzero(fold == f)
            yield f, at, [texts[i] for i in at.tolist()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for f, _, texts in texts_by_fold(unpacked(raw)):
                    code, _ = distinct_keys(texts, order, shared.value)
                    if not len(code):
                        continue
                    of = shard_of(code, shards)
                    by = np.argsort(of, kind="stable")
                    used, starts = np.unique(of[by], return_index=True)
                    out += [(int(k), chunk, f, len(x), squeezed(x)) for k, x in zip(used, np.split(code[by], starts[1:]), strict=True)]
                if out:
                    yield rows_of(out, ["shard", "chunk", "fold", "n", "grams"])
        pa.default_memory_pool().release_unused()  # a worker stays for later tasks

    # what is asked moves once, to its shard, where it is looked at again when the answers come
    asked = bucketed(chunks.select("chunk", "rows").mapInArrow(ask, ASKED), "kn-asked", "shard", shards)
    grams = written(asked.groupBy("shard").applyInArrow(distinct_grams, "fold int, gram long"), "kn-grams")
    known = answered(grams, model).mapInArrow(lambda batches: packed_answers(batches, shards), KNOWN).repartition(shards, "shard")
    back = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answers, "chunk long, fold int, shard long, logp binary")
    rest = [f for f in rows.schema.fields if f.name != "text"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        table = unpacked(left.column("rows")[0])
        found = {"perplexity": [None] * table.num_rows, "held": [None] * table.num_rows}
        got = sorted(zip(*(right.column(c).to_pylist() for c in ("fold", "shard", "logp")), strict=True), key=lambda x: x[:2])
        for f, at, texts in texts_by_fold(table):
            code, _ = distinct_keys(texts, order, shared.value)
            values = np.empty(len(code))
            values[np.argsort(shard_of(code, shards), kind="stable")] = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for g, _, x in got if g == f)])
            of = found["perplexity" if f == ALL else "held"]
            for i, x in zip(at.tolist(), means(texts, Table(code, values), order, shared.value), strict=True):
                of[i] = x
        return pa.table({**{f.name: table.column(f.name) for f in rest}, **{k: pa.array(v, pa.float64()) for k, v in found.items()}})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", perplexity double, held double"
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, schema)


def row_name(id_col: str, text: str) -> Column:
    """Names a row by its doc_id and text, null or not."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text))


def limits(held: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST) -> DataFrame:
    """lang and limit from the held-out perplexities of trusted texts: lang, t (names a text), perplexity."""
    z = NormalDist().inv_cdf(min(max(quantile, 0.5), 1 - 1e-9))
    free = F.greatest(F.col("n") - 1, F.lit(1))
    t = z + (z**3 + z) / (4 * free) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * free * free)  # Student's quantile
    texts = held.filter("perplexity is not null").groupBy("lang", "t").agg(F.max("perplexity").alias("perplexity"))
    of = texts.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("perplexity", quantile, 10_000).alias("q"), F.avg(F.log("perplexity")).alias("mean"), F.stddev_samp(F.log("perplexity")).alias("sd"))
    predicted = F.exp(F.col("mean") + t * F.col("sd") * F.sqrt(1 + 1 / F.col("n")))
    own = F.when((F.col("n") + 1) * (1 - quantile) >= 1 - 1e-9, F.col("q") * slack).otherwise(F.greatest(F.col("q") * slack, predicted))
    return of.filter(F.col("n") >= least).select("lang", own.alias("limit"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", quantile: float = QUANTILE, slack: float = SLACK, folds: int = FOLDS, least: int = LEAST, most: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, lang, perplexity, limit, kept, h (names the row); trusted are documents with a label 1 and none of 0."""
    good = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label).alias("low"), F.max(label).alias("high")).filter("low = 1 and high = 1").select("doc_id")
    good = if_small(written(good, "kn-trusted"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), row_name(id_col, text).alias("h"), F.xxhash64(text).alias("t"))
    fold = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(folds)).cast("int")
    rows = rows.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("fold", F.when(F.col("trusted"), fold).otherwise(ALL)).drop("trusted")
    model = trained(rows.filter(F.col("fold") != ALL), "text", ORDER, folds)
    scored = written(perplexities(rows, model, most), "kn-scored")
    held = scored.filter(F.col("fold").isin([f for f in model.seen if f != ALL])).select("lang", F.col("t"), F.col("held").alias("perplexity"))
    own = if_small(written(limits(held, quantile, slack, least).withColumnRenamed("lang", "lang__"), "kn-limits"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("lang__")), "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "limit", kept.alias("kept"), "h")
