"""Tokens, packing, language, quality and toxicity."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from polyscope.llm import bpe, lexicon, op2_bpe, op5_quality, op8_packing, op9_language, op10_toxicity  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def odd_docs(spark):
    """Null and empty texts, a long one, repeated rows, a null id, and extra columns with clashing names."""
    texts = [None, "", " ", "Hello world, it's  two spaces\n\n and\ttabs ", "naïve café 中文字 ½² <|endoftext|>ok", "x" * 3000, "word " * 5000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"h": F.lit("h"), "ids": F.lit(1), "row": F.lit(0), "score": F.lit("x"), "perplexity": F.lit(1), "label": F.lit(7), "n": F.lit(0), "part": F.lit(2)})


def test_automaton():
    words = {bytes(w, "ascii"): (i, i + 1) for i, w in enumerate(["a", "ab", "nation", "station", "ration", "rations", "zoo"])}
    lex = lexicon.Lexicon(lexicon.compiled(words))
    assert all(tuple(lex.get(w)) == ids for w, ids in words.items()) and len(lex) == len(words)
    assert all(lex.get(w) is None for w in (b"", b"nat", b"zoos", b"b")) and lex.states < sum(map(len, words))


def test_encoder_equals_library(vocabulary, reference):
    encoder = bpe.Encoder(vocabulary, bpe.lexicon_of(vocabulary, ["hello", "world", "it's"]), remembered=50)
    random.seed(2)
    parts = list("ab Z'st\n\t 019½²_!é中ñ　\x1c\x85́ 😀  ") + ["<|endoftext|>", "'ll", "   ", "\n\n ", " hello", " world"]
    for _ in range(3000):
        x = "".join(random.choices(parts, k=random.randint(0, 14)))
        ids = reference.encode(x, add_special_tokens=False).ids
        assert encoder.encode(x) == encoder.encode_directly(x) == ids, x
    for word in ("hello", "x" * 3000, "ab" * 200, "é" * 100):
        ids = reference.encode(word, add_special_tokens=False).ids
        assert vocabulary.merged(word.encode()) == vocabulary.merged_long([vocabulary.single[b] for b in word.encode()]) == ids


def test_digests_and_round_trip(spark, reference):
    docs = odd_docs(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_bpe.digests(docs, PATH).collect()}
    want = set()
    for r in docs.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    back = op2_bpe.decoded(op2_bpe.encoded(docs, PATH), PATH)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in docs.collect())
    assert op2_bpe.digests(docs.limit(0), PATH).count() == 0


def test_first_fit_decreasing():
    random.seed(3)
    lengths = [random.randint(1, 64) for _ in range(300)]
    bins = op8_packing.Bins(64, len(lengths))
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        want = next((i for i, f in enumerate(free) if f >= n), len(free))
        if want == len(free):
            free.append(64)
        free[want] -= n
        assert bins.put(n)[0] == want
    found = op8_packing.packed(lengths, 64, 2)
    fill: dict[int, list] = {}
    for n, pieces in zip(lengths, found, strict=True):
        assert sum(p[1] for p in pieces) == n
        for _, m, b, at in pieces:
            fill.setdefault(b, []).append((at, m))
    for pieces in fill.values():
        end = 0
        for at, m in sorted(pieces):
            assert at == end
            end += m
        assert end <= 64


def test_packing(spark, reference):
    docs = odd_docs(spark)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, reference.encode(r.text or "", add_special_tokens=False).ids + [0])
    rows = op8_packing.pack(docs, PATH).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, tokens in ids.items():
        assert sum(n for _, n in by_doc[d]) == len(tokens) * (2 if d == 3 else 1)
    for pieces in by_seq.values():
        assert sum(n for _, n in pieces) <= 1024
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
    assert op8_packing.pack(docs.limit(0), PATH).count() == 0


def sentences(n, seed=1):
    rng = random.Random(seed)
    words = {"en": "the and house river walking through green forest with people".split(), "de": "der und das ist nicht über straße häuser wälder schön".split()}
    return [(i, " ".join(rng.choices(words[lang], k=30)), lang, "s", 0) for i in range(n) for lang in [("en", "de")[i % 2]]]


def test_language(spark):
    docs = spark.createDataFrame(sentences(60) + [(100, None, "en", "s", 0), (101, "123 !!", "de", "s", 0), (102, "der wälder", None, "s", 0), (None, "the house", "en", "s", 0)], DOCS).withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: r for r in op9_language.identify(docs).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(60))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0 and got[102].lang_pred == "de"
    assert op9_language.identify(docs.limit(0)).count() == 0
    model = op9_language.trained(docs.filter("lang is not null"), "text", "lang", bits=10, orders=(1, 2))
    from polyscope.llm.ngrams import characters, hashed

    counts = np.zeros((2, 1024))
    for r in docs.filter("lang is not null and text is not null").collect():
        chars, _ = characters([r.text.lower()])
        for order in (1, 2):
            np.add.at(counts[["de", "en"].index(r.lang)], hashed(chars, order, 10), 1)
    want = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * 1024))
    assert np.allclose(model.log_p.T, want, atol=1e-4)


def test_language_letters(spark):
    """Numerals, signs and marks aren't letters; letters of any script are."""
    texts = ["½", "²", "Ⅷ ①", "123 _ !", "́", "١٢٣", "", None, "中", "ª", "x½", "Ж"]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)] + sentences(40), DOCS)
    model = op9_language.trained(docs, "text", "lang")
    best, score = model.predict([t or "" for t in texts])
    assert [x == "und" for x in best] == [True] * 8 + [False] * 4 and score[:8] == [0.0] * 8


def test_language_against_formulas(spark):
    """Languages and scores of every row, from counts in dictionaries."""
    from collections import Counter

    from polyscope.llm.ngrams import hashed

    rows = sentences(50, 3) + [(100 + i, t, k, "s", 0) for i, (t, k) in enumerate([("the der", "en"), ("", "de"), (None, "en"), ("Straße ÜBER 中文", "de"), ("a", None), ("xx" * 50, "fr"), ("river " * 3, "fr")])]
    got = {r.doc_id: r for r in op9_language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    size = 1 << op9_language.BITS
    grams = lambda t: [(o, t[i : i + o]) for o in op9_language.ORDERS for i in range(len(t) - o + 1)]
    place = lambda g: int(hashed(np.array([ord(c) for c in g[1]], np.uint32), g[0], op9_language.BITS)[0])
    trained = [(t, k) for i, t, k, *_ in rows if k is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    counts, docs = {}, Counter(k for _, k in trained)
    for t, k in trained:
        counts.setdefault(k, Counter()).update(place(g) for g in grams((t or "").lower()))
    for i, t, *_ in rows:
        text = (t or "").lower()
        total = {k: math.log(docs[k] / sum(docs.values())) + sum(math.log((c[place(g)] + op9_language.SMOOTHING) / (sum(c.values()) + op9_language.SMOOTHING * size)) for g in grams(text)) for k, c in sorted(counts.items())}
        best = max(total, key=total.get)
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(math.exp(min(x - total[best], 0)) for x in total.values())) < 1e-3


def test_quality(spark):
    rows = sentences(80) + [(200, "@@## %%zz qq$$ " * 10, "en", "s", 0), (201, "XX!! YY!! " * 10, "de", "s", 0), (202, None, "en", "s", 0), (203, "", None, "s", 0), (204, "the house", "zz", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    a = {r.doc_id: r for r in op5_quality.judged(docs, labels).collect()}
    b = {r.doc_id: r for r in op5_quality.judged(docs, labels, most=500).collect()}  # many chunks
    assert not a[200].kept and not a[201].kept and a[202].kept and a[203].kept and a[202].perplexity is None
    assert all(a[i].kept == b[i].kept for i in a) and all(abs(a[i].perplexity - b[i].perplexity) < 1e-9 for i in a if a[i].perplexity)
    assert sum(a[i].kept for i in range(80)) >= 78
    assert op5_quality.judged(docs.limit(0), labels).count() == 0
    assert op5_quality.judged(docs, labels.limit(0)).filter("not kept").count() == 0


def test_quality_of_rare_languages(spark):
    """Few trusted texts give a wide limit, none or too few give none; a null language is one of its own."""
    rng = random.Random(11)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(400)] for k, letters in {"en": "abcdefghij", "xx": "klmnopqrst", "yy": "uvwxyzäöü", "zz": "éèêëïîôûç", None: "ßåøæœñãõ"}.items()}
    clean = {k: [" ".join(rng.choices(w, k=30)) for _ in range(n)] for (k, w), n in zip(words.items(), (120, 60, 10, 10, 10), strict=True)}
    rows = [(i, t, k, "s", 0) for i, (k, t) in enumerate((k, t) for k, ts in clean.items() for t in ts)] + [(900, "@@## %%zz qq$$ " * 10, "xx", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = [*range(110), *range(120, 140), 180, 181, 182]  # of en 110, of xx 20, of yy 3
    got = {r.doc_id: r for r in op5_quality.judged(docs, spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].kept for i in range(120, 210)) and not got[900].kept
    assert all(got[i].limit is None for i in range(180, 210)) and sum(got[i].kept for i in range(110)) >= 105
    # held-out perplexities, not those of the texts trained on, set the limit
    assert got[0].limit > 1.2 * max(got[i].perplexity for i in range(110))


def kneser_ney(texts, order):
    """p(gram) of the interpolated modified model, straight from its formulas; and the characters seen."""
    from collections import Counter, defaultdict

    padded = [["start"] * (order - 1) + list(t) for t in texts]
    counts = {order: Counter(tuple(t[i : i + order]) for t in padded for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {}
    for k, c in counts.items():
        n = Counter(c.values())
        off[k] = (0.5, 1.0, 1.5)
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            off[k] = tuple(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.01), i) for i in (1, 2, 3))
    of = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            of[k][g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, lower = len(g), p(g[1:])
        found = of[k].get(g[:-1])
        if not found:
            return lower
        cut = lambda n: off[k][min(n, 3) - 1]
        n = counts[k][g]
        return (max(n - cut(n), 0) if n else 0) / sum(found) + sum(map(cut, found)) / sum(found) * lower

    return p, [g[0] for g in counts[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_against_formulas(spark, order):
    """Perplexities of texts with characters that aren't known, beyond the first plane, or equal to signs of other use; and probabilities that sum to one."""
    rng = random.Random(order)
    trusted = ["".join(rng.choices("abcd 中文😀\x01", (9, 7, 5, 3, 6, 2, 2, 1, 1), k=rng.randint(0, 60))) for _ in range(40)]
    asked = [*trusted[:5], "zzz", "abcz 文文 ab", "😀\x01😁 中", "\U0002a6d6日本", "a", "", None]
    p, chars = kneser_ney(trusted, order)
    for context in ("abc", "\x01zz", "中a ", "zzz"):
        assert abs(sum(p((*context[: order - 1], c)) for c in [*chars, "unknown"]) - 1) < 1e-9
    model = op5_quality.trained(spark.createDataFrame([(t,) for t in [*trusted, None]], "text string"), "text", order)
    rows = spark.createDataFrame([(i, t, -1) for i, t in enumerate(asked)], "i int, text string, fold int")
    for most in (1, 1 << 20):
        got = {r.i: r.perplexity for r in op5_quality.perplexities(rows, model, most).collect()}
        for i, t in enumerate(asked):
            if not t:
                assert got[i] is None
                continue
            padded = ["start"] * (order - 1) + list(t)
            want = math.exp(-sum(math.log(p(tuple(padded[j : j + order]))) for j in range(len(t))) / len(t))
            assert abs(got[i] / want - 1) < 1e-5, t


def test_toxicity(spark):
    rows = sentences(300)
    rng = random.Random(5)
    toxic = {i for i in range(300) if rng.random() < 0.3}
    rows = [(i, t + (" awfulword stinker" if i in toxic else ""), *rest) for i, t, *rest in rows] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op10_toxicity.classify(docs, labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i in toxic) for i in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert op10_toxicity.classify(docs.limit(0), labels).count() == 0
    assert op10_toxicity.classify(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_against_formulas(spark):
    """Buckets, ratios and scores from sets of n-grams, and a fit that plain descent doesn't better."""
    from polyscope.llm.ngrams import hashed

    rng = random.Random(6)
    words = "green river house walking people forest stinker awful fool idiot".split()
    texts = ["", "a", "stinker"] + [" ".join(rng.choices(words[: 6 + 4 * (i % 3 == 0)], k=rng.randint(2, 12))) for i in range(60)]
    labels = [int(any(w in t for w in words[6:]) and rng.random() < 0.9) for t in texts]
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, labels, strict=True)), "doc_id long, text string, label int")
    bits, orders = 14, (4, 5)
    model = op10_toxicity.trained(rows, bits, orders, features=300, steps=2000)
    place = lambda g: int(hashed(np.array([ord(c) for c in g], np.uint32), len(g), bits)[0])
    sets = [{place(t[i : i + o]) for t in [f" {x.lower()} "] for o in orders for i in range(len(t) - o + 1)} for x in texts]
    n = [labels.count(0), labels.count(1)]
    count = [np.zeros(1 << bits), np.zeros(1 << bits)]
    for s, y in zip(sets, labels, strict=True):
        count[y][list(s)] += 1
    ratio = np.log((count[1] + 1) / n[1]) - np.log((count[0] + 1) / n[0])
    worth = (count[0] + count[1] >= 3) * np.abs(ratio) * np.abs(count[1] / n[1] - count[0] / n[0])
    least = np.sort(worth)[-300]
    used = np.flatnonzero(model.weights)
    assert (worth[used] >= least).all() and len(used) <= 300 and set(np.flatnonzero(worth > least)) >= set(used[worth[used] > least])
    # the model's score is that of its weights, over each text's set
    want = 1 / (1 + np.exp(-np.array([model.bias + sum(model.weights[b] for b in s) for s in sets])))
    assert np.allclose(model.scores(texts), want)
    chosen = np.flatnonzero(worth >= least) if (worth >= least).sum() == 300 else used
    x = np.array([[ratio[b] if b in s else 0.0 for b in chosen] for s in sets])
    y, weight = np.array(labels, float), np.where(np.array(labels) == 1, 0.5 / n[1], 0.5 / n[0])
    penalty = op10_toxicity.PENALTY / len(texts)

    def loss(w, b):
        m = x @ w + b
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + penalty / 2 * (w @ w))

    w, b = np.zeros(len(chosen)), 0.0
    for _ in range(4000):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.02 * (x.T @ error + penalty * w), b - 0.02 * error.sum()
    assert loss(model.weights[chosen] / ratio[chosen], model.bias) <= loss(w, b) + 1e-3


def test_distinct_buckets():
    from polyscope.llm.ngrams import Presence

    rng, seen = np.random.default_rng(1), Presence(10)
    for n in (0, 1, 50, 3000):
        code = rng.integers(0, 1 << 10, n)
        assert sorted(seen.of(code)) == np.unique(code).tolist()


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "a" + " " * 1_200_000 + "b", "\n" * 1_100_000 + " q", " \n\t" * 400_000 + "z  end", "a b" + "\u00a0" * 200_000, "x " + " " * 1_100_000])
def test_long_white_space(vocabulary, reference, text):
    """White space beyond what the Rust path's pattern takes, as the library encodes it, by every way."""
    ids = reference.encode(text, add_special_tokens=False).ids
    encoder = bpe.Encoder(vocabulary)
    assert encoder.encode(text) == ids and encoder.encode_directly(text) == ids


def test_long_white_space_through_queries(spark, reference):
    text = "a" + " " * 1_200_000 + "b"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "c", "en", "s", 1)], DOCS)
    ids = reference.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in op2_bpe.digests(docs, PATH).collect()}
    assert got[1] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    pieces = op8_packing.pack(docs, PATH).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) == len(ids) + 1
