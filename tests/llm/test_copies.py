"""Lines, near copies, repeated strings, vectors, components and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyscope.llm import common, op1_lines, op3_nearest, op4_rangejoin, op6_minhash, op7_suffix, suffix_index
from polyscope.llm.components import components
from polyscope.llm.suffix_index import SuffixIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS).withColumns({"h": F.lit("h"), "marks": F.lit(1), "first": F.lit(0), "a": F.lit(1), "node": F.lit(2), "band": F.lit(3), "__marks": F.lit(4)})


def copies(rng):
    a, b, c = (prose(rng, 120) for _ in range(3))
    edited = a.split()
    edited[60] = "edited"
    passage = prose(rng, 60)
    return [(1, a), (2, a), (3, " ".join(edited)), (4, b + passage + c[:100]), (5, c + passage), (6, None), (7, ""), (8, " \n "), (9, "short text"), (10, "short text"), (None, a), (11, "ab" * 400), (12, "é" * 150 + prose(rng, 5)), (13, "é" * 150 + prose(rng, 5)), (14, prose(rng, 20000) + passage), (11, "ab" * 400)]


def brute_lines(texts):
    """Lines of each document, and the numbers of those that go: runs of every length that start at an earlier place too."""
    lines = {i: t.split("\n") for i, t in texts if t is not None}
    seen, gone = set(), {}
    for n in range(1, max(map(len, lines.values()), default=0) + 1):
        for i in sorted(lines):
            for p in range(len(lines[i]) - n + 1):
                w = tuple(lines[i][p : p + n])
                if w in seen and len("\n".join(w)) >= op1_lines.MIN_CHARS:
                    gone.setdefault(i, set()).update(range(p, p + n))
                seen.add(w)
    return lines, gone


def brute_strings(raws, span=200):
    """Which bytes of each text are covered by a string that starts elsewhere too."""
    count = Counter(r[p : p + span] for _, r in raws for p in range(len(r) - span + 1))
    for i, r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - span + 1):
            if count[r[p : p + span]] > 1:
                cover[p : p + span] = True
        yield i, r, cover


def brute_classes(docs, texts):
    """The least document of each one's class, from all pairs."""
    idf = op6_minhash.idf_of(docs, op6_minhash.IDF_BITS, 5, op6_minhash.FLOOR)
    w = op6_minhash.Weigher(idf, op6_minhash.IDF_BITS, 5)
    v = [w.get(i, t) for i, (_, t) in enumerate(texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][1] == texts[j][1] or op6_minhash.jaccard(v[i], v[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {texts[i][0]: texts[r][0] for i, r in enumerate(root)}


def test_lines(spark):
    rng = random.Random(4)
    pool = [prose(rng, 6) for _ in range(12)] + ["", "x", "The.", "yes"]
    texts = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n"), (103, prose(rng, 8))]
    got = {r.doc_id: (r.text, r.lines_removed) for r in op1_lines.deduplicated(docs_of(spark, texts)).collect()}
    lines, gone = brute_lines(texts)
    for i, t in texts:
        want = None if t is None else "\n".join(x for p, x in enumerate(lines[i]) if p not in gone.get(i, ()))
        assert got[i] == (want, len(gone.get(i, ()))), i
    d = docs_of(spark, texts)
    assert op1_lines.deduplicated(d).columns[: len(d.columns)] == d.columns
    assert op1_lines.digests(d.limit(0)).count() == 0
    assert op1_lines.digests(docs_of(spark, [(None, "a" * 30), (1, "a" * 30)])).filter("n_removed = 1").first().doc_id == 1


def test_whole_runs_of_lines(spark):
    """Runs of every length, of which many have their characters only as a whole, held against brute force; the pipeline's stage removes them too."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    line = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(0, 12)))
    runs = [[line() for _ in range(n)] for n in (3, 3, 5, 6, 7, 9, 11, 15, 17, 24, 31)]
    runs += [["a" * 8, "b" * 8, "c" * 8], ["d" * 28, "e" * 10, "f" * 9], ["g", "h", "i" * 30], [""] * 20, [""] * 40]
    cut = lambda r: r[rng.randint(0, len(r) // 2) :][: rng.randint(1, len(r))] if rng.random() < 0.5 else r
    parts = lambda: [x for r in rng.choices(runs, k=rng.randint(1, 4)) for x in [*cut(r), *([f"own {rng.random()}"] if rng.random() < 0.8 else [])]]
    texts = [(i, "\n".join(parts())) for i in range(80)]
    lines, gone = brute_lines(texts)
    want = {i: "\n".join(x for p, x in enumerate(t) if p not in gone.get(i, ())) for i, t in lines.items()}
    got = {r.doc_id: (r.text, r.lines_removed) for r in op1_lines.deduplicated(docs_of(spark, texts)).collect()}
    assert got == {i: (t, len(gone.get(i, ()))) for i, t in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs_of(spark, texts), "").collect()} == {i: t for i, t in want.items() if t}


def test_light_lines(spark):
    """Three lines of ten characters go as a run of 32, though no stretch of two has 24."""
    same = "\n".join(["abcdefghij", "klmnopqrst", "uvwxyzabcd"])
    got = {r.doc_id: r for r in op1_lines.digests(docs_of(spark, [(1, same), (2, same), (3, "abcdefghij\nklmnopqrst")])).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 3, 0]
    assert got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_doubling_ends_with_heavy_stretches(spark):
    """Ranks of more lines than a run needs by its newlines alone aren't made, and longer runs go whole."""
    lines = [str(i) for i in range(100)]
    docs = docs_of(spark, [(1, "\n".join(lines)), (2, "\n".join(["x", *lines, "y"])), (3, "\n".join(lines[57:]))])
    assert len(op1_lines.levels(op1_lines.keyed(docs, "doc_id", "text"))) == 6
    assert {r.doc_id: r.n_removed for r in op1_lines.digests(docs).collect()} == {1: 0, 2: 100, 3: 43}


def test_copies_of_many_lines(spark):
    """Two copies of a long text, and many equal rows."""
    rng = random.Random(13)
    long = "\n".join(prose(rng, 5) for _ in range(20_000))
    docs = docs_of(spark, [(1, long), (2, "first\n" + long + "\nlast")] + [(3, "a line that many rows have in common\n" * 30)] * 500)
    got = {r.doc_id: r for r in op1_lines.digests(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_lines) == (0, 20_000, 20_002)
    assert got[2].kept_sha256 == hashlib.sha256(b"first\nlast").hexdigest() and got[3].n_removed == 29


def test_suffix_index():
    rng = random.Random(7)
    span = 6
    index, strings, first = SuffixIndex(span), [], []
    for _ in range(40):
        batch = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        first += index.add(batch)
        strings += batch
        count = Counter(s[i : i + span] for s in strings for i in range(len(s) - span + 1))
        for s, at in zip(strings, first, strict=True):
            assert [bool(index.repeated[at + i]) for i in range(len(s) - span + 1)] == [count[s[i : i + span]] > 1 for i in range(len(s) - span + 1)]
    assert len(index.levels) <= 12


def test_suffix_index_of_several_keys():
    """Strings of different keys don't match, whatever order they come in."""
    rng = random.Random(8)
    span = 5
    index, strings, keys, first = SuffixIndex(span), [], [], []
    for _ in range(40):
        batch = [bytes(rng.choices(b"ab", k=rng.randint(0, 10))) for _ in range(rng.randint(1, 5))]
        own = [rng.randint(-2, 2) for _ in batch]
        first += index.add(batch, own)
        strings += batch
        keys += own
        count = Counter((k, s[i : i + span]) for k, s in zip(keys, strings, strict=True) for i in range(len(s) - span + 1))
        for k, s, at in zip(keys, strings, first, strict=True):
            assert [bool(index.repeated[at + i]) for i in range(len(s) - span + 1)] == [count[k, s[i : i + span]] > 1 for i in range(len(s) - span + 1)]


def test_order_by_doubling():
    rng = random.Random(9)
    for n, letters, span in ((4000, "ab", 200), (5000, "a", 200), (3000, "abc\0", 64), (2500, "abcdefghijklmnop", 7), (700, "ab", 1), (700, "ab", 3)):
        text = np.frombuffer("".join(rng.choices(letters, k=n)).encode(), np.uint8)
        at = np.array(sorted(rng.sample(range(n - span + 1), 400)))
        raw = text.tobytes()
        want = sorted(range(400), key=lambda i: (raw[at[i] : at[i] + span], i))
        assert suffix_index.doubled(text, at, span).tolist() == want


def test_levels_hold_different_windows_only(monkeypatch):
    """Texts of one repeated unit, all different strings of one key: bounded memory, and the windows that repeat."""
    monkeypatch.setattr(op7_suffix, "BATCH_BYTES", 100_000)
    rng = random.Random(10)
    texts = [("ab" * 3000)[: 2001 + i] for i in range(300)] + [prose(rng, 900) for _ in range(3)]
    names = ["route", "n", "chunk", "lo", "own", "bytes"]
    batches = [pa.record_batch([pa.array(c) for c in zip(*[(5, 1, i, 0, 1, t.encode()) for i, t in enumerate(texts)], strict=True)], names=names)]

    class Spy(SuffixIndex):
        most = 0

        def add(self, strings, keys=None):
            assert sum(map(len, strings)) < 110_000
            out = super().add(strings, keys)
            Spy.most = max(Spy.most, sum(len(x.at) for x in self.levels))
            assert sum(len(x.text) for x in self.levels) <= 2 * 201 + sum(map(len, texts[300:])) + 3 * 200
            return out

    got = sorted(tuple(r.values()) for b in op7_suffix.search(iter(batches), 200, 1024, Spy(200)) for r in b.to_pylist())
    assert got == [(i, 0, len(t) - 200) for i, t in enumerate(texts[:300])] and Spy.most <= 2 + sum(len(t) for t in texts[300:])


@pytest.mark.parametrize("segment", [None, 500])
def test_repeated_strings(spark, monkeypatch, segment):
    texts = copies(random.Random(5))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix.deduplicated(docs_of(spark, texts)).collect())
    raws = [(i if i is not None else -1, (t or "").encode()) for i, t in texts]
    want = []
    for i, r, cover in brute_strings(raws):
        kept = bytes(b for b, c in zip(r, cover[:-1], strict=True) if not c)
        want.append((i, len(r), int(cover.sum()), int((cover[1:] < cover[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    if segment:  # long rows are hashed a stretch at a time
        bounds = np.array([0, 1700, 1700, 1900])
        seen = set()
        for row, first, own in op7_suffix.segments(bounds, 200, segment):
            for a, b in zip(own[:-1], own[1:], strict=True):
                seen |= {(row if len(own) == 2 else None, p) for p in range(a, b - 199)}
            assert first == own[0]
        assert {p for _, p in seen} >= set(range(1501))
    assert op7_suffix.deduplicated(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("chunk_bytes,shard_bytes,size", [(3000, 2000, 3), (1 << 20, 1 << 30, 2)])
def test_repeated_strings_in_small_parts(spark, chunk_bytes, shard_bytes, size):
    """Many chunks, shards and batches against brute force: the same bytes, mostly in different strings."""
    rng = random.Random(14)
    pool = [prose(rng, 120) for _ in range(6)] + ["ab" * 300, "xyz" * 90]
    part = lambda: (lambda p, a: p[a : a + rng.randint(150, 500)])(rng.choice(pool), rng.randint(0, 200))
    texts = [(i, " ".join(part() for _ in range(rng.randint(1, 4))) + prose(rng, 5)) for i in range(60)]
    got = sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix.deduplicated(docs_of(spark, texts), chunk_bytes=chunk_bytes, shard_bytes=shard_bytes, size=size).collect())
    want = [(i, int(cover.sum()), int((cover[1:] < cover[:-1]).sum()), hashlib.sha256(bytes(b for b, c in zip(r, cover[:-1], strict=True) if not c)).hexdigest()) for i, r, cover in brute_strings([(i, t.encode()) for i, t in texts])]
    assert got == sorted(want)


def test_levels_of_a_shard():
    """Strings of one key that overlap in part: the family keeps several levels over the batches of a shard."""
    rng = random.Random(15)
    text = prose(rng, 4000).encode()
    rows = [(k, 1, 7, a, 0, text[a : a + rng.randint(200, 320)]) for k in range(30) for a in sorted(rng.sample(range(k * 500, k * 500 + 400), 12))]
    most = 0

    class Spy(SuffixIndex):
        def add(self, strings, keys=None):
            nonlocal most
            out = super().add(strings, keys)
            most = max(most, len(self.levels))
            return out

    names = ["route", "n", "chunk", "lo", "own", "bytes"]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + 50], strict=True)], names=names) for i in range(0, len(rows), 50)]
    got = {}
    for batch in op7_suffix.search(iter(batches), 200, 9, Spy(200)):
        for _, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for p in range(lo, hi + 1):
                got[p] = True
    count = Counter(s[i : i + 200] for *_, s in rows for i in range(len(s) - 199))
    assert set(got) == {a + i for *_, a, _, s in rows for i in range(len(s) - 199) if count[s[i : i + 200]] > 1}
    assert most >= 3


def test_many_equal_rows(spark):
    rng = random.Random(16)
    same = prose(rng, 700)
    docs = docs_of(spark, [(1, same)] * 5000 + [(2, prose(rng, 100)), (2, None)])
    got = Counter((r.doc_id, r.n_removed, r.n_spans) for r in op7_suffix.deduplicated(docs).collect())
    assert got == {(1, len(same), 1): 5000, (2, 0, 0): 2}


def test_near_copies(spark):
    texts = copies(random.Random(6))
    got = [(r.doc_id, r.class_id, r.kept) for r in op6_minhash.near_duplicates(docs_of(spark, texts)).collect()]
    assert len(got) == len(texts)
    of = {d: c for d, c, _ in got}
    assert of[1] == of[2] == of[3] == 1 and of[9] == of[10] == 9 and of[4] == 4 and of[5] == 5 and of[14] == 14
    assert (None, None, True) in got and all(k == (d == c) for d, c, k in got if d is not None)
    assert op6_minhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for g in range(25):
        base = prose(rng, 80).split()
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(80)] = "w" + str(rng.randrange(1000))
            texts.append((len(texts), " ".join(words)))
    docs = docs_of(spark, texts)
    of = {r.doc_id: r.class_id for r in op6_minhash.near_duplicates(docs).collect()}
    assert of == brute_classes(docs, texts)


def test_near_copies_in_a_large_band(spark):
    """More members of one band than a block takes, in many components, against all pairs."""
    rng = random.Random(18)
    base, texts = prose(rng, 60).split(), []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 2, 3, 3, 4, 5, 6))):
            words[rng.randrange(60)] = "w" + str(rng.randrange(10_000))
        texts.append((i, " ".join(words)))
    docs = docs_of(spark, texts)
    of = {r.doc_id: r.class_id for r in op6_minhash.near_duplicates(docs).collect()}
    assert of == brute_classes(docs, texts) and len(set(of.values())) > 50


def test_alike_compares_in_the_least_common_band():
    rng = np.random.default_rng(2)
    vectors = [(np.sort(rng.choice(60, 40, replace=False)).astype(np.uint64), np.ones(40)) for _ in range(40)]
    side, component = np.array([0] * 10 + [1] * 30), np.arange(40)
    linked = {(i, j) for i in range(10) for j in range(10, 40) if op6_minhash.jaccard(vectors[i], vectors[j]) >= 0.55}
    assert linked
    some = {(i, j) for i, j in op6_minhash.alike(vectors, side, component, np.zeros((40, 2), np.int64), 5, 0.55)}
    assert some <= linked
    root = list(range(40))
    for i, j in some:
        root = [root[i] if x == root[j] else x for x in root]
    assert all(root[i] == root[j] for i, j in linked)  # enough links to connect what is linked
    assert op6_minhash.alike(vectors, side, component, np.full((40, 2), 3), 5, 0.55) == []


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 63, 400, np.uint64))
    a, b = rng.random(400) + 0.5, rng.random(400) + 0.5
    s = op6_minhash.Sampler(2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s.draw(h, a) == s.draw(h, b)).mean() - want) < 0.05
    assert (s.draw(h, a) == s.draw(h, a)).all()
    # with weights worked out beforehand, some or all, the samples are the same
    c = np.array([0.8, 0.9, 1.0, 2.0])[rng.integers(0, 4, 400)]
    assert all((op6_minhash.Sampler(2000, levels=np.array(known)).draw(h, c) == s.draw(h, c)).all() for known in ([0.8, 0.9, 1.0], [0.8, 0.9, 1.0, 2.0]))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit("v"), "n": F.lit(0), "node": F.lit(1), "shard": F.lit(1), "part": F.lit(1)})


def some_vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:15] + 0.05 * rng.normal(size=(15, 8)), base[:5], base[:3] * 2, rng.normal(size=(60, 8)) * 3])
    rows = [(i, v.astype(float).tolist(), i % 3) for i, v in enumerate(x)]
    return rows + [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None] + [0.0] * 6, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [float("inf")] + [1.0] * 7, 0), (505, base[0].tolist(), None), (None, base[0].tolist(), 0), (520, base[0].tolist(), 0), (540, base[0].tolist(), 0)]


def test_nearest_is_exact_at_one(spark):
    rows = some_vectors()
    got = {}
    for r in op3_nearest.nearest(vectors(spark, rows), relax=1.0, shard=40, block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for q, found in got.items():
        a = next(v for i, v in good if i == q)
        want = sorted(((-float(a @ v), i) for i, v in good if i != q))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(want) + 1))
        assert np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in want])
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
    assert op3_nearest.nearest(vectors(spark, rows).limit(0)).count() == 0


def test_nearest_beside_a_long_vector():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1e6
    more = np.sqrt(np.maximum(1e12 - np.einsum("ij,ij->i", x, x), 0))
    ids, q = np.arange(len(x)), np.arange(0, len(x), 20)
    tree = op3_nearest.Tree(np.column_stack([x, more]) / 1e6, x)
    best, scores = tree.search(np.column_stack([x[q], np.zeros(len(q))]) / 1e6, x[q], q, ids, 20, 1.0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    assert (best == np.argsort(-s, axis=1)[:, :20]).all() and np.allclose(scores, -np.sort(-s, axis=1)[:, :20])


def long_one(x, times):
    x[11] *= times
    return x


@pytest.mark.parametrize("lengths", [lambda x, rng: x, *[lambda x, rng, s=s: x * np.exp(s * rng.normal(size=(len(x), 1))) for s in (0.1, 0.25, 0.5, 1)], *[lambda x, rng, t=t: long_one(x, t) for t in (10, 1e3, 1e6)]])
def test_nearest_recall(lengths):
    """Unit vectors, vectors of spread lengths, and one that is far longer than all others, with the measured factor and with 1."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x = lengths(x / np.linalg.norm(x, axis=1, keepdims=True), rng)
    ids, q = np.arange(len(x)) * 3, np.arange(0, len(x), 20)
    tree = op3_nearest.tree_of(x)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = np.argsort(-s, axis=1, kind="stable")[:, :20]
    found = lambda relax: tree.search(op3_nearest.scaled(x[q], tree), x[q], ids[q], ids, 20, relax)
    best, scores = found(1.0)
    assert (best == want).all() and np.allclose(scores, np.take_along_axis(s, want, 1), rtol=1e-12)
    best, _ = found(op3_nearest.tuned(tree, x[q], ids[q], ids, 20))
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, want, strict=True)]) >= 0.95


def test_nearest_searches_leaves_together(monkeypatch):
    """A leaf is met by many queries at once, and sorted are those of its vectors only that can be among a query's best, which are those of brute force."""
    rng = np.random.default_rng(9)
    x, ids = rng.normal(size=(4_000, 64)), np.arange(4_000)
    tree, q, cells, lexsort = op3_nearest.tree_of(x), np.arange(0, 4_000, 20), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: cells.append(keys[0].size) or lexsort(keys, axis=axis))
    best, _ = tree.search(op3_nearest.scaled(x[q], tree), x[q], q, ids, 20, 1.0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    assert (best == np.argsort(-s, axis=1)[:, :20]).all()
    assert sum(cells) < 0.3 * len(q) * len(x) and len(cells) < 400


def test_nearest_query_recall(spark):
    """The query with its own parameters, in several shards of several blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16)) * np.exp(0.5 * rng.normal(size=(2000, 1)))
    got = {}
    for r in op3_nearest.nearest(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), shard=500, block=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y, hits = x.astype(np.float32).astype(float), 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits >= 0.95 * 20 * len(got)


@pytest.mark.parametrize("per_pivot,block", [(5, 8), (2000, 1024)])
def test_range_join(spark, per_pivot, block):
    rows = some_vectors()
    got = {r.vec_id: r for r in op4_rangejoin.linked(vectors(spark, rows), per_pivot=per_pivot, block=block).collect()}
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, m in good if j != i and m == k and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93} for i, v, k in good}
    comp = {i: i for i in links}
    for _ in comp:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    assert len(got) == len(rows)
    for i, v, _ in rows:
        want = (len(links[i]), comp[i]) if i in links else (0, i)
        assert (got[i].n_links, got[i].component_id) == want and got[i].kept == (want[1] == i), i
    assert op4_rangejoin.linked(vectors(spark, rows).limit(0)).count() == 0


def test_range_join_of_repeated_ids(spark):
    """Repeated rows, and ids with several vectors or labels, against brute force: n_links counts other ids, each once."""
    small = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 2.0], 2), (3, [1.0, 2.0], 3)]
    assert {(r.vec_id, r.n_links, r.component_id) for r in op4_rangejoin.linked(vectors(spark, small)).collect()} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 4))
    rows = [(int(i), (base[rng.integers(12)] + 0.15 * rng.normal(size=4)).tolist(), int(rng.integers(2))) for i in rng.integers(0, 70, 120)]
    rows += [rows[0]] * 5 + [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows]
    links = {i: set() for i, _, _ in good}
    for i, v, k in good:
        for j, w, m in good:
            if i != j and k == m and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links[i].add(j)
    comp = {i: i for i in links}
    for _ in comp:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    for block in (8, 1024):
        got = op4_rangejoin.linked(vectors(spark, rows), per_pivot=10, block=block).collect()
        assert len(got) == len(rows) and {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, len(x), comp[i], comp[i] == i) for i, x in links.items()}


def test_cells_of_clustered_vectors(spark):
    """Vectors that lie in clusters are cut into many cells, spread ones, which would go to all of them, into two."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(30, size=900)] + 0.05 * rng.normal(size=(900, 16))
    y = rng.normal(size=(900, 16))
    rows = [(i, v.tolist(), k) for k, part in enumerate((x, y)) for i, v in enumerate(part, 1000 * k)]
    nodes = vectors(spark, rows).selectExpr("label", "cast(embedding as array<double>) v", "size(embedding) d", "xxhash64(embedding) h1", "xxhash64(embedding, 1) h2")
    found = {k: len(p) for (k, _), p in op4_rangejoin.pivots_of(nodes, 0.3742, 20).items()}
    assert found[0] > 8 and found[1] == 2
    got = {r.vec_id: r.n_links for r in op4_rangejoin.linked(vectors(spark, rows), per_pivot=20, block=64).collect()}
    for first, part in ((0, x), (1000, y)):
        u = part.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        assert [got[first + i] for i in range(900)] == ((u @ u.T >= 0.93).sum(1) - 1).tolist()


def test_pivots_of_many_labels(spark, monkeypatch):
    """However many labels there are, what is drawn of their vectors is bounded; those of some size are cut into cells, and links are those of brute force."""
    monkeypatch.setattr(op4_rangejoin, "ALL_PIVOTS", 64)
    rng = np.random.default_rng(11)
    rows = [(100 * k + i, v.tolist(), k) for k in range(40) for i, v in enumerate(rng.normal(size=(30, 3)))]
    nodes = vectors(spark, rows).selectExpr("label", "cast(embedding as array<double>) v", "size(embedding) d", "xxhash64(embedding) h1", "xxhash64(embedding, 1) h2")
    found = op4_rangejoin.pivots_of(nodes, 0.3742, 16)
    assert len(found) >= 30 and sum(map(len, found.values())) <= 64 + 40
    got = {r.vec_id: r.n_links for r in op4_rangejoin.linked(vectors(spark, rows), per_pivot=16).collect()}
    for k in range(40):
        u = np.array([v for _, v, label in rows if label == k], np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        assert [got[100 * k + i] for i in range(30)] == ((u @ u.T >= 0.93).sum(1) - 1).tolist()


def test_range_join_at_the_threshold():
    """Pairs at exactly 0.6, and products that rounding has moved to either side."""
    a, b = np.array([[3.0, 4.0], [4.0, 3.0]]), np.array([[1.0, 0.0], [0.0, 1.0]])
    for off in (-1e-15, 0, 1e-15):
        assert op4_rangejoin.reaches(a, b, np.array([[0.6, 0.8], [0.8, 0.6]]) + off, 0.6).all()
    assert not op4_rangejoin.reaches(a[:1] - 1e-15 * np.array([[8.0, 0]]), b[:1], np.array([[0.6]]), 0.6).any()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no tables")
    import zlib

    from tokenizers import Tokenizer

    from polyscope.llm import op5_quality
    from polyscope.llm.queries import tokenizer_path

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_copies", "strings", "packing"]
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = stages["quality"](spark, docs, sf).cache()
    good = {r.doc_id for r in op5_quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet"), most=100_000).collect() if r.kept}
    assert texts(first) == [x for x in texts(docs) if x[0] in good] and 50 < len(good) < docs.count()

    second = stages["lines"](spark, first, sf).cache()
    lines, gone = brute_lines(texts(first))
    want = [(i, "\n".join(x for p, x in enumerate(t) if p not in gone.get(i, ()))) for i, t in lines.items()]
    assert texts(second) == sorted(x for x in want if x[1])

    third = stages["near_copies"](spark, second, sf).cache()
    of = brute_classes(second, texts(second))
    assert texts(third) == [x for x in texts(second) if of[x[0]] == x[0]]

    fourth = stages["strings"](spark, third, sf).cache()
    want = [(i, bytes(b for b, c in zip(r, cover[:-1], strict=True) if not c).decode("utf-8", "ignore")) for i, r, cover in brute_strings([(i, t.encode()) for i, t in texts(third)])]
    assert texts(fourth) == sorted(x for x in want if x[1])
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    reference = Tokenizer.from_file(tokenizer_path())
    ids = {i: reference.encode(t, add_special_tokens=False).ids + [0] for i, t in texts(fourth)}
    pieces = stages["packing"](spark, fourth, sf).collect()
    assert Counter({i: len(x) for i, x in ids.items()}) == sum((Counter({r.doc_id: r.length}) for r in pieces), Counter())
    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")) == r.ids_crc32 for r in pieces)


def test_near_copies_without_shingles(spark):
    """Partitions and runs of texts that have no shingles at all, or of one that has."""
    assert [(r.doc_id, r.class_id, r.kept) for r in op6_minhash.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 1, True)]
    rows = [(i, x) for i, x in enumerate(["", "a b", " " * 200_000, "a b c d e f", "a b c d e f", None, "\t\n", "\t\n"])]
    got = {r.doc_id: r.class_id for r in op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}
    hasher = op7_suffix.Hasher()
    for texts in ([" " * 200_000, "a b c d e f"], [None], [], ["a b c d e f", " " * 200_000, "", "a"]):
        counted = [len(h) for _, h, _ in op6_minhash.counted(pa.array(texts, pa.string()), hasher)]
        assert sum(counted) == sum(len((t or "").split()) > 0 and max(1, len(t.split()) - 4) for t in texts)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, and further columns whose names are those of stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [None, "", " ", "one two three four five six", "one two three four five six", "line of text that is long enough\nanother line of some length\n" * 2, "x" * 500, "y " * 40_000, "\n\n"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1), (None, "no id but text", None, None, None), (None, None, None, None, None)]
    odd = {c: F.lit(9) for c in ("n_removed", "lines_removed", "lines_before", "__h", "h", "kept", "doc", "d", "__d", "chunk", "rows", "perplexity", "class_id", "text_", "band", "n", "id")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(odd)
    labels = spark.createDataFrame([(3, 1, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.columns, stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == before and all(r[c] == 9 for r in kept.collect() for c in odd), name
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert ("1", "") in got and ("0", "") in got and ("None", "no id but text") in got and ("None", "") in got
    assert all(i != "4" for i, _ in got)  # a copy of 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert {str(r.doc_id) for r in pieces} == {i for i, _ in got}
    # empty tables
    for name, df in (("documents", docs), ("labels", labels)):
        df.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()


def test_near_copies_in_scripts_without_spaces(spark):
    rng = random.Random(12)
    han, thai = [chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(400)], [chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(400)]
    rare = [chr(rng.randrange(0x20000, 0x2A000)) for _ in range(200)]
    rows = [(1, "".join(han)), (2, "".join(han[:200] + ["\u4e00"] + han[201:])), (3, "".join(reversed(han))), (4, "".join(thai)), (5, "".join(thai[:-3])), (6, "mixed text " + "".join(rare)), (7, "mixed text " + "".join(rare) + " end"), (8, "".join(han[:60] + thai[:300]))]
    got = {r.doc_id: r.class_id for r in op6_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    hasher = op7_suffix.Hasher()
    words = lambda t: sum(len(h) for _, _, h in op6_minhash.runs(pa.array([t]), hasher, 1))
    assert words("ab \u4e00\u4e01cd\u3042 e\U00020000f") == 2 + 1 + 1 + 1 + 3 and words("\ud55c\uad6d \uc5b4") == 2 and words("\u00e9t\u00e9 \u0e01\u0e02") == 3


def test_joins_with_hot_keys(spark, monkeypatch):
    """A key with half of all rows, others with few, and ones that only one side has."""
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1900).cast("long").alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k is not null and k <> 11").withColumn("w", F.col("k") + 1)
    want = sorted(tuple(r) for r in left.join(right.drop("n"), ["k"]).select("k", "v", "w").collect())
    for least in (10, 10**9):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        got = common.met(left, right, ["k"])
        assert sorted(tuple(r) for r in got.select("k", "v", "w").collect()) == want and sorted(got.columns) == ["k", "v", "w"]


def test_lines_and_copies_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = [(i, f"a line that is in every document of these\nanother line of number {i % 5}, long enough too") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in op1_lines.digests(docs_of(spark, texts)).collect()}
    assert got == {i: 0 if i == 0 else 1 if i < 5 else 2 for i in range(40)}
    classes = {r.doc_id: r.class_id for r in op6_minhash.near_duplicates(docs_of(spark, texts)).select("doc_id", "class_id").collect()}
    assert all(classes[i] == classes[i % 5] for i in range(40))
