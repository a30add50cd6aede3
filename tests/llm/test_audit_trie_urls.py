"""Filter interaction audit, prefix trie of conversations, URL filters."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from polyscope.llm import op11_audit, op12_trie, op13_urls, ordered
from polyscope.llm import queries as llm

DOCS = "doc_id long, text string, source string"


# --- filter interaction audit -------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    failing = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
        c, d = 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t))
        e = i is not None and least[t] < i
        failing[source or ""].append(({x for x, f in zip("ABCDE", (a, b, c, d, e), strict=True) if f}, i in good, i in toxic))
    out = {}
    for part, rows in failing.items():
        total = Counter()
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                here = [r for r in rows if x in r[0]]
                removed = [r for r in here if not r[0] & set(order[: step - 1])]
                kept = sum(not r[0] & set(order[:step]) for r in rows)
                out[part, "".join(order), step] = [kept, len(removed), len(here) - len(removed), sum(r[0] == {x} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed)]
                total[x] += len(removed)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, DOCS).withColumns({"mask": F.lit("x"), "rows": F.lit(1), "part": F.lit("y"), "good": F.lit(None).cast("int")}).repartition(3)
    got = op11_audit.audited(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}, len(got)


def test_audit(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "A B C", "x" * 100, "50 % off", " ".join(words), " ".join(words[:30] * 10), " ".join(words).upper(), "é " * 250, "a b " * 300, " ".join(words) + " #", "\x1c".join(words)]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(120)]
    docs += [(None, texts[6], "s"), (None, texts[6], "s"), (7, docs[7][1], "s"), (7, docs[7][1], "t"), (7, "another text", "s"), (-5, texts[3], "t"), (10**12, texts[3], "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (999, 1, 1)]
    got, n = audited(spark, docs, labels)
    assert got == audit_by_hand(docs, labels) and n == 600 * 3
    assert audited(spark, [], labels) == ({}, 0)
    got, n = audited(spark, docs[:3], [])
    assert got == audit_by_hand(docs[:3], [])


def test_texts_of_one_fingerprint():
    """The bytes decide: with one fingerprint for all texts, stretches of a row or so, and rows in any order."""
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice(["a", "b", "c", None, ""]), rng.choice("st")) for _ in range(300)]
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(i, least.get(t or "", i))
    for held, most in ((250, 300), (10_000, 24)):  # where stretches are long enough, copies don't travel with their text
        pairs = [x for first in range(0, 300, 50) for x in op11_audit.routed(iter(rows[first : first + 50]), held, lambda raw: 1)]
        assert sum(raw is not None for _, (raw, *_) in pairs) <= most
        rng.shuffle(pairs)
        got = Counter()
        for doc_id, part, mask, n in op11_audit.resolved(iter(pairs)):
            got[doc_id, part, mask & op11_audit.COPY > 0] += n
        assert got == Counter((i, s, i > least[t or ""]) for i, t, s in rows)


def test_masks():
    assert op11_audit.mask_of(b"") == 1 and op11_audit.mask_of(("é" * 98 + "AB").encode()) == 1 and op11_audit.mask_of(("é" * 97 + "ABC").encode()) == 5
    assert op11_audit.mask_of(b"a " * 200) == 2 and op11_audit.mask_of(" ".join(map(str, range(200))).encode()) == 0
    assert op11_audit.mask_of(("a b c " * 100).encode()) & 1 == 0  # two hundred words: only ASCII white space divides


# --- running values -----------------------------------------------------------------------------------------------------


def test_running_values(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 9, -4]), i, rng.getrandbits(60) - (1 << 59), rng.randrange(-100, 100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, i long, x long, s long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for values in (("37", "false", "7"), ("3", "true", "10000")):  # a key over many partitions, batches and partitions of several keys
        for k, v in zip(before, values, strict=True):
            spark.conf.set(k, v)
        try:
            got = ordered.running(df, "k", [F.col("k"), F.col("i").desc()], ("x",), ("s",)).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        want, state = [], {}
        for k, i, x, s in sorted(rows, key=lambda r: (r[0], -r[1])):
            at, xs, ss = state.get(k, (-1, 0, 0))
            state[k] = at + 1, xs ^ x, ss + s
            want.append((k, i, xs ^ x, ss + s, at + 1))
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert ordered.running(df.limit(0), "k", [F.col("k")]).isEmpty()


# --- prefix trie --------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(x)] for c, x in said.items()}
    convs = {}
    for c, own in said.items():
        base = c - int(np.fmod(c, 5))
        h = 0 if base == c else zlib.crc32(str(c).encode()) % 9
        convs[c] = tuple(said.get(base, [])[:h] + own[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        out[p] = (max(1, sum(out[x][0] for x in children[p])), own + sum(out[x][1] for x in children[p]))
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *out[p], sha(p)) for p in members)


def trie_of(spark, rows, **how):
    df = spark.createDataFrame(rows, TURNS).withColumns({"at": F.lit("x"), "d": F.lit(1), "owner": F.lit(2), "m": F.lit(0)}).repartition(3)
    convs, turns = op12_trie.rebuilt(df)
    got = op12_trie.trie(convs, turns, **how).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r[:3])
    return sorted((tuple(r) for r in got), key=key)


def test_trie(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(60), -7, -5, 10**15]:
        n = rng.choice([1, 2, 3, 5, 8, 12])
        rows += [(c, t, rng.choice(["user", "assistant"]) if c > 20 else "user", rng.choice(["a", "b"]) if c % 5 else f"é{c % 3}") for t in range(n)]
    rows += [(70, None, None, None), (70, 3, "user", "x"), (70, 3, "user", "a"), (70, 3, "user", "a"), (70, None, "z", ""), (None, 1, "user", "lost"), (None, 2, "user", "lost")]
    rows += [(71, 0, "user", "only"), (74, 0, "user", "b"), (79, 0, "user", "long " * 5000)]
    got = trie_of(spark, rows, span=2, run=3)  # segments and runs far shorter than conversations
    assert got == sorted(trie_by_hand(rows), key=lambda r: tuple(-1 if x is None else x for x in r[:3]))
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []
    # turnless: nothing but the root
    turnless = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert trie_of(spark, [(turnless, 0, "user", "a")]) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_trie_of_a_long_and_a_popular_conversation(spark):
    """One conversation with most rows, and most conversations alike."""
    rows = [(0, t, "user", f"t{t % 7}") for t in range(3000)] + [(5 * c, t, "user", f"t{t}") for c in range(1, 300) for t in range(3)] + [(5 * c, 0, "user", "other") for c in range(300, 310)]
    got = trie_of(spark, rows, span=64, run=16)
    assert got == sorted(trie_by_hand(rows), key=lambda r: tuple(-1 if x is None else x for x in r[:3]))


def test_first_owned_depths(spark):
    """What binary search finds is the least depth that a conversation is the minimum of."""
    rng = random.Random(6)
    seqs = {c: tuple(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for c in range(40)}
    table = [(c, d, hash(s[:d]), len(s[:d])) for c, s in seqs.items() for d in range(len(s) + 1)]
    least = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            least.setdefault(s[:d], c)
    found = spark.createDataFrame(table, "conv_id long, d long, x long, y long")
    shared = found.groupBy("d", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    for span in (1, 3, 100):
        got = {r.conv_id: (r.first, r.parent) for r in op12_trie.owners(found, shared, span).collect()}
        want = {}
        for c, s in seqs.items():
            own = [d for d in range(len(s) + 1) if least[s[:d]] == c]
            before = own[0] - 1 if own else len(s)
            want[c] = (own[0] if own else None, least[s[:before]] if before >= 0 else None)
        assert got == want


# --- URL filters --------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "https://example.com", "https://example.com/", "https://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://www.example.com/EN/", "http://a.www.example.com/en/1?x=/fr/#y", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://net/es/", "http://xnet/es/", "ftp://x.NET/es", "a?b#://x.net/es/1", "http://x.org?u=http://y.net/es/", "http://x.org#/cgi-bin/", "http://x.org/cgi-bin/run", "http://casino.org/", "http://a-casino-b.org/", "http://mycasino.org/",
    "http://free-bets.example.org/x", "http://x.org/bets-/", "http://x.org/wp-login.php?a", "http://x.org/wp-login.phps", "http://x.org/?phpsessid=1", "http://u:p@x.com:80/en/", "http://com/", "http://com", "http://x.com?/", "HTTP://É.ADS.org/", "http://x.net/es/" + "long" * 5000, "http://Kads.org/",
]


def verdict_by_hand(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    rest = after[len(host) :]
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    path = re.match(r"[^?#]*", rest)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in op13_urls.HOSTS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(rf"(^|[-.]){w}[-.]", host) for w in op13_urls.WORDS) or "/cgi-bin/" in rest or re.search(r"/wp-login\.php([^0-9A-Za-z_.%-]|\Z)", rest) or "?phpsessid=" in rest
    return host, path, None, "block" if bad else "allow"


def test_url_verdicts(spark):
    rows = [(i, u, "<html>") for i, u in enumerate(URLS)] + [(None, URLS[6], ""), (6, URLS[6], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "rule": F.lit(1), "verdict": F.lit("v"), "best": F.lit(9), "id": F.lit(1)})
    want = Counter((i, *verdict_by_hand(u)) for i, u, _ in rows)
    assert Counter(tuple(r) for r in op13_urls.verdicts(pages).collect()) == want
    few = op13_urls.judged(pages, at_a_time=7).select("page_id", "host", "path", "rule", "verdict")  # several passes
    assert Counter(tuple(r) for r in few.collect()) == want
    assert op13_urls.verdicts(pages.limit(0)).isEmpty()
    assert {r.verdict for r in op13_urls.judged(pages, []).collect()} == {"allow"}


def test_patterns():
    fits = lambda p, s: bool(re.search(op13_urls.pattern_rule(p, "block").regex, s))
    assert fits("||ads.", "x.ads.org/") and fits("||ads.", "ads.org/") and not fits("||ads.", "xads.org/") and not fits("||ads.", "x.org/ads.html")
    assert fits("||*-bets.", "a-bets.org/") and not fits("||*-bets.", "a.org/x-bets.html") and fits("|x.org/", "x.org/") and not fits("|x.org/", "a.x.org/")
    assert fits("a*z|", "x/a--z") and not fits("a*z|", "x/a--zy") and fits("/x^", "o/x") and fits("/x^", "o/x?1") and not fits("/x^", "o/xy") and fits("a.b", "a.b") and not fits("a.b", "acb")
    tokens = lambda p: set(op13_urls.pattern_rule(p, "block").tokens)
    assert tokens("||ads.") == {"ads"} and tokens("/cgi-bin/") == {"cgi", "bin"} and tokens("ads") == set() and tokens("ads/x1/*y/z|") == {"x1", "z"} and tokens("||*-w.") == {"w"} and tokens("/A^") == {"a"}
    assert set(op13_urls.host_rule("Example.com", "/en/", "block").tokens) == {"example", "com", "en"} and set(op13_urls.host_rule("a.b", "/x", "block").tokens) == {"a", "b"}


def test_only_candidates_run():
    """The index gives every rule that fits, and few that don't."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rules = [op13_urls.pattern_rule(f"/{rng.choice(words)}/{rng.choice(words)}/", "block") for _ in range(400)] + [op13_urls.host_rule(f"{rng.choice(words)}.com", "/", "allow") for _ in range(100)] + [op13_urls.pattern_rule("odd", "block")]
    rules = list(set(rules))
    subjects = [f"{rng.choice(words)}.com/{rng.choice(words)}/{rng.choice(words)}/{rng.choice(words)}/" for _ in range(300)] + ["x.org/podd"]
    counts = Counter(t for s in subjects for t in {x.lower() for x in op13_urls.TOKEN.findall(s)})
    index, tried = op13_urls.Index(rules, counts), 0
    for s in subjects:
        found = index.candidates(s)
        tried += len(found)
        fit = [r for r in rules if re.search(r.regex, s)]
        assert set(fit) <= set(found) and index.best(s) == max(fit, key=lambda r: r.order, default=None)
    assert tried < len(subjects) * 8 and all("com" not in index.rules or r.tokens == {"com"} for r in index.rules.get("com", []))


def test_queries_are_registered():
    assert {"op11_audit", "op12_trie", "op13_urls"} <= set(llm.QUERIES) and {"op11_audit", "op12_trie", "op13_urls"} <= set(llm.SQL)
