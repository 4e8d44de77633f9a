"""Merkle manifest, decontamination and periodic runs against brute force and on edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["seq", "pos", "block", "n", "leaf", "other", "row", "words", "hashes", "prints", "size", "window", "runs", "best", "item", "at"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    vocabulary = [f"W{k}" for k in range(60)] + ["É", "ß", "naïve"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 90))), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", rng.choice([None, i])) for i in range(260)]
    rows += [(None, "null id", "en", "s1", 1), (None, None, None, None, None), (7, "", "", "", 0), (8, " \n\t", "en", None, 3), (5, "A a A a A a A a", "en", "s1", 1)]
    rows += [(900, "Same row A", "en", "hot", 1)] * 3 + [(901, "one id", "en", "hot", 1), (901, "Other text", "en", "hot", 1), (902, "x" * 40_000, "fr", "long", 1), (903, "ab cd " * 8_000, "fr", "long", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# ---- 11 manifest

def brute_manifest(rows):
    h = lambda parts: digest("".join(parts))

    def leaf(r, text):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            run = i // 16 * 16
            yield level[run:i], level[i + 1:run + 16]
            i //= 16

    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r) for r in rows if r.source == s), key=lambda x: x[:3])
        trees.append((own, grow([o[2] for o in own])))
    top = grow([levels[-1][0] for _, levels in trees])
    for k, (own, levels) in enumerate(trees):
        for i, (_, _, own_leaf, r) in enumerate(own):
            path = [*way(levels, i), *way(top, k)]
            hit = r.doc_id is not None and crc(r.doc_id) % 5 == 0 and r.text is not None
            d = leaf(r, r.text.translate(LOWER)) if hit else own_leaf
            for b, a in path:
                d = h([*b, d, *a])
            yield r.doc_id, own_leaf, levels[-1][0], top[-1][0], h(x for b, a in path for x in b + a), d, d == top[-1][0]


@pytest.mark.parametrize("options", [{}, {"height": 1, "top": 2}, {"height": 1, "top": 12}, {"height": 2, "top": 3}])
def test_manifest(docs, options):
    """One small top tree, and tops reduced by the executors within and over the sources."""
    from llm.merkle import proofs_and_folds

    got = proofs_and_folds(docs, **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    assert key(rows) == key(brute_manifest(docs.collect()))
    assert {r.verified for r in rows} == {True, False}


def test_manifest_edges(spark, docs):
    from llm.merkle import manifest, proofs_and_folds

    few = docs.where("doc_id = 5 or doc_id is null")
    assert key(proofs_and_folds(few.withColumns({c: F.lit("clash") for c in CLASHES})).collect()) == key(proofs_and_folds(few).collect())
    assert proofs_and_folds(docs.where("doc_id < 0")).count() == 0
    one = proofs_and_folds(docs.where("doc_id = 5").limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("")
    assert {r.folded_root == r.root for r in manifest(docs).select("folded_root", "root").collect()} == {True}
    # a change of any one row is seen by that row alone
    altered = {(r.doc_id, r.folded_root == r.root) for r in manifest(docs, F.when(F.col("doc_id") == 12, F.lit("changed"))).collect()}
    assert (12, False) in altered and all(ok for i, ok in altered if i != 12)


# ---- 12 decontamination

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_leaks(rows, items, length=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for g in [tuple(w)] if 0 < len(w) < length else [tuple(w[i:i + length]) for i in range(len(w) - length + 1)]:
            windows.setdefault(g, set()).add("" if item is None else str(item))
    for r in rows:
        w, hit, found = words_of(r.text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        yield r.doc_id, len(w), len(hit), len(found), digest(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("limit", [1 << 18, 3])
def test_decontamination(spark, docs, monkeypatch, limit):
    """Items cut from the documents, short ones and shifted ones; with a broadcast of all fingerprints and with the bitmap and joins."""
    from llm import winnowing

    monkeypatch.setattr(winnowing, "LIMIT", limit)
    rng, rows = random.Random(3), docs.collect()
    items = [(1, None), (2, ""), (3, "..!"), (4, "null ID"), (None, "ab cd ab"), (5, "w1 w2"), (5, "é"), (6, "W59"), (8, "A a a"), (9, "same-row/a")]
    for k in range(40):
        w = words_of(rng.choice(rows).text)
        at, n = rng.randint(0, max(0, len(w) - 1)), rng.randint(8, 30)
        items.append((100 + k, "\n".join(["zz"] * rng.randint(0, 4) + w[at:at + n] + ["yy"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = key(brute_leaks(rows, items))
    got = winnowing.contamination_digests(docs, bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert key(got.collect()) == want and sum(r[5] for r in want) > 20
    if limit > 3:
        clash = docs.withColumns({c: F.lit("clash") for c in CLASHES})
        assert key(winnowing.contamination_digests(clash, bench.withColumn("size", F.lit(1))).collect()) == want


def test_every_shared_span_is_found(spark):
    """Spans of just the length, at every place of winnowing's windows; one word less is no hit."""
    from llm.winnowing import contamination_digests

    rng, rows, items = random.Random(4), [], []
    for k in range(200):
        span = [f"q{k}x{j}" for j in range(10)]
        items.append((k, " ".join([f"i{rng.random()}"] * (k % 9) + span + ["end"] * (k % 3))))
        rows.append((k, " ".join([f"d{rng.random()}"] * rng.randint(0, 12) + (span if k % 2 else span[:9]) + ["tail"] * (k % 4)), "en", "s", 0))
    got = contamination_digests(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.contaminated == bool(r.doc_id % 2) and r.n_hit == 10 * (r.doc_id % 2) for r in got)


def test_decontamination_edges(spark, docs):
    from llm.winnowing import contamination_digests

    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in contamination_digests(docs.limit(9), none).collect()} == {False}
    assert contamination_digests(docs.where("doc_id < 0"), none).count() == 0


# ---- 13 periodic runs

def brute_runs(w):
    runs = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                runs.setdefault((i, j + p), p)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, e - s, p) for (s, e), p in runs.items())


def brute_digests(rows):
    from fractions import Fraction

    for r in rows:
        w = (r.text or "").encode().split()
        n = len(w)
        if r.doc_id is not None and crc(r.doc_id) % 10 == 0 and n:
            g = crc(r.doc_id) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        s, length, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        yield (r.doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
               digest(b" ".join(w[i] for i in range(n) if i not in gone).decode()))


def test_runs_of_small_alphabets(monkeypatch):
    from llm import periodic_runs

    rng = random.Random(5)
    for portion in (1 << 20, 1):
        monkeypatch.setattr(periodic_runs, "QUESTIONS", portion)
        for _ in range(150):
            texts = []
            for _ in range(rng.randint(0, 4)):
                n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 9])
                t = [rng.randrange(k) for _ in range(n)]
                a = rng.randrange(n) if n else 0
                for i in range(a, n if rng.random() < 0.6 else 0):
                    t[i] = t[a + (i - a) % (1 + (n - a) // 5)]
                texts.append(t)
            start, end, period = periodic_runs.find_runs(texts)
            at, got = 0, list(zip(start.tolist(), end.tolist(), period.tolist()))
            for t in texts:
                assert [(s - at, e - s, p) for s, e, p in got if at <= s < at + len(t)] == brute_runs(t)
                at += len(t)


def test_run_digests(docs, monkeypatch):
    from llm.periodic_runs import run_digests

    rows = [r for r in docs.collect() if r.doc_id != 903]  # checked below: the brute force is slow there
    got = run_digests(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    out = got.collect()
    assert key(r for r in out if r.doc_id != 903) == key(brute_digests(rows))
    long = next(r for r in out if r.doc_id == 903)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 16_000, 2, 8_000_000) and long.collapsed_sha256 == digest("ab cd")
    clash = run_digests(docs.withColumns({c: F.lit("clash") for c in CLASHES}))
    assert key(clash.collect()) == key(out)
    assert run_digests(docs.where("doc_id < 0")).count() == 0


def test_best_run_is_exact():
    from llm.periodic_runs import best_run

    assert best_run([]) is None
    big = 10**9
    assert best_run([(0, big, big // 5), (4, 5 * big + 1, big), (9, 5 * big + 1, big)]) == 1
