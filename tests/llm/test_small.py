"""Each operator against brute force and on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "src0", 0), (2, "", None, None, None), (3, " \n\t", "en", "src1", 3), (4, "a b c d e f", "de", "src1", 11), (4, "a b c d e f", "de", "src1", 11),
       (5, "A b  c d e f", "de", "src1", 12), (6, "x" * 30_000, "fr", "src2", 30_000), (7, "w0 " * 9000, "fr", "src2", 27_000), (None, "null id here", "en", "src3", 12)]
CLASHES = ["kept", "key", "id", "norm", "score", "n_tokens", "group_id", "h", "epoch", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, near=6):
    """Random documents, exact copies, near copies and shared lines."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(400)])
    out = []
    for i in range(n):
        if i > 10 and rng.random() < 0.35:
            base = out[int(rng.integers(len(out)))].split(" ")
            for _ in range(int(rng.integers(0, near))):
                base[int(rng.integers(len(base)))] = f"e{rng.integers(1000)}"
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(words, int(rng.integers(3, 120)))))
    return out


# ---- 1 mixing

def test_share_gives_shortages_to_siblings_first():
    from llm.mixing import leaf_budgets, share

    assert share(90, {"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1}) == pytest.approx({"a": 10, "b": 40, "c": 40})
    tokens = {("x", "en", "s"): 5, ("x", "de", "s"): 1000, ("y", "en", "s"): 1000}
    got = leaf_budgets(tokens, 100, {}, 1)
    # what x/en lacks goes to x/de, not to y
    assert got == pytest.approx({("x", "en", "s"): 5, ("x", "de", "s"): 45, ("y", "en", "s"): 50})
    short = leaf_budgets({("x", "en", "s"): 5, ("x", "de", "s"): 10, ("y", "en", "s"): 1000}, 100, {}, 1)
    assert short == pytest.approx({("x", "en", "s"): 5, ("x", "de", "s"): 10, ("y", "en", "s"): 85})
    assert leaf_budgets({}, 10, {}, 1) == {}


def poured(tokens, budget, weights, epochs, path=()):
    """Leaf budgets another way: each node's budget is poured in small drops, each to the child that is
    furthest below its weighted level and not yet full."""
    if len(path) == 3:
        return {path: min(budget, epochs * tokens[path])}
    room = defaultdict(float)
    for leaf, n in tokens.items():
        if leaf[:len(path)] == path:
            room[leaf[:len(path) + 1]] += epochs * n
    got, drop = dict.fromkeys(room, 0.0), 1e-3
    left = min(budget, sum(room.values()))
    while left > 1e-9:
        child = min((c for c in room if got[c] < room[c] - 1e-9), key=lambda c: (got[c] / weights.get(c, 1.0), c))
        some = min(drop * budget, left, room[child] - got[child])
        got[child] += some
        left -= some
    return {leaf: b for c, own in got.items() for leaf, b in poured(tokens, own, weights, epochs, c).items()}


def test_leaf_budgets_equal_poured_ones():
    from llm.mixing import leaf_budgets

    rng = np.random.default_rng(5)
    for _ in range(20):
        tokens = {(f"d{i}", "en" if i % 2 else "de", f"s{j}"): int(rng.integers(1, 300)) for i in range(3) for j in range(int(rng.integers(1, 4)))}
        weights = {("d0",): 4.0, ("d1",): 0.5, ("d2", "de", "s1"): 3.0}
        budget = float(rng.uniform(0.2, 2.5)) * sum(tokens.values())
        got, want = leaf_budgets(tokens, budget, weights, 2), poured(tokens, budget, weights, 2)
        assert got == pytest.approx(want, abs=0.01 * budget)


def test_mix_equals_brute_force(spark):
    from llm.mixing import leaf_budgets, mix  # budgets: see the test above

    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["t"] * int(rng.integers(1, 40))), ["en", "de"][i % 3 == 0], f"src{i % 5}", 0) for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA)
    weights = {("domain0",): 5.0, ("domain1", "de"): 3.0}
    got = Counter((r.doc_id, r.epoch, r.taken) for r in mix(df, fraction=0.9, weights=weights, max_epochs=3, seed=4).collect())
    leaf = {d[0]: (f"domain{int(d[3][3:]) % 4}", d[2], d[3]) for d in docs}
    n = {d[0]: len(d[1].split()) for d in docs}
    tokens = Counter()
    for i, k in leaf.items():
        tokens[k] += n[i]
    want = Counter()
    for k, budget in leaf_budgets(dict(tokens), 0.9 * sum(tokens.values()), weights, 3).items():
        own = [i for i in leaf if leaf[i] == k]
        whole = min(int(budget // tokens[k]), 3)
        want.update((i, e, n[i]) for i in own for e in range(whole))
        left = int(budget - whole * tokens[k])
        for i in sorted(own, key=lambda i: hashlib.md5(f"4:{whole}:{i}".encode()).hexdigest()):
            if left > 0:
                want[(i, whole, min(n[i], left))] += 1
            left -= n[i]
    assert got == want


def test_mix_edges(odd, clashing, empty):
    from llm.mixing import mix, select_documents

    got = mix(odd, fraction=1.0, max_epochs=1).collect()
    assert Counter(r.doc_id for r in got) == Counter({4: 2, 5: 1, 6: 1, 7: 1, None: 1})
    assert mix(empty).count() == 0
    assert select_documents(clashing.where("doc_id > 4"), fraction=1.0, max_epochs=1).columns == clashing.columns


def test_selected_documents_are_the_chosen_ones(spark, tmp_path):
    """Null and repeated ids come back as often as they are chosen, through the pipeline's stage too."""
    import corpus_pipeline
    from llm.mixing import mix, select_documents

    rows = [(None, "null one", "en", "src0", 0), (None, "null two x", "en", "src0", 1), (None, "null two x", "en", "src0", 1)]
    rows += [(4, "a b c", "de", "src1", k) for k in range(40)] + [(5, "one text", "de", "src1", 0), (5, "other text here", "de", "src1", 0), (5, "other text here", "fr", None, 0)]
    rows += [(10 + k, "w " * (k + 1), "en", "src0", 0) for k in range(12)] + [(99, "", "en", "src0", 0), (None, None, "en", "src0", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({"fraction": 1.0, "max_epochs": 1}, {"fraction": 0.5, "max_epochs": 1}, {"fraction": 1.6, "max_epochs": 3}, {"total": 60, "max_epochs": 1, "seed": 3}):
        want = Counter((r.doc_id, r.lang, r.source, r.n_tokens) for r in mix(df, **options).collect())
        got = select_documents(df, **options)
        assert got.columns == df.columns
        assert Counter((r.doc_id, r.lang, r.source or "", len(r.text.split())) for r in got.collect()) == want
    kept = Counter(tuple(r) for r in select_documents(df, fraction=1.0, max_epochs=1).collect())
    assert kept == Counter(r for r in rows if r[1])
    out = corpus_pipeline.mixing(spark, df, str(tmp_path)).collect()
    n = Counter(r.doc_id for r in mix(df, fraction=corpus_pipeline.MIX_FRACTION, weights=corpus_pipeline.MIX_WEIGHTS, max_epochs=1).collect())
    assert Counter(r.doc_id for r in out) == n and n[None] and n[4] > 1


# ---- 2 exact dedup

def test_directory_doubles_and_covers():
    from llm.exact_dedup import build_directory

    loads = {0: 50, 1: 1, 2: 1, 7: 30}
    d = build_directory(loads, 3, 40)
    assert [p for p, _, _ in d] == list(range(8))
    held = Counter()
    for p, b, _ in d:
        held[b] += loads.get(p, 0)
    assert held[dict((p, b) for p, b, _ in d)[0]] == 50 and max(v for v in held.values() if v != 50) <= 40
    assert len({b for _, b, _ in build_directory({}, 3, 40)}) == 1
    # an entry that is overfull with all bits of the directory has the depth that its load needs
    assert [(p, depth) for p, _, depth in build_directory({1: 161, 3: 40}, 2, 40) if depth > 2] == [(1, 5)]


def test_buckets_below_the_directory(spark):
    """Beyond the directory's bits buckets split on: none holds many more keys than it should, and groups stay right."""
    from llm.exact_dedup import build_index, exact_groups

    texts = [(i, f"text {i % 1500}") for i in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index, _ = build_index(df, max_bits=2, capacity=50)
    sizes = [r[1] for r in index.groupBy(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1)).count().collect()]
    assert sum(sizes) == 1500 and len(sizes) >= 24 and max(sizes) < 100
    assert Counter(tuple(r) for r in exact_groups(df, max_bits=2, capacity=50).collect()) == exact_brute(texts)


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((i, t or ""))
    out = Counter()
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is not None, r[0] or 0))[0]
        for i, _ in own:
            out[(i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("capacity", [3, 20_000])
def test_exact_equals_brute_force(spark, odd, capacity):
    from llm.exact_dedup import exact_groups

    texts = [(i, t.replace(" ", [" ", "\n", "  "][i % 3])) for i, t in enumerate(prose(1, 150, 2), 100)] + [(900, "é\u00a0x"), (901, "éx")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    got = Counter(tuple(r) for r in exact_groups(df, max_bits=6, capacity=capacity).collect())
    assert got == exact_brute([(r[0], r[1]) for r in ODD] + texts)


def test_exact_edges(clashing, empty):
    from llm.exact_dedup import drop_copies, exact_groups

    assert exact_groups(empty).count() == 0
    out = drop_copies(clashing)
    assert out.columns == clashing.columns
    # of each group one row stays: of two equal rows of document 4 (5 has the same wording in other case) one
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 3, 4, 5, 6, 7]


def test_row_identity(spark):
    """Repeated rows, null ids and one id with two texts go through both dedup stages by row."""
    from llm.exact_dedup import drop_copies
    from llm.ngram_join import jaccard_groups, one_of_each_group

    long = " ".join(f"w{k}" for k in range(60))
    near, other = long.replace("w59", "x"), " ".join(f"v{k}" for k in range(60))
    rows = [(1, long)] * 3 + [(1, other), (2, near), (3, other.replace("v0", "y")), (None, "no id at all"), (None, "no id at all"), (0, other.replace("v30", "z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "first": F.lit(1), "hash": F.lit(2)})
    exact = drop_copies(df)
    assert exact.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter(dict.fromkeys(rows, 1))
    got = Counter((r.doc_id, r.class_id, r.n_links, r.group_id, r.kept) for r in jaccard_groups(df.where("doc_id is not null")).collect())
    assert got == Counter({(1, 1, 3, 1, True): 3, (1, 1, 2, 0, False): 1, (2, 2, 3, 1, False): 1, (3, 3, 2, 0, False): 1, (0, 0, 2, 0, True): 1})
    kept = Counter((r.doc_id, r.text) for r in one_of_each_group(df).collect())
    assert kept == Counter({(1, long): 1, (0, rows[-1][1]): 1, (None, "no id at all"): 2})


# ---- 3 url filter

def test_rules_and_edges(spark):
    from llm.url_filter import judge

    urls = [None, "", "no scheme/x", "http://net/", "https://A.Example.NET/en/1", "https://example.net/de/1", "http://net", "x://example.com/de/?q#f", "http://sub.example.com/de/x",
            "http://notexample.com/de/x", "http://a.org/fr/1", "http://orgx/fr/", "http://b.net?x=http://c.net/", "http://u:p@h.net:80/", "http://ÄB.net/", "http://a.net/\n?"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "score": F.lit(1)})
    got = {r.page_id: r for r in judge(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "net/", "example.net/en/", "net/", None, "example.com/de/", "example.com/de/", None, "org/fr/", None, None, None, "net/", "net/"]
    assert (got[4].host, got[4].path, got[4].verdict) == ("a.example.net", "/en/1", "allow")
    assert (got[7].host, got[7].path, got[7].verdict) == ("example.com", "/de/", "block")
    assert (got[12].host, got[12].path) == ("b.net", "") and got[13].host == "u:p@h.net:80" and got[14].host == "Äb.net" and got[15].path == "/\n"
    assert all(got[i].host == got[i].path == "" for i in (0, 1, 2)) and all(r.verdict in ("allow", "block") for r in got.values())
    assert judge(df.limit(0)).count() == 0


def test_trees_learn_held_out_urls():
    from llm.url_filter import labelled_urls, train

    rows = labelled_urls()
    fit, held = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if k % 4 == 0]
    p = train(*map(list, zip(*fit, strict=True))).probability([u for u, _ in held])
    assert ((p >= 0.5) == [y for _, y in held]).mean() > 0.9


# ---- 4 toxicity

def toxic_rows(n=360):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        w = list(rng.choice([f"word{k}" for k in range(300)], 40))
        toxic = i % 3 == 0
        if toxic:
            w[int(rng.integers(40))] = str(rng.choice(["vile", "scumlike", "rotten"]))
            w[int(rng.integers(40))] = "vile"
        out.append((i, " ".join(w), "en", "s", 0, int(toxic)))
    return out


def test_toxicity_learns_and_keeps_inputs_apart(spark, clashing):
    from llm.toxicity import Scorer, labelled_sample, score_documents, train

    rows = toxic_rows()
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, 200)
    assert 0 < len(sample) <= 200 and all(__import__("zlib").crc32(str(r.doc_id).encode()) % 5 for r in sample)
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].predicted == r[5] for r in held]) > 0.9
    net = train([r[1] for r in rows], [r[5] for r in rows], ["en"] * len(rows), epochs=2)
    s = Scorer(net)
    texts = ["", "a", "vile", rows[0][1] * 2000, rows[1][1]]
    alone = [float(s.score([t])[0]) for t in texts]
    assert np.allclose(alone, s.score(texts), atol=1e-6) and all(0 <= v <= 1 for v in alone)
    out = score_documents(clashing, labels, net=net).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert score_documents(docs.limit(0), labels, net=net).count() == 0
    with pytest.raises(ValueError):
        train(["a"], [1], ["en"])


def test_scores_are_the_forward_pass(monkeypatch):
    """The scorer against the network written out, over whole texts of many blocks."""
    from llm import toxicity as T

    rows = toxic_rows(90)
    net = T.train([r[1] for r in rows], [r[5] for r in rows], ["en"] * len(rows), epochs=1, min_docs=1)
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(300)] + ["vile", "rotten", "unseen"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 64, 65, 66, 127, 128, 129, 130, 700)] + [" ".join(rng.choice(words, 60_000))]

    def brute(text):
        x = np.stack([sum(net.table[i] for i in [np.searchsorted(net.hashes, h) for h in T.features(w)] if i < len(net.hashes) and net.hashes[i] in T.features(w))
                      if any(h in known for h in T.features(w)) else np.zeros(net.table.shape[1]) for w in T.words_of(text.lower())])
        x = np.vstack([x, np.zeros((T.PAD, x.shape[1]))])
        top = [max_ for w in T.WIDTHS for max_ in (sum(x[k:len(x) - T.PAD + k] @ net.filters[w][k] for k in range(w)).max(0) + net.bias[w])]
        z = np.maximum(top, 0) @ net.out + net.out_bias
        return 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -30, 30)))

    known = set(net.hashes.tolist())
    want = [brute(t) for t in texts]
    for block in (50_000, 64, 7):
        monkeypatch.setattr(T, "BLOCK_WORDS", block)
        assert np.allclose(T.Scorer(net).score(texts), want, atol=1e-5), block


# ---- 5 html

def test_html():
    from llm.html_text import grow, labelled_blocks, main_text

    tree = grow(*labelled_blocks())
    body = "<article><h1>A &amp; B</h1><p>One  two\n three <a href=x>link</a> four.<p>Caf&eacute; &#x41;&lt;b&gt;</p><!-- <p>no</p> --><script>var a = '<p>x</p>'</script></article>"
    page = f"<nav><a href=1>Home</a> <a href=2>More</a></nav><div class='cookie-banner'><p>{'we use cookies ' * 20}</p></div>{body}<section id=comments><p>{'I think so too ' * 20}</p></section><footer>&copy; x</footer>"
    assert main_text(page, tree) == "A & B\nOne two three link four.\nCafé A<b>"
    for bad in ("", "<", "<p", "<p>", "text only", "<script>never closed", "<!-- never closed", "</p></div>", "<a" * 1000):
        assert isinstance(main_text(bad, tree), str)
    import time

    for bad in ("<a", "<!", "<a '", "<svg ", "<script", "<a b='"):  # a megabyte of bad markup is read in one go
        began = time.time()
        assert isinstance(main_text(bad * (1_000_000 // len(bad)), tree), str) and time.time() - began < 20
    shell = "<article><p>{}</p><p>some more words that belong to the article</p></article>"
    icon = main_text(shell.format("text <svg viewBox='0 0 1 1'/> after an icon and a few more words"), tree)
    assert icon.startswith("text after an icon") and icon.count("\n") == 1
    assert main_text("<div class='overflow-hidden has-sidebar'>" + shell.format("first words here") + "</div>", tree).startswith("first words here")
    long = "<article>" + "<p>" + "word " * 200_000 + "</article>"
    assert len(main_text(long, tree)) == 999_999


def test_html_table(spark):
    from llm.html_text import extract_text

    df = spark.createDataFrame([(1, "u", None), (2, None, "<article><p>some text that is main</article>"), (2, None, "<article><p>some text that is main</article>"), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_text(df).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter({(1, "", 0): 1, (2, "some text that is main", 22): 2, (None, "", 0): 1})
    assert extract_text(df.limit(0)).count() == 0


# ---- 6 vectors

def test_vectors_equal_brute_force(spark):
    from llm.vector_dedup import near_vectors

    rng = np.random.default_rng(2)
    v = rng.normal(size=(260, 16))
    v[100:200] = v[:100] + rng.normal(size=(100, 16)) * rng.uniform(0.05, 0.5, (100, 1))
    v[200:230] = v[0]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    odd = [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] + [1.0] * 15), (305, [float("inf")] * 16), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    x = np.array([r[1] for r in rows] + [rows[0][1]])
    ids = [r[0] for r in rows] + [0]
    n = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / np.outer(n, n) >= 0.95
    np.fill_diagonal(link, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(link, low[None], 10 ** 9).min(1))
        if (new == low).all():
            break
        low = new
    want = Counter((i, int(c), int(g), i == g) for i, c, g in zip(ids, link.sum(1), low, strict=True))
    want += Counter({(i, 0, i, True): 1 for i in range(300, 306)}) + Counter({(306, 1, 306, True): 1, (307, 1, 306, False): 1})
    for tile in (40, 4096):
        got = Counter(tuple(r) for r in near_vectors(df, tile=tile).where("vec_id is not null").collect())
        assert got == want
    assert near_vectors(df.limit(0)).count() == 0
    # one id with two vectors, and a null id with a copy
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.01]), (2, [0.01, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in near_vectors(two).collect())
    assert got == Counter({(0, 1, 0, True): 2, (1, 1, 0, False): 1, (2, 1, 0, False): 1, (None, 0, None, True): 1})


# ---- 7 token counts

def test_automaton_equals_greedy_matching():
    from llm.wordpiece_count import Automaton, automaton, default_model

    def greedy(word, starts, rest):
        n, at = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (starts if at == 0 else rest)), None)
            if end is None:
                return -1
            n, at = n + 1, end
        return n

    rng = np.random.default_rng(3)
    for _ in range(60):
        make = lambda k: {"".join(rng.choice(list("abc"), int(rng.integers(1, 5)))) for _ in range(k)}  # noqa: E731, B023
        starts, rest = make(12), make(8)
        a = Automaton(sorted(starts), sorted(rest))
        for _ in range(60):
            w = "".join(rng.choice(list("abcd"), int(rng.integers(0, 12)), p=[0.33, 0.33, 0.33, 0.01]))
            assert a.count(w) == greedy(w, starts, rest), (w, starts, rest)
    a = automaton(default_model())
    assert a.count("") == 0 and a.count("the") == 1 and a.count("x" * 100_000) > 1


def test_token_counts(odd, clashing, empty):
    from llm.wordpiece_count import token_counts

    got = [tuple(r) for r in token_counts(odd).orderBy("doc_id", "n_tokens").collect()]
    assert [tuple(r) for r in token_counts(clashing).orderBy("doc_id", "n_tokens").collect()] == got
    assert (1, 0, 0, 0) in got and (2, 0, 0, 0) in got and (3, 0, 0, 0) in got and got.count(next(r for r in got if r[0] == 4)) == 2
    assert token_counts(empty).count() == 0


# ---- 8 pieces

HARD = ["", " ", "  a", "a ", "a  b", "\u2581", "\u2581\u2581 x\u2581y", "日本語🎉 x", "\n\n", "a\tb", "<s></s><unk><0x41>", "é" * 5, "x" * 5000, "🎉🎉", " \u2581", "Ｆｕｌｌ ①", "ﬁ é \u0000 z"]


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    from llm.pieces import Pieces, default_model, encode_and_decode, token_digests

    sp, p = sentencepiece.SentencePieceProcessor(model_file=default_model()), Pieces(default_model())
    for t in HARD + prose(4, 40):
        ids, ends = p.encode(t)
        assert ids.tolist() == sp.encode(t) and p.decode(ids) == sp.decode(sp.encode(t))
        assert ends.tolist() == [x.end for x in sp.encode(t, return_type="proto").pieces]
        assert not len(ends) or ends[-1] == len(t.encode())
    # the table: repeated rows, a null id, clashing columns, spans against the library's begins and ends
    def digests(t):
        pieces = sp.encode(t, return_type="proto").pieces
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        ids = [*sp.encode(t), 2]
        return len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)), sha(" ".join(map(str, [x.begin for x in pieces] + [x.end for x in pieces])))

    texts = [(i, t) for i, t in enumerate(HARD + prose(5, 20))]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string")).withColumns({"ids": F.lit("clash"), "decoded": F.lit(0)})
    want = Counter((i, *digests(t or "")) for i, t in [(r[0], r[1]) for r in ODD] + texts)
    assert Counter(tuple(r) for r in token_digests(encode_and_decode(df)).collect()) == want
    got = {r.doc_id: r for r in token_digests(encode_and_decode(odd.where("doc_id <> 4"))).collect()}
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (1, hashlib.sha256(b"2").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert got[6].ids_sha256 == hashlib.sha256(" ".join(map(str, [*sp.encode("x" * 30_000), 2])).encode()).hexdigest()
    assert encode_and_decode(odd.limit(0)).count() == 0


def test_compiled_map_normalises_like_the_library(tmp_path):
    """A model with a compiled character map: the published one with the map of a named rule put in."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from llm.pieces import Pieces, default_model

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = pb.ModelProto()
    spec.ParseFromString(rule.serialized_model_proto())
    model = pb.ModelProto()
    model.ParseFromString(open(default_model(), "rb").read())
    model.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    sp, p = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), Pieces(str(tmp_path / "m.model"))
    for t in [*HARD, "ｱｲｳ ㌔ Ⅷ x², ½  end  ", "a\u00a0b\u3000c", "e\u0301 A\u030a"]:
        ids, ends = p.encode(t)
        assert ids.tolist() == sp.encode(t), t
        assert len(ends) == len(ids) and all(a <= b for a, b in zip(ends, ends[1:], strict=False)) and (not len(ends) or ends[-1] <= len(t.encode()))
        assert p.decode(ids) == sp.decode(sp.encode(t))


# ---- 9 jaccard

def jaccard_brute(rows, words=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    links, low = Counter(), {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (links[i], low[i]) for i in sets}


@pytest.mark.parametrize("tile", [8, 2048])
def test_jaccard_equals_brute_force(spark, tile):
    from llm.ngram_join import jaccard_groups

    rows = list(enumerate(prose(6, 160, 4))) + [(500, "a b"), (501, "A  b"), (502, "a"), (503, None), (504, "  ")]
    got = {r.doc_id: (r.n_links, r.group_id) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    assert got == jaccard_brute(rows)


def test_bayes_table():
    from llm.ngram_join import HASHES, STEP, fewest_matches

    least = fewest_matches(0.8, 1e-6)
    assert len(least) == HASHES // STEP and all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[0] < 0.8 * STEP and least[-1] < 0.8 * HASHES
    assert fewest_matches(0.8, 1e-2) > least


def test_jaccard_edges(odd, clashing, empty):
    from llm.ngram_join import jaccard_groups, one_of_each_group

    got = [tuple(r) for r in jaccard_groups(odd).collect()]
    assert len(got) == len(ODD) and (5, 4, 2, 4, False) in got and got.count((4, 4, 2, 4, True)) == 2 and (None, None, 0, None, True) in got
    assert jaccard_groups(empty).count() == 0
    out = one_of_each_group(clashing)
    assert out.columns == clashing.columns and out.where("doc_id = 5").count() == 0


# ---- 10 lines

def test_lines(spark, odd, clashing, empty):
    from llm.line_dedup import drop_fuzzy_lines, fuzzy_line_groups

    long = " ".join(f"word{k}" for k in range(60))
    near = long.replace("word30", "word30x")
    docs = [(1, f"Hello, World!\n{long}\nonly here once"), (2, f"hello world\n{near}\n\n---"), (3, "HELLO   WORLD\nonly here twice or so\nonly here twice or so"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r for r in fuzzy_line_groups(df).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    assert [k for k in sorted(got) if got[k].kept] == [(1, 0), (1, 1), (1, 2), (3, 1)]
    assert got[(1, 1)].group_id == got[(2, 1)].group_id and got[(1, 2)].group_id != got[(3, 1)].group_id
    out = {r.doc_id: r.text for r in drop_fuzzy_lines(df).collect()}
    assert out == {1: docs[0][1], 2: "\n---", 3: "only here twice or so", 4: None, 5: ""}
    assert fuzzy_line_groups(empty).count() == 0
    # the repeated row of document 4 counts as a row of its own
    assert fuzzy_line_groups(clashing).count() == 6 and drop_fuzzy_lines(clashing).columns == clashing.columns


def test_lines_link_like_brute_force(spark):
    """Against plain edit similarity of all pairs: no line joins a group that brute force keeps apart, and nearly all pairs are found."""
    from llm.line_dedup import fuzzy_line_groups

    texts = list(dict.fromkeys(prose(8, 260, 4)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dist = df.alias("x").join(df.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select(
        F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.levenshtein("x.text", "y.text").alias("d")).collect()
    pairs = [(r.a, r.b) for r in dist if r.d <= 0.1 * max(len(texts[r.a]), len(texts[r.b])) + 1e-9]
    low = {i: i for i in range(len(texts))}
    for _ in range(20):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    group = {r.doc_id: r.group_id for r in fuzzy_line_groups(df).collect()}
    assert len(pairs) > 40 and np.mean([group[a] == group[b] for a, b in pairs]) >= 0.9
    brute = defaultdict(set)
    for i, g in group.items():
        brute[g].add(low[i])
    assert all(len(x) == 1 for x in brute.values())


def test_lines_long_repeated_and_hot(spark, monkeypatch):
    """Lines of 100,000 characters, repeated documents, and a key that many lines share in small tiles."""
    from llm import line_dedup

    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 10 ** 6, 15_000)]
    near, far = list(words), list(words)
    near[7_000] = near[7_010] = "changed"
    for k in range(0, 15_000, 3):
        far[k] = f"other{k}"
    docs = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (None, "a b c d e f g h"), (4, "same line here\nsame line here"), (4, "same line here\nsame line here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "norm": F.lit(1)})
    got = line_dedup.fuzzy_line_groups(df).collect()
    by = {r.doc_id: r for r in got if r.line_no == 0}
    assert len(docs[0][1]) > 90_000 and by[1].group_id == by[2].group_id != by[3].group_id
    assert sum(r.kept for r in got if r.doc_id == 4) == 1 and by[None].kept
    out = [(r.doc_id, r.text) for r in line_dedup.drop_fuzzy_lines(df).collect()]
    assert Counter(t for i, t in out if i == 4) == Counter({"same line here": 1, "": 1})
    # one template with two different numbers each: lines share keys and are no near copies of the key's smallest
    base = "the quick brown fox jumps over the lazy dog near a river bank at"
    rows = [(i, f"{base} {10 ** 9 + 7 * i} {10 ** 9 * (1 + i % 9) + i}") for i in range(60)] + [(100 + i, f"{base} {10 ** 9 + 7 * i} {10 ** 9 * (1 + i % 9) + i}x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "TILE", 7)
    group = {r.doc_id: r.group_id for r in line_dedup.fuzzy_line_groups(df).collect()}
    assert all(group[i] == group[100 + i] for i in range(60))


def test_lines_recall_against_edit_similarity(spark, tmp_path):
    """Of pairs one character apart the registered query links nine in ten, and of pairs below the similarity none directly."""
    from llm.line_dedup import normal
    from llm.queries import QUERIES

    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = ["".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(2000)]
    base = [" ".join(rng.choice(words, int(rng.integers(4, 80)))) for _ in range(300)]
    base = [t for t in base if len(t) >= 20]
    rows = []
    for i, t in enumerate(base):
        at = int(rng.integers(1, len(t) - 1))
        rows += [(2 * i, t), (2 * i + 1, t[:at] + "q" + t[at + 1:])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    group = {r.doc_id: r.group_id for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    found = np.mean([group[2 * i] == group[2 * i + 1] for i in range(len(base))])
    assert found >= 0.9, found
    assert len({group[2 * i] for i in range(len(base))}) == len(base)
    odd = ["\u201cHello\u201d \u2014 world\u2026", "hello\u00a0world!", "HELLO, - world"]
    assert {r.n for r in spark.createDataFrame([(t,) for t in odd], "t string").select(normal(F.col("t")).alias("n")).collect()} == {"hello world"}


def test_lines_pieces_bound_the_distance(spark):
    """The sum over pieces is never below the edit distance, and near it for lines with scattered edits."""
    from llm.line_dedup import _bound

    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeéß"), int(rng.integers(2, 9)))) for _ in range(300)]
    rows = [("", "x"), ("thor " * 60 + "end", "thor " * 70 + "end"), ("a", "a")]
    for k in range(60):
        a = list(rng.choice(words, int(rng.integers(5, 200))))
        b = list(a)
        for _ in range(int(rng.integers(0, 1 + len(a) // 8))):
            at = int(rng.integers(0, len(b)))
            b[at:at + int(rng.integers(0, 2))] = rng.choice(words, int(rng.integers(0, 3)))
        rows += [(" ".join(a), " ".join(b)), (" ".join(a), " ".join(rng.permutation(a)))]
    df = spark.createDataFrame([(*r, 10 ** 6) for r in rows], "na string, nb string, most int")
    got = df.select(_bound(F.col("na"), F.col("nb"), F.col("most")).alias("bound"), F.levenshtein("na", "nb").alias("d")).collect()
    assert all(r.bound >= r.d for r in got)
    assert np.median([r.bound - r.d for r in got[3::2]]) <= 3


def test_lines_are_normalised_and_compared_once(spark, monkeypatch):
    """No plan normalises a line twice, lines are exchanged as bits of their words, and every comparison is written before answers are dropped."""
    from llm import line_dedup

    plans, cut = {}, line_dedup.cut

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(line_dedup, "cut", spy)
    docs = [(k, f"One line, of SEVERAL words; number {k % 3}\nand another: line") for k in range(9)]
    assert line_dedup.fuzzy_line_groups(spark.createDataFrame(docs, "doc_id long, text string")).count() == 18
    assert plans["rawlines"].count("regexp_replace") == 1 and "min(norm" not in plans["simhashes"]
    compared = {name: plan for name, plan in plans.items() if "levenshtein" in plan}
    assert set(compared) == {"first", "near_by", "second"}
    assert not any("levenshtein" in x for plan in compared.values() for x in plan.splitlines() if "Filter" in x)


def test_lines_blocks_like_brute_force(spark):
    """Each block's bits are the majority of its words' hashes, and lines share a key where a choice of blocks agrees."""
    from itertools import combinations

    from llm.line_dedup import BLOCKS, CHOICES, block_keys, with_simhash

    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(400)]
    lines = {i: list(rng.choice(words, int(n))) for i, n in enumerate(rng.integers(1, 60, 40))}
    for i in range(40, 70):
        lines[i] = list(lines[i - 40])
        lines[i][int(rng.integers(len(lines[i])))] = "other"
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in lines.items()] * 2, "id long, norm string")
    made = with_simhash(df)
    hashes = {r.w: r.h % 2 ** 64 for r in df.select(F.explode(F.split("norm", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    want, blocks = {}, {}
    for i, w in lines.items():
        own = [[hashes[x] for x in set(w) if (hashes[x] >> 20) % BLOCKS == k] for k in range(BLOCKS)]
        b = [1 + sum(1 << j + 5 * lane for lane in range(3) for j in range(5) if sum(h >> j + 21 * lane & 1 for h in hs) > len(hs) // 2) if hs else 0 for hs in own]
        n, three = [len(hs) for hs in own], lambda v: sum(x << 21 * j for j, x in enumerate(v))
        want[i], blocks[i] = (len(" ".join(w)), three(b[:3]), three(b[3:]), three(n[:3]), three(n[3:])), (b, n)
    assert {r.id: tuple(r)[1:] for r in made.collect()} == want
    keys = defaultdict(set)
    for i, (b, n) in blocks.items():
        for size, low, high, most in CHOICES:
            if low <= sum(n) <= (high or 10 ** 9):
                for c in combinations(range(BLOCKS), size):
                    if sum(n[k] for k in c) >= min(most, (sum(n) + 1) // 2):
                        keys[c, tuple(b[k] for k in c)].add(i)
    got = defaultdict(set)
    for r in block_keys(made).collect():
        got[r.key].add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, keys.values()))


# ---- components and pipeline

def test_components(spark):
    from llm.common import components

    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3)]
    low = {v: v for e in edges for v in e if v is not None}
    for _ in range(80):
        for a, b in edges:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: m for v, m in low.items() if v != m}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_rows(300)
    clean = [(1000 + i, t, "en", f"src{i % 6}", len(t)) for i, t in enumerate(prose(9, 60, 2))]
    docs = spark.createDataFrame([r[:5] for r in rows] + clean + [(2000, None, "en", "src1", 0), (2001, "", None, None, None)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, held, str(tmp_path))
        got.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        out[name] = held
        if name != "encode":
            assert held.columns == docs.columns
    toxic = {r[0] for r in rows if r[5]}
    left = {r.doc_id for r in out["toxicity"].collect()}
    assert len(left & toxic) < 0.1 * len(toxic) and {c[0] for c in clean} <= left
    exact = {r.doc_id for r in out["exact_dedup"].collect()}
    assert exact == {k[0] for k in exact_brute([(r.doc_id, r.text) for r in out["toxicity"].collect()]) if k[3]}
    near = {r.doc_id for r in out["near_dedup"].collect()}
    brute = jaccard_brute([(r.doc_id, r.text) for r in out["exact_dedup"].collect()])
    assert near == {i for i, (_, low) in brute.items() if i == low}
    ids = [r.doc_id for r in out["encode"].collect()]
    assert set(ids) <= near and len(ids) == out["mixing"].count() > 0.7 * len(near)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(ids)


def test_html_frames_and_links():
    from llm.html_text import blocks, grow, labelled_blocks, main_text

    tree = grow(*labelled_blocks())
    text = lambda page: main_text(page, tree)
    assert text("<article><p>wo<script>x</script>rd, b<button>y</button>ook<!-- z -->s</p></article>") == "word, books"
    inside = "<p>The long story of a town that had no name.</p><p>It has a second part.</p>"
    story = "The long story of a town that had no name.\nIt has a second part."
    for part in ("article", "main", "div class='post-body'"):
        name = part.split()[0]
        assert text(f"<form id='page'><nav><p>Menu and more</p></nav><{part}>{inside}</{name}><footer>Foot of the page</footer></form>") == story
        # a form inside the article, and one named as boilerplate around something like an article, stay out
        assert text(f"<{part}>{inside}<form><p>Your name</p><p>Your mail</p></form></{name}>") == story
        assert text(f"<{part}>{inside}</{name}><form class='comment-form'><{part}><p>Say what you think of it</p></{name}></form>") == story
    for other in ("related-article", "related-posts", "sponsored-content", "promoStory", "comment-body"):
        assert text(f"<main>{inside}<div class='{other}'><p>Another story about another town</p></div></main>") == story
    for own in ("article-related-to-nothing", "privacy-article", "post-content"):
        assert text(f"<main><div class='{own}'>{inside}</div></main>") == story
    assert text(f"<main>{inside}<a href='/x'><div>Read also this one</div></a></main>") == story
    found = blocks("<p><a href=/a>one two</p><p>three</p><a name=top><p>four <a href=/b>five</a></p>")
    assert [(b[0], b[2]) for b in found] == [("one two", 2), ("three", 0), ("four five", 1)]
    import time

    began = time.time()
    assert text("<form><article>" * 60_000 + "end of it all") == "end of it all" and time.time() - began < 20


def test_html_generated_pages():
    """Pages put together at random around a known article, in and out of forms, with every kind of boilerplate between its parts."""
    import random

    from llm.html_text import grow, labelled_blocks, main_text

    rng, tree = random.Random(7), grow(*labelled_blocks())
    words = "river town story light market winter bridge letter garden music people morning".split()
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for _ in range(300):
        parts, want = [], []
        for _ in range(rng.randint(1, 8)):
            t = line(rng.choice((2, 9, 40, 120)))
            want.append(t)
            parts.append(rng.choice(("<p>{}</p>", "<p>\n {} \t</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>")).format(t.replace(" ", rng.choice((" ", "  ", "\n")), 1)))
            parts.append(rng.choice((
                "", "<script>var a = '<p>no</p>';</script>", f"<aside><p>{line(30)}</p></aside>", f"<div class='related-article'><p>{line(30)}</p></div>",
                f"<form><p>{line(5)}</p><input></form>", f"<div class='ad'>{line(12)}</div>", f"<section class='comments'><article><p>{line(60)}</p></article></section>")))
        shell = rng.choice(("<article>{}</article>", "<main><div>{}</div></main>", "<div class='post-content'>{}</div>"))
        page = f"<header><p>{line(4)}</p></header><nav><a href=/>{line(2)}</a></nav>" + shell.format("".join(parts)) + f"<div class='cookie-notice'>{line(40)}</div><footer>{line(9)}</footer>"
        if rng.random() < 0.5:
            page = f"<form method=post>{page}</form>"
        assert main_text(f"<html><head><title>{line(3)}</title></head><body>{page}</body></html>", tree) == "\n".join(want)
