"""N-gram Jaccard join: incremental MinHash comparison with Bayesian pruning, exact verification.

A document's set holds its runs of ``words`` consecutive words (lower case, cut
at white space); a document with fewer words is one run. Documents with equal
sets are one class. Classes are linked when the Jaccard similarity of their sets
reaches ``threshold``. Bands of MinHash values propose which classes may meet;
their signatures are compared some hashes at a time, and a pair is dropped as
soon as the posterior probability (uniform prior) of reaching the threshold
falls below ``tolerance``. What survives is verified on the sets themselves.

Defined cases: null, empty and blank texts have no set: they link with nothing
and are classes of their own; rows with a null doc_id are returned without
links; repeated rows of one doc_id are members of one class, and a doc_id with
two texts is in two classes that link for themselves (what is compared is named
by its set, a doc_id only names the result); texts of any length are read whole.
Sets hold 64-bit hashes of runs, so a similarity is exact but for their collisions.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Forest, components, cut, only_wanted, with_rows

BANDS, ROWS, STEP = 28, 5, 20
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20)
MULTIPLY = (_rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
MEMO_WORDS = 300_000


class WordHashes(dict):
    """64-bit hashes of words, at most MEMO_WORDS of them remembered."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str, words: int, memo: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of words."""
    h = np.array(list(map(memo.__getitem__, text.lower().split())), np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k:k + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set: the smallest of (a x + b), upper half, for each of HASHES functions."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 2048):
        x = s[at:at + 2048]
        low = np.minimum(low, ((MULTIPLY[:, None] * x[None] + ADD[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return low


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For each multiple n of STEP the fewest matches with P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int], same: bool, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that no step of the comparison drops; same: a is b[at:], take later rows of b only."""
    match = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        match += a[:, k, None] == b[None, :, k]
    good = match >= least[0]
    if same:
        good &= np.arange(len(b))[None] > at + np.arange(len(a))[:, None]
    i, j = np.nonzero(good)
    m = match[i, j].astype(np.int32)
    for step in range(1, HASHES // STEP):
        cols = slice(step * STEP, (step + 1) * STEP)
        for s in range(0, len(i), 200_000):
            m[s:s + 200_000] += (a[i[s:s + 200_000], cols] == b[j[s:s + 200_000], cols]).sum(1)
        keep = m >= least[step]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def intersections(i: np.ndarray, j: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of the pairs' sets."""
    if not len(i):
        return np.empty(0, np.int64)
    ua, ub = np.unique(i), np.unique(j)
    flat_a = np.concatenate([sets_a[k] for k in ua])
    vocab, ids_a = np.unique(flat_a, return_inverse=True)
    row_a = np.repeat(np.arange(len(ua)), [len(sets_a[k]) for k in ua])
    flat_b = np.concatenate([sets_b[k] for k in ub])
    at = np.searchsorted(vocab, flat_b).clip(0, len(vocab) - 1)
    hit = vocab[at] == flat_b
    row_b = np.repeat(np.arange(len(ub)), [len(sets_b[k]) for k in ub])[hit]
    ids_b = at[hit]
    ia, jb = np.searchsorted(ua, i), np.searchsorted(ub, j)
    if len(i) > 0.05 * len(ua) * len(ub) and len(ua) > 1:  # dense: products of 0/1 blocks
        total = np.zeros((len(ua), len(ub)), np.float32)
        for c in range(0, len(vocab), 2048):
            x, y = np.zeros((len(ua), 2048), np.float32), np.zeros((len(ub), 2048), np.float32)
            k = (ids_a >= c) & (ids_a < c + 2048)
            x[row_a[k], ids_a[k] - c] = 1
            k = (ids_b >= c) & (ids_b < c + 2048)
            y[row_b[k], ids_b[k] - c] = 1
            total += x @ y.T
        return total[ia, jb].astype(np.int64)
    keys = np.sort(row_a.astype(np.int64) * len(vocab) + ids_a)
    starts = np.searchsorted(row_b, np.arange(len(ub) + 1))
    size = starts[jb + 1] - starts[jb]
    out = np.zeros(len(i), np.int64)
    s = 0
    while s < len(i):  # pairs whose elements fit in one look-up
        e = s + max(1, int(np.searchsorted(np.cumsum(size[s:s + 100_000]), 2_000_000)))
        n = size[s:e]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[jb[s:e]], n)
        want = np.repeat(ia[s:e].astype(np.int64), n) * len(vocab) + ids_b[pos]
        found = keys[np.searchsorted(keys, want).clip(0, len(keys) - 1)] == want
        out[s:e] = np.bincount(np.repeat(np.arange(e - s), n), found, e - s).astype(np.int64)
        s = e
    return out


def _sides(t: pa.Table):
    """Rows of a tile pair ordered by side and id; the number of rows on the first side (all, on the diagonal)."""
    t = t.sort_by([("side", "ascending"), ("id", "ascending")])
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
    side = t["side"].to_numpy()
    return t, sig, int((side == 0).sum()), bool((side == 0).all())


def _blocks(sig, n_first, same, least):
    """(rows, rows, at) of surviving pairs, some rows of the first side at a time, as indices into the whole tile."""
    others = sig if same else sig[n_first:]
    for at in range(0, n_first, 128):
        a = sig[at:min(at + 128, n_first)]
        i, j = survivors(a, others, least, same, at)
        if len(i):
            yield i + at, j + (0 if same else n_first)


def jaccard_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, tile: int = 2048) -> DataFrame:
    """(doc_id, class_id, n_links, group_id, kept), one row per row of ``docs(doc_id, text)``.

    class_id is the smallest doc_id with the same set, n_links the number of
    other documents linked directly (copies included), group_id the smallest
    doc_id reachable by links, kept whether the row is its group's smallest.

    Scale: copies collapse by a combined aggregate first. Band keys (one narrow
    row per class and band) say which classes can meet; connected sets of them
    are dealt into tiles of bounded size, a large one into many tiles of which
    those pairs are compared that share a key. Pairs live and die inside a tile
    pair: what leaves it is one count per row and a spanning forest of links, so
    a group of n near copies ships n rows a tile pair and never n squared.
    """
    out = _groups(docs.select("doc_id", "text", F.lit(0).cast("long").alias("row__")), words, threshold, tolerance, tile)
    return out.select(
        "doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), "n_links",
        F.coalesce("group_first.doc_id", "doc_id").alias("group_id"),
        F.coalesce(F.col("doc_id") == F.col("group_first.doc_id"), F.lit(True)).alias("kept"))


def _groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, tile: int = 2048) -> DataFrame:
    """(doc_id, row__, first, n_links, group_first) for each row of ``docs(doc_id, text, row__)``: the smallest
    (doc_id, row__) of its class and of its group, null for rows without a set or without a doc_id."""
    least = fewest_matches(threshold, tolerance)

    def sign(batches):
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys, sigs, bands = [], [], []
                for text in some["text"].to_pylist():
                    s = shingles(text or "", words, memo)
                    if len(s):
                        sig = signature(s)
                        keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        sigs.append(sig.tobytes())
                        h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
                        for c in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
                            h = (h ^ c) * MIX
                            h ^= h >> np.uint64(31)
                        bands.append(h.view(np.int64).tolist())
                    else:
                        keys.append(None)
                        sigs.append(None)
                        bands.append([])
                yield pa.RecordBatch.from_arrays([
                    some["doc_id"], some["row__"], some["hash"], pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "row__", "hash", "key", "sig", "bands"])

    texts_of = docs.select("doc_id", "row__", "text", F.xxhash64("text").alias("hash"))
    signed = cut(texts_of.mapInArrow(sign, "doc_id long, row__ long, hash long, key binary, sig binary, bands array<long>"), "signed")
    # a class is named by a number that only this run knows; hash finds one of its texts
    classes = cut(signed.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "row__")).alias("first"), F.min("hash").alias("hash"), F.count("*").alias("size"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    met = cut(keyed.join(shared, "band"), "met")
    lead = components(met.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    own = lead.select(F.col("a").alias("id"), F.col("b").alias("lead"))
    member = cut(own.union(own.select(F.col("lead").alias("id"), "lead").distinct()), "member")
    sizes = member.groupBy("lead").agg(F.count("*").alias("n"))
    deals = max(1, -(-member.count() // tile))
    placed = cut(member.join(sizes, "lead").select(
        "id", F.when(F.col("n") > tile, F.col("lead")).alias("big"),
        F.when(F.col("n") > tile, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / tile))).otherwise(F.pmod(F.xxhash64("lead"), F.lit(deals))).alias("chunk")), "placed")
    # which chunks of a large component share a key
    chunks = met.join(placed.where("big is not null"), "id").select("band", "big", "chunk").distinct()
    c2 = chunks.select("band", F.col("big").alias("big2"), F.col("chunk").alias("chunk2"))
    both = chunks.join(c2, "band").where("big = big2 and chunk <= chunk2").select("big", "chunk", "chunk2").distinct()
    pair = cut(both, "chunkpairs")
    name = F.concat_ws("/", "big", "c1", "c2").alias("pair")
    first = pair.select("big", "chunk", F.col("chunk").alias("c1"), F.col("chunk2").alias("c2"), F.lit(0).alias("side"))
    second = pair.where("chunk < chunk2").select("big", F.col("chunk2").alias("chunk"), F.col("chunk").alias("c1"), F.col("chunk2").alias("c2"), F.lit(1).alias("side"))
    big_rows = placed.where("big is not null").join(first.union(second), ["big", "chunk"]).select("id", name, "side")
    small_rows = placed.where("big is null").select("id", F.concat(F.lit("small/"), F.col("chunk")).alias("pair"), F.lit(0).alias("side"))
    rows = cut(small_rows.union(big_rows).join(classes.select("id", "size", "sig"), "id"), "tiles")

    def may_reach(t: pa.Table) -> pa.Table:
        t, sig, n, same = _sides(t)
        seen = np.zeros(len(sig), bool)
        for i, j in _blocks(sig, n, same, least):
            seen[i] = seen[j] = True
        return t.select(["pair", "side", "id", "size", "sig"]).filter(pa.array(seen))

    alive = cut(rows.groupBy("pair").applyInArrow(may_reach, "pair string, side int, id long, size long, sig binary"), "alive")
    wanted = cut(classes.select("id", "hash").join(alive.select("id").distinct(), "id"), "wanted")
    found_texts = only_wanted(texts_of.select("hash", "text"), wanted.select("hash").distinct(), "hash").groupBy("hash").agg(F.min("text").alias("text"))
    texts = wanted.join(found_texts, "hash").select("id", "text")

    def verify(t: pa.Table) -> pa.Table:
        t, sig, n, same = _sides(t)
        memo = WordHashes()
        sets = [shingles(x or "", words, memo) for x in t["text"].to_pylist()]
        length = np.array([len(s) for s in sets])
        ids, size = t["id"].to_numpy(), t["size"].to_numpy()
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for i, j in _blocks(sig, n, same, least):
            both = intersections(i, j, sets, sets)
            ok = both >= threshold * (length[i] + length[j] - both) - 1e-9
            i, j = i[ok], j[ok]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            forest.join(i, j)
        a, b = forest.edges()
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], ids[a]]), pa.int64()),
            "b": pa.array([None] * len(some) + ids[b].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]), pa.int64())})

    found = cut(alive.join(texts, "id").groupBy("pair").applyInArrow(verify, "a long, b long, links long"), "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("id"), "links")
    group = components(found.where("b is not null").select("a", "b")).select(F.col("a").alias("id"), F.col("b").alias("lead"))
    by_class = classes.select("key", "id", "first", "size").join(links, "id", "left").join(group, "id", "left").select(
        "key", "first", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lead", "id").alias("lead"))
    firsts = by_class.groupBy("lead").agg(F.min("first").alias("group_first"))
    named = by_class.join(firsts, "lead").select("key", "first", "n_links", "group_first")
    own = F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")
    return signed.select("doc_id", "row__", own).join(named, "key", "left").select(
        "doc_id", "row__", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_first")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each linked group, the smallest by doc_id and then by its own key; all columns as they are."""
    keyed = with_rows(docs)
    gone = _groups(keyed.select("doc_id", "text", "row__"), **options).where("group_first.row__ <> row__").select("row__")
    return keyed.join(gone, "row__", "left_anti").select(*docs.columns)
