"""Periodic runs of words by the harmonic grid.

A run is a stretch of words that keeps its smallest period q (words q apart are the
same), is at least ``max(least, times * q)`` words long and cannot grow. For each
period p the grid asks, at every multiple j * p of a text, how far the words from
j * p and from (j + 1) * p agree forward and backward. The answers (longest common
extensions) are range minima over the LCP array of a suffix array, forward and of
the reversed words. A run of period p holds two neighbouring multiples of p, so the
grid finds it; n / 1 + n / 2 + ... questions are n log n. A stretch that the grid
finds for several periods belongs to the smallest: it is maximal for that one too.

Words are runs of other bytes than space, tab, line feed, vertical tab, form feed
and carriage return, and equal when their bytes are. Texts are taken in chunks of
CHUNK words, so that NumPy's calls are shared by many short texts; words of different
texts never agree. A text is never cut: memory is some 200 bytes a word of the larger
of a chunk and a text.

Defined cases: a null or empty text has no words and no runs, and its collapsed text
is empty; repeated rows and null ids are rows of their own; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 200_000
QUESTIONS = 1 << 20  # grid points that are asked about in one go
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, best int, n_words bigint, collapsed string"


class Extensions:
    """Longest common extensions to the right between places of an integer array."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        # ranks[l]: order of the stretches of 2**l words from each place, shorter ones at the end first
        rank = np.unique(words, return_inverse=True)[1].astype(np.int32)
        ranks, order, width = [rank], np.argsort(rank, kind="stable").astype(np.int32), 1
        while n > 1:
            rank = ranks[-1]
            sorted_rank = rank[order]
            alone = np.ones(n, bool)
            same = sorted_rank[1:] == sorted_rank[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            if alone.all():
                break
            # only places that share their rank move, and only among themselves
            at = np.nonzero(~alone)[0]
            places = order[at]
            follow = np.full(len(at), -1, np.int64)
            inside = places + width < n
            follow[inside] = rank[places[inside] + width]
            key = sorted_rank[at].astype(np.int64) * (n + 1) + follow + 1
            moved = np.argsort(key, kind="stable")
            order[at] = places[moved]
            key = key[moved]
            new = np.ones(n, bool)
            new[1:] = ~same
            new[at[1:]] |= key[1:] != key[:-1]
            # a rank is the number of its first place in the order
            fresh = np.empty(n, np.int32)
            fresh[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
            ranks.append(fresh)
            width *= 2
        self.place = np.empty(n, np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)
        # LCP of neighbours in the order: from the longest stretches that agree to the shortest
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        lcp = np.zeros(max(n - 1, 0), np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            at = np.nonzero((a < n) & (b < n))[0]
            at = at[ranks[level][a[at]] == ranks[level][b[at]]]
            # equal ranks mean equal stretches, all of 2**level words: the last ones' ranks differ by their ends
            a[at] += 1 << level
            b[at] += 1 << level
            lcp[at] += 1 << level
        del ranks
        self.minima = [lcp]
        while 2 << len(self.minima) - 1 <= len(lcp):
            half, last = 1 << len(self.minima) - 1, self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on (i and j differ)."""
        i, j = self.place[i], self.place[j]
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for l in np.unique(level):
            own = level == l
            m = self.minima[l]
            out[own] = np.minimum(m[low[own]], m[high[own] - (1 << l)])
        return out


def grid(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p): places i of the grid of period p whose word is also at i + p, in portions of bounded size."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    held, count = [], 0
    for p in range(1, int(sizes[0]) // times + 1 if len(sizes) else 0):
        texts = np.searchsorted(-sizes, -times * p, side="right")  # those that are long enough
        points = (sizes[:texts] - 1) // p
        ends = np.cumsum(points)
        i = np.repeat(starts[:texts] - (ends - points) * p, points) + p * np.arange(ends[-1])
        i = i[words[i] == words[i + p]]
        if len(i):
            held.append((i, np.full(len(i), p, np.int64)))
            count += len(i)
        if count >= QUESTIONS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def find_runs(texts: list[list[int]], least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and then period; places count through all texts.

    ``texts`` have words as numbers from 0 on, the same number for the same word."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([np.asarray(t, np.int64) for t in texts if t])
    words += np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1)  # texts share no word
    asked = list(grid(words, starts, sizes, times))
    if not asked:
        return none, none, none
    ahead = Extensions(words)
    forward = [ahead.between(i, i + p) for i, p in asked]
    del ahead
    back = Extensions(words[::-1])
    found = []
    for (i, p), f in zip(asked, forward, strict=True):
        # the words before i and before i + p; at the first word there are none
        b = np.zeros(len(i), np.int64)
        some = i > 0
        b[some] = back.between(n - i[some], n - i[some] - p[some])
        start, end = i - b, i + p + f
        good = end - start >= np.maximum(least, times * p)
        found.append(np.stack([start[good], end[good], p[good]]))
    start, end, period = np.concatenate(found, 1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of each stretch
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def best_run(runs: list[tuple[int, int, int]]) -> int | None:
    """The first run, by start and period, with the greatest exact length / period."""
    best = None
    for k, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


def analysed(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """(runs, collapsed text) of each text; a run is (start, length, period)."""
    numbers: dict[bytes, int] = {}
    start, end, period = find_runs([[numbers.setdefault(w, len(numbers)) for w in t] for t in texts], least, times)
    at = np.cumsum([0, *(len(t) for t in texts)])
    cuts = np.searchsorted(start, at)
    for k, t in enumerate(texts):
        own = slice(cuts[k], cuts[k + 1])
        s, e, q = start[own] - at[k], end[own] - at[k], period[own]
        kept = t
        if len(s):
            edge = np.zeros(len(t) + 1, np.int64)
            np.add.at(edge, s + q, 1)
            np.add.at(edge, e, -1)
            kept = [t[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0]]
        yield list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)), b" ".join(kept).decode(errors="replace")


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of its texts) for runs of rows of about CHUNK words, or of one larger text."""
    first, held, count = 0, [], 0
    for k, value in enumerate(batch[text]):
        words = (value.as_py() or b"").split()  # bytes split at the six white characters
        if held and count + len(words) > CHUNK:
            yield first, held
            first, held, count = k, [], 0
        held.append(words)
        count += len(words)
    if held:
        yield first, held


def periodic_runs(docs: DataFrame, key: list[str], text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(*key, runs, best, n_words, collapsed) for every row of ``docs``: its runs by start and then period, the number
    of the one with the greatest length / period, and the words outside the runs' repetitions (all that a run holds after
    its first period goes), joined by one space. One narrow pass, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(*key, F.col(text).cast("binary").alias(text))
    ddl = "".join(f"`{c}` {kind}, " for c, kind in rows.dtypes[:-1]) + RUNS
    fields = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(RUNS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch, text):
                out = [(runs, best_run(runs), len(t), collapsed) for t, (runs, collapsed) in zip(texts, analysed(texts, least, times), strict=True)]
                own = [batch[c].slice(first, len(texts)) for c in key]
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in o[0]] for o in out]
                columns = [pa.array(v, kind) for v, kind in zip([runs, *([o[j] for o in out] for j in (1, 2, 3))], fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *columns], [*key, *fields])

    return rows.mapInArrow(run, ddl)


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """Where 10 divides h = crc32(doc_id): words from place a on become periodic repeats of the first of them,
    a = floor(h / 10) mod n, period 1 + floor((n - a) / (3 + floor(h / 10) mod 8)); else the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p)))), " ")

    apart = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bound = F.get(F.transform(F.array(apart), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, bound).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of ``docs`` with planted periods: counts, the best run and digests."""
    planted = docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.get("runs", F.col("best"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return periodic_runs(planted, ["doc_id"]).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
