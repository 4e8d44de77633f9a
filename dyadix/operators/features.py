"""Interval quantile features: exact by sorting, or approximate from four moments.

The plans give the same values: ``rowwise`` (array functions, no shuffle, no
Python), ``arrow`` (blocks of rows in NumPy, no shuffle), ``presort`` (the same with one
sort a series), ``auto`` (``mixed``: each batch chooses) and ``long`` (one row
per point, hash aggregates by interval or, for moments, by segment: for series that
arrive as rows). Features are an array per series, so a width of
tens of thousands is no trouble.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.functions import representations as R
from dyadix.functions.normal import expansion_terms
from dyadix.plans.layout import REPRESENTATIONS, approximated, feature_table, features, intervals, membership_table, representation_lengths, segments

FLOOR = 1e-12
BATCH_BYTES = 32 << 20  # points and features that a task holds at a time


def exact_block(z: np.ndarray, depth: int = 6, div: int = 4, lower_median: bool = False) -> np.ndarray:
    """(rows, features) for a block of one representation: each interval is sorted once for all rows."""
    n = z.shape[1]
    own: dict[int, list] = {}
    for f in features(n, depth, div, lower_median):
        own.setdefault(f.interval_id, []).append(f)
    out = []
    for iv in intervals(n, depth, lower_median):
        part = z[:, iv.start:iv.end]
        fs = own[iv.interval_id]
        if fs[0].kind == 0:
            out.append(part)
            continue
        ordered = np.sort(part, axis=1)
        place = np.array([f.q for f in fs]) * (iv.width - 1)
        low = np.floor(place).astype(int)
        rest = place - low
        a, b = ordered[:, low], ordered[:, np.minimum(low + 1, iv.width - 1)]
        value = np.where(rest >= 0.5, b - (b - a) * (1 - rest), a + (b - a) * rest)
        out.append(value - part.mean(1)[:, None] * np.array([f.centered for f in fs]))
    return np.concatenate(out, 1)


@lru_cache(1024)
def widths(length: int, depth: int, div: int, lower_median: bool):
    """The intervals of each width: (points of each, its quantiles, where their values go)."""
    own: dict[int, list] = {}
    for f in features(length, depth, div, lower_median):
        own.setdefault(f.interval_id, []).append(f)
    groups: dict[int, list] = {}
    for iv in intervals(length, depth, lower_median):
        groups.setdefault(iv.width, []).append(iv)
    return [(np.array([iv.start for iv in g])[:, None] + np.arange(w), own[g[0].interval_id], np.array([[f.feature_id for f in own[iv.interval_id]] for iv in g]))
            for w, g in groups.items()]


def width_block(z: np.ndarray, mode: str, depth: int = 6, div: int = 4, lower_median: bool = False) -> np.ndarray:
    """(rows, features) of one representation, all intervals of one width together."""
    out = np.empty((len(z), len(features(z.shape[1], depth, div, lower_median))))
    for points, fs, to in widths(z.shape[1], depth, div, lower_median):
        part = z[:, points]
        if fs[0].kind == 0:
            out[:, to[:, 0]] = part[:, :, 0]
            continue
        mean = part.mean(2, keepdims=True)
        if mode == "exact":
            ordered = np.sort(part, axis=2)
            place = np.array([f.q for f in fs]) * (points.shape[1] - 1)
            low = np.floor(place).astype(int)
            rest = place - low
            a, b = ordered[:, :, low], ordered[:, :, np.minimum(low + 1, points.shape[1] - 1)]
            value = np.where(rest >= 0.5, b - (b - a) * (1 - rest), a + (b - a) * rest)
        else:
            c = part - mean
            c2 = c * c
            var = c2.mean(2)
            skew = (c2 * c).mean(2) / (np.sqrt(np.maximum(var, FLOOR)) ** 3 + FLOOR)
            kurt = (c2 * c2).mean(2) / (var * var + FLOOR) - 3
            value = np.empty((*part.shape[:2], len(fs)))
            for k, f in enumerate(fs):
                if approximated(f):
                    t = expansion_terms(f.q)
                    value[:, :, k] = mean[:, :, 0] + np.sqrt(np.maximum(var, 0)) * (t[0] + t[1] * skew + t[2] * kurt - t[3] * skew * skew)
                else:
                    value[:, :, k] = part.max(2) if f.k else part.min(2)
        out[:, to] = value - mean * np.array([f.centered for f in fs])
    return out


def presorted_block(z: np.ndarray, depth: int = 6, div: int = 4, lower_median: bool = False) -> np.ndarray:
    """As exact_block, from one sort of each series: a stable partition of that order by bucket puts the points of every
    interval in order, level after level (edges nest; moved intervals part the whole order)."""
    own: dict[int, list] = {}
    for f in features(z.shape[1], depth, div, lower_median):
        own.setdefault(f.interval_id, []).append(f)
    levels: dict[tuple[int, bool], list] = {}
    for iv in intervals(z.shape[1], depth, lower_median):
        levels.setdefault((iv.depth, iv.shifted), []).append(iv)
    out = np.empty((len(z), sum(map(len, own.values()))))
    whole = nested = np.argsort(z, axis=1, kind="stable").astype(np.int32)
    for (_, shifted), ivs in levels.items():
        bucket = np.full(z.shape[1], len(ivs), np.int16)  # small numbers are parted by counting, not compared
        for i, iv in enumerate(ivs):
            bucket[iv.start:iv.end] = i
        order = whole if shifted else nested
        order = np.take_along_axis(order, np.argsort(bucket[order], axis=1, kind="stable"), 1)
        if not shifted:
            nested = order
        ordered = np.take_along_axis(z, order, 1)
        begin = np.cumsum([0] + [iv.width for iv in ivs])
        for width in {iv.width for iv in ivs}:
            mine = [i for i, iv in enumerate(ivs) if iv.width == width]
            fs = own[ivs[mine[0]].interval_id]
            part = ordered[:, begin[mine][:, None] + np.arange(width)]
            to = np.array([[f.feature_id for f in own[ivs[i].interval_id]] for i in mine])
            if fs[0].kind == 0:
                out[:, to[:, 0]] = part[:, :, 0]
                continue
            place = np.array([f.q for f in fs]) * (width - 1)
            low = np.floor(place).astype(int)
            rest = place - low
            a, b = part[:, :, low], part[:, :, np.minimum(low + 1, width - 1)]
            value = np.where(rest >= 0.5, b - (b - a) * (1 - rest), a + (b - a) * rest)
            out[:, to] = value - part.mean(2, keepdims=True) * np.array([f.centered for f in fs])
    return out


@lru_cache(256)
def _merges(length: int, depth: int) -> list[tuple]:
    """For each group of intervals that do not overlap: which they are, their segments, and the 0/1 matrix that adds segments up."""
    seg, out = segments(length, depth), []
    for ivs in seg.levels:
        first, last = seg.runs[ivs[0]][0], sum(seg.runs[ivs[-1]])
        held = np.zeros((len(ivs), last - first))
        for i, iv in enumerate(ivs):
            at, k = seg.runs[iv]
            held[i, at - first:at - first + k] = 1
        out.append((slice(ivs[0], ivs[-1] + 1), slice(first, last), held))
    return out


def _extremes(low: np.ndarray, high: np.ndarray, runs: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest over runs of rows, each from two stretches of a power of two rows."""
    first, k = np.array(runs).T
    level = np.frexp(k.astype(float))[1] - 1
    out = np.empty((len(k), low.shape[1])), np.empty((len(k), low.shape[1]))
    for j in range(level.max() + 1):
        own = np.flatnonzero(level == j)
        a, b = first[own], first[own] + k[own] - (1 << j)
        out[0][own], out[1][own] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        if len(low) > 1 << j:
            low, high = np.minimum(low[:-(1 << j)], low[1 << j:]), np.maximum(high[:-(1 << j)], high[1 << j:])
    return out


def moments_block(z: np.ndarray, depth: int = 6) -> dict[str, np.ndarray]:
    """mean, m2, m3, m4 (sums of powers about the mean), low and high of every interval, (intervals, rows) each, and their n.

    Each point is read once, into the moments of its segment about the segment's own mean; an interval's moments are
    merged from those of its segments, so large offsets lose no digits. Points go down and rows across."""
    seg = segments(z.shape[1], depth)
    y = np.ascontiguousarray(z.T)
    starts, widths = np.array(seg.starts), np.array(seg.widths)
    n = widths[:, None].astype(float)
    if len(starts) == len(y):  # every point is a segment
        mean = low = high = y
        m2 = m3 = m4 = np.zeros_like(y)
    else:
        mean = np.add.reduceat(y, starts) / n
        c = y - np.repeat(mean, widths, axis=0)
        c2 = c * c
        m2, m3, m4 = (np.add.reduceat(v, starts) for v in (c2, c2 * c, c2 * c2))
        low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    return _merged({"n": n, "mean": mean, "m2": m2, "m3": m3, "m4": m4, "low": low, "high": high}, z.shape[1], depth)


def _merged(of: dict[str, np.ndarray], length: int, depth: int) -> dict[str, np.ndarray]:
    """Moments of the intervals, (intervals, rows), from those of the segments, (segments, rows); n may be one column for all rows."""
    n, mean, m2, m3, m4 = (of[k] for k in ("n", "mean", "m2", "m3", "m4"))
    count = len(intervals(length, depth))
    out = {k: np.empty((count, mean.shape[1])) for k in ("mean", "m2", "m3", "m4")} | {"n": np.empty((count, n.shape[1]))}
    for own, s, held in _merges(length, depth):
        total = held @ n[s]
        together = held @ (n[s] * mean[s]) / np.maximum(total, 1)
        d = mean[s] - held.T @ together  # a segment of no interval here gets its own mean: it is in no sum
        nd = n[s] * d
        out["n"][own], out["mean"][own] = total, together
        out["m2"][own] = held @ (m2[s] + nd * d)
        out["m3"][own] = held @ (m3[s] + d * (3 * m2[s] + nd * d))
        out["m4"][own] = held @ (m4[s] + d * (4 * m3[s] + d * (6 * m2[s] + nd * d)))
    out["low"], out["high"] = _extremes(of["low"], of["high"], segments(length, depth).runs)
    return out


@lru_cache(256)
def _expanded(length: int, depth: int, div: int) -> tuple[np.ndarray, ...]:
    """Of every feature: its interval, its expansion terms, how it is found (0 mean, 1 least, 2 greatest, 3 expansion), and whether the mean goes off."""
    fs = features(length, depth, div)
    terms = np.array([expansion_terms(f.q) if approximated(f) else (0.0,) * 4 for f in fs])
    how = np.array([0 if f.kind == 0 else 3 if approximated(f) else 2 if f.k else 1 for f in fs])
    return np.array([f.interval_id for f in fs]), terms.T.copy(), how, np.array([f.centered for f in fs], float)


def approx_block(z: np.ndarray, depth: int = 6, div: int = 4) -> np.ndarray:
    """As exact_block, with interior quantiles from the moments of each interval: merged where segments hold several points, else read from the points."""
    if 2 * len(segments(z.shape[1], depth).starts) > z.shape[1]:
        return width_block(z, "approx", depth, div)
    at, t, how, centered = _expanded(z.shape[1], depth, div)
    m = moments_block(z, depth)
    var = m["m2"] / m["n"]
    spread = np.sqrt(np.maximum(var, 0))
    floored = np.sqrt(np.maximum(var, FLOOR))
    skew = m["m3"] / m["n"] / (floored * floored * floored + FLOOR)
    kurt = m["m4"] / m["n"] / (var * var + FLOOR) - 3
    own = np.flatnonzero(how == 3)
    iv, u = at[own], t[:, own, None]
    sk = skew[iv]
    value = np.empty((len(at), len(z)))
    value[own] = m["mean"][iv] + spread[iv] * (u[0] + u[1] * sk + u[2] * kurt[iv] - u[3] * sk * sk)
    for k, name in ((0, "mean"), (1, "low"), (2, "high")):
        own = np.flatnonzero(how == k)
        value[own] = m[name][at[own]]
    own = np.flatnonzero(centered)
    value[own] -= m["mean"][at[own]]
    return np.ascontiguousarray(value.T)


BLOCKS = {"exact": exact_block, "presort": presorted_block}


def _arrow(df: DataFrame, key: list[str], x: str, mode: str, length: int, names: tuple[str, ...], depth: int, div: int, lower_median: bool) -> DataFrame:
    def run(batches):
        rows = max(1, BATCH_BYTES // (8 * (width + length)))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            flat = batch[x].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != batch.num_rows * length or not np.isfinite(flat).all():
                raise ValueError(f"every series needs {length} finite points")
            made = R.blocks(flat.reshape(-1, length))
            parts = [approx_block(made[n], depth, div) if mode == "approx" else BLOCKS[mode](made[n], depth, div, lower_median) for n in names]
            both = np.concatenate(parts, 1)
            offsets = pa.array(np.arange(len(both) + 1) * both.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in key), pa.ListArray.from_arrays(offsets, pa.array(both.ravel()))], [*key, "features"])

    kept = df.select(*key, x)
    lengths = representation_lengths(length)
    width = sum(len(features(lengths[n], depth, div, lower_median)) for n in names)
    schema = ", ".join(f"{k} {t}" for k, t in kept.dtypes if k != x)
    return kept.mapInArrow(run, f"{schema}, features array<double>")


def _rowwise(y: Column, n: int, mode: str, depth: int, div: int) -> Column:
    """The features of one representation as array expressions over literal layout arrays."""
    ivs, fs = intervals(n, depth), features(n, depth, div)
    start, width = F.lit([iv.start + 1 for iv in ivs]), F.lit([iv.width for iv in ivs])

    def parts(series: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(ivs) - 1)), lambda i: _interval(F.slice(series, F.get(start, i), F.get(width, i)), mode))

    lit = lambda values: F.lit(list(values))
    at, centered = lit(f.interval_id for f in fs), lit(float(f.centered) for f in fs)
    if mode == "exact":
        place = [f.q * (f.width - 1) for f in fs]
        low, rest = lit(int(p) for p in place), lit(p - int(p) for p in place)
        high = lit(min(int(p) + 1, f.width - 1) for p, f in zip(place, fs, strict=True))

        def value(k: Column, iv: Column) -> Column:
            a, b, r = F.get(iv["ordered"], F.get(low, k)), F.get(iv["ordered"], F.get(high, k)), F.get(rest, k)
            return F.when(r >= 0.5, b - (b - a) * (1 - r)).otherwise(a + (b - a) * r) - F.get(centered, k) * iv["mean"]
    else:
        terms = [expansion_terms(f.q) if approximated(f) else (0.0, 0.0, 0.0, 0.0) for f in fs]
        t = [lit(x[i] for x in terms) for i in range(4)]
        how = lit(0 if f.kind == 0 else 3 if approximated(f) else 2 if f.k else 1 for f in fs)

        def value(k: Column, iv: Column) -> Column:
            h = F.get(how, k)
            cf = iv["mean"] + F.sqrt(F.greatest(iv["var"], F.lit(0.0))) * (
                F.get(t[0], k) + F.get(t[1], k) * iv["skew"] + F.get(t[2], k) * iv["kurt"] - F.get(t[3], k) * iv["skew"] * iv["skew"])
            return F.when(h == 0, iv["mean"]).when(h == 1, iv["low"]).when(h == 2, iv["high"]).otherwise(cf) - F.get(centered, k) * iv["mean"]

    every = F.sequence(F.lit(0), F.lit(len(fs) - 1))
    return R.once(y, lambda s: R.once(parts(s), lambda p: F.transform(every, lambda k: R.once(F.get(p, F.get(at, k)), lambda iv: value(k, iv)))))


def _interval(part: Column, mode: str) -> Column:
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    if mode == "exact":
        return R.once(part, lambda p: F.struct(F.sort_array(p).alias("ordered"), (total(p) / F.size(p)).alias("mean")))

    def moments(p: Column, c: Column) -> Column:
        def add(acc: Column, v: Column) -> Column:
            d = v - c
            return F.struct((acc["m2"] + d * d).alias("m2"), (acc["m3"] + d * d * d).alias("m3"), (acc["m4"] + d * d * d * d).alias("m4"))

        n = F.size(p)
        zero = F.struct(*[F.lit(0.0).alias(f"m{k}") for k in (2, 3, 4)])
        return F.aggregate(p, zero, add, lambda a: F.struct(
            c.alias("mean"), (a["m2"] / n).alias("m2"), (a["m3"] / n).alias("m3"), (a["m4"] / n).alias("m4"), F.array_min(p).alias("low"), F.array_max(p).alias("high")))

    return R.once(R.once(part, lambda p: R.once(total(p) / F.size(p), lambda c: moments(p, c))), lambda m: F.struct(
        m["mean"].alias("mean"), m["m2"].alias("var"),
        (m["m3"] / (F.pow(F.sqrt(F.greatest(m["m2"], F.lit(FLOOR))), F.lit(3)) + FLOOR)).alias("skew"),
        (m["m4"] / (m["m2"] * m["m2"] + FLOOR) - 3).alias("kurt"), m["low"].alias("low"), m["high"].alias("high")))


def interval_features(df: DataFrame, key: list[str], x: str, length: int, mode: str = "exact", names: tuple[str, ...] = REPRESENTATIONS,
                      strategy: str = "arrow", depth: int = 6, div: int = 4, lower_median: bool = False) -> DataFrame:
    """``df`` -> (key, features array<double>): the named representations' features one after another."""
    if mode not in ("exact", "approx"):
        raise ValueError(f"mode is exact or approx, not {mode!r}")
    lengths = representation_lengths(length)
    if strategy == "auto":  # by the size of each batch, inside the job
        from dyadix.operators.mixed import features_by_length

        x_ok = df.withColumn(x, F.when(F.size(x) == length, F.col(x)).otherwise(F.raise_error(F.lit(f"every series needs {length} finite points"))))
        return features_by_length(x_ok, key, x, mode, names, depth=depth, div=div, lower_median=lower_median).select(*key, "features")
    if strategy == "arrow":
        return _arrow(df, key, x, mode, length, names, depth, div, lower_median)
    if strategy == "presort":
        if mode != "exact":
            raise ValueError("only exact quantiles need an order")
        return _arrow(df, key, x, "presort", length, names, depth, div, lower_median)
    if lower_median:
        raise ValueError("the baseline layout is there in the arrow, presort and auto plans only")
    if strategy == "long":
        return _long(df, key, x, mode, length, names, depth, div)
    if strategy != "rowwise":
        raise ValueError(f"strategy is auto, arrow, presort, rowwise or long, not {strategy!r}")
    out = df.select(*key, F.col(x).alias("__x"))
    for name in names:
        y = R.fft_abs_sql(F.col("__x"), length) if name == "fft_abs" else R.COLUMNS[name](F.col("__x"))
        out = out.withColumn(f"__{name}", _rowwise(y, lengths[name], mode, depth, div))
    return out.select(*key, F.concat(*[F.col(f"__{n}") for n in names]).alias("features"))


MOMENTS = ("n", "mean", "m2", "m3", "m4", "low", "high")


def segment_moments(points: DataFrame, key: list[str], length: int, depth: int = 6) -> DataFrame:
    """``points(key, t, y)``, a stream or not -> (key, segment, *MOMENTS): a point belongs to one segment, found in a literal
    array, and the engine's central-moment aggregates keep and merge the moments. On a stream they are the state."""
    of = [i for i, w in enumerate(segments(length, depth).widths) for _ in range(w)]
    held = points.select(*key, F.get(F.lit(of), F.col("t").cast("int")).alias("segment"), F.col("y").cast("double").alias("y"))
    agg = held.groupBy(*key, "segment").agg(
        F.count("y").cast("double").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"), F.skewness("y").alias("sk"), F.kurtosis("y").alias("ku"),
        F.min("y").alias("low"), F.max("y").alias("high"))
    # the built-ins are null on constant parts
    return agg.select(*key, "segment", "n", "mean", (F.col("var") * F.col("n")).alias("m2"),
                      F.coalesce(F.col("sk") * F.pow("var", F.lit(1.5)) * F.col("n"), F.lit(0.0)).alias("m3"),
                      F.coalesce((F.col("ku") + 3) * F.col("var") * F.col("var") * F.col("n"), F.lit(0.0)).alias("m4"), "low", "high")


def interval_moments(states: DataFrame, key: list[str], length: int, depth: int = 6) -> DataFrame:
    """``states`` of a series' segments -> (key, interval_id, n, mean, var, m3, m4, low, high) of every interval, merged from its segments.

    A segment without points may be missing; an interval without any has n = 0 and nulls."""
    count, ivs = len(segments(length, depth).widths), len(intervals(length, depth))
    parts = states.groupBy(*key).agg(F.collect_list(F.struct("segment", *MOMENTS)).alias("p"))  # a few for each of the finest intervals
    parts = parts.select(*key, *[F.col(f"p.{c}").alias(c) for c in ("segment", *MOMENTS)])
    schema = "".join(f"`{k}` {t}, " for k, t in parts.dtypes[:len(key)])

    def run(batches):
        rows = max(1, BATCH_BYTES // (8 * 7 * (count + ivs)))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            at = np.repeat(np.arange(batch.num_rows), np.diff(batch["segment"].offsets.to_numpy()))
            seg = batch["segment"].flatten().to_numpy()
            of = {}
            for c in MOMENTS:
                of[c] = np.full((count, batch.num_rows), {"low": np.inf, "high": -np.inf}.get(c, 0.0))
                of[c][seg, at] = batch[c].flatten().to_numpy(zero_copy_only=False)
            m = _merged(of, length, depth)
            n = m["n"].T.ravel()
            own = pa.array(np.repeat(np.arange(batch.num_rows), ivs))
            none = n == 0
            columns = [m["mean"], *(m[c] / np.maximum(m["n"], 1) for c in ("m2", "m3", "m4")), m["low"], m["high"]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k].take(own) for k in key), pa.array(np.tile(np.arange(ivs, dtype=np.int32), batch.num_rows)), pa.array(n.astype(np.int64)),
                 *(pa.array(v.T.ravel(), mask=none) for v in columns)], [*key, "interval_id", "n", "mean", "var", "m3", "m4", "low", "high"])

    return parts.mapInArrow(run, schema + "interval_id int, n long, mean double, var double, m3 double, m4 double, low double, high double")


def moments_long(points: DataFrame, key: list[str], length: int, depth: int = 6) -> DataFrame:
    """``points(key, t, y)`` of one representation -> (key, interval_id, n, mean, var, m3, m4, low, high).

    Every point is read once, into its segment's moments (a combined hash aggregate); a series' segments, at most four for each of the finest
    intervals, are then merged into all intervals."""
    return interval_moments(segment_moments(points, key, length, depth), key, length, depth)


def _long(df, key, x, mode, length, names, depth, div):
    spark, out = df.sparkSession, None
    table = feature_table(spark, length, depth, div)
    for at, name in enumerate(names):
        n = representation_lengths(length)[name]
        y = R.fft_abs_sql(F.col(x), length) if name == "fft_abs" else R.COLUMNS[name](F.col(x))
        points = df.select(*key, F.posexplode(y).alias("t", "y"))
        own = F.broadcast(table.where(F.col("repr") == name).drop("repr"))
        if mode == "exact":
            held = points.join(F.broadcast(membership_table(spark, n, depth)), "t").groupBy(*key, "interval_id").agg(
                F.sort_array(F.collect_list("y")).alias("ordered"), F.avg("y").alias("mean"))
            f = held.join(own, "interval_id")
            place = F.col("q") * (F.col("m") - 1)
            low = F.floor(place).cast("int")
            a, b = F.get("ordered", low), F.get("ordered", F.least(low + 1, F.col("m") - 1))
            r = place - low
            value = F.when(r >= 0.5, b - (b - a) * (1 - r)).otherwise(a + (b - a) * r)
        else:
            f = moments_long(points, key, n, depth).join(own, "interval_id")
            skew = F.col("m3") / (F.pow(F.sqrt(F.greatest("var", F.lit(FLOOR))), F.lit(3)) + FLOOR)
            kurt = F.col("m4") / (F.col("var") * F.col("var") + FLOOR) - 3
            cf = F.col("mean") + F.sqrt(F.greatest("var", F.lit(0.0))) * (F.col("z") + F.col("c2") * skew + F.col("c3") * kurt - F.col("c4") * skew * skew)
            value = F.when(F.col("kind") == 0, F.col("mean")).when((F.col("kind") == 2) & (F.col("k") == 0), F.col("low")).when(
                (F.col("kind") == 2) & (F.col("k") == F.col("nq") - 1), F.col("high")).otherwise(cf)
        rows = f.select(*key, F.struct(F.lit(at).alias("at"), "feature_id", (value - F.when(F.col("centered"), F.col("mean")).otherwise(0.0)).alias("value")).alias("f"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list("f")), lambda s: s["value"]).alias("features"))


def join_channels(df: DataFrame, key: str, channel: str, length: int, names: tuple[str, ...] = REPRESENTATIONS, depth: int = 6, div: int = 4) -> DataFrame:
    """Per-channel (key, channel, features) -> (key, features), channels side by side inside each interval."""
    order, base = [], 0
    for name in names:
        fs = features(representation_lengths(length)[name], depth, div)
        order += [(base + f.interval_id, f.k) for f in fs]
        base += len(intervals(representation_lengths(length)[name], depth))
    iv, k = F.lit([o[0] for o in order]), F.lit([o[1] for o in order])
    rows = df.select(key, F.transform("features", lambda v, i: F.struct(
        F.get(iv, i).alias("iv"), F.col(channel).alias("channel"), F.get(k, i).alias("k"), v.alias("value"))).alias("f"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.flatten(F.collect_list("f"))), lambda s: s["value"]).alias("features"))


def channel_order(length: int, channels: int, names: tuple[str, ...] = REPRESENTATIONS, depth: int = 6, div: int = 4) -> np.ndarray:
    """Where each output feature of ``channels`` channels, side by side inside each interval, stands among the channels' features one after another."""
    place, base = [], 0
    for name in names:
        fs = features(representation_lengths(length)[name], depth, div)
        place += [(base + f.interval_id, f.k) for f in fs]
        base += len(intervals(representation_lengths(length)[name], depth))
    every = [(iv, c, k, c * len(place) + at) for c in range(channels) for at, (iv, k) in enumerate(place)]
    return np.array([e[3] for e in sorted(every)])


def channel_features(df: DataFrame, key: list[str], channels: list[str], length: int, mode: str = "exact",
                     names: tuple[str, ...] = REPRESENTATIONS, depth: int = 6, div: int = 4) -> DataFrame:
    """(*key, features) of series with a column for each channel: one narrow pass, the channels side by side inside each interval."""
    order = channel_order(length, len(channels), names, depth, div)

    def run(batches):
        rows = max(1, BATCH_BYTES // (8 * (len(order) + len(channels) * length)))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            parts = []
            for c in channels:
                flat = batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) != batch.num_rows * length or not np.isfinite(flat).all():
                    raise ValueError(f"every channel needs {length} finite points")
                made = R.blocks(flat.reshape(-1, length))
                parts += [exact_block(made[n], depth, div) if mode == "exact" else approx_block(made[n], depth, div) for n in names]
            both = np.concatenate(parts, 1)[:, order]
            offsets = pa.array(np.arange(len(both) + 1) * both.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in key), pa.ListArray.from_arrays(offsets, pa.array(both.ravel()))], [*key, "features"])

    kept = df.select(*key, *channels)
    schema = "".join(f"`{k}` {t}, " for k, t in kept.dtypes[:len(key)])
    return kept.mapInArrow(run, f"{schema}features array<double>")


def as_rows(df: DataFrame, key: list[str], digits: int = 6) -> DataFrame:
    """(key, feature_idx, value), rounded for comparison across engines."""
    return df.select(*key, F.posexplode("features").alias("feature_idx", "value")).withColumn("value", F.round("value", digits) + F.lit(0.0))
