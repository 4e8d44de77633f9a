"""Dyadic intervals and the quantiles that each emits: small tables made from (length, depth, div) alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from statistics import median, median_low

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadix.functions.normal import expansion_terms

REPRESENTATIONS = ("raw", "diff1_smooth", "diff2", "fft_abs")


def representation_lengths(length: int) -> dict[str, int]:
    if length < 3:
        raise ValueError(f"a series needs at least 3 points, not {length}")
    return dict(zip(REPRESENTATIONS, (length, length - 1, length - 2, length // 2 + 1), strict=True))


@dataclass(frozen=True)
class Interval:
    interval_id: int
    depth: int
    shifted: bool
    start: int
    end: int

    @property
    def width(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class Feature:
    feature_id: int
    interval_id: int
    k: int
    nq: int
    width: int
    q: float
    centered: bool
    kind: int  # 0: the point itself, 1: the median, 2: evenly spaced quantiles


@lru_cache(256)
def intervals(length: int, depth: int = 6, lower_median: bool = False) -> tuple[Interval, ...]:
    """Every level's intervals, then (where the median width is over 1) all but one of them moved by half a width.

    lower_median takes the lower of two middle widths, as the baseline variants do."""
    middle = median_low if lower_median else median
    out: list[Interval] = []
    for level in range(min(depth, length.bit_length())):
        n = 1 << level
        edges = [i * length // n for i in range(n + 1)]
        own = list(zip(edges, edges[1:], strict=False))
        if n > 1 and middle([e - s for s, e in own]) > 1:
            step = -(-length // (2 * n))
            moved = [(s + step, e + step) for s, e in own[:-1]]
        else:
            moved = []
        for shifted, group in ((False, own), (True, moved)):
            out += [Interval(len(out) + i, level, shifted, s, e) for i, (s, e) in enumerate(group)]
    return tuple(out)


@lru_cache(256)
def features(length: int, depth: int = 6, div: int = 4, lower_median: bool = False) -> tuple[Feature, ...]:
    out: list[Feature] = []
    for iv in intervals(length, depth, lower_median):
        nq = 1 + (iv.width - 1) // div
        kind = 0 if iv.width == 1 else 1 if nq == 1 else 2
        for k in range(nq):
            q = 0.5 if nq == 1 else k / (nq - 1)
            out.append(Feature(len(out), iv.interval_id, k, nq, iv.width, q, kind == 2 and k % 2 == 1, kind))
    return tuple(out)


@dataclass(frozen=True)
class Segments:
    """The pieces between all edges of the intervals: every interval is a run of them, and a point is in one."""

    starts: tuple[int, ...]
    widths: tuple[int, ...]
    runs: tuple[tuple[int, int], ...]  # first segment and number of segments of each interval
    levels: tuple[tuple[int, ...], ...]  # intervals that do not overlap, in order: one group for each level, and for each level's moved copies


@lru_cache(256)
def segments(length: int, depth: int = 6) -> Segments:
    ivs = intervals(length, depth)
    edges = sorted({e for iv in ivs for e in (iv.start, iv.end)})
    at = {e: i for i, e in enumerate(edges)}
    groups: dict[tuple[int, bool], list[int]] = {}
    for iv in ivs:
        groups.setdefault((iv.depth, iv.shifted), []).append(iv.interval_id)
    return Segments(tuple(edges[:-1]), tuple(b - a for a, b in zip(edges, edges[1:], strict=False)),
                    tuple((at[iv.start], at[iv.end] - at[iv.start]) for iv in ivs), tuple(map(tuple, groups.values())))


def approximated(f: Feature) -> bool:
    """Whether the expansion gives the value; ends of kind 2 and single points are exact."""
    return f.kind == 1 or f.kind == 2 and 0 < f.k < f.nq - 1


def feature_names(length: int, mode: str, depth: int = 6, div: int = 4, channels: int = 1) -> list[str]:
    """One name per output feature, in output order (not always unique: positions are cut to two digits)."""
    names = []
    for name, n in representation_lengths(length).items():
        own: dict[int, list[Feature]] = {}
        for f in features(n, depth, div):
            own.setdefault(f.interval_id, []).append(f)
        for iv in intervals(n, depth):
            for c in range(channels):
                for f in own[iv.interval_id]:
                    tag = "raw" if f.kind == 0 else f"q{f.q:.2f}" + "_centered" * f.centered
                    names.append(f"{name}{f'_ch{c}' if channels > 1 else ''}_iv[{iv.start}:{iv.end}]_d{iv.depth}_{tag}_{mode}")
    return names


def interval_table(spark: SparkSession, length: int, depth: int = 6, lower_median: bool = False) -> DataFrame:
    """The same intervals made in the engine: (interval_id, depth, shifted, s, e, m)."""
    levels = spark.range(min(depth, length.bit_length())).select(F.col("id").cast("int").alias("depth"))
    base = levels.select("depth", F.expr("shiftleft(1L, depth)").alias("n")).select(
        "depth", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(
        "depth", "n", "i", F.expr(f"(i * {length}) div n").alias("s"), F.expr(f"((i + 1) * {length}) div n").alias("e"))
    rule = F.expr("percentile_disc(0.5) within group (order by e - s)") if lower_median else F.expr("percentile(e - s, 0.5)")
    wide = base.groupBy("depth").agg(rule.alias("middle"))
    step = F.expr(f"({length} + 2 * n - 1) div (2 * n)")
    moved = base.join(F.broadcast(wide), "depth").where("n > 1 and middle > 1 and i < n - 1").select(
        "depth", F.lit(True).alias("shifted"), "i", (F.col("s") + step).alias("s"), (F.col("e") + step).alias("e"))
    both = base.select("depth", F.lit(False).alias("shifted"), "i", "s", "e").unionByName(moved)
    order = F.expr("row_number() over (order by depth, shifted, i)").cast("long") - 1
    return both.select(order.alias("interval_id"), "depth", "shifted", "s", "e", (F.col("e") - F.col("s")).alias("m"))


def quantile_table(spark: SparkSession, length: int, depth: int = 6, div: int = 4) -> DataFrame:
    """(interval_id, k, nq, m, kind, q, centered): the quantiles of every interval, made in the engine."""
    iv = interval_table(spark, length, depth).select("interval_id", "m", F.expr(f"1 + (m - 1) div {div}").alias("nq"))
    return iv.select("interval_id", "m", "nq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("k")).select(
        "interval_id", "k", "nq", "m",
        F.expr("case when m = 1 then 0 when nq = 1 then 1 else 2 end").alias("kind"),
        F.expr("case when nq = 1 then 0.5D else k / (nq - 1) end").alias("q"),
        F.expr("nq > 1 and k % 2 = 1").alias("centered"))


def feature_table(spark: SparkSession, length: int, depth: int = 6, div: int = 4) -> DataFrame:
    """Every feature of all representations with its expansion terms: a few rows per point, fit for a broadcast."""
    rows = []
    for name, n in representation_lengths(length).items():
        for f in features(n, depth, div):
            z, c2, c3, c4 = expansion_terms(f.q) if approximated(f) else (0.0, 0.0, 0.0, 0.0)
            rows.append((name, f.feature_id, f.interval_id, f.k, f.nq, f.width, f.q, f.centered, f.kind, z, c2, c3, c4))
    return spark.createDataFrame(
        rows, "repr string, feature_id int, interval_id int, k int, nq int, m int, q double, centered boolean, kind int, z double, c2 double, c3 double, c4 double")


def membership_table(spark: SparkSession, length: int, depth: int = 6) -> DataFrame:
    """(t, interval_id): which intervals hold a point. Joins on t instead of a range."""
    return spark.createDataFrame(
        [(t, iv.interval_id) for iv in intervals(length, depth) for t in range(iv.start, iv.end)], "t int, interval_id int")
