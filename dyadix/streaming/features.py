"""The fitted transform on a stream: each row has its own series, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.operators.features import segment_moments


def stream_features(stream: DataFrame, model) -> DataFrame:
    return model.transform(stream)


def stream_moments(points: DataFrame, key: list[str], length: int, depth: int = 6) -> DataFrame:
    """A stream of ``points(key, t, y)`` -> each series' segment moments so far, in update or complete mode: the state is the merged
    moments, a few dozen rows a series whatever the number of points. ``features.interval_moments`` makes intervals of what it has written."""
    return segment_moments(points, key, length, depth)


def windowed_series(events: DataFrame, key: str, ts: str, value: str, window: str, late: str, length: int) -> DataFrame:
    """Event rows -> (key, window, block, x): the events of each key and tumbling window in order of time, cut into
    consecutive series of ``length`` points; the last one repeats its last value up to that length.

    Late events within ``late`` still count; the state of a window is dropped after that. No event is left out."""
    rows = events.withWatermark(ts, late).groupBy(key, F.window(ts, window)).agg(F.sort_array(F.collect_list(F.struct(ts, value))).alias("points"))
    cut = rows.select(key, "window", "points", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(points) - 1) div {length} as int)"))).alias("block"))
    own = F.transform(F.slice("points", F.col("block") * length + 1, length), lambda p: p[value].cast("double"))
    return cut.select(key, "window", "block", padded(own, length).alias("x"))


def padded(x: Column, length: int) -> Column:
    """A series of at least one point with its last value repeated up to ``length``."""
    return F.concat(x, F.array_repeat(F.element_at(x, -1), F.lit(length) - F.size(x)))
