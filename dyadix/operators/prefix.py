"""Running sums over an order without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadix.sources.shared import written


def running_before(df: DataFrame, keys: list[str], order: str, value: str, out: str, slices: int = 64) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows of smaller ``order``; ``order`` is unique within a group.

    Approximate quantiles cut each group's order into at most ``slices`` + 1
    slices; the slices' sums are added up over a few rows per group, and windows
    run inside (group, slice), so a group that holds all rows is many tasks."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, F.lit([k / slices for k in range(1, slices)]), F.lit(10_000)).alias("__cuts"))
    one = [] if keys else ["__one"]
    group = keys or one
    if one:  # a single row of cuts
        df, cuts = df.withColumn("__one", F.lit(1)), F.broadcast(cuts.withColumn("__one", F.lit(1)))
    cut = df.join(cuts, group).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")
    sums = cut.groupBy(*group, "__slice").agg(F.sum(value).alias("__in"))
    below = F.sum("__in").over(Window.partitionBy(*group).orderBy("__slice")) - F.col("__in")
    starts = sums.select(*group, "__slice", below.alias("__below"))
    inside = F.sum(value).over(Window.partitionBy(*group, "__slice").orderBy(order)) - F.col(value)
    return cut.join(starts, [*group, "__slice"]).withColumn(out, F.col("__below") + inside).drop("__slice", "__below", *one)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, few: int = 1 << 16) -> DataFrame:
    """Add ``out``: a row's number from 0 within its group, by ``order`` (unique within a group).

    Rows are dealt by ranges of (keys, order) and written, so that a group of any size is many tasks and its ranges stay
    the same. Where a group starts in a partition follows from counts, one for each partition and each
    group in it; up to ``few`` of them are broadcast."""
    ranked = written(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    starts = ranked.groupBy(*keys, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    if shifts.count() <= few:
        shifts = F.broadcast(shifts)
    same = part == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = ranked.join(shifts, same)
    return joined.withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__of", "__shift", *[f"__k{i}" for i in range(len(keys))])
