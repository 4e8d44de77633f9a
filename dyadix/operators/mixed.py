"""Features of series of many lengths in one pass, with the plan chosen block by block.

A batch of rows is parted by length; each part gets the layout of its length (made
once in a task) and the plan that pays for its size: interval by interval, each for all series of the part
(``intervals``: few passes over much data), or all intervals of one width of a
series at once (``samples``: a tenth of the calls, for parts of few points). Both
give the same features. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.functions import representations as R
from dyadix.operators.features import BATCH_BYTES, approx_block, exact_block, width_block
from dyadix.plans import dispatch
from dyadix.plans.layout import REPRESENTATIONS, features, representation_lengths

PLANS = ("samples", "intervals")


def work_of(mode: str, n: Column, length: Column) -> Column:
    """The size that is held against a threshold: points, times the sorting of a point in exact mode."""
    return n * length * (F.lit(1.0) if mode == "approx" else F.log2(length) - 2.5)


def planned(df: DataFrame, dataset: str, x: str, mode: str, threshold: float | None = None, most_sets: int = 1 << 16) -> DataFrame:
    """``df`` with ``plan``: by the number of series of the row's data set and length.

    Sizes are a combined count. Their table is broadcast when it has at most ``most_sets`` rows, so that a data
    set of a third of all rows is not gathered for it."""
    limit = dispatch.threshold(mode) if threshold is None else threshold
    sized = df.withColumn("__length", F.size(x))
    sizes = sized.groupBy(F.col(dataset).alias("__set"), F.col("__length").alias("__of")).agg(F.count("*").alias("__n"))
    if sizes.count() <= most_sets:
        sizes = F.broadcast(sizes)
    joined = sized.join(sizes, F.col(dataset).eqNullSafe(F.col("__set")) & (F.col("__length") == F.col("__of")), "left")
    return joined.withColumn("plan", F.when(work_of(mode, F.col("__n"), F.col("__length")) > limit, "intervals").otherwise("samples")).drop("__set", "__of", "__n", "__length")


def block_features(z: np.ndarray, mode: str, names: tuple[str, ...], depth: int, div: int, lower_median: bool, plan: str) -> np.ndarray:
    """(rows, features) of series of one length by either plan."""
    made = R.blocks(z)
    if plan == "samples":
        return np.concatenate([width_block(made[n], mode, depth, div, lower_median) for n in names], 1)
    return np.concatenate([exact_block(made[n], depth, div, lower_median) if mode == "exact" else approx_block(made[n], depth, div) for n in names], 1)


def batch_plan(mode: str, n: int, length: int, limit: float) -> str:
    return "intervals" if n * length * (1.0 if mode == "approx" else log2(length) - 2.5) > limit else "samples"


def features_by_length(df: DataFrame, key: list[str], x: str, mode: str = "exact", names: tuple[str, ...] = REPRESENTATIONS, plan: str | None = None,
                       threshold: float | None = None, depth: int = 6, div: int = 4, lower_median: bool = False) -> DataFrame:
    """(*key, length, plan, seconds, features): series of any lengths from 3 on, in one narrow pass.

    ``plan`` names a column that holds each row's plan (see ``planned``); without it, each part of one length
    of an Arrow batch is held against the threshold by its own size. ``seconds`` is the row's share of the time that its
    part took. A series that is null, too short or has missing points raises inside the job."""
    if lower_median and mode != "exact":
        raise ValueError("the baseline layout is there in exact mode only")
    limit = dispatch.threshold(mode) if threshold is None else threshold
    kept = df.select(*key, F.col(x).cast("array<double>").alias("__x"), *([F.col(plan).alias("__plan")] if plan else []))
    schema = "".join(f"`{c}` {kind}, " for c, kind in kept.dtypes[:len(key)]) + "length int, plan string, seconds double, features array<double>"

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, str]]:
        """(rows, length, plan) of the batch's parts, in portions of bounded bytes."""
        if batch["__x"].null_count:
            raise ValueError("every series needs at least 3 finite points")
        lengths = np.diff(batch["__x"].offsets.to_numpy())
        chosen = np.array(batch["__plan"].to_pylist()) if plan else None
        for length in np.unique(lengths):
            if length < 3:
                raise ValueError("every series needs at least 3 finite points")
            own = np.flatnonzero(lengths == length)
            width = sum(len(features(n, depth, div, lower_median)) for n in (representation_lengths(int(length))[name] for name in names))
            some = max(1, BATCH_BYTES // (8 * (width + int(length))))
            for name in PLANS if plan else [batch_plan(mode, len(own), int(length), limit)]:
                rows = own[chosen[own] == name] if plan else own
                for at in range(0, len(rows), some):
                    yield rows[at:at + some], int(length), name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, length, name in parts(batch):
                own = batch.take(pa.array(rows))
                z = own["__x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                if not np.isfinite(z).all():
                    raise ValueError("every series needs at least 3 finite points")
                start = time.perf_counter()
                out = block_features(z, mode, names, depth, div, lower_median, name)
                share = (time.perf_counter() - start) / len(rows)
                offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(own[c] for c in key), pa.array(np.full(len(rows), length, np.int32)), pa.array([name] * len(rows)), pa.array(np.full(len(rows), share)),
                     pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*key, "length", "plan", "seconds", "features"])

    return kept.mapInArrow(run, schema)


def dataset_timings(made: DataFrame, dataset: str, estimator: str) -> DataFrame:
    """(dataset, estimator, series_length, n_samples, plan, n_features, runtime): seconds in the transform by data set and length, of the
    output of ``features_by_length``; one combined aggregate."""
    return made.groupBy(F.col(dataset).alias("dataset"), F.col("length").alias("series_length"), "plan").agg(
        F.count("*").alias("n_samples"), F.max(F.size("features")).alias("n_features"), F.sum("seconds").alias("runtime")).select(
        "dataset", F.lit(estimator).alias("estimator"), "series_length", "n_samples", "plan", "n_features", "runtime")


def baseline_speedups(df: DataFrame, dataset: str, x: str, modes: tuple[str, ...] = ("exact", "approx")) -> DataFrame:
    """(dataset, series_length, n_samples, baseline, exact, approx, speedup_exact, speedup_approx): the transform with the baseline's layout
    and in the two modes over every data set of ``df``, in one job for each, and how many times faster the modes are."""
    out = None
    for name, mode, lower in [("baseline", "exact", True), *((m, m, False) for m in modes)]:
        one = dataset_timings(features_by_length(df, [dataset], x, mode, threshold=0.0, lower_median=lower), dataset, name)
        out = one if out is None else out.unionByName(one)
    wide = out.groupBy("dataset", "series_length").pivot("estimator", ["baseline", *modes]).agg(F.sum("runtime"))
    sizes = out.where("estimator = 'baseline'").groupBy("dataset", "series_length").agg(F.sum("n_samples").alias("n_samples"))
    both = wide.join(sizes, ["dataset", "series_length"])
    return both.select("dataset", "series_length", "n_samples", "baseline", *modes, *[(F.col("baseline") / F.col(m)).alias(f"speedup_{m}") for m in modes])
