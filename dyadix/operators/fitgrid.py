"""A grid of fits as tasks: every cell (data set, resample, mode, classifier) is one group of rows that one task fits and predicts.

The features of a data set do not depend on its resamples, so they are made once a
mode, in one narrow pass over series of all lengths. Each row is then copied to the
cells that need it, and a task holds one cell. A cell that cannot be fitted is a
row with the reason, not the end of the job. Data sets whose features pass a
bound of bytes do not come here (see ``studies.classification_grid``).
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.operators.classify import RidgeCV
from dyadix.operators.mixed import features_by_length
from dyadix.operators.trees import LOCAL_BYTES, SHARE, TREES, bagged, grown, in_own_order, matrix, walk
from dyadix.plans.layout import REPRESENTATIONS, features, representation_lengths

CELL = ["dataset", "resample", "mode", "classifier"]
FITTED = ("dataset string, resample int, mode string, classifier string, classes int, pool_id long, y int, pred int, proba array<double>, "
          "seconds array<double>, error string")
TASKS = 1024  # cells that run in tasks of their own; more share them by hash


def shapes(pool: DataFrame) -> DataFrame:
    """(dataset, n, length, fault): rows and points of each data set of ``pool(dataset, pool_id, label, x)``, and why its features cannot be made.

    One combined aggregate: a data set that holds a third of all rows is counted where its rows are."""
    faulty = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    counted = pool.groupBy("dataset").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("length"),
                                          F.bool_or(faulty).alias("gaps"), F.bool_or(F.col("label").isNull()).alias("unlabelled"))
    fault = F.when(F.col("gaps"), "missing points").when(F.col("low") < F.col("length"), "unequal lengths").when(F.col("length") < 3, "fewer than 3 points").when(
        F.col("unlabelled"), "missing labels")
    return counted.select("dataset", "n", "length", fault.alias("fault"))


def feature_bytes(n: Column, length: Column, lengths: list[int]) -> Column:
    """Bytes of the features of ``n`` series; ``lengths`` are the different lengths there are."""
    width = F.lit(0)
    for one in lengths:
        if one >= 3:
            width = F.when(length == one, sum(len(features(k)) for k in representation_lengths(one).values())).otherwise(width)
    return n * width * 8


def fitted(name: str, x: np.ndarray, y: np.ndarray, classes: int, trees: int, seed: int):
    """A function from rows to class probabilities, as the distributed classifiers of the same name and seed give them."""
    if name == "ridge":
        model = RidgeCV(classes).fit_block(x, y)
        return lambda z: np.eye(classes)[(z @ model.beta + model.intercept).argmax(1)]
    if name == "random_forest":
        x, y = in_own_order(x, y)
    grow = {"extra_trees": grown, "random_forest": bagged}[name]
    made = [grow(x, y, classes, max(1, int(SHARE * x.shape[1])), seed, t) for t in range(trees)]
    sent = [(t.packed(), t.proba()) for t in made]
    return lambda z: sum(p[walk(t, z)] for t, p in sent) / len(sent)


def cell_predictions(pool: DataFrame, indices: DataFrame, modes=("approx", "exact"), classifiers=("extra_trees", "random_forest", "ridge"), trees: int = TREES,
                     names: tuple[str, ...] = REPRESENTATIONS, tasks: int = TASKS) -> DataFrame:
    """Predictions (FITTED) of each test row of every cell; a cell that fails is one row with ``error`` and without a row number.

    ``pool(dataset, pool_id, label, x)`` holds series of one length within a data set, ``indices(dataset, resample, idx)`` the rows that each
    resample trains on; the others are its test rows. The seed of a cell is its resample. ``seconds`` are those of the features of the training rows,
    of the fit, of the features of the test rows and of the prediction."""
    # a row's resamples travel as two short arrays, so its features are copied last of all
    own = indices.groupBy("dataset", F.col("idx").alias("pool_id")).agg(F.collect_set(F.col("resample").cast("int")).alias("trains"))
    every = indices.groupBy("dataset").agg(F.collect_set(F.col("resample").cast("int")).alias("resamples"))
    rows = pool.select("dataset", F.col("pool_id").cast("long").alias("pool_id"), F.col("label").cast("string").alias("label"), "x").join(
        own, ["dataset", "pool_id"], "left").join(every, "dataset").withColumn("trains", F.coalesce("trains", F.array().cast("array<int>")))
    made = None
    for mode in modes:
        one = features_by_length(rows, ["dataset", "pool_id", "label", "trains", "resamples"], "x", mode, names).withColumn("mode", F.lit(mode))
        made = one if made is None else made.unionByName(one)
    copied = made.withColumn("resample", F.explode("resamples")).withColumn("train", F.array_contains("trains", F.col("resample"))).withColumn(
        "classifier", F.explode(F.array(*[F.lit(c) for c in classifiers]))).select(*CELL, "pool_id", "label", "train", "seconds", "features")

    def run(key, table):
        dataset, resample, mode, name = (v.as_py() for v in key)

        def rows_of(count, classes=None, pool_id=None, y=None, pred=None, proba=None, seconds=None, error=None):
            values = [*([v] * count for v in (dataset, resample, mode, name, classes)), pool_id or [None] * count, y or [None] * count, pred or [None] * count,
                      proba or [None] * count, [seconds] * count, [error] * count]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
            return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[*CELL, "classes", "pool_id", "y", "pred", "proba", "seconds", "error"])

        try:
            table = table.sort_by("pool_id").combine_chunks()
            train = table["train"].to_numpy()
            labels = np.array(table["label"].to_pylist(), object)
            known = sorted(set(labels[train]))
            if not known:
                raise ValueError("no rows to learn from")
            unknown = sorted(set(labels) - set(known))
            if unknown:
                raise ValueError(f"unknown label {unknown[0]}")
            x, y = matrix(table["features"].combine_chunks()), np.searchsorted(known, labels)
            spent = table["seconds"].to_numpy()
            start = time.perf_counter()
            predict = fitted(name, x[train], y[train], len(known), trees, resample)
            between = time.perf_counter()
            test = ~train
            proba = predict(x[test]) if test.any() else np.zeros((0, len(known)))
            seconds = [float(spent[train].sum()), between - start, float(spent[test].sum()), time.perf_counter() - between]
            if not len(proba):
                raise ValueError("no rows to test on")
            return rows_of(len(proba), len(known), table["pool_id"].to_numpy()[test].tolist(), y[test].tolist(), proba.argmax(1).tolist(), proba.tolist(), seconds)
        except Exception as e:  # a cell's failure is its result
            return rows_of(1, error=str(e) or type(e).__name__)

    # small cells of much work: their number of tasks is set, not merged by the bytes they read
    return copied.repartition(tasks, *CELL).groupBy(*CELL).applyInArrow(run, FITTED)
