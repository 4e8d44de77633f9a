"""The measuring side: timed grids of the transform, the classification benchmark, thresholds from measurements, and their runner.

``python -m dyadix.studies --list`` names the stages, ``--from NAME`` starts at
one. DYADIX_SMOKE=1 shrinks every grid.
"""

from __future__ import annotations

import argparse
import os
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadix.operators import classify, fitgrid, fits, metrics, relational, trees
from dyadix.operators.features import interval_features
from dyadix.operators.quantiles import aggregated
from dyadix.plans import costmodel, dispatch, layout
from dyadix.sources import series
from dyadix.sources.shared import written
from dyadix.transformer import IntervalQuantiles

SMOKE = os.environ.get("DYADIX_SMOKE") == "1"
LENGTHS = [16, 64] if SMOKE else [16, 32, 64, 128, 256, 512, 1024]
SIZES = [1, 10] if SMOKE else [1, 10, 100, 1000, 10_000]
RUNS = 1 if SMOKE else 5
VARIANTS = {"samples": "rowwise", "intervals": "arrow"}
CLASSIFIERS = ("extra_trees", "random_forest", "ridge")
N_TREES = 8 if SMOKE else classify.TREES
SCORES = ["accuracy", "balanced_accuracy", "log_loss", "roc_auc", "f1"]
STAGE_SECONDS = ["runtime_features_train", "runtime_fit", "runtime_features_test", "runtime_prediction"]


def timed(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed_grid(spark: SparkSession, lengths=None, sizes=None, runs: int | None = None, seed: int = 0) -> DataFrame:
    """runtimes(L, n, mode, variant, run, runtime): every cell in a shuffled order after one warm-up.

    The driver loops over cells because each cell is a measurement of its own."""
    lengths, sizes, runs = lengths or LENGTHS, sizes or SIZES, runs or RUNS
    cells = relational.shuffled(relational.grid(spark, L=lengths, n=sizes, mode=["approx", "exact"], variant=list(VARIANTS), run=list(range(runs))), seed).collect()
    rows, warm = [], False
    for c in cells:
        data = series.gaussian(spark, c.n, c.L, seed).cache()
        data.count()
        plan = interval_features(data, ["series_id"], "x", c.L, c.mode, strategy=VARIANTS[c.variant])
        if not warm:
            timed(plan)
            warm = True
        rows.append((c.L, c.n, c.mode, c.variant, c.run, timed(plan)))
        data.unpersist()
    return spark.createDataFrame(rows, "L int, n int, mode string, variant string, run int, runtime double")


def calibration(runtimes: DataFrame, length: int = 64) -> DataFrame:
    """Thresholds of this machine from a timed grid, in the form that ``dispatch.calibrate`` reads."""
    minima = relational.min_over_runs(runtimes, ["L", "n", "mode", "variant"])
    study = fits.dispatch_study(minima, costmodel.n_intervals(length, 6))
    return study.withColumns({"depth": F.lit(6), "div": F.lit(4)})


def sort_study(spark: SparkSession, lengths=None, runs: int | None = None) -> DataFrame:
    """(L, variant, run, runtime): sorting arrays by value against sorting positions (argsort)."""
    rows = []
    for n in lengths or LENGTHS:
        data = series.gaussian(spark, 200, n).cache()
        data.count()
        for name, e in (("sort", F.sort_array("x")), ("argsort", F.transform(F.sort_array(F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: s["i"]))):
            rows += [(n, name, r, timed(data.select(e.alias("y")))) for r in range(runs or RUNS)]
        data.unpersist()
    return spark.createDataFrame(rows, "L int, variant string, run int, runtime double")


def _predict(name: str, train: DataFrame, test: DataFrame, classes: int, seed: int, n_trees: int) -> tuple[DataFrame, float, float]:
    """(test with pred and proba, seconds of the fit, seconds of the prediction)."""
    start = time.perf_counter()
    if name == "ridge":
        model = classify.RidgeCV(classes).fit(train)
        out = model.transform(test).withColumn("proba", metrics.one_hot(F.col("pred"), classes))
    elif name == "extra_trees":
        model = classify.ExtraTrees(classes, trees=n_trees, seed=seed).fit(train)
        out = model.transform(test)
    else:
        out = classify.Forest(classes, n_trees, seed=seed).fit(train).transform(test)
    fitted = time.perf_counter()
    out = out.withColumn("pred", metrics.argmax(F.col("proba"))).select("y", "pred", "proba").cache()
    out.count()
    return out, fitted - start, time.perf_counter() - fitted


def classification_benchmark(pool: DataFrame, resamples: dict[int, DataFrame], modes=("approx", "exact"), classifiers=CLASSIFIERS, n_trees: int = N_TREES) -> DataFrame:
    """One row of scores and stage runtimes per dataset, resample, mode and classifier.

    ``pool(dataset, pool_id, label, x)`` holds one data set; ``resamples`` maps a
    number to its train indices (line_no, idx)."""
    spark, rows = pool.sparkSession, []
    dataset = pool.select("dataset").first().dataset
    for number, indices in resamples.items():
        train, test = series.resample(pool, indices)
        index = series.label_index(train, "label").cache()
        classes = index.count()
        for mode in modes:
            model = IntervalQuantiles(mode=mode, idCol="pool_id").fit(train)
            made, seconds = [], []
            for part in (train, test):
                start = time.perf_counter()
                labelled = series.with_label(part.select("pool_id", "label"), index, "label")
                f = model.transform(part).join(labelled, "pool_id").select("y", "features").cache()
                f.count()
                made.append(f)
                seconds.append(time.perf_counter() - start)
            for name in classifiers:
                out, fit_s, predict_s = _predict(name, made[0], made[1], classes, number, n_trees)
                m = metrics.all_metrics(out.withColumn("key", F.lit(1)), ["key"], classes).first()
                rows.append((dataset, number, f"{mode}/{name}", m.accuracy, m.balanced_accuracy, m.log_loss, m.roc_auc, m.f1,
                             sum(seconds) + fit_s + predict_s, seconds[0], fit_s, seconds[1], predict_s))
                out.unpersist()
    return spark.createDataFrame(rows, series.METRICS)


def classification_grid(pool: DataFrame, indices: DataFrame, modes=("approx", "exact"), classifiers=CLASSIFIERS, n_trees: int = N_TREES,
                        cell_bytes: int = trees.LOCAL_BYTES, tasks: int = fitgrid.TASKS) -> DataFrame:
    """Scores and stage runtimes (METRICS, with ``error``) of every data set, resample, mode and classifier, in one job.

    ``pool(dataset, pool_id, label, x)`` holds any number of data sets, ``indices(dataset, resample, idx)`` their training rows. Cells whose features
    take at most ``cell_bytes`` are fitted as tasks of their own; larger data sets go one by one through the distributed classifiers. A data set
    or cell that cannot be fitted is a row without scores that gives the reason."""
    spark = pool.sparkSession
    shape = written(fitgrid.shapes(pool))  # a row a data set
    lengths = sorted(r.length for r in shape.where("fault is null").select("length").distinct().collect())
    sized = shape.withColumn("large", fitgrid.feature_bytes(F.col("n"), F.col("length"), lengths) > cell_bytes)
    keys = ["dataset", "resample", "estimator"]
    name = F.concat_ws("/", "mode", "classifier")
    small = pool.join(sized.where("fault is null and not large").select("dataset"), "dataset", "left_semi")
    made = written(fitgrid.cell_predictions(small, indices, modes, classifiers, n_trees, tasks=tasks).withColumn("estimator", name))
    fitted = made.where("error is null")
    seconds = fitted.groupBy(*keys).agg(F.first("seconds").alias("s")).select(
        *keys, F.aggregate("s", F.lit(0.0), lambda a, v: a + v).alias("runtime"), *[F.get("s", F.lit(i)).alias(c) for i, c in enumerate(STAGE_SECONDS)])
    out = metrics.all_metrics_by_classes(fitted, keys).join(seconds, keys).withColumn("error", F.lit(None).cast("string")).unionByName(
        made.where("error is not null").select(*keys, "error"), allowMissingColumns=True)
    cells = indices.select("dataset", F.col("resample").cast("int").alias("resample")).distinct()
    estimators = F.explode(F.array(*[F.lit(f"{m}/{c}") for m in modes for c in classifiers])).alias("estimator")
    faulty = cells.join(shape.where("fault is not null"), "dataset").select("dataset", "resample", estimators, F.col("fault").alias("error"))
    absent = cells.join(shape, "dataset", "left_anti").select("dataset", "resample", estimators, F.lit("no series").alias("error"))
    out = out.unionByName(faulty, allowMissingColumns=True).unionByName(absent, allowMissingColumns=True)
    big = pool.join(sized.where("fault is null and large").select("dataset"), "dataset", "left_semi").select("dataset", "pool_id", F.col("label").cast("string").alias("label"))
    learnt = big.join(indices.select("dataset", F.col("resample").cast("int").alias("resample"), F.col("idx").alias("pool_id")).distinct(), ["dataset", "pool_id"]).groupBy(
        "dataset", "resample", "label").agg(F.count("*").alias("learnt"))
    unknown = F.min(F.when(F.col("learnt").isNull(), F.col("label")))
    reason = F.when(F.sum("learnt").isNull(), "no rows to learn from").when(unknown.isNotNull(), F.concat(F.lit("unknown label "), unknown)).when(
        F.sum("learnt") == F.sum("n"), "no rows to test on")  # as a task gives them
    large = cells.join(big.groupBy("dataset", "label").agg(F.count("*").alias("n")), "dataset").join(learnt, ["dataset", "resample", "label"], "left").groupBy(
        "dataset", "resample").agg(reason.alias("error")).collect()
    failed = [(r.dataset, r.resample, f"{m}/{c}", r.error) for r in large if r.error for m in modes for c in classifiers]
    if failed:
        out = out.unionByName(spark.createDataFrame(failed, "dataset string, resample int, estimator string, error string"), allowMissingColumns=True)
    for r in (r for r in large if not r.error):  # each of them is over the bound and a distributed job of its own
        own = indices.where((F.col("dataset") == r.dataset) & (F.col("resample") == r.resample)).select(F.lit(0).alias("line_no"), "idx")
        for mode in modes:
            for c in classifiers:
                try:
                    one = classification_benchmark(pool.where(F.col("dataset") == r.dataset), {r.resample: own}, (mode,), (c,), n_trees).withColumn("error", F.lit(None).cast("string"))
                except Exception as e:
                    one = spark.createDataFrame([(r.dataset, r.resample, f"{mode}/{c}", str(e).splitlines()[0])], "dataset string, resample int, estimator string, error string")
                out = out.unionByName(one, allowMissingColumns=True)
    return out.select("dataset", "resample", "estimator", *SCORES, "runtime", *STAGE_SECONDS, "error")


def loading_audit(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return series.missing_resamples(wanted, present)


def _main_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, DataFrame]]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 3").select(
        F.lit("embeddings").alias("dataset"), F.col("vec_id").alias("pool_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    idx = e.where("pool_id % 2 = 0").select(F.col("pool_id").alias("line_no"), F.col("pool_id").alias("idx"))
    return e, {0: idx}


#: Stages in order; each takes (spark, test table folder) and returns the table that it would store.
STAGES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "layout_counts": lambda spark, d: costmodel.count_table(spark, LENGTHS),
    "timed_grid": lambda spark, d: timed_grid(spark),
    "dispatch_thresholds": lambda spark, d: calibration(timed_grid(spark)),
    "sort_study": lambda spark, d: sort_study(spark),
    "classification": lambda spark, d: classification_benchmark(*_main_data(spark, d), modes=("approx",)),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--list", action="store_true")
    p.add_argument("--from", dest="start", choices=list(STAGES), default=next(iter(STAGES)))
    p.add_argument("--data", default="/root/testdata/sf0.001")
    p.add_argument("--out", default=None, help="folder for CSV files; without it tables are shown")
    a = p.parse_args(argv)
    names = list(STAGES)
    if a.list:
        print("\n".join(names))
        return
    spark = SparkSession.builder.getOrCreate()
    for name in names[names.index(a.start):]:
        table = STAGES[name](spark, a.data)
        if a.out:
            series.write_facts(table, f"{a.out}/{name}")
        else:
            print(name)
            table.show(truncate=False)


def expected_accuracy_delta(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Mean score difference and mean ratio of runtimes between two estimators, per bin of ``scores(bin, dataset, estimator, score, runtime)``."""
    long = aggregated(scores, ["bin", "dataset", "estimator"], [F.avg("score").alias("score")], {"runtime": (F.col("runtime"), 0.5)})
    per = long.groupBy("bin", "dataset").pivot("estimator", [a, b]).agg(F.first("score").alias("score"), F.first("runtime").alias("runtime"))
    return per.groupBy("bin").agg(
        F.avg(F.col(f"{a}_score") - F.col(f"{b}_score")).alias("mean_delta"), F.avg(F.col(f"{b}_runtime") / F.col(f"{a}_runtime")).alias("mean_speedup"),
        F.countDistinct("dataset").alias("n_datasets"))


def prediction_table(spark: SparkSession, mode: str, lengths, sizes, c_intervals, k_intervals, c_series, k_series) -> DataFrame:
    """(L, n, intervals_s, samples_s, winner): the cost model over a grid."""
    rows = []
    for n_points in lengths:
        for n in sizes:
            i = costmodel.intervals_cost(mode, n, n_points, 6, 4, c_intervals, k_intervals)
            s = costmodel.series_cost(mode, n, n_points, 6, 4, c_series, k_series)
            rows.append((int(n_points), int(n), float(i), float(s), "intervals" if i < s else "samples"))
    return spark.createDataFrame(rows, "L int, n int, intervals_s double, samples_s double, winner string")


def decisions_against_truth(spark: SparkSession, truth: DataFrame, mode: str) -> DataFrame:
    """(hit_rate, mean_percent_slower): the dispatcher's choices on measured cells truth(L, n, samples, intervals)."""
    measured = F.when(F.col("intervals") < F.col("samples"), "intervals").otherwise("samples")
    work = F.col("n") * F.col("L") * (F.lit(1.0) if mode == "approx" else F.log2("L") - 2.5)
    chosen = F.when(work > dispatch.threshold(mode), "intervals").otherwise("samples")
    best, own = F.least("samples", "intervals"), F.when(chosen == "intervals", F.col("intervals")).otherwise(F.col("samples"))
    return truth.agg(F.avg((measured == chosen).cast("double")).alias("hit_rate"), F.avg((own / best - 1) * 100).alias("mean_percent_slower"))


def heuristic_against_theorem(crossovers: DataFrame, threshold: float) -> DataFrame:
    """crossovers(length, n_theorem) with the size at which a constant product of series and points switches, and their ratio."""
    heuristic = F.lit(threshold) / F.col("length")
    return crossovers.select("length", heuristic.alias("n_heuristic"), "n_theorem", (heuristic / F.nullif("n_theorem", F.lit(0.0))).alias("ratio"))


def width_basis(length: int, depth: int = 6, div: int = 4) -> dict[str, float]:
    """The regressors of the processing-cost fits, over all representations."""
    own = [costmodel.counts(n, depth, div) for n in layout.representation_lengths(length).values()]
    return {"sort_work": costmodel.over_representations(costmodel.sort_work, length, depth), "n_quantiles": float(np.sum([c["n_quantiles_gt1"] for c in own])),
            "width": float(np.sum([c["total_width_gt1"] for c in own])), "n_intervals": float(np.sum([c["n_intervals"] for c in own]))}


MOMENT_TERMS = ["total_width", "n_quantiles_gt1", "n_intervals"]


def moment_basis(length: int, depth: int = 6, div: int = 4) -> list[float]:
    """MOMENT_TERMS over all representations: points and intervals of any width, quantiles of those that have an expansion."""
    own = [costmodel.counts(n, depth, div) for n in layout.representation_lengths(length).values()]
    return [float(sum(c[t] for c in own)) for t in MOMENT_TERMS]


def moment_constants(lines: DataFrame, lengths: list[int]) -> DataFrame:
    """Fact rows (estimator, constant, value, r2, fit) of the processing costs of a point, a quantile and an interval, from lines(estimator, L, slope).

    ``joint_3param`` fits all three. Points and quantiles grow together, so their costs are hard to
    tell apart; ``robust_2param`` gives the points both shares (c1 with a quantile's cost times quantiles per point)."""
    spark = lines.sparkSession
    basis = spark.createDataFrame([(n, *moment_basis(n)) for n in lengths], "L long, " + ", ".join(f"{t} double" for t in MOMENT_TERMS))
    made = fits.joint_fits(lines.join(F.broadcast(basis), "L"), ["estimator"], MOMENT_TERMS, "slope", ["total_width", "n_intervals"])  # a row a length
    row = lambda name, fit, beta, at, r2: F.struct(F.lit(name).alias("constant"), F.get(beta, F.lit(at)).alias("value"), F.col(r2).alias("r2"), F.lit(fit).alias("fit"))
    rows = [row(f"c{i + 1}_tilde", "joint_3param", "beta", i, "r2") for i in range(3)]
    rows += [row("c1_plus_ratio_c2_tilde", "robust_2param", "reduced_beta", 0, "reduced_r2"), row("c3_tilde", "robust_2param", "reduced_beta", 1, "reduced_r2")]
    return made.select("estimator", F.explode(F.array(*rows)).alias("c")).select("estimator", "c.*")



if __name__ == "__main__":
    main()
