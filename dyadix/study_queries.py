"""Registered queries of the estimator, the readers and writers, the cost model and the studies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadix import queries as Q
from dyadix import studies
from dyadix.operators import features as X
from dyadix.operators import fits, metrics, relational
from dyadix.operators.classify import RidgeCV
from dyadix.operators.mixed import baseline_speedups, dataset_timings, features_by_length, planned
from dyadix.plans import costmodel, layout
from dyadix.queries import GRID_SQL, LENGTH, LENGTHS, LINES_SQL, PAIRS_SQL, RUNS_SQL, SCORES_SQL, VECTORS_SQL, query, table
from dyadix.sources import audit, series
from dyadix.sources.shared import scratch
from dyadix.transformer import IntervalQuantiles


# ---- the estimator -----------------------------------------------------------------------------------------------

def _checks(features, digits: int = 3):
    """Sums that also change when features change places."""
    total = lambda f: F.aggregate(F.transform(features, lambda v, i: v * (i % 97 + 1)), F.lit(0.0), f)
    return [F.size(features).cast("long").alias("n_features"), F.round(total(lambda a, v: a + v), digits).alias("weighted"), F.round(total(lambda a, v: a + F.abs(v)), digits).alias("weighted_abs")]


def _all_sql(mode: str) -> str:
    parts, base = [], 0
    for name, n in layout.representation_lengths(LENGTH).items():
        parts.append(f"SELECT * FROM ({Q.features_sql('vec_id', VECTORS_SQL, LENGTH, name, mode, digits=12, base=base)})")
        base += len(layout.features(n))
    return f"""SELECT vec_id, label, count(*) AS n_features, round(sum(value * (feature_idx % 97 + 1)), 3) AS weighted, round(sum(abs(value * (feature_idx % 97 + 1))), 3) AS weighted_abs
        FROM ({' UNION ALL '.join(parts)}) JOIN embeddings USING (vec_id) GROUP BY vec_id, label"""


def _estimator(name: str, mode: str, version):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        out = IntervalQuantiles(mode=mode, version=version, inputCol="embedding", idCol="vec_id").fit_transform(e)
        return out.select("vec_id", "label", *_checks(F.col("features")))

    run.__name__ = f"estimator_{name}"
    query(_all_sql(mode))(run)


for _name, _mode, _version in (("exact", "exact", "auto"), ("approx", "approx", "auto"), ("samples", "approx", "samples"), ("intervals", "approx", "intervals"),
                               ("from_length", "exact", 32)):
    _estimator(_name, _mode, _version)


@query(f"WITH {Q.intervals_sql(LENGTH)}, {Q.quantiles_sql()} SELECT feature_idx, ft.interval_id, depth, nq, round(q, 9) AS q FROM ft JOIN (SELECT interval_id, depth FROM iv) USING (interval_id)")
def feature_depths(spark, sf_dir):
    """The level, interval and quantile that each raw column comes from."""
    f = layout.feature_table(spark, LENGTH).where("repr = 'raw'")
    return f.join(F.broadcast(layout.interval_table(spark, LENGTH)), "interval_id").select(
        F.col("feature_id").cast("long").alias("feature_idx"), F.col("interval_id").cast("long").alias("interval_id"), F.col("depth").cast("long").alias("depth"),
        F.col("nq").cast("long").alias("nq"), F.round("q", 9).alias("q"))


# ---- readers and writers -----------------------------------------------------------------------------------------

@query("SELECT label::VARCHAR AS label, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5) + 0.0 AS total FROM embeddings")
def read_tsv_series(spark, sf_dir):
    """Labelled series written as tab-separated lines and read again."""
    path = scratch(spark)
    e = table(spark, sf_dir, "embeddings")
    e.select(F.concat_ws("\t", F.col("label").cast("string"), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), "\t")).alias("value")).write.text(path)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return series.read_tsv(spark, path).select("label", F.size("x").cast("long").alias("n"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query("SELECT label::VARCHAR AS label, c AS channel, round(list_sum(list_transform(CASE c WHEN 0 THEN embedding[1:32] ELSE embedding[33:64] END, lambda v: v::DOUBLE)), 5) + 0.0 AS total FROM embeddings, (SELECT unnest([0, 1])::BIGINT AS c)")
def read_ts_channels(spark, sf_dir):
    """Two channels a series in the colon-separated format, with a header."""
    path = scratch(spark)
    e = table(spark, sf_dir, "embeddings")
    half = lambda at: F.array_join(F.slice(F.col("embedding").cast("array<double>").cast("array<string>"), at, 32), ",")
    # eight files, each with its own header
    lines = e.select(F.concat_ws(":", half(1), half(33), F.col("label").cast("string")).alias("value"))
    files = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(8)).alias("k")).agg(
        F.concat(F.lit("# made here\n@problemName x\n@data\n"), F.array_join(F.collect_list("value"), "\n")).alias("value"))
    files.select("value").repartition(8, "value").write.text(path)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return series.read_ts(spark, path).select("label", F.col("channel").cast("long").alias("channel"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query("SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS line_no, vec_id AS idx FROM embeddings WHERE vec_id % 7 = 3")
def read_resample_indices(spark, sf_dir):
    """An index file of one number a line, read in file order (a file is a few hundred lines)."""
    path = scratch(spark)
    table(spark, sf_dir, "embeddings").where("vec_id % 7 = 3").orderBy(F.desc("vec_id")).select(F.col("vec_id").cast("string").alias("value")).coalesce(1).write.text(path)
    return series.read_resample(spark, path).select(F.col("line_no").cast("long").alias("line_no"), "idx")


@query(f"WITH {RUNS_SQL} SELECT dataset, estimator, split, run, round(runtime, 9) AS runtime FROM r")
def facts_round_trip(spark, sf_dir):
    path = scratch(spark)
    series.write_facts(Q.runs(spark, sf_dir).select("dataset", "estimator", "split", "run", "runtime"), path, single=False)
    return series.read_facts(spark, path, "dataset string, estimator string, split long, run long, runtime double").withColumn("runtime", F.round("runtime", 9))


@query(f"WITH {RUNS_SQL} SELECT L, round(min(runtime), 9) AS best FROM r GROUP BY L")
def wide_runs_round_trip(spark, sf_dir):
    """One row a length and one column a run, written and read back as the least of the runs."""
    path = scratch(spark)
    series.write_wide_runs(Q.runs(spark, sf_dir).select("L", "run", "runtime"), path, "L", 5)
    return series.read_wide_runs(spark, path, "L").select(F.col("L").cast("long").alias("L"), F.round("best", 9).alias("best"))


# ---- scores ------------------------------------------------------------------------------------------------------

@query(f"""WITH {SCORES_SQL}, r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM s),
    au AS (SELECT fold, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc FROM r GROUP BY fold),
    ba AS (SELECT fold, avg(r) AS b FROM (SELECT fold, y, avg((y = pred)::INT) AS r FROM s GROUP BY fold, y) GROUP BY fold),
    mi AS (SELECT fold, arg_min(y, n * 10 + y) AS c FROM (SELECT fold, y, count(*) AS n FROM s GROUP BY fold, y) GROUP BY fold),
    f AS (SELECT fold, coalesce(2.0 * count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (pred = c), 0), 0) AS f1 FROM s JOIN mi USING (fold) GROUP BY fold),
    ll AS (SELECT fold, avg((y = pred)::INT) AS accuracy, -avg(ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss FROM s GROUP BY fold)
    SELECT fold, round(accuracy, 8) AS accuracy, round(b, 8) AS balanced_accuracy, round(log_loss, 8) AS log_loss, round(roc_auc, 8) AS roc_auc, round(f1, 8) AS f1
    FROM ll JOIN ba USING (fold) JOIN au USING (fold) JOIN f USING (fold)""")
def all_metrics(spark, sf_dir):
    names = ("accuracy", "balanced_accuracy", "log_loss", "roc_auc", "f1")
    return Q._round(metrics.all_metrics(Q.scores(spark, sf_dir), ["fold"], 2), *names, digits=8).select("fold", *names)


@query(f"WITH {PAIRS_SQL} SELECT round(corr(ln(a / b), a - b), 6) AS correlation FROM pr WHERE a / b > 0")
def log_speedup_correlation(spark, sf_dir):
    """How the logarithm of a speed-up goes with the difference."""
    p = Q.pairs(spark, sf_dir).where(F.col("a") / F.col("b") > 0).select(F.ln(F.col("a") / F.col("b")).alias("x"), (F.col("a") - F.col("b")).alias("y"))
    return Q._round(metrics.correlation(p, [], "x", "y"), "correlation", digits=6)


@query(f"""WITH a AS ({Q.features_sql('vec_id', VECTORS_SQL, LENGTH, 'raw', 'exact')}), b AS ({Q.features_sql('vec_id', VECTORS_SQL, LENGTH, 'raw', 'approx')})
    SELECT round(max(abs(a.value - b.value)), 5) AS max_abs_diff, round(max(abs(a.value - b.value) / nullif(abs(b.value), 0)), 3) AS max_rel_diff,
    count(*) FILTER (a.value::FLOAT <> b.value::FLOAT) AS float32_disagreements, count(*) AS n FROM a JOIN b USING (vec_id, feature_idx)""")
def diff_summary_whole(spark, sf_dir):
    """Largest absolute and relative difference and disagreements in single precision, of features rounded to six digits."""
    e = table(spark, sf_dir, "embeddings")
    exact, approx = (Q._rows(X.interval_features(e, ["vec_id"], "embedding", LENGTH, m, ("raw",))) for m in ("exact", "approx"))
    both = exact.join(approx.withColumnRenamed("value", "other"), ["vec_id", "feature_idx"])
    s = metrics.difference_summary(both, [], "value", "other")
    return s.select(F.round("max_abs_diff", 5).alias("max_abs_diff"), F.round("max_rel_diff", 3).alias("max_rel_diff"), "float32_disagreements", "n")


# ---- relational studies ------------------------------------------------------------------------------------------

@query(f"""WITH {RUNS_SQL}, p AS (SELECT L, dataset, avg(n) FILTER (estimator = 'click') AS sa, avg(n) FILTER (estimator = 'view') AS sb,
      median(runtime) FILTER (estimator = 'click') AS ta, median(runtime) FILTER (estimator = 'view') AS tb FROM r GROUP BY L, dataset)
    SELECT L AS bin, round(avg(sa - sb), 8) AS mean_delta, round(avg(tb / ta), 8) AS mean_speedup, count(DISTINCT dataset) AS n_datasets FROM p WHERE sa IS NOT NULL OR sb IS NOT NULL GROUP BY L""")
def expected_accuracy_delta(spark, sf_dir):
    """Aggregates of aggregates: per data set first, then per bin."""
    df = Q.runs(spark, sf_dir).where("estimator in ('click', 'view')").select(F.col("L").alias("bin"), "dataset", "estimator", F.col("n").alias("score"), "runtime")
    return Q._round(studies.expected_accuracy_delta(df, "click", "view"), "mean_delta", "mean_speedup", digits=8)


@query(f"WITH {RUNS_SQL}, c AS (SELECT estimator, count(*) AS c FROM r WHERE estimator <> 'error' GROUP BY estimator) SELECT k AS place, estimator, coalesce(c, 0) AS c, c IS NOT NULL AS found FROM (SELECT unnest(['view', 'error', 'click', 'none']) AS estimator, unnest(range(4)) AS k) LEFT JOIN c USING (estimator)")
def fixed_labels(spark, sf_dir):
    labels = spark.createDataFrame(list(enumerate(["view", "error", "click", "none"])), "place long, estimator string")
    counts = Q.runs(spark, sf_dir).where("estimator <> 'error'").groupBy("estimator").agg(F.count("*").alias("c"))
    return relational.fixed_labels(counts, labels, "estimator", "place").select("place", "estimator", F.coalesce("c", F.lit(0)).alias("c"), F.col("c").isNotNull().alias("found"))


@query(f"WITH {RUNS_SQL} SELECT estimator, split, count(*) AS c FROM r GROUP BY ALL")
def complete_join(spark, sf_dir):
    """Every pair of keys has its partner, or the job stops."""
    r = Q.runs(spark, sf_dir)
    return relational.require_complete(r.groupBy("estimator", "split").agg(F.count("*").alias("c")), r, ["estimator", "split"])


@query("SELECT doc_id, coalesce(nullif(toxic, 1), -1) AS toxic FROM labels")
def fill_nulls(spark, sf_dir):
    return relational.fill_nulls(table(spark, sf_dir, "labels").select("doc_id", F.nullif("toxic", F.lit(1)).alias("toxic")), {"toxic": -1})


@query(f"WITH {RUNS_SQL} SELECT dataset, round(min(runtime), 9) AS t_min FROM r WHERE estimator = 'click' AND dataset = 'd3' GROUP BY dataset")
def one_row_lookup(spark, sf_dir):
    m = relational.min_over_runs(Q.runs(spark, sf_dir).where("estimator = 'click'"), ["dataset"])
    return Q._round(relational.one_row(m, F.col("dataset") == "d3"), "t_min")


@query(f"WITH {RUNS_SQL}, m AS (SELECT dataset, estimator, min(runtime) AS t FROM r GROUP BY ALL) SELECT dataset, list(estimator ORDER BY t DESC, estimator)[1] AS slowest, array_to_string(list(estimator ORDER BY t DESC, estimator), ',') AS ranking FROM m GROUP BY dataset")
def sorted_ranking(spark, sf_dir):
    """The estimators of each data set from slowest to fastest, ties by name."""
    m = relational.min_over_runs(Q.runs(spark, sf_dir), ["dataset", "estimator"])
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("t_min")).alias("t"), "estimator"))), lambda s: s["estimator"])
    return m.groupBy("dataset").agg(order.alias("o")).select("dataset", F.get("o", F.lit(0)).alias("slowest"), F.array_join("o", ",").alias("ranking"))


# ---- cost model --------------------------------------------------------------------------------------------------

#: Constants of the registered cost queries: (per unit of sorting or width, per quantile, per interval or width) and an overhead A - B / length.
COST_C, COST_K = {"exact": (1.0, 2.5, 0.75), "approx": (0.5, 3.0, 1.25)}, (40.0, 90.0)


def _cost_sql(n: int) -> str:
    return f"""(WITH {Q.intervals_sql(n)} SELECT {n}::BIGINT AS length, count(*) FILTER (m > 1) AS own, sum(m * log2(m)) AS sorting, sum(m)::DOUBLE AS width, count(*) AS ni,
        coalesce(sum(1 + (m - 1) // 4) FILTER (m > 1), 0) AS nq, coalesce(sum(m) FILTER (m > 1), 0)::DOUBLE AS width1 FROM iv)"""


def _model_sql() -> str:
    (e1, e2, e3), (a1, a2, a3), (ka, kb) = COST_C["exact"], COST_C["approx"], COST_K
    return f"""c AS (SELECT length, own, {e1} * sorting + {e2} * nq + {e3} * width1 AS exact_cost, {a1} * width + {a2} * nq + {a3} * ni AS approx_cost, own * ({ka} - {kb} / length) AS setup,
        ({ka} - {kb} / length) + 2 AS kappa_series FROM ({' UNION ALL '.join(map(_cost_sql, LENGTHS))}))"""


@query(f"WITH {_model_sql()} SELECT length, round(exact_cost, 6) AS exact_cost, round(approx_cost, 6) AS approx_cost FROM c")
def processing_costs(spark, sf_dir):
    rows = [(n, costmodel.exact_cost(n, 6, 4, *COST_C["exact"]), costmodel.approx_cost(n, 6, 4, *COST_C["approx"])) for n in LENGTHS]
    return Q._round(spark.createDataFrame(rows, "length long, exact_cost double, approx_cost double"), "exact_cost", "approx_cost", digits=6)


@query(f"WITH {_model_sql()} SELECT length, n, round(setup + n * exact_cost, 6) AS intervals_cost, round(n * (kappa_series + exact_cost), 6) AS series_cost FROM c, (SELECT unnest([1, 30, 1000])::BIGINT AS n)")
def outer_loop_costs(spark, sf_dir):
    k, ks = costmodel.overhead_curve(*COST_K), costmodel.overhead_curve(COST_K[0] + 2, COST_K[1])
    rows = [(n, m, costmodel.intervals_cost("exact", m, n, 6, 4, COST_C["exact"], k, every=False), costmodel.series_cost("exact", m, n, 6, 4, COST_C["exact"], ks, every=False)) for n in LENGTHS for m in (1, 30, 1000)]
    return Q._round(spark.createDataFrame(rows, "length long, n long, intervals_cost double, series_cost double"), "intervals_cost", "series_cost", digits=6)


@query(f"WITH {_model_sql()} SELECT length, round(setup / kappa_series, 6) AS n_star FROM c")
def crossover_sizes(spark, sf_dir):
    """The number of series from which the interval order is cheaper, at equal constants of the two orders."""
    return _crossovers(spark).select("length", F.round("n_theorem", 6).alias("n_star"))


@query(f"""SELECT length, round({COST_K[0]} - {COST_K[1]} / length, 9) AS overhead, round(2.0 + 0.5 * pow(length, 0.75), 9) AS power, round(6 * length * 1.25, 6) AS basis_approx, round(6 * length * (log2(length) - 2.5), 6) AS basis_exact
    FROM (SELECT unnest({LENGTHS})::BIGINT AS length)""")
def overhead_curves_and_bases(spark, sf_dir):
    k, p = costmodel.overhead_curve(*COST_K), costmodel.power_curve(2.0, 0.5, 0.75)
    df = spark.createDataFrame([(n, k(n), p(n)) for n in LENGTHS], "length long, overhead double, power double")
    df = df.withColumns({"basis_approx": fits.basis(F.col("length"), "approx"), "basis_exact": fits.basis(F.col("length"), "exact")})
    return Q._round(Q._round(df, "overhead", "power"), "basis_approx", "basis_exact", digits=6)


# ---- fits --------------------------------------------------------------------------------------------------------

@query(f"WITH {RUNS_SQL}, {GRID_SQL}, {LINES_SQL} SELECT L, n, round(setup + marginal * n, 6) AS predicted, round(t, 6) AS actual, round(setup + marginal * n - t, 6) AS error FROM ln JOIN g USING (L)")
def predicted_runtimes(spark, sf_dir):
    """Theory against measurement: fitted constants joined with the grid."""
    g = Q.fit_grid(spark, sf_dir)
    return Q._round(fits.predicted(fits.setup_and_marginal(g, ["L"]), g, ["L"]), "predicted", "actual", "error", digits=6)


@query(f"WITH {RUNS_SQL}, {GRID_SQL}, {LINES_SQL} SELECT L, round(marginal - 0.001 * 6 * L * (log2(L) - 2.5), 6) AS residual FROM ln")
def series_overhead_residual(spark, sf_dir):
    """What the fitted slope leaves after the predicted processing cost: the overhead of one series."""
    line = fits.setup_and_marginal(Q.fit_grid(spark, sf_dir), ["L"])
    return fits.overhead_residual(line, "marginal", F.lit(0.001) * fits.basis(F.col("L"), "exact")).select("L", F.round("residual", 6).alias("residual"))


@query(f"""WITH {_model_sql()}, x AS (SELECT length, 5000.0 / length AS n_heuristic, setup / kappa_series AS n_theorem FROM c)
    SELECT length, round(n_heuristic, 6) AS n_heuristic, round(n_theorem, 6) AS n_theorem, round(n_heuristic / n_theorem, 6) AS ratio FROM x""")
def heuristic_against_theorem(spark, sf_dir):
    """The size from which blocks pay: a constant product of series and points against the cost model's crossover."""
    return Q._round(studies.heuristic_against_theorem(_crossovers(spark), 5000.0), "n_heuristic", "n_theorem", "ratio", digits=6)


def _crossovers(spark) -> DataFrame:
    k, ks = costmodel.overhead_curve(*COST_K), costmodel.overhead_curve(COST_K[0] + 2, COST_K[1])
    rows = [(n, costmodel.crossover("exact", n, 6, 4, COST_C["exact"], k, COST_C["exact"], ks, every=False)) for n in LENGTHS]
    return spark.createDataFrame(rows, "length long, n_theorem double")


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, {LINES_SQL} SELECT 'L' || L AS estimator, round(setup, 6) AS setup, round(marginal, 6) AS marginal FROM ln""")
def constants_by_estimator(spark, sf_dir):
    """A long table of fitted constants, read back as one row per estimator; a missing or double constant stops the job."""
    line = fits.setup_and_marginal(Q.fit_grid(spark, sf_dir), ["L"]).select(F.concat(F.lit("L"), "L").alias("estimator"), "setup", "marginal")
    long = relational.unpivot(line, ["estimator"], ["setup", "marginal"], "constant", "value")
    return Q._round(fits.constants_table(long, ["setup", "marginal"]), "setup", "marginal", digits=6)


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, s AS (SELECT avg(L) AS ml, avg(n) AS mn, avg(t) AS mt, var_pop(L) AS ll, var_pop(n) AS nn, covar_pop(L, n) AS ln, covar_pop(L, t) AS lt, covar_pop(n, t) AS nt, var_pop(t) AS tt FROM g),
    b AS (SELECT *, (lt * nn - nt * ln) / (ll * nn - ln * ln) AS bl, (nt * ll - lt * ln) / (ll * nn - ln * ln) AS bn FROM s)
    SELECT round(mt - bl * ml - bn * mn, 6) AS one, round(bl, 6) AS L, round(bn, 6) AS n, round((bl * lt + bn * nt) / tt, 6) AS r2 FROM b""")
def joint_coefficients(spark, sf_dir):
    """The joint fit of three terms, from per-task triangular factors."""
    g = Q.fit_grid(spark, sf_dir).select(F.lit(1.0).alias("one"), F.col("L").cast("double").alias("L"), F.col("n").cast("double").alias("n"), "t")
    beta, r2, _ = fits.least_squares(g, ["one", "L", "n"], "t")
    return Q._round(spark.createDataFrame([(*map(float, beta), float(r2))], "one double, L double, n double, r2 double"), "one", "L", "n", "r2", digits=6)


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS t FROM lineitem),
    s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(t) AS mt, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
        covar_pop(a, t) AS ta, covar_pop(b, t) AS tb, var_pop(t) AS tt, avg(a * a) AS qa, avg(b * b) AS qb, avg(a * b) AS qab FROM g GROUP BY ALL),
    w AS (SELECT *, (ta * bb - tb * ab) / (aa * bb - ab * ab) AS wa, (tb * aa - ta * ab) / (aa * bb - ab * ab) AS wb,
        (1 + qa + qb) / 3 AS m, ma * ma + mb * mb + qab * qab AS off FROM s),
    p AS (SELECT *, sqrt((pow(1 - m, 2) + pow(qa - m, 2) + pow(qb - m, 2) + 2 * off) / 6) AS p FROM w),
    r AS (SELECT *, acos(greatest(-1, least(1, ((1 - m) * ((qa - m) * (qb - m) - qab * qab) - ma * (ma * (qb - m) - qab * mb) + mb * (ma * qab - (qa - m) * mb)) / (2 * p * p * p)))) / 3 AS phi FROM p),
    e AS (SELECT *, m + 2 * p * cos(phi) AS most, qa * qb + ma * mb * qab * 2 - qa * mb * mb - qab * qab - qb * ma * ma AS det, m + 2 * p * cos(phi + 2 * pi() / 3) AS least FROM r)
    SELECT l_returnflag, l_linestatus, n, round(mt - wa * ma - wb * mb, 3) AS one, round(wa, 3) AS l_quantity, round(wb, 2) AS l_discount, round((wa * ta + wb * tb) / tt, 6) AS r2,
        round(sqrt(most * most * (1 + qa + qb - most - least) / det), 1) AS condition, round(mt - ta / aa * ma, 3) AS reduced_one, round(ta / aa, 3) AS reduced_quantity, round(ta * ta / aa / tt, 6) AS reduced_r2 FROM e""")
def joint_fits_by_group(spark, sf_dir):
    """The price of an order line by quantity and discount in every group, with two terms too, and how well the three can be told apart."""
    g = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    made = fits.joint_fits(g, ["l_returnflag", "l_linestatus"], ["one", "l_quantity", "l_discount"], "l_extendedprice", ["one", "l_quantity"])
    pick = lambda column, at, digits, name: F.round(F.get(column, F.lit(at)), digits).alias(name)
    return made.select("l_returnflag", "l_linestatus", "n", pick("beta", 0, 3, "one"), pick("beta", 1, 3, "l_quantity"), pick("beta", 2, 2, "l_discount"), F.round("r2", 6).alias("r2"),
                       F.round("condition", 1).alias("condition"), pick("reduced_beta", 0, 3, "reduced_one"), pick("reduced_beta", 1, 3, "reduced_quantity"), F.round("reduced_r2", 6).alias("reduced_r2"))


MOMENT_LENGTHS = [16, 32, 48, 64, 80, 96]
MOMENT_BASIS = ", ".join("({}, {}, {}, {})".format(n, *studies.moment_basis(n)) for n in MOMENT_LENGTHS)


@query(f"""WITH {RUNS_SQL}, b(L, w, q, i) AS (VALUES {MOMENT_BASIS}),
    m AS (SELECT estimator, L, n, min(runtime) + n * 3.0 AS t FROM r GROUP BY estimator, L, n), ln AS (SELECT estimator, L, regr_intercept(t / n, 1.0 / n) AS y FROM m GROUP BY estimator, L),
    s AS (SELECT estimator, sum(w * w) AS ww, sum(w * i) AS wi, sum(i * i) AS ii, sum(w * y) AS wy, sum(i * y) AS iy, count(*) * var_pop(y) AS tt, sum(y * y) AS yy FROM ln JOIN b USING (L) WHERE y IS NOT NULL GROUP BY estimator),
    f AS (SELECT *, (wy * ii - iy * wi) / (ww * ii - wi * wi) AS c1, (iy * ww - wy * wi) / (ww * ii - wi * wi) AS c3 FROM s)
    SELECT estimator, 'c1_plus_ratio_c2_tilde' AS constant, round(c1, 6) AS value, round(1 - (yy - c1 * wy - c3 * iy) / tt, 5) AS r2 FROM f
    UNION ALL SELECT estimator, 'c3_tilde', round(c3, 6), round(1 - (yy - c1 * wy - c3 * iy) / tt, 5) FROM f""")
def moment_constants_robust(spark, sf_dir):
    """Costs of a point and an interval from every estimator's fitted lines over six lengths."""
    minima = Q.runs(spark, sf_dir).groupBy("estimator", "L", "n").agg((F.min("runtime") + F.col("n") * 3.0).alias("t"))
    lines = fits.setup_and_marginal(minima, ["estimator", "L"]).select("estimator", "L", F.col("marginal").alias("slope"))
    rows = studies.moment_constants(lines, MOMENT_LENGTHS).where("fit = 'robust_2param'")
    return rows.select("estimator", "constant", F.round("value", 6).alias("value"), F.round("r2", 5).alias("r2"))


# ---- classifiers -------------------------------------------------------------------------------------------------

@query("""WITH x AS (SELECT vec_id, label AS y, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS a, list_sum(list_transform(embedding, lambda v: abs(v::DOUBLE))) AS b FROM embeddings),
    t AS (SELECT k, a, b, CASE WHEN y = k THEN 1.0 ELSE -1.0 END AS t FROM x, (SELECT unnest(range(10)) AS k) WHERE vec_id % 3 <> 0),
    c AS (SELECT k, avg(a) AS ma, avg(b) AS mb, avg(t) AS mt, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, t) AS ta, count(*) * covar_pop(b, t) AS tb FROM t GROUP BY k),
    w AS (SELECT *, (ta * bb - tb * ab) / (aa * bb - ab * ab) AS wa, (tb * aa - ta * ab) / (aa * bb - ab * ab) AS wb FROM c)
    SELECT vec_id, any_value(y) AS y, arg_max(k, mt + wa * (a - ma) + wb * (b - mb))::INT AS pred FROM x, w WHERE vec_id % 3 = 0 GROUP BY vec_id""")
def ridge_two_sums(spark, sf_dir):
    """Ridge regression at a fixed penalty on two features of whole vectors, so few that their system is solved in SQL too."""
    total = lambda f: F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), f)
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("y"), F.array(total(lambda s, v: s + v), total(lambda s, v: s + F.abs(v))).alias("features"))
    return RidgeCV(10, alphas=(1.0,)).fit(x.where("vec_id % 3 <> 0")).transform(x.where("vec_id % 3 = 0")).select("vec_id", "y", "pred")


# ---- the grid of fits --------------------------------------------------------------------------------------------

GRID_CELLS = """v AS (SELECT 'set' || label // 4 AS dataset, vec_id, label FROM embeddings), r AS (SELECT unnest(range(3))::INT AS resample),
    c AS (SELECT unnest(['extra_trees', 'random_forest', 'ridge']) AS classifier),
    own AS (SELECT dataset, resample, vec_id, label, (vec_id // 10 + resample) % 3 <> 0 AND NOT (dataset = 'set1' AND resample = 2 AND label = 7) AS train FROM v, r)"""


@query(f"""WITH {GRID_CELLS}, cell AS (SELECT dataset, resample, count(*) FILTER (NOT train) AS n_test, count(DISTINCT label) FILTER (train) AS classes,
      min(label) FILTER (label NOT IN (SELECT label FROM own AS o WHERE o.train AND o.dataset = own.dataset AND o.resample = own.resample)) AS unknown FROM own GROUP BY dataset, resample)
    SELECT dataset, resample, 'approx/' || classifier AS estimator, CASE WHEN unknown IS NULL THEN 1.0::DOUBLE END AS accuracy, CASE WHEN unknown IS NULL THEN 1.0::DOUBLE END AS balanced_accuracy,
      CASE WHEN unknown IS NULL THEN 1.0::DOUBLE END AS roc_auc, CASE WHEN unknown IS NULL THEN 1.0::DOUBLE END AS f1, unknown IS NULL AS timed, 'unknown label ' || unknown AS error FROM cell, c""")
def classification_grid(spark, sf_dir):
    """Three classifiers over three resamples of three data sets, fitted as tasks of one job, on vectors to which each label adds a wave of its own: every
    test row must be told right, and a resample whose training rows lack a label is a row with the reason."""
    e = table(spark, sf_dir, "embeddings")
    wave = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: v + 3 * F.cos((F.col("label") + 1) * i / 4))
    pool = e.select(F.concat(F.lit("set"), F.floor(F.col("label") / 4)).alias("dataset"), F.col("vec_id").alias("pool_id"), "label", wave.alias("x"))
    every = pool.select("dataset", "pool_id", "label", F.explode(F.array(*[F.lit(r) for r in range(3)])).alias("resample"))
    lacks = (F.col("dataset") == "set1") & (F.col("resample") == 2) & (F.col("label") == 7)
    indices = every.where((F.floor(F.col("pool_id") / 10) + F.col("resample")) % 3 != 0).where(~lacks).select("dataset", "resample", F.col("pool_id").alias("idx"))
    out = studies.classification_grid(pool, indices, ("approx",), n_trees=20, tasks=32)
    scores = ["accuracy", "balanced_accuracy", "roc_auc", "f1"]
    return out.select("dataset", "resample", "estimator", *[F.round(s, 9).alias(s) for s in scores], F.coalesce(F.col("runtime") > 0, F.lit(False)).alias("timed"), "error")


# ---- data sets of many lengths -----------------------------------------------------------------------------------

MIXED = (16, 24, 32, 48, 64)
MIXED_LIMIT = 20_000.0  # between the sizes of the data sets at the smaller scales


def _event_sets(spark, sf_dir) -> DataFrame:
    """(dataset, user_id, block, x): one data set for each length, cut from every user's events."""
    rows = Q.numbered_events(table(spark, sf_dir, "events"))
    out = None
    for n in MIXED:
        one = Q.event_series(rows, n).select(F.lit(f"values{n}").alias("dataset"), "user_id", "block", F.col("v").alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


def _mixed_sql(select: str) -> str:
    parts = []
    for n in MIXED:
        src = f"{Q.EVENTS_SQL}, {Q.event_pairs_sql(n)}, series AS (SELECT id, v AS x FROM pair)"
        parts.append(f"SELECT 'values{n}' AS dataset, {n} AS len, * FROM ({Q.features_sql('id', src, n, 'raw', 'exact', digits=12)})")
    return select.format(f"({' UNION ALL '.join(parts)})")


@query(_mixed_sql(f"""WITH m AS (SELECT dataset, len, id, count(*) AS n_features, round(sum(value * (feature_idx % 97 + 1)) / 3.14159265, 4) AS weighted FROM {{}} GROUP BY dataset, len, id)
    SELECT dataset, split_part(id, '/', 1)::BIGINT AS user_id, split_part(id, '/', 2)::BIGINT AS block, n_features, weighted,
           CASE WHEN count(*) OVER (PARTITION BY dataset) * len * (log2(len) - 2.5) > {MIXED_LIMIT} THEN 'intervals' ELSE 'samples' END AS plan FROM m"""))
def mixed_lengths(spark, sf_dir):
    """Data sets of five lengths in one job, each by the plan that its own size asks for."""
    made = features_by_length(planned(_event_sets(spark, sf_dir), "dataset", "x", "exact", MIXED_LIMIT), ["dataset", "user_id", "block"], "x", "exact", ("raw",), plan="plan")
    weighted = F.aggregate(F.transform("features", lambda v, i: v * (i % 97 + 1)), F.lit(0.0), lambda a, v: a + v)
    return made.select("dataset", "user_id", "block", F.size("features").cast("long").alias("n_features"), F.round(weighted / 3.14159265, 4).alias("weighted"), "plan")


@query(_mixed_sql("""SELECT dataset, len::INT AS series_length, count(DISTINCT id) AS n_samples, (count(*) // count(DISTINCT id))::INT AS n_features, true AS timed FROM {} GROUP BY dataset, len"""))
def dataset_runtimes(spark, sf_dir):
    """Time in the transform by data set and length, all in one job."""
    made = features_by_length(_event_sets(spark, sf_dir), ["dataset"], "x", "exact", ("raw",), threshold=0.0)
    t = dataset_timings(made, "dataset", "exact")
    return t.select("dataset", "series_length", "n_samples", "n_features", (F.col("runtime") > 0).alias("timed"))


@query(_mixed_sql("""SELECT dataset, len::INT AS series_length, count(DISTINCT id) AS n_samples, true AS timed FROM {} GROUP BY dataset, len"""))
def baseline_speedup_table(spark, sf_dir):
    """The baseline's layout against both modes over every data set, with speed-ups."""
    s = baseline_speedups(_event_sets(spark, sf_dir), "dataset", "x")
    return s.select("dataset", "series_length", "n_samples", ((F.col("speedup_exact") > 0) & (F.col("speedup_approx") > 0)).alias("timed"))


# ---- loading that never raises -----------------------------------------------------------------------------------

def _damaged(spark, sf_dir) -> str:
    """Every vector as a line of its label's file, five kinds of lines damaged by number, and two data sets of a wrong shape."""
    p = F.col("embedding").cast("array<double>").cast("array<string>")
    k = F.pmod("vec_id", F.lit(50))
    points = F.when(k == 7, F.concat(F.array(F.lit("x1")), F.slice(p, 2, 63))).when(k == 11, F.concat(F.slice(p, 1, 63), F.array(F.lit("?")))).when(
        k == 17, F.array(F.lit(""))).when((F.col("label") == 4) & (k % 2 == 0), F.slice(p, 1, 60)).otherwise(p)
    half = lambda at: F.array_join(F.slice(points, at, 32), ",")
    two = F.concat_ws(":", half(1), F.when(k == 23, F.array_join(F.slice(points, 33, 31), ",")).otherwise(half(33)))
    body = F.when((F.col("label") == 3) & ~k.isin(7, 11, 17), two).otherwise(F.array_join(points, ","))
    path = scratch(spark)
    line = F.concat(body, F.lit(":"), F.when(k == 13, F.lit(" ")).otherwise(F.col("label").cast("string")))
    table(spark, sf_dir, "embeddings").select(F.concat(F.lit("set"), F.col("label")).alias("dataset"), line.alias("value")).write.partitionBy("dataset").text(path)
    return path


DAMAGE_SQL = """bad AS (SELECT 'set' || label AS dataset, CASE vec_id % 50 WHEN 13 THEN 'no label' WHEN 7 THEN 'not a number' WHEN 11 THEN 'missing value' WHEN 17 THEN 'no points'
      WHEN 23 THEN CASE label WHEN 3 THEN 'channels of unequal length' END END AS reason, vec_id, label FROM embeddings)"""


@query(f"WITH {DAMAGE_SQL} SELECT dataset, reason, count(*) AS n, true AS placed FROM bad WHERE reason IS NOT NULL GROUP BY dataset, reason")
def audit_bad_lines(spark, sf_dir):
    """What is wrong with which line: five kinds of damage, each with its place."""
    _, bad = audit.audited(spark, _damaged(spark, sf_dir))
    return bad.groupBy("dataset", "reason").agg(F.count("*").alias("n"), (F.count_distinct("file", "line_no") == F.count("*")).alias("placed"))


@query(f"""WITH {DAMAGE_SQL}, sizes AS (SELECT dataset, label, count(*) FILTER (reason IS NULL) AS n, count(*) AS lines,
      count(*) FILTER (reason IS NULL AND label = 4 AND vec_id % 2 = 0) AS cut FROM bad GROUP BY dataset, label),
    pairs AS (SELECT 'set' || d AS dataset, r FROM range(12) t(d), range(3) u(r)),
    f AS (SELECT p.dataset, r, unnest([CASE WHEN n IS NULL THEN 'no series' END, CASE WHEN lines > n THEN 'bad lines' END, CASE WHEN label = 3 THEN 'several channels' END,
      CASE WHEN label = 4 AND cut > 0 AND cut < n THEN 'unequal lengths' END, CASE WHEN r = 2 THEN 'no indices' END,
      CASE WHEN r = 1 AND label = 5 OR n IS NULL AND r < 2 THEN 'index out of range' END, CASE WHEN r = 0 AND label = 6 THEN 'index twice' END]) AS reason FROM pairs p LEFT JOIN sizes s USING (dataset))
    SELECT dataset, r AS resample, reason FROM f WHERE reason IS NOT NULL""")
def audit_failures(spark, sf_dir):
    """Which data sets and resamples cannot be used, and why: wrong shapes, bad lines, absent data and faulty indices are rows."""
    good, bad = audit.audited(spark, _damaged(spark, sf_dir))
    wanted = relational.grid(spark, dataset=[f"set{d}" for d in range(12)], resample=[0, 1, 2]).withColumn("resample", F.col("resample").cast("long"))
    n = F.when((F.col("dataset") == "set5") & (F.col("resample") == 1), 10 ** 9).otherwise(F.lit(0))
    twice = F.when((F.col("dataset") == "set6") & (F.col("resample") == 0), F.array(F.lit(0), F.lit(0))).otherwise(F.array(n))
    indices = wanted.where("resample < 2").select("dataset", "resample", F.explode(twice.cast("array<bigint>")).alias("idx"))
    return audit.failures(wanted, good, bad, indices)
