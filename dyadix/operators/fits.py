"""Curve fits as aggregates: every design matrix of a few columns is reduced to sums or a triangular factor before it leaves a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.operators.quantiles import aggregated


def setup_and_marginal(df: DataFrame, keys: list[str], n: str = "n", t: str = "t") -> DataFrame:
    """t / n against 1 / n: slope = setup cost, intercept = marginal cost; R2 is that of t itself, unweighted."""
    x, y = 1 / F.col(n), F.col(t) / F.col(n)
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("setup"), F.regr_intercept(y, x).alias("marginal"), F.avg(t).alias("__mean"))
    miss = F.col(t) - (F.col("setup") + F.col("marginal") * F.col(n))
    r2 = 1 - F.sum(miss * miss) / F.nullif(F.sum((F.col(t) - F.col("__mean")) * (F.col(t) - F.col("__mean"))), F.lit(0.0))
    return df.join(fit, keys).groupBy(*keys).agg(F.first("setup").alias("setup"), F.first("marginal").alias("marginal"), r2.alias("r2"))


def through_origin(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))


def two_terms(df: DataFrame, keys: list[str], x1: str, x2: str, y: str) -> DataFrame:
    """y = A x1 - B x2 by least squares: five sums and a 2 x 2 solution."""
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = df.groupBy(*keys).agg(s(x1, x1).alias("s11"), s(x1, x2).alias("s12"), s(x2, x2).alias("s22"), s(x1, y).alias("s1y"), s(x2, y).alias("s2y"))
    det = F.nullif(F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"), F.lit(0.0))
    return sums.select(*keys, ((F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det).alias("A"),
                       ((F.col("s1y") * F.col("s12") - F.col("s2y") * F.col("s11")) / det).alias("B"))


def power_law(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The exponent from logarithms, then y = A + C x^p by least squares."""
    p = df.groupBy(*keys).agg(F.regr_slope(F.ln(F.greatest(F.col(y), F.lit(1e-300))), F.ln(x)).alias("P"))
    z = F.pow(F.col(x), F.col("P"))
    return df.join(p, keys).groupBy(*keys, "P").agg(F.regr_intercept(F.col(y), z).alias("A"), F.regr_slope(F.col(y), z).alias("C"))


MERGING = 64  # tasks that merge the factors of one group before the last merge
ROUNDING = 16 * 2.0 ** -52  # share of a value that its computation may change
HELD_GROUPS = 4096  # groups whose factors a task holds before it hands them on


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows (terms, y): at most as many rows as columns, with the same least-squares solutions."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _merged(a: tuple, b: tuple) -> tuple:
    """(factor, n, mean of y, squared distances from it) of two disjoint sets of rows together."""
    n = a[1] + b[1]
    d = b[2] - a[2]
    return _factor(np.vstack([a[0], b[0]])), n, a[2] + d * b[1] / n, a[3] + b[3] + d * d * a[1] * b[1] / n


def _solved(state: tuple, columns: list[int]) -> tuple[list[float], float | None, float]:
    """(coefficients of the chosen columns, R2, condition number); where y has no spread beyond its own rounding there is no R2."""
    design, goal = state[0][:, columns], state[0][:, -1]
    beta, *_ = np.linalg.lstsq(design, goal, rcond=None)
    miss = float(((goal - design @ beta) ** 2).sum())
    return beta.tolist(), 1 - miss / state[3] if state[3] > state[1] * (ROUNDING * state[2]) ** 2 else None, float(np.linalg.cond(design))


def joint_fits(df: DataFrame, keys: list[str], terms: list[str], y: str, reduced: list[str] | None = None) -> DataFrame:
    """(*keys, n, beta, r2, condition, reduced_beta, reduced_r2, reduced_condition): least squares of ``y`` on a few terms, by group.

    ``reduced`` names the terms of a second, better conditioned fit, solved from the same factor (null without it). A design
    of lower rank gets the solution of least norm, as its condition number tells. Rows with a null or non-finite term or value are left
    out; a null key is a group of its own; an empty table gives no rows; ``keys`` may be empty.

    A task reduces its rows, portion by portion, to one triangular factor a group (nothing is squared, so an
    ill-conditioned design loses no digits to it). The factors of a group are merged in MERGING tasks, then in one: neither a group
    that holds all rows nor many groups reach the driver or one task."""
    k = len(terms) + 1
    small = [terms.index(t) for t in reduced] if reduced else None
    value = [F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate((*terms, y))]
    rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *value)
    for i in range(k):
        rows = rows.where(F.abs(f"__v{i}") < float("inf"))  # neither null nor NaN, which is the largest of all
    own = [f"__k{i}" for i in range(len(keys))]
    kinds = "".join(f"{c} {kind}, " for c, kind in rows.dtypes[:len(keys)])
    state = "__r array<double>, __n long, __mean double, __spread double"

    def packed(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        made = [s for _, s in found]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([key[i] for key, _ in found], t) for i, t in enumerate(types)), pa.array([s[0].ravel().tolist() for s in made], pa.list_(pa.float64())),
             *(pa.array([s[j] for s in made], t) for j, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64())))], [*own, "__r", "__n", "__mean", "__spread"])

    def reduce(batches):
        held: dict[tuple, tuple] = {}
        types: list[pa.DataType] = []
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(c).type for c in own]
            m = np.stack([b[f"__v{i}"].to_numpy(zero_copy_only=False) for i in range(k)], 1)
            if own:
                at = pa.table({c: b[c] for c in own}).append_column("at", pa.array(np.arange(b.num_rows))).group_by(own, use_threads=False).aggregate([("at", "list")])
                parts = zip(zip(*(at[c].to_pylist() for c in own), strict=True), at["at_list"].to_pylist(), strict=True)
            else:
                parts = [((), slice(None))]
            for key, chosen in parts:
                part = m[chosen]
                one = _factor(part), len(part), float(part[:, -1].mean()), float(((part[:, -1] - part[:, -1].mean()) ** 2).sum())
                held[key] = _merged(held[key], one) if key in held else one
            if len(held) > HELD_GROUPS:
                yield packed(list(held.items()), types)
                held = {}
        if held:
            yield packed(list(held.items()), types)

    def whole(table: pa.Table) -> tuple:
        out = None
        for r, n, mean, spread in zip(*(table[c].to_pylist() for c in ("__r", "__n", "__mean", "__spread")), strict=True):
            one = np.reshape(r, (-1, k)), n, mean, spread
            out = _merged(out, one) if out else one
        return out

    def types_of(table: pa.Table) -> list[pa.DataType]:
        return [table.schema.field(c).type for c in own]

    def merge(key, table):
        named = tuple(v.as_py() for v in key[:len(own)])
        return pa.Table.from_batches([packed([(named, whole(table))], types_of(table))])

    def solve(key, table):
        s = whole(table)
        beta, r2, condition = _solved(s, list(range(k - 1)))
        fewer = _solved(s, small) if small else (None, None, None)
        double, many = pa.float64(), pa.list_(pa.float64())
        values = [(s[1], pa.int64()), (beta, many), (r2, double), (condition, double), (fewer[0], many), (fewer[1], double), (fewer[2], double)]
        columns = [*(pa.array([v.as_py()], t) for v, t in zip(key, types_of(table), strict=False)), *(pa.array([v], t) for v, t in values)]
        return pa.Table.from_arrays(columns, names=[*own, "n", "beta", "r2", "condition", "reduced_beta", "reduced_r2", "reduced_condition"])

    parts = rows.mapInArrow(reduce, kinds + state).withColumn("__task", F.pmod(F.spark_partition_id(), F.lit(MERGING)))
    merged = parts.groupBy(*own, "__task").applyInArrow(merge, kinds + state)
    if not own:
        merged, last = merged.withColumn("__all", F.lit(1)), ["__all"]
    out = merged.groupBy(*(own or last)).applyInArrow(
        solve, kinds + "n long, beta array<double>, r2 double, condition double, reduced_beta array<double>, reduced_r2 double, reduced_condition double")
    return out.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def least_squares(df: DataFrame, terms: list[str], y: str) -> tuple[np.ndarray, float, float]:
    """(coefficients, R2, condition number) of a joint fit of a few terms over the whole table."""
    found = joint_fits(df, [], terms, y).first()
    if found is None:
        raise ValueError("no rows to fit")
    return np.array(found.beta), float("nan") if found.r2 is None else found.r2, found.condition


def threshold(kappa: Column, n_intervals: int, slope_samples: Column, slope_intervals: Column) -> Column:
    delta = slope_samples - slope_intervals
    return F.when(delta > 0, kappa * n_intervals / delta).otherwise(F.lit(float("inf")))


def crossover(c_samples: Column, s_samples: Column, c_intervals: Column, s_intervals: Column) -> Column:
    """Where two fitted lines meet; null if they never do for a positive number of series."""
    n = (c_intervals - c_samples) / (s_samples - s_intervals)
    return F.when((s_samples > s_intervals) & (n > 0), n)


def basis(length: Column, mode: str, depth: int = 6, div: int = 4) -> Column:
    return depth * length * (1 + 1 / div) if mode == "approx" else depth * length * (F.log2(length) - (depth - 1) / 2)


def dispatch_study(minima: DataFrame, n_intervals: int, depth: int = 6, div: int = 4) -> DataFrame:
    """minima(L, n, mode, variant, t_min) -> (mode, kappa, tau_scalar, tau_vec, delta, nl_threshold)."""
    lines = setup_and_marginal(minima.withColumnRenamed("t_min", "t"), ["L", "mode", "variant"])
    setup = lines.groupBy("L", "mode").pivot("variant", ["samples", "intervals"]).agg(F.first("setup"))
    kappa = aggregated(setup, ["mode"], [], {"kappa": ((F.col("intervals") - F.col("samples")) / n_intervals, 0.5)})
    x = F.when(F.col("mode") == "approx", basis(F.col("L"), "approx", depth, div)).otherwise(basis(F.col("L"), "exact", depth, div))
    tau = through_origin(lines.withColumn("x", x), ["mode", "variant"], "x", "marginal")
    both = tau.groupBy("mode").pivot("variant", ["samples", "intervals"]).agg(F.first("slope"))
    return kappa.join(both, "mode").select(
        "mode", "kappa", F.col("samples").alias("tau_scalar"), F.col("intervals").alias("tau_vec"), (F.col("samples") - F.col("intervals")).alias("delta"),
        threshold(F.col("kappa"), n_intervals, F.col("samples"), F.col("intervals")).alias("nl_threshold"))


def predicted(constants: DataFrame, grid: DataFrame, keys: list[str], n: str = "n", actual: str = "t") -> DataFrame:
    """constants(keys, setup, marginal) x grid(keys, n, actual) -> (keys, n, predicted, actual, error)."""
    both = grid.join(constants.select(*keys, "setup", "marginal"), keys)
    p = F.col("setup") + F.col("marginal") * F.col(n)
    return both.select(*keys, n, p.alias("predicted"), F.col(actual).alias("actual"), (p - F.col(actual)).alias("error"))


def overhead_residual(lines: DataFrame, slope: str, cost: Column) -> DataFrame:
    """Adds ``residual``: the fitted slope without the predicted processing cost of one series."""
    return lines.withColumn("residual", F.col(slope) - cost)


def constants_table(long: DataFrame, names: list[str]) -> DataFrame:
    """(estimator, constant, value) -> one row per estimator with a column per constant; each must be there once."""
    wide = long.groupBy("estimator").pivot("constant", names).agg(F.first("value").alias("v"), F.count("value").alias("n"))
    whole = F.forall(F.array(*[F.coalesce(F.col(f"{c}_n"), F.lit(0)) for c in names]), lambda n: n == 1)
    return wide.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a constant is missing or double")).cast("boolean"))).select(
        "estimator", *[F.col(f"{c}_v").alias(c) for c in names])


def holdout_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    miss, a = F.col(actual) - F.col(predicted), F.col(actual)
    mean = df.agg(F.avg(a).alias("__m")).withColumn("__k", F.lit(1))
    joined = df.withColumn("__k", F.lit(1)).join(F.broadcast(mean), "__k")
    return joined.agg(
        (1 - F.sum(miss * miss) / F.nullif(F.sum((a - F.col("__m")) * (a - F.col("__m"))), F.lit(0.0))).alias("r2"),
        (F.avg(F.abs(miss / a)) * 100).alias("mape"), (F.max(F.abs(miss / a)) * 100).alias("max_ape"))
