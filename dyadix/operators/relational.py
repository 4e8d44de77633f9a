"""The relational studies of runtimes and scores: minima over repeats, shares, pivots, speed-ups, bins.

Fact tables keep the columns of the published schemas in snake case: runtimes
(dataset, split, estimator, run, runtime) and scores (dataset, resample,
estimator, accuracy, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.operators.quantiles import FEW, aggregated


def min_over_runs(df: DataFrame, keys: list[str], value: str = "runtime", out: str = "t_min") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(out))


def sum_of_min_over_splits(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """The least runtime of each split, added up: both aggregates combine before they shuffle."""
    return min_over_runs(df, [*keys, split]).groupBy(*keys).agg(F.sum("t_min").alias("transform_time"))


def mean_by(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def summary_by_bin(df: DataFrame, keys: list[str], score: str, runtime: str, item: str) -> DataFrame:
    return aggregated(df, keys, [F.avg(score).alias("mean_score"), F.count("*").alias("n"), F.countDistinct(item).alias("n_items")],
                      {"median_runtime": (F.col(runtime), 0.5)}).select(*keys, "mean_score", "median_runtime", "n", "n_items")


def share_of_total(df: DataFrame, within: list[str], value: str, out: str = "share") -> DataFrame:
    """Totals are combined before they move and joined back (a null key has no share)."""
    total = df.groupBy(*within).agg(F.sum(value).alias("__total"))
    if total.count() <= FEW:  # no row of a hot group moves
        total = F.broadcast(total)
    return df.join(total, within).withColumn(out, F.col(value) / F.col("__total")).drop("__total")


def pivot_mean(df: DataFrame, keys: list[str], column: str, names: list, value: str) -> DataFrame:
    """One column per name; the names are given, so no job looks for them."""
    return df.groupBy(*keys).pivot(column, names).agg(F.avg(value))


def pivot_two_levels(df: DataFrame, keys: list[str], columns: list[str], names: list[str], value: str) -> DataFrame:
    return pivot_mean(df.withColumn("__both", F.concat_ws("_", *columns)), keys, "__both", names, value)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "stage", value: str = "time") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def speedup(base: DataFrame, other: DataFrame, keys: list[str], value: str = "t_min") -> DataFrame:
    """Inner join on the keys and the ratio base / other."""
    a, b = base.select(*keys, F.col(value).alias("t_base")), other.select(*keys, F.col(value).alias("t_other"))
    return a.join(b, keys).withColumn("speedup", F.col("t_base") / F.col("t_other"))


def require_complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left``, or an error inside the job if ``right`` misses one of its keys."""
    missing = left.join(right.select(*keys).distinct().withColumn("__there", F.lit(True)), keys, "left")
    return missing.where(F.coalesce(F.col("__there"), F.raise_error(F.lit("a key has no partner")).cast("boolean"))).drop("__there")


def exclude_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(cells, cells.columns, "left_anti")


def map_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left look-up in a small table; unknown keys give null."""
    return df.join(table, key, "left")


def drop_null_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one of least ``order``: a combined minimum, no sort of whole groups."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__r")).select(key, "__r.*")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def one_row(df: DataFrame, condition: Column) -> DataFrame:
    """The single row that meets the condition; none or several raise inside the job."""
    found = df.where(condition)
    n = found.agg(F.count("*").alias("__n"))
    ok = n.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.col("__n").cast("string"), F.lit(" rows, not one"))).cast("boolean")))
    return ok.withColumn("__k", F.lit(1)).join(found.withColumn("__k", F.lit(1)), "__k", "left").drop("__k", "__n")


def quadrant_counts(df: DataFrame, x: str, y: str, x0: float = 1.0, y0: float = 0.0) -> DataFrame:
    a, b = F.col(x) >= x0, F.col(y) >= y0
    return df.agg(
        F.count_if(a & b).alias("faster_better"), F.count_if(a & ~b).alias("faster_worse"),
        F.count_if(~a & b).alias("slower_better"), F.count_if(~a & ~b).alias("slower_worse"))


def error_summary(df: DataFrame, keys: list[str], error: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_abs_error"), F.max(F.abs(error)).alias("max_abs_error"))


def row_minimum(df: DataFrame, columns: list[str], out: str = "best") -> DataFrame:
    return df.withColumn(out, F.least(*columns))


def winner(df: DataFrame, keys: list[str], variant: str, value: str) -> DataFrame:
    """The variant of least value per key and how much slower the other one is, in percent."""
    return df.groupBy(*keys).agg(
        F.min_by(variant, F.struct(value, variant)).alias("winner"), ((F.max(value) / F.min(value) - 1) * 100).alias("percent_slower"))


def grid(spark, **axes) -> DataFrame:
    """Every combination of a few parameter lists, one row each, made from literal arrays."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in a seeded order that is the same on every engine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in df.columns])), *df.columns)


def bin_edges(lengths: DataFrame, column: str) -> DataFrame:
    """Quartiles of the logarithm, back on the scale of the lengths, the outer two moved out by one."""
    edges = aggregated(lengths, [], [], {"q": (F.ln(column), [0.0, 0.25, 0.5, 0.75, 1.0])})
    return edges.select(
        (F.exp(F.get("q", F.lit(0))) - 1).alias("e0"), *[F.exp(F.get("q", F.lit(i))).alias(f"e{i}") for i in (1, 2, 3)], (F.exp(F.get("q", F.lit(4))) + 1).alias("e4"))


def bin_number(value: Column, slack: float = 1e-9) -> Column:
    """1 to 4, closed on the right; a value on an edge stays below it whatever the rounding."""
    out = F.lit(4)
    for i in (3, 2, 1):
        out = F.when(value <= F.col(f"e{i}") * (1 + slack), F.lit(i)).otherwise(out)
    return out


def length_bins(lengths: DataFrame, column: str) -> DataFrame:
    """Each row with its quartile bin; the single row of edges is broadcast."""
    edges = bin_edges(lengths, column)
    joined = lengths.withColumn("__k", F.lit(1)).join(F.broadcast(edges.withColumn("__k", F.lit(1))), "__k")
    return joined.withColumn("bin", bin_number(F.col(column))).drop("__k", "e0", "e1", "e2", "e3", "e4")


def fixed_labels(df: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """Every label once, in its order, with nulls where ``df`` has none."""
    return labels.join(df, key, "left").orderBy(order)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
