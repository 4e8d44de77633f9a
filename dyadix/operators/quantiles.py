"""Exact quantiles of groups of any size: selection in rounds.

The engine's own exact percentile gathers a group's distinct values in one task. It is used
where every group is small. In a large group each wanted rank has a range of values that
holds it; a round counts the range's values in BINS bins (a combined aggregate, at most BINS rows
for each rank), keeps the bin that the rank falls in, and goes on with that bin's least and
greatest value, until these are equal. Bins are even on the plain and on a logarithmic scale by turns, so values of
any spread are parted. No task holds more of a group than its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadix.sources.shared import written

BINS = 1024
SMALL = 100_000  # values of a group that may meet in one task
FEW = 1 << 16  # rows of a table of ranks that is broadcast
ROUNDS = 200


def _log(v: Column) -> Column:
    """Rises with the value; even steps are even ratios, down to the least number."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _keys(keys: list[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def _match(keys: list[str]) -> Column:
    same = F.lit(True)
    for k, own in zip(keys, _keys(keys), strict=True):
        same = same & F.col(k).eqNullSafe(F.col(own))
    return same


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(*keys, rank, found): the value of each rank (from 0, by size) of ``ranks(*keys, rank)``. Values must be finite."""
    values = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    values = written(values.where(F.when(F.abs("__v") < float("inf"), F.lit(True)).otherwise(F.raise_error(F.lit("quantiles need finite values")).cast("boolean"))))
    wanted = ranks.distinct()
    ends = values.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high")).select(*[F.col(k).alias(o) for k, o in zip(keys, _keys(keys), strict=True)], "__low", "__high")
    open_ = written(wanted.join(ends, _match(keys)).select(*keys, "rank", "__low", "__high", F.lit(0).cast("long").alias("__below")))
    done = None
    for turn in range(ROUNDS):
        closed = open_.where("__low = __high").select(*keys, "rank", F.col("__low").alias("found"))
        done = closed if done is None else done.unionByName(closed)
        open_ = open_.where("__low < __high")
        left = open_.count()
        if not left:
            return done
        scale = (lambda v: v) if turn % 2 == 0 else _log
        own = open_.select(*[F.col(k).alias(o) for k, o in zip(keys, _keys(keys), strict=True)], "rank", "__low", "__high", "__below")
        held = values.join(F.broadcast(own) if left <= FEW else own, _match(keys) & (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
        # halves first: the range of two finite numbers may not be finite
        part = (scale(F.col("__v")) / 2 - scale(F.col("__low")) / 2) / (scale(F.col("__high")) / 2 - scale(F.col("__low")) / 2)
        place = F.when(F.col("__v") == F.col("__high"), BINS - 1).otherwise(F.least(F.floor(F.coalesce(part, F.lit(0.0)) * BINS).cast("int"), F.lit(BINS - 1)))
        bins = held.groupBy(*keys, "rank", "__below", place.alias("__bin")).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = F.col("__below") + F.sum("__n").over(Window.partitionBy(*keys, "rank").orderBy("__bin"))  # at most BINS rows
        open_ = written(bins.withColumn("__upto", upto).where("rank < __upto and rank >= __upto - __n").select(
            *keys, "rank", "__low", "__high", (F.col("__upto") - F.col("__n")).alias("__below")))
    raise RuntimeError("the ranks did not settle")


def largest_group(df: DataFrame, keys: list[str], values: list[str]) -> int:
    """The most values that one group has in one of the columns."""
    n = df.groupBy(*keys).agg(F.greatest(F.lit(0), *[F.count(v) for v in values]).alias("n"))
    return n.agg(F.max("n")).first()[0] or 0


def selected_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], out: str) -> DataFrame:
    """(*keys, out array<double>): exact quantiles with linear interpolation by selection; a group without values has null."""
    n = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    sizes = written(n)
    place = F.lit(qs)
    at = lambda i: F.get(place, i) * (F.col("__n") - 1)
    every = F.sequence(F.lit(0), F.lit(len(qs) - 1))
    wanted = sizes.where("__n > 0").select(*keys, F.explode(F.array_distinct(F.flatten(F.transform(every, lambda i: F.array(F.floor(at(i)), F.ceil(at(i))))))).alias("rank"))
    found = select_ranks(df, keys, value, wanted)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("__m"))  # two ranks for each quantile
    by_rank = by_rank.select(*[F.col(k).alias(o) for k, o in zip(keys, _keys(keys), strict=True)], "__m")

    def one(i: Column) -> Column:
        low, high, rest = F.try_element_at("__m", F.floor(at(i))), F.try_element_at("__m", F.ceil(at(i))), at(i) - F.floor(at(i))
        return F.when(rest == 0, low).otherwise(low * (1 - rest) + high * rest)

    joined = sizes.join(by_rank, _match(keys), "left")
    return joined.select(*keys, F.when(F.col("__n") > 0, F.transform(every, one)).alias(out))


def aggregated(df: DataFrame, keys: list[str], aggregates: list[Column], quantiles: dict[str, tuple[Column, float | list[float]]], small: int = SMALL) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggregates)`` and exact quantiles, ``{name: (values, q or several)}``, whatever the size of a group.

    Where no group has over ``small`` values, one aggregate does all; else the quantiles are selected in rounds and joined."""
    named = df.withColumns({f"__q{i}": v.cast("double") for i, (v, _) in enumerate(quantiles.values())})
    if largest_group(named, keys, [f"__q{i}" for i in range(len(quantiles))]) <= small:
        exact = [F.percentile(f"__q{i}", F.lit(q) if isinstance(q, float) else F.array(*map(F.lit, q))).alias(name) for i, (name, (_, q)) in enumerate(quantiles.items())]
        return named.groupBy(*keys).agg(*aggregates, *exact)
    out = named.groupBy(*keys).agg(F.count("*").alias("__rows"), *aggregates).drop("__rows")
    for i, (name, (_, q)) in enumerate(quantiles.items()):
        one = selected_quantiles(named, keys, f"__q{i}", [q] if isinstance(q, float) else list(q), "__values")
        value = F.get("__values", F.lit(0)) if isinstance(q, float) else F.col("__values")
        one = one.select(*[F.col(k).alias(o) for k, o in zip(keys, _keys(keys), strict=True)], value.alias(name))
        out = out.join(one, _match(keys), "left").drop(*_keys(keys)) if keys else out.withColumn("__one", F.lit(1)).join(one.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return out
