"""Exact quantiles by selection in rounds, against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadix.operators import quantiles as K

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def groups(seed):
    rng = np.random.default_rng(seed)
    return {
        "even": rng.uniform(-5, 5, 3001), "ties": rng.integers(0, 4, 2000) * 0.1, "one": np.array([7.25]), "same": np.full(500, -3.0),
        "wide": np.concatenate([10.0 ** rng.uniform(-200, 200, 700), -(10.0 ** rng.uniform(-200, 200, 701)), [0.0]]),
        "close": 1.0 + np.arange(900) * 2.0 ** -52, None: rng.normal(size=400) * 1e-9, "ends": np.array([-1.7e308, 1.7e308, 0.0, 5.0])}


def frame(spark, data):
    rows = [(k, float(v)) for k, own in data.items() for v in own] + [("even", None), ("nulls", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_groups_of_every_kind(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW", few)
    data = groups(1)
    got = {r.k: r.q for r in K.selected_quantiles(frame(spark, data), ["k"], "v", QS, "q").collect()}
    assert got.pop("nulls") is None and set(got) == set(data)
    for k, own in data.items():
        s, place = np.sort(own), np.array(QS) * (len(own) - 1)
        low, high, rest = s[np.floor(place).astype(int)], s[np.ceil(place).astype(int)], place % 1
        assert got[k] == pytest.approx(np.where(rest == 0, low, low * (1 - rest) + high * rest), rel=1e-12, abs=0), k


def test_a_million_distinct_values(spark, monkeypatch):
    """A round's table has at most BINS rows for each rank, however many values there are."""
    seen, n = [], 1_000_000
    own = K.written
    monkeypatch.setattr(K, "written", lambda df: (lambda t: (seen.append((t.columns, t.count())), t)[1])(own(df)))
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    assert K.selected_quantiles(df, [], "v", [0.5, 0.333], "q").first().q == pytest.approx([(n - 1) / 2, 0.333 * (n - 1)], rel=1e-15)
    tables = [count for columns, count in seen if "__below" in columns]
    assert len(tables) <= 4 and max(tables) <= 4  # two ranks for each quantile; a thousand bins in each of two or three rounds


def test_both_roads_of_an_aggregate(spark):
    df = frame(spark, groups(2)).where("k <> 'wide' and k <> 'ends' or k is null")
    a, b = (sorted(map(tuple, K.aggregated(df, ["k"], [F.count("*").alias("n"), F.avg("v").alias("m")], {"p": (F.col("v"), 0.5), "qs": (F.col("v") * 2, [0.25, 0.75])}, small=s)
                       .select("k", "n", "m", "p", "qs").collect()), key=str) for s in (10**9, 10))
    assert len(a) == len(b) == 7
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and (x[2] is None and y[2:4] == (None, None) or x[2:4] == pytest.approx(y[2:4]) and x[4] == pytest.approx(y[4]))
    one = K.aggregated(df, [], [F.count("*").alias("n")], {"p": (F.col("v"), 0.5)}, small=10).first()
    assert one.n == df.count() and one.p == pytest.approx(df.agg(F.percentile("v", F.lit(0.5))).first()[0])


def test_no_rows_and_bad_values(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert K.selected_quantiles(none, ["k"], "v", QS, "q").count() == 0
    with pytest.raises(Exception, match="finite"):
        K.selected_quantiles(spark.createDataFrame([("a", float("inf")), ("a", 1.0)], "k string, v double"), ["k"], "v", QS, "q").collect()
