"""Series of many lengths in one job, and the plan that each block gets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadix import queries as Q
from dyadix.operators import features as X
from dyadix.operators.mixed import baseline_speedups, block_features, features_by_length, planned
from dyadix.operators.prefix import numbered
from dyadix.transformer import IntervalQuantiles

SCHEMA = "dataset string, id long, x array<double>"


def made(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return [(f"d{n}", i, rng.normal(size=n).tolist()) for i, n in enumerate(lengths)]


@pytest.mark.parametrize("length", [3, 16, 37, 65])
@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_both_plans_give_the_same_block(length, mode):
    z = np.random.default_rng(length).normal(size=(4, length))
    for lower in (False, True) if mode == "exact" else (False,):
        a, b = (block_features(z, mode, ("raw", "diff2", "fft_abs") if length > 3 else ("raw",), 6, 4, lower, p) for p in ("intervals", "samples"))
        assert np.allclose(a, b, atol=1e-12)
    assert np.allclose(X.width_block(z, "exact", 6, 4, False), X.exact_block(z))


def test_many_lengths_equal_one_at_a_time(spark):
    rows = made([3, 8, 8, 16, 33, 16, 100, 8, 33])
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = {r.id: r for r in features_by_length(df, ["dataset", "id"], "x", "exact", threshold=60.0).collect()}
    assert len(got) == len(rows)
    for n in {len(r[2]) for r in rows}:
        for r in X.interval_features(df.where(F.size("x") == n), ["id"], "x", n, "exact").collect():
            assert got[r.id].features == pytest.approx(r.features, abs=1e-9) and got[r.id].length == n and got[r.id].seconds > 0


def test_plan_by_data_set_and_by_batch(spark):
    df = spark.createDataFrame([("small", i, [float(i)] * 16) for i in range(3)] + [("large", i, [float(i)] * 16) for i in range(40)] + [(None, 1, [0.0] * 16)], SCHEMA)
    out = planned(df, "dataset", "x", "approx", 100.0)
    assert {(r.dataset, r.plan) for r in out.collect()} == {("small", "samples"), ("large", "intervals"), (None, "samples")}
    assert planned(df, "dataset", "x", "approx", 100.0, most_sets=0).count() == 44
    both = features_by_length(out, ["dataset", "id"], "x", "approx", ("raw",), plan="plan").collect()
    assert {r.plan for r in both if r.dataset == "large"} == {"intervals"} and {r.plan for r in both if r.dataset == "small"} == {"samples"}
    # by batch: two batches of 30 and 14 rows of one partition take different plans in one job
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        own = features_by_length(df.coalesce(1), ["id"], "x", "approx", ("raw",), threshold=300.0).groupBy("plan").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.plan: r["count"] for r in own} == {"intervals": 30, "samples": 14}


def test_estimator_over_files_decides_by_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=20).tolist()) for i in range(6)], "series_id long, x array<double>")
    df.write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    model = IntervalQuantiles(mode="exact").fit(files)
    assert model.strategy(None) == "auto"
    a, b = (m.transform(files).orderBy("series_id").collect() for m in (model, IntervalQuantiles(mode="exact", version="intervals").fit(files)))
    assert [r.features for r in a] == [pytest.approx(r.features) for r in b]
    with pytest.raises(Exception, match="finite points"):
        model.transform(files.withColumn("x", F.slice("x", 1, 9))).collect()


def test_bad_series_raise_and_no_rows_are_fine(spark):
    for bad in ([1.0, 2.0], None, [1.0, None, 2.0], [1.0, float("nan"), 2.0]):
        with pytest.raises(Exception, match="finite points"):
            features_by_length(spark.createDataFrame([("a", 1, bad)], SCHEMA), ["id"], "x").collect()
    assert features_by_length(spark.createDataFrame([], SCHEMA), ["id"], "x").count() == 0


def test_speedups(spark):
    out = baseline_speedups(spark.createDataFrame(made([24, 24, 48]), SCHEMA), "dataset", "x").orderBy("series_length").collect()
    assert [(r.dataset, r.series_length, r.n_samples) for r in out] == [("d24", 24, 2), ("d48", 48, 1)]
    assert all(r.speedup_exact == pytest.approx(r.baseline / r.exact) for r in out)


def test_a_user_of_many_events(spark):
    """Blocks of a user with 40,000 events stay that user's: ids of other users are not met."""
    ev = spark.range(40_000).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("value"))
    ev = ev.unionByName(ev.where("event_id < 70").withColumn("user_id", F.lit(2).cast("long"))).unionByName(ev.where("event_id < 3").withColumn("user_id", F.lit(None).cast("long")))
    out = Q.event_series(Q.numbered_events(ev), 32).collect()
    assert len(out) == 1250 + 3 + 1 and all(len(r.v) == len(r.g) == 32 for r in out)
    by = {(r.user_id, r.block): r for r in out}
    assert by[1, 1001].v[0] == 1001 * 32 and by[2, 1].v[0] == 32 and by[2, 2].v == [64.0 + i for i in range(6)] + [69.0] * 26
    gap = 7e6 / 3141592653.59
    assert by[1, 0].g[0] == 0 and by[1, 5].g[0] == pytest.approx(gap) and by[None, 0].g[1] == pytest.approx(gap)
    made = X.channel_features(spark.createDataFrame(out[:5], "user_id long, block long, v array<double>, g array<double>"), ["user_id", "block"], ["v", "g"], 32)
    assert made.count() == 5


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("o")).withColumn("k", F.when(F.col("k") < 2, F.col("k")))
    for few in (1 << 16, 0):
        rows = numbered(df, ["k"], ["o"], "pos", few).collect()
        assert len(rows) == 1000
        for k in (0, 1, None):
            own = sorted((r.o, r.pos) for r in rows if r.k == k)
            assert [p for _, p in own] == list(range(len(own)))


def test_channels_in_one_call_equal_the_join(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=20).tolist(), rng.normal(size=20).tolist()) for i in range(4)]
    wide = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    long = wide.select("id", F.posexplode(F.array("a", "b")).alias("channel", "x"))
    want = X.join_channels(X.interval_features(long, ["id", "channel"], "x", 20, "exact"), "id", "channel", 20).orderBy("id").collect()
    got = X.channel_features(wide, ["id"], ["a", "b"], 20, "exact").orderBy("id").collect()
    assert [r.features for r in got] == [pytest.approx(r.features) for r in want]
