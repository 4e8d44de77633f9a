import json
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadix.operators import fits, metrics, relational
from dyadix.operators.classify import ExtraTrees, RidgeCV
from dyadix.plans import dispatch
from dyadix.sources import series


def test_resample(spark, tmp_path):
    (tmp_path / "TRAIN.txt").write_text("3\n0\n4\n")
    idx = series.read_resample(spark, str(tmp_path / "TRAIN.txt"))
    rows = spark.createDataFrame([("d", i, chr(97 + i)) for i in range(6)], "dataset string, i long, label string")
    pool = series.pooled(rows.where("i < 3"), rows.where("i >= 3"), "i")
    train, test = series.resample(pool, idx)
    assert [r.pool_id for r in train.orderBy("line_no").collect()] == [3, 0, 4]
    assert sorted(r.pool_id for r in test.collect()) == [1, 2, 5]
    index = series.label_index(rows.where("i < 3"), "label")
    assert {r.label: r.y for r in index.collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(Exception, match="unknown label"):
        series.with_label(rows, index, "label").collect()


def test_ts_reader(spark, tmp_path):
    (tmp_path / "a.ts").write_text("# c\n@problemName x\n@data\n1,2,3:4,5,6:yes\n7,?,9:1,1,1:no\n")
    got = series.read_ts(spark, str(tmp_path / "a.ts")).orderBy("line", "channel").collect()
    assert [(r.label, r.channel, r.x) for r in got] == [("yes", 0, [1, 2, 3]), ("yes", 1, [4, 5, 6]), ("no", 0, [7, None, 9]), ("no", 1, [1, 1, 1])]
    (tmp_path / "b.tsv").write_text("1\t0.5\t0.25\n")
    r = series.read_tsv(spark, str(tmp_path / "b.tsv")).first()
    assert (r.label, r.x) == ("1", [0.5, 0.25])
    df = series.read_ts(spark, str(tmp_path / "a.ts")).withColumn("dataset", F.lit("a"))
    with pytest.raises(Exception, match="missing"):
        series.equal_length(df, ["dataset"]).collect()


def test_wide_runs(spark, tmp_path):
    rows = spark.createDataFrame([(16, r, 1.0 + r) for r in range(3)], "L int, run int, runtime double")
    series.write_wide_runs(rows, str(tmp_path / "w"), "L", 3)
    got = series.read_wide_runs(spark, str(tmp_path / "w"), "L").first()
    assert (got.L, got.best) == (16, 1.0)


def test_gaussian(spark):
    x = np.array([r.x for r in series.gaussian(spark, 200, 50, 3).collect()])
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05
    assert np.array_equal(x, np.array([r.x for r in series.gaussian(spark, 200, 50, 3).orderBy("series_id").collect()]))


def test_metrics_small(spark):
    df = spark.createDataFrame([(1, 1, [0.2, 0.8]), (0, 1, [0.4, 0.6]), (0, 0, [0.4, 0.6]), (1, 0, [0.9, 0.1])], "y int, pred int, proba array<double>").withColumn("k", F.lit(1))
    m = metrics.all_metrics(df, ["k"], 2).first()
    assert m.accuracy == 0.5 and m.balanced_accuracy == 0.5 and m.roc_auc == 0.5 and m.f1 == 0.5
    one = spark.createDataFrame([(0, 0, 0.5), (0, 0, 0.1)], "y int, pred int, p double").withColumn("k", F.lit(1))
    assert metrics.roc_auc(one, ["k"], "y", "p").first().roc_auc is None


def test_paired_tests(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b)) for a, b in zip(rng.normal(0.3, 1, 12), rng.normal(size=12), strict=True)]
    w = metrics.wilcoxon_sums(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    d = np.array([a - b for a, b in rows])
    ranks = np.argsort(np.argsort(abs(d))) + 1
    assert w.w_plus == ranks[d > 0].sum() and w.n == 12 and w.tie_term == 0
    assert metrics.wilcoxon_greater(78, 12) == pytest.approx(1 / 4096)
    assert metrics.t_greater(0.0, 9) == pytest.approx(0.5, abs=1e-4)
    assert metrics.t_greater(1.833, 9) == pytest.approx(0.05, abs=1e-3)


def test_fits(spark):
    rows = [(8, n, 2.0 + 3.0 * n) for n in (1, 3, 10, 30)]
    f = fits.setup_and_marginal(spark.createDataFrame(rows, "L int, n int, t double"), ["L"]).first()
    assert (f.setup, f.marginal, f.r2) == pytest.approx((2, 3, 1))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    t = x @ [1.0, -2.0, 3.0]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, t, strict=True)], "a double, b double, c double, t double").repartition(3)
    beta, r2, condition = fits.least_squares(df, ["a", "b", "c"], "t")
    assert beta == pytest.approx([1, -2, 3]) and r2 == pytest.approx(1) and condition < 5


def test_bins_and_lists(spark):
    df = spark.createDataFrame([(n,) for n in (10, 20, 40, 80, 160)], "len int")
    assert [r.bin for r in relational.length_bins(df, "len").orderBy("len").collect()] == [1, 1, 2, 3, 4]
    assert relational.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert relational.require_complete(b, a, ["k"]).count() == 1
    with pytest.raises(Exception, match="no partner"):
        relational.require_complete(a, b, ["k"]).collect()


def test_dispatch(spark, tmp_path):
    dispatch.reset()
    path = tmp_path / "c.json"
    cols = "mode string, depth int, div int, delta double, nl_threshold double"
    got = dispatch.calibrate(spark.createDataFrame([("approx", 6, 4, 1.0, 99.0), ("exact", 6, 4, -1.0, 5.0)], cols), path=path)
    assert got == {"approx": 99.0, "exact": inf} and json.loads(path.read_text())["exact"]["value"] == -1
    assert dispatch.blocks_pay("approx", 10, 10) and not dispatch.blocks_pay("exact", 10 ** 9, 10)
    assert dispatch.mismatch("approx", 5, 4) and not dispatch.mismatch("approx", 6, 4)
    dispatch.reset()
    assert dispatch.threshold("approx") == dispatch.DEFAULTS["approx"]
    with pytest.warns(UserWarning):
        assert dispatch.load_cached(path)["exact"] == inf
    path.write_text('{"approx": 7}')
    assert dispatch.load_cached(path) == {"approx": 7.0}
    with pytest.raises(ValueError):
        dispatch.calibrate(spark.createDataFrame([("approx", 6, 4, 1.0, 99.0)] * 2, cols), modes=("approx",), path=path)
    dispatch.reset(delete_cache=True, path=path)
    assert not path.exists()


@pytest.mark.parametrize("kind", ["ridge", "extra"])
def test_classifiers_separate(spark, kind):
    rng = np.random.default_rng(0)
    y = np.arange(90) % 3
    x = rng.normal(size=(90, 12)) + 4 * np.eye(12)[y]
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x, strict=True)], "y int, features array<double>")
    model = RidgeCV(3).fit(df) if kind == "ridge" else ExtraTrees(3, trees=12, share=0.5).fit(df)
    out = model.transform(df)
    pred = out if kind == "ridge" else out.withColumn("pred", metrics.argmax(F.col("proba")))
    assert metrics.accuracy(pred.withColumn("k", F.lit(1)), ["k"]).first().accuracy > 0.9
    if kind == "ridge":
        # leave-one-out errors in closed form equal refitting
        z = np.hstack([x, np.ones((90, 1))])
        t = np.where(np.eye(3)[y] > 0, 1.0, -1.0)

        def loss(a):
            total = 0.0
            for i in range(90):
                keep = np.arange(90) != i
                m, mt = x[keep].mean(0), t[keep].mean(0)
                c = x[keep] - m
                beta = np.linalg.solve(c.T @ c + a * np.eye(12), c.T @ (t[keep] - mt))
                total += ((t[i] - mt - (x[i] - m) @ beta) ** 2).sum()
            return total

        assert model.alpha == pytest.approx(min(np.logspace(-3, 3, 10), key=loss)) and z.shape[1] == 13


def test_joint_fits_by_group(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, n, shift in ((None, 40, 0.0), ("a", 900, 1e6), ("b", 2, 0.0), ("flat", 5, 0.0), ("thin", 60, 0.0)):
        x = rng.normal(size=(n, 2)) + shift
        if g == "thin":
            x[:, 1] = x[:, 0] * 3  # of lower rank
        t = np.full(n, 7.0) if g == "flat" else 2 + x @ [1.0, -2.0] + rng.normal(size=n)
        want[g] = (np.column_stack([np.ones(n), x]), t)
        rows += [(g, 1.0, *map(float, r), float(v)) for r, v in zip(x, t, strict=True)]
    rows += [("a", 1.0, None, 1.0, 1.0), ("a", 1.0, 1.0, float("nan"), 1.0), ("a", 1.0, 1.0, 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "n string, one double, a double, b double, t double").repartition(7)
    got = {r[0]: r for r in fits.joint_fits(df, ["n"], ["one", "a", "b"], "t", ["one", "a"]).collect()}
    assert set(got) == set(want)
    for g, (x, t) in want.items():
        r = got[g]
        beta = np.linalg.lstsq(x, t, rcond=None)[0]
        fewer = np.linalg.lstsq(x[:, :2], t, rcond=None)[0]
        assert r[1] == len(t)
        assert np.allclose(r.beta, beta, rtol=1e-5, atol=1e-4) and np.allclose(r.reduced_beta, fewer, rtol=1e-5, atol=1e-4)
        if g == "flat":
            assert r.r2 is None
        else:
            assert r.r2 == pytest.approx(1 - ((t - x @ beta) ** 2).sum() / ((t - t.mean()) ** 2).sum(), abs=1e-6)
        if g in (None, "a"):
            assert r.condition == pytest.approx(np.linalg.cond(x), rel=1e-4)
        if g == "thin":
            assert r.condition > 1e12
    assert fits.joint_fits(df.where("false"), ["n"], ["one", "a"], "t").count() == 0
    assert fits.joint_fits(df, [], ["one", "a"], "t").first().n == sum(len(t) for _, t in want.values()) + 1


def test_factors_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(fits, "HELD_GROUPS", 10)
    df = spark.range(3000).select((F.col("id") % 300).alias("g"), F.lit(1.0).alias("one"), (F.col("id") / 300).alias("x")).withColumn("t", F.col("g") + F.col("g") * F.col("x"))
    got = fits.joint_fits(df, ["g"], ["one", "x"], "t").collect()
    assert len(got) == 300 and all(r.n == 10 and np.allclose(r.beta, r.g, atol=1e-8) for r in got)


def test_no_r2_of_rounding(spark):
    """Values that differ in their last bit only have no spread to explain."""
    rows = [(float(i), 3.0 if i % 2 else 3.0000000000000004) for i in range(1, 9)]
    found = fits.joint_fits(spark.createDataFrame(rows, "a double, y double"), [], ["a"], "y", ["a"]).first()
    assert found.r2 is None and found.reduced_r2 is None and found.n == 8
    some = fits.joint_fits(spark.createDataFrame([(a, y + a * 1e-9) for a, y in rows], "a double, y double").selectExpr("1.0D AS one", "a", "y"), [], ["one", "a"], "y").first()
    assert some.r2 > 0.99
