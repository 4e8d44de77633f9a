from dyadix import studies
from dyadix.plans import costmodel


def test_small_grid_and_calibration(spark):
    runs = studies.timed_grid(spark, [16, 32], [1, 4], 1)
    assert runs.count() == 2 * 2 * 2 * 2 and runs.where("runtime <= 0").count() == 0
    assert {r["mode"] for r in studies.calibration(runs).collect()} == {"approx", "exact"}


def test_classification(spark, monkeypatch):
    monkeypatch.setattr(studies, "SMOKE", True)
    pool, idx = studies._main_data(spark, "/root/testdata/sf0.001")
    out = studies.classification_benchmark(pool, idx, modes=("approx",), classifiers=("extra_trees", "ridge")).collect()
    assert [r.estimator for r in out] == ["approx/extra_trees", "approx/ridge"] and all(0 <= r.accuracy <= 1 for r in out)


def test_tables(spark, capsys):
    k = costmodel.overhead_curve(4e-5, 2e-4)
    t = studies.prediction_table(spark, "approx", [64, 128], [1, 1000], (1e-8,) * 3, k, (2e-8,) * 3, k)
    assert t.count() == 4
    truth = spark.createDataFrame([(64, 1, 1.0, 2.0), (1024, 10_000, 2.0, 1.0)], "L int, n int, samples double, intervals double")
    assert studies.decisions_against_truth(spark, truth, "approx").first().hit_rate == 1
    scores = spark.createDataFrame([(1, "d", "a", 0.9, 1.0), (1, "d", "b", 0.8, 3.0)], "bin int, dataset string, estimator string, score double, runtime double")
    r = studies.expected_accuracy_delta(scores, "a", "b").first()
    assert abs(r.mean_delta - 0.1) < 1e-9 and r.mean_speedup == 3 and r.n_datasets == 1
    assert studies.width_basis(64)["n_quantiles"] > 0
    studies.main(["--list"])
    assert "timed_grid" in capsys.readouterr().out
