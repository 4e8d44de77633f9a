import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadix import studies
from dyadix.operators import fitgrid, trees
from dyadix.operators.classify import RidgeCV

SCORES = studies.SCORES


def _pool(spark, sets):
    """Noisy waves: (dataset, pool_id, label, x) for {dataset: (rows, length, classes)}."""
    rng = np.random.default_rng(5)
    rows = [(d, i, "abc"[i % k], (np.sin(np.arange(m) * (1 + i % k) / 4) + rng.normal(0, 1.5, m)).tolist()) for d, (n, m, k) in sets.items() for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, pool_id long, label string, x array<double>").repartition(5)


def _indices(spark, pairs):
    return spark.createDataFrame([(d, r, i) for d, r, own in pairs for i in own], "dataset string, resample int, idx long")


def test_grid_equals_the_loop(spark):
    pool = _pool(spark, {"two": (45, 16, 2), "three": (60, 24, 3)})
    pick = {(d, r): [i for i in range(n) if (i * 7 + r) % 5 > 1] for d, n in (("two", 45), ("three", 60)) for r in (0, 1, 2)}
    indices = _indices(spark, [(d, r, own) for (d, r), own in pick.items()])
    grid = {(r.dataset, r.resample, r.estimator): r for r in studies.classification_grid(pool, indices, ("approx",), n_trees=6, tasks=4).collect()}
    assert len(grid) == 2 * 3 * 3 and all(r.error is None for r in grid.values())
    for d in ("two", "three"):
        resamples = {r: indices.where(f"dataset = '{d}' and resample = {r}").select(F.lit(0).alias("line_no"), "idx") for r in ((0, 1, 2) if d == "three" else (0,))}
        for want in studies.classification_benchmark(pool.where(F.col("dataset") == d), resamples, ("approx",), n_trees=6).collect():
            got = grid[d, want.resample, want.estimator]
            assert [got[s] for s in SCORES] == pytest.approx([want[s] for s in SCORES], abs=1e-9), want.estimator
            assert got.runtime == pytest.approx(sum(got[s] for s in studies.STAGE_SECONDS)) and got.runtime > 0
    assert len({round(r.accuracy, 6) for r in grid.values()}) > 3  # the scores tell the cells apart


def test_failures_are_rows(spark):
    pool = _pool(spark, {"good": (30, 16, 2), "gap": (20, 16, 2), "mixed": (20, 16, 2), "short": (6, 2, 2), "large": (40, 64, 2)})
    i = F.col("pool_id")
    pool = pool.withColumn("x", F.when((F.col("dataset") == "gap") & (i == 3), F.array(F.lit(float("nan")))).when((F.col("dataset") == "mixed") & (i == 1), F.slice("x", 1, 9)).otherwise(F.col("x")))
    some = list(range(0, 20, 3))
    indices = _indices(spark, [(d, 0, some) for d in ("good", "gap", "mixed", "short", "none")] + [("large", 0, range(0, 40, 3)), ("good", 1, range(0, 30, 2)), ("good", 2, range(30)), ("good", 3, [99])])
    out = studies.classification_grid(pool, indices, ("approx",), ("ridge",), cell_bytes=150_000, tasks=4).collect()
    got = {(r.dataset, r.resample): (r.error, r.accuracy is not None) for r in out}
    assert got == {("good", 0): (None, True), ("large", 0): (None, True), ("good", 1): ("unknown label b", False), ("good", 2): ("no rows to test on", False),
                   ("good", 3): ("no rows to learn from", False), ("gap", 0): ("missing points", False), ("mixed", 0): ("unequal lengths", False),
                   ("short", 0): ("fewer than 3 points", False), ("none", 0): ("no series", False)}
    assert len(out) == len(got)
    lengths = [64]
    sized = fitgrid.shapes(pool.where("dataset = 'large'")).select(fitgrid.feature_bytes(F.col("n"), F.col("length"), lengths).alias("b")).first().b
    assert sized > 150_000  # that set went through the distributed classifiers


def test_bagged_trees():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(80, 6)), 1)
    y = (x[:, 0] + x[:, 3] > 0).astype(int)
    turned = rng.permutation(80)
    a, b = trees.in_own_order(x, y), trees.in_own_order(x[turned], y[turned])
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    t = trees.bagged(*a, 2, 6, 3, 1)
    # the first cut against every cut of every feature
    sample = np.repeat(np.arange(80), np.random.default_rng((3, 1)).multinomial(80, np.full(80, 1 / 80)))
    u, v = a[0][sample], np.eye(2, dtype=int)[a[1][sample]]
    costs = [float(trees.cost_of(v[u[:, f] <= c].sum(0)) + trees.cost_of(v[u[:, f] > c].sum(0))) for f in range(6) for c in np.unique(u[:, f])[:-1]]
    low = u[:, t.feature[0]] <= t.cut[0]
    assert float(trees.cost_of(v[low].sum(0)) + trees.cost_of(v[~low].sum(0))) == pytest.approx(min(costs), abs=1e-8)
    assert t.proba()[trees.walk(t.packed(), u)].argmax(1).tolist() == v.argmax(1).tolist()
    near = trees.bagged(np.array([[1.0], [np.nextafter(1.0, 2)]] * 10), np.array([0, 1] * 10), 2, 1, 0, 0)
    assert near.proba()[trees.walk(near.packed(), np.array([[1.0], [np.nextafter(1.0, 2)]]))].argmax(1).tolist() == [0, 1]


def test_ridge_block_equals_the_sums(spark):
    rng = np.random.default_rng(4)
    for n, width in ((60, 7), (15, 40)):
        x = rng.normal(size=(n, width))
        y = np.argmax(x[:, :3] + rng.normal(0, 1, (n, 3)), axis=1)
        rows = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(y, x, strict=True)], "y int, features array<double>")
        a, b = RidgeCV(3).fit(rows), RidgeCV(3).fit_block(x, y)
        assert a.alpha == b.alpha and np.allclose(a.beta, b.beta, atol=1e-8) and np.allclose(a.intercept, b.intercept, atol=1e-8)


def test_large_cells_fail_for_the_same_reasons(spark):
    """The reasons do not depend on the size at which a data set goes through the distributed classifiers."""
    pool = _pool(spark, {"good": (30, 16, 2)})
    indices = _indices(spark, [("good", 1, range(0, 30, 2)), ("good", 2, range(30)), ("good", 3, [99])])
    found = [{(r.resample, r.estimator): (r.error, r.accuracy) for r in studies.classification_grid(pool, indices, ("approx",), n_trees=2, cell_bytes=b, tasks=4).collect()} for b in (0, 1 << 20)]
    assert found[0] == found[1] and len(found[0]) == 9
    assert {e for e, _ in found[0].values()} == {"unknown label b", "no rows to test on", "no rows to learn from"}
