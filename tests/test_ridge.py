"""Ridge regression by its three roads against one another and against a plain solution."""

import numpy as np
import pytest

from dyadix.operators.classify import RidgeCV


def made(spark, n, width, classes=3, seed=0, shift=0.4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, width)) * rng.uniform(0.2, 3, width) + 5 + shift * y[:, None] * (np.arange(width) % 4 == 0)
    return x, y, spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)], "y int, features array<double>").repartition(3)


def loo(x, y, classes, alphas):
    """Leave-one-out errors by leaving one out."""
    t = np.where(np.eye(classes)[y] > 0, 1.0, -1.0)
    out = np.zeros(len(alphas))
    for k, a in enumerate(alphas):
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            m, mt = x[keep].mean(0), t[keep].mean(0)
            c = x[keep] - m
            beta = np.linalg.solve(c.T @ c + a * np.eye(x.shape[1]), c.T @ (t[keep] - mt))
            out[k] += ((t[i] - mt - (x[i] - m) @ beta) ** 2).sum()
    return out


@pytest.mark.parametrize(("n", "width"), [(40, 12), (25, 60)])
def test_dual_equals_primal(spark, n, width):
    x, y, df = made(spark, n, width)
    a, b = RidgeCV(3).fit(df), RidgeCV(3, max_features=5, tile=7).fit(df)
    assert a.alpha == b.alpha == RidgeCV(3).alphas[int(loo(x, y, 3, RidgeCV(3).alphas).argmin())]
    assert np.allclose(a.beta, b.beta, atol=1e-8) and np.allclose(a.intercept, b.intercept, atol=1e-7)
    assert [r.pred for r in a.transform(df).collect()] == [r.pred for r in b.transform(df).collect()]


def test_iterations_reach_the_same_solution(spark):
    _, _, df = made(spark, 60, 15, seed=2)
    for alpha in (0.01, 10.0):
        a = RidgeCV(3, alphas=(alpha,)).fit(df)
        b = RidgeCV(3, alphas=(alpha,), max_features=5, max_rows=10).fit(df)
        assert np.allclose(a.beta, b.beta, atol=1e-7) and np.allclose(a.intercept, b.intercept, atol=1e-6)


def test_iterations_choose_a_penalty(spark):
    x, y, df = made(spark, 80, 9, seed=3, shift=4.0)
    model = RidgeCV(3, alphas=(1e-3, 1e6), max_features=5, max_rows=10).fit(df)
    assert model.alpha == 1e-3  # the other one leaves the means only
    pred = [r.pred for r in model.transform(df).collect()]
    assert np.mean(np.array(pred) == [r.y for r in df.collect()]) > 0.5


def test_no_rows(spark):
    with pytest.raises(ValueError):
        RidgeCV(2).fit(made(spark, 3, 4)[2].where("y > 9"))


def test_roads(spark, monkeypatch):
    """More than 5,000 rows and features need no iterations; few rows still take the dual system."""
    taken = []
    for road in ("_primal", "_dual", "_iterative"):
        monkeypatch.setattr(RidgeCV, road, lambda self, data, width, road=road: taken.append(road))
    for n, width, want in ((6001, 5654, "_primal"), (500, 5654, "_dual"), (500, 300, "_primal"), (6001, 8193, "_iterative")):
        RidgeCV(2).fit(spark.range(n).selectExpr("0 AS y", f"array_repeat(0.0D, {width}) AS features"))
        assert taken.pop() == want


def test_portions_change_nothing(spark, monkeypatch):
    from dyadix.operators import classify

    _, _, df = made(spark, 60, 15, seed=2)
    a = RidgeCV(3).fit(df)
    monkeypatch.setattr(classify, "PORTION", 8 * 15 * 7)
    b = RidgeCV(3).fit(df)
    assert a.alpha == b.alpha and np.allclose(a.beta, b.beta, atol=1e-9)
