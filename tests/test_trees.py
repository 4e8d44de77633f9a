"""Trees grown over a distributed table against a plain grower with the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadix.operators import trees
from dyadix.operators.trees import ExtraTrees, drawn, walk


def plain(x, y, classes, share, seed, tree):
    """One tree, rows in memory, level by level: (feature, cut, children, class counts) of each node."""
    want, nodes = max(1, int(share * x.shape[1])), []
    count = lambda rows: np.bincount(y[rows], minlength=classes)

    def add(rows):
        nodes.append([-1, 0.0, (-1, -1), count(rows).tolist()])
        return len(nodes) - 1, rows

    level = [add(np.arange(len(y)))]
    while level:
        after = []
        for n, rows in level:
            if (count(rows) > 0).sum() < 2:
                continue
            order, place = drawn(seed, tree, n, x.shape[1])
            low, high, best = x[rows].min(0), x[rows].max(0), None
            for j, f in enumerate([f for f in order if high[f] > low[f]][:want]):
                cut = low[f] + place[f] * (high[f] - low[f])
                left = x[rows, f] <= cut
                cost = 0.0
                for c in (count(rows[left]), count(rows[~left])):
                    cost -= sum(v * np.log2(v / c.sum()) for v in c if v)
                if 0 < left.sum() < len(rows) and (best is None or (round(cost, 9), j) < best[0]):
                    best = (round(cost, 9), j), f, cut, left
            if best:
                _, f, cut, left = best
                (a, ra), (b, rb) = add(rows[left]), add(rows[~left])
                nodes[n][:3] = [int(f), float(cut), (a, b)]
                after += [(a, ra), (b, rb)]
        level = after
    return nodes


def made(seed, n=90, width=12, classes=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, width)) + y[:, None] * (np.arange(width) % 3)
    x[:, 4:9] = rng.integers(0, 2, (n, 5))  # few values: constant in many nodes
    x[:, 9] = 1.0
    return x, y


@pytest.mark.parametrize(("partitions", "local"), [(1, trees.LOCAL_BYTES), (5, trees.LOCAL_BYTES), (3, 0)])
def test_equal_to_the_plain_grower(spark, partitions, local):
    """The level-wise growth over executors and the whole trees of a task, however the rows are dealt out."""
    x, y = made(3)
    df = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)], "y int, features array<double>").repartition(partitions)
    model = ExtraTrees(3, trees=3, share=0.3, seed=7, local_bytes=local).fit(df).model
    for t, tree in enumerate(model):
        assert [list(n) for n in zip(tree.feature, tree.cut, tree.down, tree.counts)] == plain(x, y, 3, 0.3, 7, t)
        leaf = walk(tree.packed(), x)
        assert np.array_equal(np.array(tree.counts)[leaf].argmax(1), y)  # pure, nothing is constant


def test_portions_of_nodes_and_rows_change_nothing(spark, monkeypatch):
    x, y = made(4, n=24)
    df = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)], "y int, features array<double>").repartition(3)
    want = ExtraTrees(3, trees=2, share=0.3, seed=1, local_bytes=0).fit(df).model
    monkeypatch.setattr(trees, "HELD", 2 * 3 * 3 * 4)
    got = ExtraTrees(3, trees=2, share=0.3, seed=1, local_bytes=0).fit(df).model
    assert got == want


def test_edges(spark):
    for local in (0, trees.LOCAL_BYTES):
        _edges(spark, local)


def _edges(spark, local):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "y int, features array<double>")
    out = ExtraTrees(3, trees=2, local_bytes=local).fit(one).transform(one).collect()
    assert all(r.proba == [0.0, 1.0, 0.0] for r in out)
    same = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0])], "y int, features array<double>")  # nothing to cut
    assert ExtraTrees(2, trees=1, local_bytes=local).fit(same).transform(same).first().proba == pytest.approx([1 / 3, 2 / 3])
    with pytest.raises(ValueError):
        ExtraTrees(2, trees=1, local_bytes=local).fit(same.where("y > 5"))
    assert ExtraTrees(2, trees=1, local_bytes=local).fit(same).transform(same.where("y > 5")).select(F.size("proba")).count() == 0


@pytest.mark.parametrize("kind", [ExtraTrees, trees.Forest])
def test_parts_below_a_bound(spark, kind):
    """Large nodes cut level by level, all that is below them grown in tasks: every row ends in a leaf of its own kind, however the rows are dealt out."""
    x, y = made(5, n=300)
    x[150:] = x[:150]  # equal rows
    y[150:] = y[:150]
    rows = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(y, x))], "i int, y int, features array<double>")
    found = []
    for n in (1, 5):
        model = kind(3, trees=4, share=0.3, seed=7, local_bytes=8 * 12 * 100).fit(rows.repartition(n))
        assert model.parts.count() >= 8 and all(sum(t.counts[i]) <= 100 for t, own in zip(model.model, model.handed) for i in own)
        found.append({r.i: r.proba for r in model.transform(rows.repartition(n)).collect()})
    assert found[0] == found[1] and len(found[0]) == 300
    proba = np.array([found[0][i] for i in range(300)])
    assert np.allclose(proba.sum(1), 1)
    assert (proba.argmax(1) == y).mean() > 0.95
    if kind is ExtraTrees:
        assert (proba.max(1) == 1).all()  # pure, nothing is constant
    few = model.transform(rows.where("i < 3").withColumn("y", F.lit(None).cast("int"))).collect()
    assert len(few) == 3 and all(r.proba == found[0][r.i] for r in few)


@pytest.mark.parametrize("exact", [False, True])
def test_growth_of_all_nodes_of_a_level(exact):
    x, y = made(6, n=200)
    x[:, 0] = np.round(x[:, 0], 1)
    sample = np.sort(np.random.default_rng(1).integers(0, 200, 260))
    feature, cut, down, counts = trees.below(x, y, sample, 3, 12, (0, 1), exact)
    assert np.array_equal(counts[0], np.bincount(y[sample], minlength=3))
    inner = feature >= 0
    assert np.array_equal(counts[down[inner]].sum(1), counts[inner]) and (counts > 0).sum(1)[~inner].max() == 1
    assert np.array_equal(counts[walk((feature, cut, down), x[sample])].argmax(1), y[sample])
    if exact:  # the first cut against every cut of every feature
        u, v = x[sample], np.eye(3, dtype=int)[y[sample]]
        costs = [float(trees.cost_of(v[u[:, f] <= c].sum(0)) + trees.cost_of(v[u[:, f] > c].sum(0))) for f in range(12) for c in np.unique(u[:, f])[:-1]]
        assert float(trees.cost_of(counts[down[0]]).sum()) == pytest.approx(min(costs), abs=1e-6)


def test_parts_take_the_time_of_their_rows():
    """All nodes of a level at once: a node costs no calls of its own."""
    import time

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20000, 40)), rng.integers(0, 10, 20000)
    start = time.perf_counter()
    trees.below(x, y, np.arange(20000), 10, 4, (0,), False)
    whole = time.perf_counter()
    trees.grown(x, y, 10, 4, 0, 0)
    assert whole - start < (time.perf_counter() - whole) / 2


def peak_of_shuffles(spark, run):
    """(what ``run`` returns, the most bytes of shuffle files that it added at any time)."""
    import threading
    from pathlib import Path

    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    done, sizes = threading.Event(), []

    def held():
        total = 0
        for f in (f for d in folders for f in Path(d).rglob("shuffle_*.data")):
            try:
                total += f.stat().st_size
            except FileNotFoundError:
                pass
        return total

    def watch():
        while not done.wait(0.05):
            sizes.append(held())

    before, other = held(), threading.Thread(target=watch)
    other.start()
    try:
        out = run()
    finally:
        done.set()
        other.join()
    return out, max(sizes) - before


@pytest.mark.parametrize("kind", [ExtraTrees, trees.Forest])
def test_disk_does_not_grow_with_the_trees(spark, monkeypatch, kind):
    """Rows are dealt to the parts of a few trees at a time and no shuffle files stay; the model and its shares are those of all trees at once."""
    x, y = made(8, n=2000)
    rows = spark.createDataFrame([(i, int(c), r.tolist()) for i, (c, r) in enumerate(zip(y, x))], "i int, y int, features array<double>").repartition(3)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)

    def run():
        model = kind(3, trees=16, share=0.3, seed=7, local_bytes=8 * 12 * 700).fit(rows)
        proba = {r.i: r.proba for r in model.transform(rows).collect()}
        return sorted((r.tree, r.node, bytes(r.cut)) for r in model.parts.collect()), proba

    one_tree = 8 * 12 * 2000
    whole = run()
    monkeypatch.setattr(trees, "WAVE_BYTES", 2 * one_tree // 4)  # two trees at a time on four cores
    found, peak = peak_of_shuffles(spark, run)
    assert found == whole and len(found[1]) == 2000
    assert peak < 6 * one_tree, (peak, one_tree)
    assert spark.conf.get(setting, None) == before
