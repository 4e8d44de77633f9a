"""Classifiers over feature vectors: forests, extremely randomised trees (in ``trees``), ridge with built-in validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadix.operators.trees import SHARE, TREES, ExtraTrees, Forest, matrix
from dyadix.sources.shared import written

__all__ = ["ExtraTrees", "Forest", "RidgeCV", "random_forest"]


def random_forest(seed: int = 0, trees: int = TREES, share: float = SHARE, bootstrap: bool = True) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, featureSubsetStrategy=str(share), impurity="entropy",
                                  maxDepth=30, bootstrap=bootstrap, seed=seed)


MATRICES = 16  # large matrices of sums that are made at once and shuffled
PORTION = 64 << 20  # bytes of features that are multiplied at a time


def _points(rows, name: str = "features") -> np.ndarray:
    column = rows[name]
    return matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _targets(y: np.ndarray, classes: int) -> np.ndarray:
    return np.where(np.eye(classes)[y] > 0, 1.0, -1.0)


def _added(rows):
    """Vectors of one number ``i``, added up."""
    return pa.table({"i": rows["i"][:1], "g": pa.array([np.sum([np.frombuffer(r) for r in rows["g"].to_pylist()], axis=0).tobytes()])})


def _stacked(parts: DataFrame) -> np.ndarray:
    """The sum over all tasks of numbered vectors (i, g), one vector a row; executors add, the driver gets each number once."""
    total = parts.groupBy("i").applyInArrow(_added, "i long, g binary").collect()
    return np.stack([np.frombuffer(r.g) for r in sorted(total, key=lambda r: r.i)])


class RidgeCV:
    """One-vs-rest ridge regression on targets of -1 and 1; the penalty of least leave-one-out error.

    Up to ``max_features`` features, executors reduce their rows to sums of products and the driver solves a system of the number
    of features: two passes over the rows, however many. With more features than ``max_rows`` but no more rows than that, it solves the dual system of the number of rows: tiles of features are multiplied on
    executors, each tile of all rows. Beyond ``max_features`` and ``max_rows``, all penalties and classes are solved together by conjugate gradients,
    a pass over the rows each step; leave-one-out has no such form, so the penalty is the one of least error on a fifth of the rows, chosen by
    hash, and is then fitted to all rows."""

    def __init__(self, classes: int, alphas=tuple(np.logspace(-3, 3, 10)), max_features: int = 8192, max_rows: int = 5000, tile: int = 1024):
        self.classes, self.alphas, self.max_features, self.max_rows, self.tile = classes, alphas, max_features, max_rows, tile

    def fit(self, train: DataFrame) -> RidgeCV:
        width, rows = train.agg(F.max(F.size("features")), F.count("*")).first()
        if not rows:
            raise ValueError("no rows to learn from")
        if width <= self.max_features and not rows <= self.max_rows < width:
            return self._primal(train, width)
        data = written(train.select(F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"), F.monotonically_increasing_id().alias("id")))
        return self._dual(data, width) if rows <= self.max_rows else self._iterative(data, width)

    def fit_block(self, x: np.ndarray, y: np.ndarray) -> RidgeCV:
        """The same model of rows in memory, by their singular values."""
        t, n = _targets(y, self.classes), len(y)
        mean, middle = x.mean(0), t.mean(0)
        u, s, v = np.linalg.svd(x - mean, full_matrices=False)
        inner = u.T @ (t - middle)
        losses = []
        for a in self.alphas:
            kept = s * s / (s * s + a)
            own = (u ** 2) @ kept + 1 / n
            losses.append((((t - middle - u @ (kept[:, None] * inner)) / (1 - own)[:, None]) ** 2).sum())
        self.alpha = float(self.alphas[int(np.argmin(losses))])
        self.beta = v.T @ ((s / (s * s + self.alpha))[:, None] * inner)
        self.intercept = middle - mean @ self.beta
        return self

    def _dual(self, data: DataFrame, width: int) -> RidgeCV:
        labels = sorted(map(tuple, data.select("id", "y").collect()))  # max_rows at most
        place, t = {i: k for k, (i, _) in enumerate(labels)}, _targets(np.array([y for _, y in labels]), self.classes)
        n, tile = len(labels), self.tile
        tiles = data.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit((width - 1) // tile)), lambda b: F.slice("features", b * tile + 1, tile))).alias("tile", "part"))

        def ordered(rows) -> np.ndarray:
            x = _points(rows, "part")
            out = np.empty_like(x)
            out[[place[i] for i in rows["id"].to_pylist()]] = x
            return out

        def products(rows):
            x = ordered(rows)
            return pa.table({"i": pa.array(range(n), pa.int64()), "g": pa.array([r.tobytes() for r in x @ x.T])})

        kernel = _stacked(tiles.groupBy("tile").applyInArrow(products, "i long, g binary"))
        mean = kernel.mean(0)
        values, vectors = np.linalg.eigh(kernel - mean - mean[:, None] + mean.mean())
        values = values.clip(0)
        middle = t.mean(0)
        inner = vectors.T @ (t - middle)
        losses = []
        for a in self.alphas:
            kept = values / (values + a)
            own = (vectors ** 2) @ kept + 1 / n
            losses.append((((t - middle - vectors @ (kept[:, None] * inner)) / (1 - own)[:, None]) ** 2).sum())
        self.alpha = float(self.alphas[int(np.argmin(losses))])
        weights = vectors @ (inner / (values + self.alpha)[:, None])

        def slopes(key, rows):
            x = ordered(rows)
            both = np.vstack([(x - x.mean(0)).T @ weights, x.mean(0) @ ((x - x.mean(0)).T @ weights)[None]])
            return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "g": pa.array([both.tobytes()])})

        found = [np.frombuffer(r.g).reshape(-1, self.classes) for r in sorted(tiles.groupBy("tile").applyInArrow(slopes, "i long, g binary").collect(), key=lambda r: r.i)]
        self.beta = np.vstack([f[:-1] for f in found])
        self.intercept = middle - np.sum([f[-1] for f in found], axis=0)
        return self

    def _iterative(self, data: DataFrame, width: int, steps: int = 2000, error: float = 1e-10) -> RidgeCV:
        k, context = self.classes, data.sparkSession.sparkContext
        apart = F.pmod(F.xxhash64("id"), F.lit(5)) == 0

        def summed(df: DataFrame, make) -> np.ndarray:
            """The sum of make(x, t) over all rows, as vectors."""
            def run(batches):
                total = None
                for b in batches:
                    if b.num_rows:
                        one = make(_points(b), _targets(b["y"].to_numpy(zero_copy_only=False), k))
                        total = one if total is None else total + one
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array([r.tobytes() for r in total])], ["i", "g"])
            return _stacked(df.select("y", "features").mapInArrow(run, "i long, g binary"))

        def solved(df: DataFrame, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(slopes of each penalty and class, intercepts): conjugate gradients on the centred system, scaled by its diagonal."""
            first = summed(df, lambda x, t: np.vstack([x.sum(0), (x * x).sum(0), t.T @ x, np.pad(np.append(t.sum(0), len(x)), (0, x.shape[1] - k - 1))]))
            n = first[-1, k]
            mean, middle = first[0] / n, first[-1, :k] / n
            penalty = np.repeat(alphas, k)
            scale = (first[1] - n * mean * mean).clip(0)[:, None] + penalty
            goal = np.tile((first[2:2 + k] - n * np.outer(middle, mean)).T, len(alphas))
            beta, rest = np.zeros_like(goal), goal.copy()
            z = rest / scale
            way, size = z.copy(), (rest * z).sum(0)
            for _ in range(steps):
                if (np.linalg.norm(rest, axis=0) <= error * np.maximum(np.linalg.norm(goal, axis=0), 1e-300)).all():
                    break
                sent = context.broadcast(way)
                ahead = summed(df, lambda x, t: ((x - mean).T @ ((x - mean) @ sent.value)).T).T + penalty * way  # noqa: B023
                sent.unpersist()
                step = size / np.maximum((way * ahead).sum(0), 1e-300)
                beta += step * way
                rest -= step * ahead
                z = rest / scale
                new = (rest * z).sum(0)
                way, size = z + new / np.maximum(size, 1e-300) * way, new
            else:
                raise RuntimeError("the ridge system did not settle")
            return beta, np.tile(middle, len(alphas)) - mean @ beta

        alphas = np.array(self.alphas, float)
        self.alpha = float(alphas[0])
        if len(alphas) > 1:
            slopes = context.broadcast(solved(data.where(~apart), alphas))
            miss = summed(data.where(apart), lambda x, t: ((x @ slopes.value[0] + slopes.value[1] - np.tile(t, len(alphas))) ** 2).sum(0, keepdims=True))
            self.alpha = float(alphas[int(miss.reshape(len(alphas), k).sum(1).argmin())])
        self.beta, self.intercept = solved(data, np.array([self.alpha]))
        return self

    def _primal(self, train: DataFrame, width: int) -> RidgeCV:
        k, n, some = self.classes, width + self.classes + 1, max(1, PORTION // (8 * width))

        def portions(b):
            return (b.slice(at, some) for at in range(0, b.num_rows, some))

        def sums(batches):
            total = None
            for b in batches:
                for part in portions(b):
                    x, t = _points(part), _targets(part["y"].to_numpy(zero_copy_only=False), k)
                    z = np.hstack([x, t, np.ones((len(x), 1))])
                    total = np.zeros((n, n)) if total is None else total
                    total += z.T @ z
            for at in range(0, n if total is not None else 0, 256):
                some = total[at:at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array([r.tobytes() for r in some])], ["i", "g"])

        # matrices are added row by row on the executors: the driver gets one, whatever the number of partitions; of large ones few are made
        own = train.select("y", "features")
        g = _stacked((own.coalesce(MATRICES) if width > 1000 else own).mapInArrow(sums, "i long, g binary"))
        assert g.shape == (n, n)
        rows, mean = g[-1, -1], g[-1, :-1] / g[-1, -1]
        c = g[:-1, :-1]
        c -= rows * np.outer(mean, mean)
        values, vectors = np.linalg.eigh(c[:width, :width])
        values = values.clip(0)
        xy = vectors.T @ c[:width, width:]
        basis = train.sparkSession.sparkContext.broadcast((vectors, mean, [vectors @ (xy / (values + a)[:, None]) for a in self.alphas], values, list(self.alphas), int(rows)))

        def errors(batches):
            v, m, betas, w, alphas, count = basis.value
            out = np.zeros(len(alphas))
            for b in batches:
                for part in portions(b):
                    x = _points(part) - m[:len(w)]
                    t = _targets(part["y"].to_numpy(zero_copy_only=False), k) - m[len(w):]
                    p = (x @ v) ** 2
                    for i, (a, beta) in enumerate(zip(alphas, betas, strict=True)):
                        own = p @ (1 / (w + a)) + 1 / count
                        out[i] += (((t - x @ beta) / (1 - own)[:, None]) ** 2).sum()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()])], ["e"])

        loss = np.sum([r.e for r in train.select("y", "features").mapInArrow(errors, "e array<double>").collect()], axis=0)
        best = int(np.argmin(loss))
        self.alpha, self.beta = float(self.alphas[best]), vectors @ (xy / (values + self.alphas[best])[:, None])
        self.intercept = mean[width:] - mean[:width] @ self.beta
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast((self.beta, self.intercept))

        @F.pandas_udf("int")
        def predict(features: pd.Series) -> pd.Series:
            beta, b = sent.value
            return pd.Series((np.stack(features.to_numpy()) @ beta + b).argmax(1))

        return df.withColumn("pred", predict("features"))
