"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision where they leave a doubt.

Each vector is scaled to length one and rounded to int8 with its own scale; the
length of what rounding lost bounds the error of every product with it. Tiles of
vectors are multiplied as integers; a pair whose product is above the threshold
by more than its error bound is linked, one below by more is not, and only the
pairs between are recomputed in double precision.

Defined cases: a vector that is null, empty, all zero or holds null or
non-finite components links with nothing; vectors of different lengths never
meet; equal vectors are one row from the start, with their number; rows that
repeat a vec_id are vectors like any others, with their own links (component_id
is the smallest vec_id of what a row reaches); a null vec_id takes no part in
links and is returned without any. Labels are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Forest, components, cut


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, error): unit(v) = scale * row + e with |e| <= error."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-12
    return q, scale, error


def candidates(q: np.ndarray, scale: np.ndarray, error: np.ndarray, n_first: int, same: bool, threshold: float):
    """(i, j, sure) arrays of rows that are linked for certain or possibly: of the first n_first rows with later rows (same) or with the rest."""
    # products of int8 rows are exact in single precision up to this length
    wide = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    others = np.arange(len(q)) if same else np.arange(n_first, len(q))
    right = np.ascontiguousarray(q[others].astype(wide).T)
    worst = error[others].max() if len(others) else 0.0
    for at in range(0, n_first, 256):
        rows = np.arange(at, min(at + 256, n_first))
        top = error[rows].max()
        bound = (1 + top) * worst + top * (1 + worst) + top * worst + 1e-6
        product = q[rows].astype(wide) @ right
        product *= scale[others].astype(wide)
        i, j = np.nonzero(product >= ((threshold - bound) / scale[rows]).astype(wide)[:, None])
        i, j = rows[i], others[j]
        if same:
            i, j = i[j > i], j[j > i]
        for s in range(0, len(i), 50_000):
            a, b = i[s:s + 50_000], j[s:s + 50_000]
            about = np.einsum("ij,ij->i", q[a].astype(np.int32), q[b].astype(np.int32)) * scale[a] * scale[b]
            most = (1 + error[a]) * error[b] + error[a] * (1 + error[b]) + error[a] * error[b] + 1e-12
            sure = about - most >= threshold
            keep = about + most >= threshold
            if keep.any():
                yield a[keep], b[keep], sure[keep]


def exact_links(v: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's cosine in double precision reaches the threshold."""
    length = np.linalg.norm(v, axis=1)
    return np.einsum("ij,ij->i", v[i], v[j]) / (length[i] * length[j]) >= threshold


KEYS = "dim int, t1 long, t2 long, side int, id long, size long"


def _rows(t: pa.Table):
    """A tile pair's rows by side and id, the number on the first side, and whether it is a tile with itself."""
    t = t.sort_by([("side", "ascending"), ("id", "ascending")])
    return t, int((t["side"].to_numpy() == 0).sum()), t["t1"][0].as_py() == t["t2"][0].as_py()


def _found(t: pa.Table, links: np.ndarray, forest: Forest, doubt: np.ndarray) -> pa.Table:
    """Rows with links (b null), links of a spanning forest (b not null), and rows with a doubtful partner (links null)."""
    ids, (a, b) = t["id"].to_numpy(), forest.edges()
    some, open_ = np.flatnonzero(links), np.flatnonzero(doubt)
    rows = t.select(["dim", "t1", "t2", "side", "id", "size"]).take(pa.array(np.concatenate([some, a, open_])))
    return rows.append_column("b", pa.array([None] * len(some) + ids[b].tolist() + [None] * len(open_), pa.int64())).append_column(
        "links", pa.array(links[some].tolist() + [0] * len(a) + [None] * len(open_), pa.int64()))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tile: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors(vec_id, embedding)``.

    n_links counts the other vectors linked directly, component_id is the
    smallest vec_id reachable by links. All pairs are compared, in tiles of
    bounded size: N rows make N / tile tiles, every two of which meet in one
    group of at most 2 * tile rows (a row is sent to N / tile groups as int8
    with its scale and error; larger tiles send less). A group returns one count
    per row and a spanning forest of its links, never its pairs. Rows that are
    in doubt with some partner of a group meet there again in full precision.
    """

    def usable(batches):
        for batch in batches:
            for x in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                full, small, scales, errors = [], [], [], []
                for e in x["embedding"]:
                    a = np.array(e.values, np.float64) if e.is_valid and len(e) and e.values.null_count == 0 else np.zeros(1)
                    ok = np.isfinite(a).all() and a.any() and np.isfinite(n := np.linalg.norm(a)) and n > 0
                    q, scale, error = quantise(a[None]) if ok else (None, [None], [None])
                    full.append(a.tobytes() if ok else None)
                    small.append(q.tobytes() if ok else None)
                    scales.append(scale[0])
                    errors.append(error[0])
                yield pa.RecordBatch.from_arrays([
                    x["vec_id"], pa.array(full, pa.binary()), pa.array(small, pa.binary()), pa.array(scales, pa.float64()), pa.array(errors, pa.float64())],
                    ["vec_id", "v", "q", "scale", "error"])

    rows = cut(vectors.select("vec_id", "embedding").mapInArrow(usable, "vec_id long, v binary, q binary, scale double, error double"), "vectors")
    alone = rows.where("v is not null and vec_id is not null").groupBy("v").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("size"), F.first("q").alias("q"), F.first("scale").alias("scale"), F.first("error").alias("error"))
    # a distinct vector is named by a number that only this run knows, since a vec_id may stand for several
    distinct = cut(alone.withColumns({"id": F.monotonically_increasing_id(), "dim": (F.length("v") / 8).cast("int")}), "distinct")
    tiles = max(1, -(-distinct.count() // tile))
    placed = distinct.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(tiles)))
    # (first tile, second tile): its own tile comes first or second with every other
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "dim", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "size", "q", "scale", "error")

    def linked(t: pa.Table) -> pa.Table:
        t, n_first, same = _rows(t)
        q = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(t.num_rows, -1)
        size, links, forest, doubt = t["size"].to_numpy(), np.zeros(t.num_rows, np.int64), Forest(t.num_rows), np.zeros(t.num_rows, bool)
        for i, j, sure in candidates(q, t["scale"].to_numpy(), t["error"].to_numpy(), n_first, same, threshold):
            doubt[i[~sure]] = doubt[j[~sure]] = True
            i, j = i[sure], j[sure]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            forest.join(i, j)
        return _found(t, links, forest, doubt)

    def settled(t: pa.Table) -> pa.Table:
        t, n_first, same = _rows(t)
        v = np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(t.num_rows, -1)
        size, links, forest = t["size"].to_numpy(), np.zeros(t.num_rows, np.int64), Forest(t.num_rows)
        for i, j, sure in candidates(*quantise(v), n_first, same, threshold):
            i, j = i[~sure], j[~sure]
            ok = exact_links(v, i, j, threshold)
            i, j = i[ok], j[ok]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            forest.join(i, j)
        return _found(t, links, forest, np.zeros(t.num_rows, bool))

    schema = f"{KEYS}, b long, links long"
    sure = cut(met.groupBy("dim", "t1", "t2").applyInArrow(linked, schema), "veclinks")
    doubtful = sure.where("links is null").select("dim", "t1", "t2", "side", "id", "size").join(distinct.select("id", "v"), "id")
    found = sure.where("links is not null").union(cut(doubtful.groupBy("dim", "t1", "t2").applyInArrow(settled, schema), "settled"))
    links = found.where("b is null").groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.where("b is not null").select(F.col("id").alias("a"), "b")).select(F.col("a").alias("id"), F.col("b").alias("lead"))
    by_vector = distinct.select("id", "v", "low", "size").join(links, "id", "left").join(group, "id", "left").select(
        "v", "low", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lead", "id").alias("lead"))
    lows = by_vector.groupBy("lead").agg(F.min("low").alias("component_id"))
    named = by_vector.join(lows, "lead").select("v", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("v")).alias("v")).join(named, "v", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
