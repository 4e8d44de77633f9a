"""Helpers that several operators share: tables in the shared folder, word lists, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a session in one
    process (tests) gets a local folder, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def write_shared(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write ``df`` as Parquet into the shared folder and return its path.

    A written table cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again with the same schema."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def with_rows(docs: DataFrame, name: str = "rows") -> DataFrame:
    """``docs`` with a long ``row__`` that tells its rows apart, written once so that it stays the same."""
    return cut(docs.withColumn("row__", F.monotonically_increasing_id()), name)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_shared`` wrote and nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size does not grow with the corpus; more than ``limit`` raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has over {limit} rows; it must stay bounded")
    return rows


def only_wanted(df: DataFrame, wanted: DataFrame, name: str = "id", slots: int = 1 << 18) -> DataFrame:
    """Rows of ``df`` whose long ``name`` is in ``wanted(name)``, which has each id once.

    A bitmap of the wanted ids, 64 bits in each of ``slots`` rows whatever their
    number, is broadcast first, so that hardly any other row is shuffled. Then
    an inner join decides: the optimiser would move a semi join below the
    bitmap and shuffle every row."""
    h = F.xxhash64(name)
    slot = F.pmod(F.shiftrightunsigned(h, 6), F.lit(slots)).alias("slot__")
    bit = h.bitwiseAND(F.lit(63)).cast("int").alias("bit__")
    bits = wanted.select(slot, bit).groupBy("slot__").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit__"))).alias("bits__"))
    maybe = df.select("*", slot, bit).join(F.broadcast(bits), "slot__").where(F.call_function("getbit", "bits__", "bit__") == 1)
    return maybe.select(*df.columns).join(wanted, name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns (a, b): every vertex that is not the smallest of its component, with
    that smallest vertex. Each round is a map-side combined minimum and a join
    on the vertex; its edges go to the shared folder, so the plan stays short.
    The joins can be split by the engine when one hub holds most edges. Null
    ends and loops are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    path = write_shared(e, "edges")
    sign = None
    for _ in range(max_rounds):
        e = spark.read.parquet(path)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a > b").distinct()
        new = write_shared(small, "edges")
        remove_shared(spark, path)
        path = new
        now = spark.read.parquet(path).agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("the components did not settle")
    return spark.read.parquet(path)


class Forest:
    """Union of the rows of a tile; keeps one link for each two trees that it joins."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high, at = np.unique(np.maximum(a, b), return_index=True)
            low = np.minimum(a, b)[at]
            self.links.append((high, low))
            self.parent[high] = low
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs of a spanning forest (roots stand for their trees)."""
        if not self.links:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.links, strict=True))
