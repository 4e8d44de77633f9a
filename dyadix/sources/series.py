"""Readers and writers: series files, resample indices, fact tables, synthetic series; resampling and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadix.operators.prefix import running_before

RUNTIMES = "dataset string, split string, n_samples int, series_length int, estimator string, run int, runtime double"
GRID_RUNTIMES = "series_length int, n_samples int, estimator string, run int, runtime double"
METRICS = ("dataset string, resample int, estimator string, accuracy double, balanced_accuracy double, log_loss double, roc_auc double, f1 double, "
           "runtime double, runtime_features_train double, runtime_fit double, runtime_features_test double, runtime_prediction double")
CONSTANTS = "estimator string, constant string, value double, r2 double, fit string"


def read_ts(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A ``.ts`` file: header lines with @ or #, then points by comma, channels and label by colon.

    (file, line, split, label, channel, x array<double>), one row per series and channel."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("line", F.monotonically_increasing_id())
    body = lines.where(~F.ltrim("value").rlike("^[@#%]") & (F.trim("value") != "")).withColumn("parts", F.split("value", ":"))
    rows = body.select("file", "line", F.lit(split).alias("split"), F.trim(F.element_at("parts", -1)).alias("label"),
                       F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("channel", "points"))
    return rows.select("file", "line", "split", "label", "channel", F.transform(F.split("points", ","), lambda v: F.trim(v).try_cast("double")).alias("x"))


def read_tsv(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Label, then points, by tabs."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where("value <> ''").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), parts.alias("p"))
    return lines.select("file", "line", F.lit(split).alias("split"), F.get("p", F.lit(0)).alias("label"), F.lit(0).alias("channel"),
                        F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda v: v.try_cast("double")).alias("x"))


def equal_length(df: DataFrame, key: list[str], x: str = "x") -> DataFrame:
    """Rows of data sets whose series all have one length and no missing points; the others raise inside the job."""
    shape = df.groupBy(*key).agg(F.min(F.size(x)).alias("low"), F.max(F.size(x)).alias("high"), F.bool_or(F.exists(x, lambda v: v.isNull() | F.isnan(v))).alias("bad"))
    ok = shape.withColumn("ok", F.when((F.col("low") == F.col("high")) & ~F.col("bad"), F.lit(True)).otherwise(F.raise_error(F.lit("unequal lengths or missing points"))))
    return df.join(ok.where("ok").select(*key), key)


def read_resample(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, idx): one index per line, in file order. A file is a few hundred lines, so its order costs nothing."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n\r ")), "\r?\n")).alias("line_no", "v"))
    return lines.select("line_no", F.trim("v").cast("long").alias("idx"))


def pooled(train: DataFrame, test: DataFrame, order: str) -> DataFrame:
    """Train rows, then test rows, numbered from 0 within a data set; ``order`` is a number, unique within a side.

    Rows are numbered inside slices of the order, so one data set that holds all rows is many tasks."""
    sides = train.withColumns({"__t": F.lit(0), "__one": F.lit(1)}).unionByName(test.withColumns({"__t": F.lit(1), "__one": F.lit(1)}))
    first = train.groupBy("dataset").agg(F.count("*").alias("__first"))
    ranked = running_before(sides, ["dataset", "__t"], order, "__one", "__before").join(first, "dataset", "left")
    return ranked.withColumn("pool_id", F.col("__before") + F.when(F.col("__t") == 1, F.coalesce("__first", F.lit(0))).otherwise(0)).drop("__t", "__one", "__before", "__first")


def resample(pool: DataFrame, indices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train in file order, test ascending): the indexed rows and the set difference."""
    train = pool.join(indices, pool.pool_id == indices.idx).drop("idx")
    test = pool.join(indices.select(F.col("idx").alias("pool_id")), "pool_id", "left_anti")
    return train, test


def missing_resamples(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(dataset, resample) pairs without a file."""
    return wanted.join(present, ["dataset", "resample"], "left_anti")


def label_index(train: DataFrame, label: str, out: str = "y") -> DataFrame:
    """(label, y): train labels in alphabetical order, from 0."""
    return train.select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)  # one row per class


def with_label(df: DataFrame, index: DataFrame, label: str, out: str = "y") -> DataFrame:
    """Labels that the training rows do not have raise inside the job."""
    found = df.join(F.broadcast(index), label, "left")
    return found.withColumn(out, F.coalesce(out, F.raise_error(F.concat(F.lit("unknown label "), F.col(label).cast("string"))).cast("int")))


def series_lengths(df: DataFrame, key: str = "dataset", x: str = "x") -> DataFrame:
    return df.groupBy(key).agg(F.max(F.size(x)).alias("series_length"))


def gaussian(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    """(series_id, x): normal points by Box and Muller from hashes of (seed, series, point): the same wherever they are made."""
    unit = lambda tag, t: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tag), F.col("id"), t), 11).cast("double") + 0.5) / float(1 << 53)
    return spark.range(n).select(F.col("id").alias("series_id"), F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.sqrt(-2 * F.ln(unit(1, t))) * F.cos(6.283185307179586 * unit(2, t))).alias("x"))


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_wide_runs(spark: SparkSession, path: str, index: str) -> DataFrame:
    """A matrix file with columns ``index, Run 0, Run 1, ...`` -> (index, best)."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    runs = [c for c in df.columns if c.startswith("Run ")]
    return df.select(F.col(df.columns[0]).alias(index), F.least(*[F.col(f"`{c}`").cast("double") for c in runs]).alias("best"))


def write_facts(df: DataFrame, path: str, single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_wide_runs(df: DataFrame, path: str, index: str, runs: int) -> None:
    """(index, run, runtime) -> one row per index with a column per run."""
    wide = df.groupBy(index).pivot("run", list(range(runs))).agg(F.min("runtime"))
    write_facts(wide.select(index, *[F.col(str(r)).alias(f"Run {r}") for r in range(runs)]).orderBy(index), path)


def catalogue(spark: SparkSession, names: dict[str, list[str]]) -> DataFrame:
    """(dataset, archive) from lists of names by archive."""
    return spark.createDataFrame([(n, a) for a, own in names.items() for n in own], "dataset string, archive string")
