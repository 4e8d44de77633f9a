"""Loading that never raises: good series, bad lines with reason and place, and what fails for which data set and resample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadix.operators.quantiles import FEW

NO_LABEL, NO_POINTS, MISSING, NOT_A_NUMBER, RAGGED = "no label", "no points", "missing value", "not a number", "channels of unequal length"
CHANNELS, LENGTHS, SHORT, NOTHING, BAD_LINES = "several channels", "unequal lengths", "under 3 points", "no series", "bad lines"
NO_INDICES, OUTSIDE, TWICE = "no indices", "index out of range", "index twice"


def _reason(label: Column, channels: Column) -> Column:
    """Why a line is no series, or null. ``channels`` has the points of each channel as trimmed texts."""
    missing = lambda p: p.isin("", "?") | F.lower(p).isin("nan", "inf", "-inf", "infinity", "-infinity")
    any_point = lambda test: F.exists(channels, lambda c: F.exists(c, test))
    return (F.when(F.coalesce(label, F.lit("")) == "", NO_LABEL).when((F.size(channels) == 0) | F.exists(channels, lambda c: (F.size(c) == 1) & (F.get(c, F.lit(0)) == "")), NO_POINTS)
            .when(any_point(missing), MISSING).when(any_point(lambda p: F.coalesce(F.abs(p.try_cast("double")) < float("inf"), F.lit(False)) == F.lit(False)), NOT_A_NUMBER)
            .when(F.array_min(F.transform(channels, F.size)) < F.array_max(F.transform(channels, F.size)), RAGGED))


def _with_line_numbers(lines: DataFrame) -> DataFrame:
    """``lines(file, block, id, ...)`` with ``line_no`` from 1. A file may be read in several blocks: the lines before a block are
    counted, one row a block; within a block lines are in order."""
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    if starts.count() <= FEW:
        starts = F.broadcast(starts)
    return lines.join(starts, ["file", "block"]).withColumn("line_no", F.col("id") + F.col("shift") + 1).drop("shift")


def audited(spark: SparkSession, path: str, kind: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of the files under ``path``, in one folder ``dataset=NAME`` for each data set.

    good(dataset, file, line_no, label, channels array<array<double>>); bad(dataset, file, line_no, reason, start): a line that is no series
    of finite numbers, its first reason and its first characters. ``ts`` files have header lines, points by commas, channels and label by colons;
    ``tsv`` files have a label and points by tabs. A line without any text is skipped."""
    if kind not in ("ts", "tsv"):
        raise ValueError(f"kind is ts or tsv, not {kind!r}")
    text = spark.read.text(path).select(
        F.col("dataset").cast("string").alias("dataset"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = _with_line_numbers(text).where(F.trim("value") != "")
    if kind == "ts":
        lines = lines.where(~F.ltrim("value").rlike("^[@#%]")).withColumn("parts", F.split("value", ":"))
        label, channels = F.trim(F.element_at("parts", -1)), F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda c: F.split(c, ","))
        label = F.when(F.size("parts") > 1, label)  # points alone have no label
    else:
        lines = lines.withColumn("parts", F.split("value", "\t"))
        label, channels = F.trim(F.get("parts", F.lit(0))), F.when(F.size("parts") > 1, F.array(F.slice("parts", 2, F.size("parts") - 1))).otherwise(F.array().cast("array<array<string>>"))
    named = lines.withColumn("label", label).withColumn("channels", F.transform(channels, lambda c: F.transform(c, lambda p: F.trim(p))))
    judged = named.withColumn("reason", _reason(F.col("label"), F.col("channels")))
    good = judged.where("reason is null").select("dataset", "file", "line_no", "label", F.transform("channels", lambda c: F.transform(c, lambda p: p.try_cast("double"))).alias("channels"))
    bad = judged.where("reason is not null").select("dataset", "file", "line_no", "reason", F.substring("value", 1, 80).alias("start"))
    return good, bad


def dataset_faults(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(dataset, reason): what keeps a whole data set from being used as equal series of one channel; one combined aggregate of each side."""
    own = F.transform("channels", F.size)
    shape = good.groupBy("dataset").agg(F.max(F.size("channels")).alias("channels"), F.min(F.array_min(own)).alias("low"), F.max(F.array_max(own)).alias("high"))
    reasons = F.array_compact(F.array(F.when(F.col("channels") > 1, CHANNELS), F.when(F.col("low") < F.col("high"), LENGTHS), F.when(F.col("low") < 3, SHORT)))
    return shape.select("dataset", F.explode(reasons).alias("reason")).union(bad.select("dataset", F.lit(BAD_LINES).alias("reason")).distinct())


def failures(wanted: DataFrame, good: DataFrame, bad: DataFrame, indices: DataFrame) -> DataFrame:
    """(dataset, resample, reason) for each fault of the data sets and resamples in ``wanted(dataset, resample)``; those without a row can be used.

    ``indices(dataset, resample, idx)`` numbers a data set's good series from 0. Nothing raises: an absent file is a row like the others."""
    pairs = wanted.distinct()
    sizes = good.groupBy("dataset").agg(F.count("*").alias("n"))
    seen = sizes.select("dataset").union(bad.select("dataset")).distinct()
    absent = pairs.join(seen, "dataset", "left_anti").withColumn("reason", F.lit(NOTHING))
    faults = pairs.join(dataset_faults(good, bad), "dataset").select("dataset", "resample", "reason")
    used = indices.groupBy("dataset", "resample", "idx").count().groupBy("dataset", "resample").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.max("count").alias("most"))
    held = pairs.join(used, ["dataset", "resample"], "left").join(sizes, "dataset", "left")
    found = F.array_compact(F.array(F.when(F.col("most").isNull(), NO_INDICES), F.when((F.col("low") < 0) | (F.col("high") >= F.coalesce("n", F.lit(0))), OUTSIDE), F.when(F.col("most") > 1, TWICE)))
    return absent.union(faults).union(held.select("dataset", "resample", F.explode(found).alias("reason")))
