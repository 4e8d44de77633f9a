"""The estimator: fit looks at the shape only, transform adds the features as an array or a vector."""

from __future__ import annotations

import warnings

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadix.operators.features import interval_features, join_channels
from dyadix.plans import dispatch
from dyadix.plans.layout import feature_names, features, representation_lengths

VERSIONS = ("auto", "intervals", "samples")


class _Shared(Params):
    inputCol = Param(Params._dummy(), "inputCol", "array of points", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "features", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "series id", TypeConverters.toString)
    channelCol = Param(Params._dummy(), "channelCol", "channel number; empty for one channel", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "levels of intervals", TypeConverters.toInt)
    div = Param(Params._dummy(), "div", "points per quantile", TypeConverters.toInt)
    mode = Param(Params._dummy(), "mode", "exact or approx", TypeConverters.toString)
    version = Param(Params._dummy(), "version", "auto, intervals, samples, or a length from which intervals is used", lambda v: v if isinstance(v, int) else str(v))
    vector = Param(Params._dummy(), "vector", "emit an ML vector instead of an array", TypeConverters.toBoolean)

    def _defaults(self) -> None:
        self._setDefault(inputCol="x", outputCol="features", idCol="series_id", channelCol="", depth=6, div=4, mode="approx", version="auto", vector=False)

    def _validate(self) -> None:
        mode, version = self.getOrDefault("mode"), self.getOrDefault("version")
        if mode not in ("exact", "approx"):
            raise ValueError(f"mode is exact or approx, not {mode!r}")
        for name in ("depth", "div"):
            if self.getOrDefault(name) < 1:
                raise ValueError(f"{name} is at least 1")
        if not (version in VERSIONS or isinstance(version, int) and not isinstance(version, bool) and version > 0 or str(version).isdigit() and int(version) > 0):
            raise ValueError(f"version is one of {VERSIONS} or a positive length, not {version!r}")


class IntervalQuantiles(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the number of points and channels from the data."""

    @keyword_only
    def __init__(self, *, inputCol="x", outputCol="features", idCol="series_id", channelCol="", depth=6, div=4, mode="approx", version="auto", vector=False):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)
        self._validate()

    def _fit(self, df: DataFrame) -> IntervalQuantilesModel:
        self._validate()
        x, channel = self.getOrDefault("inputCol"), self.getOrDefault("channelCol")
        shape = df.agg(F.min(F.size(x)).alias("low"), F.max(F.size(x)).alias("high"), (F.count_distinct(channel) if channel else F.lit(1)).alias("channels")).first()
        if shape.low is None or shape.low != shape.high or shape.low < 3:
            raise ValueError(f"series need one length of at least 3, found {shape.low} to {shape.high}")
        model = IntervalQuantilesModel(length=shape.high, channels=int(shape.channels))
        return self._copyValues(model)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class IntervalQuantilesModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    length = Param(Params._dummy(), "length", "points of a series", TypeConverters.toInt)
    channels = Param(Params._dummy(), "channels", "channels of a series", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, length=3, channels=1):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    @property
    def n_features(self) -> int:
        d, v = self.getOrDefault("depth"), self.getOrDefault("div")
        return self.getOrDefault("channels") * sum(len(features(n, d, v)) for n in representation_lengths(self.getOrDefault("length")).values())

    def feature_names(self) -> list[str]:
        return feature_names(self.getOrDefault("length"), self.getOrDefault("mode"), self.getOrDefault("depth"), self.getOrDefault("div"), self.getOrDefault("channels"))

    def strategy(self, n_series: int | None) -> str:
        """Blocks of series (arrow) or one series at a time (rowwise), by the size of this input; where that is not known
        without a job (files, streams), each batch decides by its own size (auto)."""
        version, length = self.getOrDefault("version"), self.getOrDefault("length")
        if str(version).isdigit():
            return "arrow" if length >= int(version) else "rowwise"
        if version != "auto":
            return "arrow" if version == "intervals" else "rowwise"
        mode = self.getOrDefault("mode")
        for said in dispatch.mismatch(mode, self.getOrDefault("depth"), self.getOrDefault("div")):
            warnings.warn(said, stacklevel=2)
        if n_series is None:
            return "auto"
        return "arrow" if dispatch.blocks_pay(mode, n_series, length) else "rowwise"

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        channel = g("channelCol")
        # one channel: every other column of the input goes along; several: rows of one id become one
        key = [g("idCol"), channel] if channel else [c for c in df.columns if c not in (g("inputCol"), g("outputCol"), "features")]
        x, length = F.col(g("inputCol")), g("length")
        good = (F.size(x) == length) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
        checked = df.withColumn(g("inputCol"), F.when(good, x).otherwise(F.raise_error(F.lit(f"every series needs {length} finite points"))))
        # the size is asked for only where the answer can differ
        n = None if df.isStreaming or g("version") != "auto" else dispatch.known_size(df)
        out = interval_features(checked, key, g("inputCol"), length, g("mode"), strategy=self.strategy(n), depth=g("depth"), div=g("div"))
        if channel:
            out = join_channels(out, g("idCol"), channel, length, depth=g("depth"), div=g("div"))
        out = out.withColumnRenamed("features", g("outputCol"))
        return out.withColumn(g("outputCol"), array_to_vector(g("outputCol"))) if g("vector") else out
