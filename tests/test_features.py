import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadix.functions import representations as R
from dyadix.operators import features as X
from dyadix.plans import layout
from dyadix.streaming.features import stream_features, windowed_series
from dyadix.transformer import IntervalQuantiles, IntervalQuantilesModel

WORKED = [1, 2, 4, 7, 11, 16, 22, 29, 37, 46]
EXACT_RAW = [1, -4, 46, 1, 6, 16, 16, 7, 12, 1.5, 7, 19, 37, 5.5, 16, 33, 1, 2, 4, 9, 16, 22, 29, 41.5]
APPROX_RAW = [1, -1.52381, 46, 1, 6, 16, 16, 7, 12, 1.5, 7.250751, 19, 37.250128, 5.5, 16.250305, 33, 1, 2, 4, 9, 16, 22, 29, 41.5]
EXACT_DIFF1 = [1.6, 0, 8.4, 2.6, 5, 1.56, 5.5, 1.9, 3.5, 5.5, 7.8, 3.5, 5.5, 7.4, 1.6, 2.2, 3, 4, 5, 6, 7, 8.1]
EXACT_FFT = [25, 110.856052, 84.646585, 26.300428, 30.983152, 175, 63.790055, 30.983152, 25.650214, 84.646585, 36.958338, 26.300428]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "series_id long, x array<double>")


@pytest.mark.parametrize("strategy", ["arrow", "rowwise", "long"])
def test_worked_example(spark, strategy):
    df = frame(spark, [WORKED])
    get = lambda mode, name: X.interval_features(df, ["series_id"], "x", 10, mode, (name,), strategy).first().features
    assert get("exact", "raw") == pytest.approx(EXACT_RAW, abs=1e-6)
    assert get("approx", "raw") == pytest.approx(APPROX_RAW, abs=1e-5)
    assert get("exact", "diff1_smooth") == pytest.approx(EXACT_DIFF1, abs=1e-6)
    assert get("exact", "fft_abs") == pytest.approx(EXACT_FFT, abs=1e-5)
    assert get("exact", "diff2") == pytest.approx([1, 0] + [1] * 18)


@pytest.mark.parametrize("length", [3, 48, 65])
@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_three_plans_agree(spark, length, mode):
    rng = np.random.default_rng(length)
    rows = [rng.normal(size=length) + 1e4, np.full(length, 7.0), rng.normal(size=length)]
    df = frame(spark, rows)
    got = [X.interval_features(df, ["series_id"], "x", length, mode, strategy=s).orderBy("series_id").collect() for s in ("arrow", "rowwise", "long")]
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            # single-point spreads of a large offset are rounding noise in any plan
            assert a.features == pytest.approx(b.features, abs=2e-5)


def test_equivariance_and_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 64))
    f, g = X.exact_block(x), X.exact_block(3 * x + 2)
    centered = np.array([p.centered for p in layout.features(64)])
    assert np.allclose(g[:, centered], 3 * f[:, centered]) and np.allclose(g[:, ~centered], 3 * f[:, ~centered] + 2)
    ends = np.array([not layout.approximated(p) for p in layout.features(64)])
    assert np.allclose(X.approx_block(x)[:, ends], f[:, ends])
    assert np.allclose(X.approx_block(np.full((2, 64), 4.0)), X.exact_block(np.full((2, 64), 4.0)))


def test_fft_by_sums(spark):
    df = frame(spark, [WORKED])
    a, b = df.select(R.fft_abs(F.col("x")).alias("a"), R.fft_abs_sql(F.col("x"), 10).alias("b")).first()
    assert a == pytest.approx(b) and a == pytest.approx(list(np.abs(np.fft.rfft(WORKED))))


@pytest.mark.parametrize(("length", "short"), [(3, 128), (97, 128), (15, 0), (16, 0), (31, 0), (37, 0), (74, 0), (120, 0), (256, 128)])
def test_fft_without_python(spark, monkeypatch, length, short):
    """Powers of two, odd, small and large prime lengths, and twice a large prime."""
    monkeypatch.setattr(R, "SHORT", short)
    x = np.random.default_rng(length).normal(size=(2, length)) + 3
    df = frame(spark, x)
    got = [r.a for r in df.select("series_id", R.fft_abs_sql(F.col("x"), length).alias("a")).orderBy("series_id").collect()]
    assert np.allclose(got, np.abs(np.fft.rfft(x, axis=1)), atol=1e-9)


def test_estimator(spark, tmp_path):
    df = frame(spark, [WORKED, WORKED[::-1]])
    model = IntervalQuantiles(mode="exact").fit(df)
    out = model.transform(df).orderBy("series_id").collect()
    assert len(out[0].features) == model.n_features == len(model.feature_names())
    assert out[0].features[:24] == pytest.approx(EXACT_RAW)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = IntervalQuantilesModel.load(str(tmp_path / "m")).transform(df).orderBy("series_id").collect()
    assert again[1].features == out[1].features
    for version in ("samples", "intervals", 5, 5000):
        got = IntervalQuantiles(mode="exact", version=version).fit_transform(df).orderBy("series_id").collect()
        assert got[0].features == pytest.approx(out[0].features)
    for bad in ({"mode": "x"}, {"depth": 0}, {"div": 0}, {"version": "y"}, {"version": 0}):
        with pytest.raises(ValueError):
            IntervalQuantiles(**bad)
    with pytest.raises(ValueError):
        IntervalQuantiles().fit(frame(spark, [[1, 2, 3], [1, 2]]))
    with pytest.raises(Exception, match="10 finite points"):
        model.transform(frame(spark, [[float("nan")] * 10])).collect()


def test_two_channels(spark):
    rows = [(0, c, [float(v * (1 + c)) for v in WORKED]) for c in (0, 1)]
    df = spark.createDataFrame(rows, "series_id long, c int, x array<double>")
    model = IntervalQuantiles(mode="exact", channelCol="c").fit(df)
    out = model.transform(df).first().features
    names = model.feature_names()
    assert len(out) == len(names) == model.n_features
    at = names.index("raw_ch1_iv[0:10]_d0_q1.00_exact")
    assert out[at] == 92 and out[names.index("raw_ch0_iv[0:10]_d0_q1.00_exact")] == 46


def test_stream(spark, tmp_path):
    df = frame(spark, [WORKED, WORKED[::-1]])
    df.write.parquet(str(tmp_path / "in"))
    model = IntervalQuantiles(mode="approx").fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_features(stream, model).writeStream.format("memory").queryName("f").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("f").count() == 2


def test_windowed_series(spark):
    ev = spark.sql("select id % 2 as k, timestamp_seconds(id * 10) as ts, double(id) as v from range(40)")
    got = windowed_series(ev, "k", "ts", "v", "100 seconds", "1 minute", 4).collect()
    assert got and all(len(r.x) == 4 and r.x == sorted(r.x) for r in got)


@pytest.mark.parametrize("length", [3, 10, 48, 97, 512])
def test_presorted_blocks(length):
    z = np.random.default_rng(length).integers(0, 9, (6, length)) * 0.37  # ties
    for lower in (False, True):
        assert np.allclose(X.presorted_block(z, lower_median=lower), X.exact_block(z, lower_median=lower), atol=1e-12)


@pytest.mark.parametrize("length", [3, 10, 48, 97, 512, 1000])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_merged_moments_of_blocks(length, offset):
    z = np.random.default_rng(length).normal(size=(5, length)) + offset
    m = X.moments_block(z)
    for iv in layout.intervals(length):
        part = z[:, iv.start:iv.end]
        c = part - part.mean(1, keepdims=True)
        i = iv.interval_id
        assert m["n"][i] == iv.width and np.allclose(m["mean"][i], part.mean(1), rtol=1e-14)
        assert np.array_equal(m["low"][i], part.min(1)) and np.array_equal(m["high"][i], part.max(1))
        for k, name in ((2, "m2"), (3, "m3"), (4, "m4")):
            assert np.allclose(m[name][i], (c ** k).sum(1), atol=1e-6 * max(1, iv.width))
    if offset == 0:
        assert np.allclose(X.approx_block(z), X.width_block(z, "approx"), atol=1e-9)


def test_presort_plan(spark):
    df = frame(spark, [WORKED, WORKED[::-1]])
    a, b = (X.interval_features(df, ["series_id"], "x", 10, "exact", strategy=s).orderBy("series_id").collect() for s in ("presort", "arrow"))
    assert [r.features for r in a] == [pytest.approx(r.features) for r in b]
    with pytest.raises(ValueError):
        X.interval_features(df, ["series_id"], "x", 10, "approx", strategy="presort")


def test_moments_of_a_stream(spark, tmp_path):
    """The state is the merged moments: points in any order over two files, then intervals from what was written."""
    from dyadix.streaming.features import stream_moments

    rng = np.random.default_rng(3)
    z = rng.normal(size=(3, 37)) + 1e5
    rows = [(i, t, float(z[i, t])) for i in range(3) for t in range(37)]
    order = rng.permutation(len(rows))
    schema = "id long, t int, y double"
    for k in range(2):
        spark.createDataFrame([rows[i] for i in order[k::2]], schema).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    q = stream_moments(stream, ["id"], 37).writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.id, r.interval_id): r for r in X.interval_moments(spark.table("moments"), ["id"], 37).collect()}
    batch = {(r.id, r.interval_id): r for r in X.moments_long(spark.createDataFrame(rows, schema), ["id"], 37).collect()}
    assert len(got) == len(batch) == 3 * len(layout.intervals(37))
    for iv in layout.intervals(37):
        for i in range(3):
            part, r = z[i, iv.start:iv.end], got[i, iv.interval_id]
            c = part - part.mean()
            assert r.n == iv.width and r.mean == pytest.approx(part.mean()) and (r.low, r.high) == (part.min(), part.max())
            for name, power in (("var", 2), ("m3", 3), ("m4", 4)):
                assert r[name] == pytest.approx((c ** power).mean(), abs=1e-6) and batch[i, iv.interval_id][name] == pytest.approx(r[name], abs=1e-6)
