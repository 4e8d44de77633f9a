"""Registered queries over the test tables and the SQL that an independent database runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadix.functions import normal
from dyadix.functions import representations as R
from dyadix.operators import features as X
from dyadix.operators import fits, metrics, relational
from dyadix.operators.prefix import numbered
from dyadix.plans import costmodel, layout
from dyadix.sources import series
from dyadix.streaming.features import padded

LENGTH = 64
LENGTHS = [3, 15, 16, 24, 32, 48, 63, 64, 96, 97, 128, 200]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- layout ------------------------------------------------------------------------------------------------------

def intervals_sql(length: int, depth: int = 6, median: str = "median") -> str:
    """CTEs ending in iv(interval_id, depth, shifted, s, e, m)."""
    levels = min(depth, length.bit_length())
    return f"""
      lv AS (SELECT r AS d, (1::BIGINT << r) AS n FROM range({levels}) t(r)),
      base AS (SELECT d, n, i, (i * {length}) // n AS s, ((i + 1) * {length}) // n AS e FROM (SELECT d, n, unnest(range(n)) AS i FROM lv)),
      mid AS (SELECT d, {median}(e - s) AS w FROM base GROUP BY d),
      moved AS (SELECT b.d, i, s + ({length} + 2 * n - 1) // (2 * n) AS s, e + ({length} + 2 * n - 1) // (2 * n) AS e
                FROM base b JOIN mid USING (d) WHERE n > 1 AND w > 1 AND i < n - 1),
      iv AS (SELECT row_number() OVER (ORDER BY d, sh, i) - 1 AS interval_id, d AS depth, sh AS shifted, s, e, e - s AS m
             FROM (SELECT d, false AS sh, i, s, e FROM base UNION ALL SELECT d, true, i, s, e FROM moved))"""


def quantiles_sql(div: int = 4) -> str:
    """CTE ft(feature_idx, interval_id, s, e, m, nq, k, q, centered, kind) over iv."""
    return f"""
      ft AS (SELECT row_number() OVER (ORDER BY interval_id, k) - 1 AS feature_idx, *,
                    CASE WHEN nq = 1 THEN 0.5 ELSE k::DOUBLE / (nq - 1) END AS q, nq > 1 AND k % 2 = 1 AS centered,
                    CASE WHEN m = 1 THEN 0 WHEN nq = 1 THEN 1 ELSE 2 END AS kind
             FROM (SELECT interval_id, s, e, m, 1 + (m - 1) // {div} AS nq, unnest(range(1 + (m - 1) // {div})) AS k FROM iv))"""


REPR_SQL = {
    "raw": "list_transform(x, lambda v: v)",
    "diff1_smooth": "list_transform(range(len(x) - 1), lambda i: list_sum(list_transform(range(-2, 3), lambda k: x[least(greatest(i + k, 0), len(x) - 2) + 2] - x[least(greatest(i + k, 0), len(x) - 2) + 1])) / 5)",
    "diff2": "list_transform(range(len(x) - 2), lambda i: (x[i + 3] - x[i + 2]) - (x[i + 2] - x[i + 1]))",
    "fft_abs": "list_transform(range(len(x) // 2 + 1), lambda k: sqrt(pow(list_sum(list_transform(range(len(x)), lambda t: x[t + 1] * cos(2 * pi() * ((k * t) % len(x)) / len(x)))), 2) + pow(list_sum(list_transform(range(len(x)), lambda t: x[t + 1] * sin(2 * pi() * ((k * t) % len(x)) / len(x)))), 2)))",
}
VECTORS_SQL = "series AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def poly_sql(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0])
    for v in c[1:]:
        out = f"(({out}) * {x} + {v!r})"
    return out


def z_sql(q: str) -> str:
    n = normal
    tail = lambda p: f"({poly_sql(n.TAIL_TOP, f'sqrt(-2 * ln({p}))')}) / ({poly_sql(n.TAIL_BOTTOM, f'sqrt(-2 * ln({p}))')})"
    mid = f"({q} - 0.5) * ({poly_sql(n.CENTRE_TOP, f'(({q} - 0.5) * ({q} - 0.5))')}) / ({poly_sql(n.CENTRE_BOTTOM, f'(({q} - 0.5) * ({q} - 0.5))')})"
    return f"CASE WHEN {q} <= 0 OR {q} >= 1 THEN 0 WHEN {q} < {n.TAIL} THEN {tail(q)} WHEN {q} > 1 - {n.TAIL} THEN -({tail(f'(1 - {q})')}) ELSE {mid} END"


EXACT_VALUE = """CASE WHEN q * (m - 1) - floor(q * (m - 1)) >= 0.5
    THEN o[least(floor(q * (m - 1))::BIGINT + 1, m - 1) + 1] - (o[least(floor(q * (m - 1))::BIGINT + 1, m - 1) + 1] - o[floor(q * (m - 1))::BIGINT + 1]) * (1 - (q * (m - 1) - floor(q * (m - 1))))
    ELSE o[floor(q * (m - 1))::BIGINT + 1] + (o[least(floor(q * (m - 1))::BIGINT + 1, m - 1) + 1] - o[floor(q * (m - 1))::BIGINT + 1]) * (q * (m - 1) - floor(q * (m - 1))) END"""


def features_sql(key: str, source: str, length: int, name: str, mode: str, median: str = "median", digits: int = 6, base: int = 0) -> str:
    """(key, feature_idx, value) of one representation; ``source`` is a CTE named series(key, x)."""
    n = layout.representation_lengths(length)[name]
    parts = f"""ft2 AS (SELECT *, {z_sql('q')} AS z FROM ft),
      y AS (SELECT {key}, {REPR_SQL[name]} AS y FROM series),
      part AS (SELECT {key}, interval_id, s, e, list_slice(y, s + 1, e) AS p FROM y, iv),
      sums AS (SELECT *, list_avg(p) AS mean FROM part),"""
    if mode == "exact":
        parts += f"""st AS (SELECT {key}, interval_id, mean, list_sort(p) AS o FROM sums)
      SELECT {key}, feature_idx + {base} AS feature_idx, round({EXACT_VALUE} - CASE WHEN centered THEN mean ELSE 0 END, {digits}) + 0.0 AS value
      FROM st JOIN ft2 USING (interval_id)"""
    else:
        parts += f"""mo AS (SELECT {key}, interval_id, mean, list_min(p) AS lo, list_max(p) AS hi,
               list_avg(list_transform(p, lambda v: pow(v - mean, 2))) AS var,
               list_avg(list_transform(p, lambda v: pow(v - mean, 3))) AS m3, list_avg(list_transform(p, lambda v: pow(v - mean, 4))) AS m4 FROM sums),
      st AS (SELECT *, m3 / (pow(sqrt(greatest(var, 1e-12)), 3) + 1e-12) AS sk, m4 / (var * var + 1e-12) - 3 AS ku FROM mo)
      SELECT {key}, feature_idx + {base} AS feature_idx,
             round(CASE WHEN kind = 0 THEN mean WHEN kind = 2 AND k = 0 THEN lo WHEN kind = 2 AND k = nq - 1 THEN hi
                   ELSE mean + sqrt(greatest(var, 0)) * (z + (z * z - 1) / 6 * sk + (z * z * z - 3 * z) / 24 * ku - (2 * z * z * z - 5 * z) / 36 * sk * sk) END
                   - CASE WHEN centered THEN mean ELSE 0 END, {digits}) + 0.0 AS value
      FROM st JOIN ft2 USING (interval_id)"""
    return f"WITH {source}, {intervals_sql(n, median=median)}, {quantiles_sql()}, {parts}"


@query(f"WITH {intervals_sql(LENGTH)} SELECT interval_id, depth, shifted, s, e, m FROM iv")
def layout_intervals(spark, sf_dir):
    return layout.interval_table(spark, LENGTH).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {intervals_sql(48).replace('median(e - s)', 'quantile_disc(e - s, 0.5)')} SELECT interval_id, depth, shifted, s, e, m FROM iv")
def layout_lower_median(spark, sf_dir):
    return layout.interval_table(spark, 48, lower_median=True).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {intervals_sql(LENGTH)}, {quantiles_sql()} SELECT interval_id, k, nq, m, kind::BIGINT AS kind, round(q, 9) AS q, centered FROM ft")
def layout_quantiles(spark, sf_dir):
    return layout.quantile_table(spark, LENGTH).withColumn("q", F.round("q", 9)).withColumn("kind", F.col("kind").cast("long"))


def _counts_sql(n: int) -> str:
    return f"""(WITH {intervals_sql(n)} SELECT {n}::BIGINT AS length, count(*) AS n_intervals, sum(m)::BIGINT AS total_width, sum(1 + (m - 1) // 4)::BIGINT AS n_quantiles,
        count(*) FILTER (m = 1) AS n_points, round(sum(m * log2(m)), 6) AS sort_work FROM iv)"""


@query(" UNION ALL ".join(map(_counts_sql, LENGTHS)))
def layout_counts_by_length(spark, sf_dir):
    """The closed forms, beside an enumeration in SQL."""
    return costmodel.count_table(spark, LENGTHS).select(
        F.col("length").cast("long").alias("length"), "n_intervals", "total_width", "n_quantiles", "n_points", F.round("sort_work", 6).alias("sort_work"))


@query(f"""WITH {intervals_sql(LENGTH)}, {quantiles_sql()} SELECT feature_idx, 'raw_iv[' || s || ':' || e || ']_d' || depth || '_'
    || CASE WHEN kind = 0 THEN 'raw' ELSE 'q' || printf('%.2f', q) || CASE WHEN centered THEN '_centered' ELSE '' END END || '_exact' AS name
    FROM ft JOIN (SELECT interval_id, depth FROM iv) USING (interval_id)""")
def feature_names(spark, sf_dir):
    names = layout.feature_names(LENGTH, "exact")[:len(layout.features(LENGTH))]
    return spark.createDataFrame(list(enumerate(names)), "feature_idx long, name string")


# ---- representations ---------------------------------------------------------------------------------------------

def _representation(name):
    def run(spark, sf_dir):
        x = F.col("embedding").cast("array<double>")
        df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(R.COLUMNS[name](x)).alias("t", "y"))
        return df.select("vec_id", F.col("t").cast("long").alias("t"), (F.round("y", 6) + F.lit(0.0)).alias("y"))

    run.__name__ = f"repr_{name}"
    query(f"WITH {VECTORS_SQL}, y AS (SELECT vec_id, {REPR_SQL[name]} AS y FROM series) SELECT vec_id, unnest(range(len(y))) AS t, round(unnest(y), 6) + 0.0 AS y FROM y")(run)


for _name in layout.REPRESENTATIONS:
    _representation(_name)


# ---- features ----------------------------------------------------------------------------------------------------

def _rows(df, key="vec_id"):
    return X.as_rows(df, [key]).select(key, F.col("feature_idx").cast("long").alias("feature_idx"), "value")


def _features(mode, name, strategy):
    def run(spark, sf_dir):
        return _rows(X.interval_features(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", LENGTH, mode, (name,), strategy))

    run.__name__ = f"{mode}_{name}" + ("" if strategy == "arrow" else f"_{strategy}")
    query(features_sql("vec_id", VECTORS_SQL, LENGTH, name, mode))(run)


for _mode in ("exact", "approx"):
    for _name in layout.REPRESENTATIONS:
        _features(_mode, _name, "arrow")
    for _strategy in ("rowwise", "long"):
        _features(_mode, "raw", _strategy)


def _all(mode):
    def run(spark, sf_dir):
        df = X.interval_features(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", LENGTH, mode)
        total = lambda f: F.aggregate("features", F.lit(0.0), f)
        return df.select("vec_id", F.size("features").cast("long").alias("n_features"), F.round(total(lambda a, v: a + v), 4).alias("total"),
                         F.round(total(lambda a, v: a + F.abs(v)), 4).alias("total_abs"))

    run.__name__ = f"{mode}_all"
    parts, base = [], 0
    for name, n in layout.representation_lengths(LENGTH).items():
        parts.append(f"SELECT * FROM ({features_sql('vec_id', VECTORS_SQL, LENGTH, name, mode, digits=12, base=base)})")
        base += len(layout.features(n))
    union = " UNION ALL ".join(parts)
    query(f"SELECT vec_id, count(*) AS n_features, round(sum(value), 4) AS total, round(sum(abs(value)), 4) AS total_abs FROM ({union}) GROUP BY vec_id")(run)


_all("exact")
_all("approx")


@query(features_sql("vec_id", "series AS (SELECT vec_id, list_transform(range(48), lambda i: embedding[i + 1]::DOUBLE + CASE WHEN i < 16 THEN embedding[i + 49]::DOUBLE ELSE 0 END) AS x FROM embeddings)", 48, "raw", "exact").replace("median(e - s)", "quantile_disc(e - s, 0.5)"))
def exact_baseline_layout(spark, sf_dir):
    """The baseline variants' layout (lower median), at a length where it differs: all 64 values folded onto 48 points."""
    x = F.col("embedding").cast("array<double>")
    folded = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.get(x, i) + F.when(i < 16, F.get(x, i + 48)).otherwise(0.0))
    df = table(spark, sf_dir, "embeddings").select("vec_id", folded.alias("x"))
    return _rows(X.interval_features(df, ["vec_id"], "x", 48, "exact", ("raw",), lower_median=True))


@query(features_sql("vec_id", VECTORS_SQL, 64, "raw", "exact"))
def exact_sort_order(spark, sf_dir):
    """The pre-sorted variant: one sort a series, parted by bucket level after level."""
    return _rows(X.interval_features(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", LENGTH, "exact", ("raw",), "presort"))


@query(f"""WITH {VECTORS_SQL}, {intervals_sql(LENGTH)}, p AS (SELECT vec_id, interval_id, list_slice(x, s + 1, e) AS p FROM series, iv), q AS (SELECT *, list_avg(p) AS mean FROM p)
    SELECT vec_id, interval_id, len(p) AS n, round(mean, 6) + 0.0 AS mean, round(list_avg(list_transform(p, lambda v: pow(v - mean, 2))), 6) AS var,
    round(list_avg(list_transform(p, lambda v: pow(v - mean, 3))), 6) + 0.0 AS m3, round(list_avg(list_transform(p, lambda v: pow(v - mean, 4))), 6) AS m4,
    round(list_min(p), 6) + 0.0 AS low, round(list_max(p), 6) + 0.0 AS high FROM q""")
def moments_raw(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("t", "y"))
    m = X.moments_long(points, ["vec_id"], LENGTH)
    return m.select("vec_id", F.col("interval_id").cast("long").alias("interval_id"), "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "var", "m3", "m4", "low", "high")])


EVENTS_SQL = """ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, value,
      coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) / 3141592653.59 AS gap FROM events)"""


def event_pairs_sql(length: int) -> str:
    """CTE pair(id, user_id, block, v, g) over ev."""
    return f"""pair AS (SELECT user_id || '/' || r // {length} AS id, user_id, r // {length} AS block, list_resize(list(value ORDER BY r), {length}, arg_max(value, r)) AS v,
             list_resize(list(gap ORDER BY r), {length}, arg_max(gap, r)) AS g FROM ev GROUP BY user_id, r // {length})"""


def numbered_events(events: DataFrame) -> DataFrame:
    """Events with ``r``, their number from 0 within their user by (ts, event_id)."""
    return numbered(events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "r")


def event_series(rows: DataFrame, length: int) -> DataFrame:
    """(user_id, block, v, g): every user's values and the times between them (in a unit that makes no decimal ties when rounded), as consecutive
    series of ``length`` events of ``numbered_events``; the last one repeats its last event up to that length.

    A block is a group of its own, so a user of any number of events is many tasks; the time before a block's first
    event comes from the block before it by a join on (user_id, block)."""
    point = F.struct("r", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    blocks = rows.groupBy("user_id", F.floor(F.col("r") / length).alias("block")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    last = rows.where(F.pmod("r", F.lit(length)) == length - 1).select(
        F.col("user_id").alias("u"), F.floor(F.col("r") / length + 1).alias("b"), F.unix_micros(F.col("ts").cast("timestamp")).alias("prior"))
    joined = blocks.join(last, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("block") == F.col("b")), "left")
    gaps = F.transform("p", lambda s, i: F.coalesce((s["at"] - F.when(i == 0, F.col("prior")).otherwise(F.get(F.col("p"), i - 1)["at"])) / 3141592653.59, F.lit(0.0)))
    return joined.select("user_id", "block", padded(F.transform("p", lambda s: s["value"]), length).alias("v"), padded(gaps, length).alias("g"))


def _two_channels_sql(mode):
    src = "series AS (SELECT id || '/0' AS id, v AS x FROM pair UNION ALL SELECT id || '/1', g FROM pair)"
    inner = features_sql("id", f"{EVENTS_SQL}, {event_pairs_sql(32)}, {src}", 32, "raw", mode, digits=15).replace("WITH ", "", 1)
    cut = inner.rindex("SELECT id, feature_idx")
    return f"""WITH {inner[:cut]} , res AS ({inner[cut:]})
      SELECT split_part(id, '/', 1)::BIGINT AS user_id, split_part(id, '/', 2)::BIGINT AS block,
             row_number() OVER (PARTITION BY split_part(id, '/', 1), split_part(id, '/', 2) ORDER BY interval_id, id, k) - 1 AS feature_idx, round(value, 7) + 0.0 AS value
      FROM res JOIN ft USING (feature_idx)"""


def _events(mode):
    def run(spark, sf_dir):
        pairs = event_series(numbered_events(table(spark, sf_dir, "events")), 32)
        made = X.channel_features(pairs, ["user_id", "block"], ["v", "g"], 32, mode, ("raw",))
        return X.as_rows(made, ["user_id", "block"], 7).select("user_id", "block", F.col("feature_idx").cast("long").alias("feature_idx"), "value")

    run.__name__ = f"{mode}_events_two_channel"
    query(_two_channels_sql(mode).replace(" , res", ", res"))(run)


_events("exact")
_events("approx")


@query(f"""WITH a AS ({features_sql('vec_id', VECTORS_SQL, LENGTH, 'raw', 'exact', digits=12)}), b AS ({features_sql('vec_id', VECTORS_SQL, LENGTH, 'raw', 'approx', digits=12)})
    SELECT feature_idx, round(corr(a.value, b.value), 5) AS correlation FROM a JOIN b USING (vec_id, feature_idx) GROUP BY feature_idx""")
def approx_vs_exact_correlation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    exact, approx = (X.interval_features(e, ["vec_id"], "embedding", LENGTH, m, ("raw",)) for m in ("exact", "approx"))
    both = exact.join(approx.withColumnRenamed("features", "other"), "vec_id").select("vec_id", F.posexplode(F.arrays_zip("features", "other")).alias("feature_idx", "p"))
    c = metrics.correlation(both.select("feature_idx", F.col("p.features").alias("a"), F.col("p.other").alias("b")), ["feature_idx"], "a", "b")
    return c.select(F.col("feature_idx").cast("long").alias("feature_idx"), F.round("correlation", 5).alias("correlation"))


@query(f"""WITH a AS ({features_sql('vec_id', VECTORS_SQL, LENGTH, 'raw', 'exact', digits=12)}), b AS ({features_sql('vec_id', VECTORS_SQL, LENGTH, 'raw', 'approx', digits=12)})
    SELECT round(max(abs(a.value - b.value)), 5) AS max_abs_diff, round(avg(abs(a.value - b.value)), 6) AS mean_abs_diff, count(*) AS n FROM a JOIN b USING (vec_id, feature_idx)""")
def diff_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    exact, approx = (X.interval_features(e, ["vec_id"], "embedding", LENGTH, m, ("raw",)) for m in ("exact", "approx"))
    both = exact.join(approx.withColumnRenamed("features", "other"), "vec_id").select(F.explode(F.arrays_zip("features", "other")).alias("p")).select("p.features", "p.other")
    s = metrics.difference_summary(both, [], "features", "other")
    return s.select(F.round("max_abs_diff", 5).alias("max_abs_diff"), F.round("mean_abs_diff", 6).alias("mean_abs_diff"), "n")


# ---- resampling and labels ---------------------------------------------------------------------------------------

@query("""WITH pool AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS pool_id FROM embeddings),
    idx AS (SELECT pool_id AS idx FROM pool WHERE (pool_id * 7) % 3 = 0)
    SELECT vec_id, pool_id, CASE WHEN pool_id IN (SELECT idx FROM idx) THEN 'train' ELSE 'test' END AS split FROM pool""")
def resample_split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("dataset"), "vec_id", "label")
    pool = series.pooled(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "vec_id")
    indices = pool.where("(pool_id * 7) % 3 = 0").select(F.col("pool_id").alias("idx"))
    train, test = series.resample(pool, indices)
    return train.select("vec_id", "pool_id", F.lit("train").alias("split")).unionByName(test.select("vec_id", "pool_id", F.lit("test").alias("split")))


@query("WITH i AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS y FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, event_type, y FROM events JOIN i USING (event_type)")
def label_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return series.with_label(e, series.label_index(e, "event_type"), "event_type").select("event_id", "event_type", F.col("y").cast("long").alias("y"))


LENGTHS_SQL = "n AS (SELECT user_id, count(*) AS series_length FROM events GROUP BY user_id)"


@query(f"""WITH {LENGTHS_SQL}, q AS (SELECT quantile_cont(ln(series_length), [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM n)
    SELECT user_id, series_length, CASE WHEN series_length <= exp(q[2]) * (1 + 1e-9) THEN 1 WHEN series_length <= exp(q[3]) * (1 + 1e-9) THEN 2
    WHEN series_length <= exp(q[4]) * (1 + 1e-9) THEN 3 ELSE 4 END AS bin FROM n, q""")
def length_bins(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("series_length"))
    return relational.length_bins(n, "series_length")


# ---- scores ------------------------------------------------------------------------------------------------------

SCORES_SQL = "s AS (SELECT doc_id, doc_id % 3 AS fold, quality AS y, ((doc_id * 7919) % 101) / 101.0::DOUBLE AS p, CASE WHEN (doc_id * 7919) % 101 >= 50 THEN 1 ELSE 0 END AS pred FROM labels)"


def scores(spark, sf_dir):
    h = (F.col("doc_id") * 7919) % 101
    p = h / F.lit(101.0)
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).alias("fold"), F.col("quality").alias("y"), p.alias("p"),
                                                  F.array(1 - p, p).alias("proba"), (h >= 50).cast("int").alias("pred"))


def _round(df, *columns, digits=9):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(f"WITH {SCORES_SQL} SELECT fold, round(avg((y = pred)::INT), 9) AS accuracy FROM s GROUP BY fold")
def accuracy(spark, sf_dir):
    return _round(metrics.accuracy(scores(spark, sf_dir), ["fold"]), "accuracy")


@query(f"WITH {SCORES_SQL} SELECT fold, round(avg(r), 9) AS balanced_accuracy FROM (SELECT fold, y, avg((y = pred)::INT) AS r FROM s GROUP BY fold, y) GROUP BY fold")
def balanced_accuracy(spark, sf_dir):
    return _round(metrics.balanced_accuracy(scores(spark, sf_dir), ["fold"]), "balanced_accuracy")


@query(f"WITH {SCORES_SQL} SELECT fold, round(-avg(ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 8) AS log_loss FROM s GROUP BY fold")
def log_loss(spark, sf_dir):
    return _round(metrics.log_loss(scores(spark, sf_dir), ["fold"]), "log_loss", digits=8)


@query(f"""WITH {SCORES_SQL}, r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM s)
    SELECT fold, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS roc_auc FROM r GROUP BY fold""")
def roc_auc_binary(spark, sf_dir):
    return _round(metrics.roc_auc(scores(spark, sf_dir), ["fold"], "y", "p"), "roc_auc")


MULTI_SQL = """m AS (SELECT vec_id, label % 3 AS y, list_transform(range(3), lambda k: 1.0::DOUBLE + ((vec_id + 31 * k) * 7919) % 97) AS w FROM embeddings),
    pr AS (SELECT vec_id, y, list_transform(w, lambda v: v / list_sum(w)) AS p, w FROM m)"""


def multi(spark, sf_dir):
    w = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.lit(1.0) + ((F.col("vec_id") + 31 * k) * 7919) % 97)
    df = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"), w.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    return df.select("vec_id", "y", F.transform("w", lambda v: v / total).alias("proba")).withColumn("pred", metrics.argmax(F.col("proba")))


@query(f"""WITH {MULTI_SQL}, e AS (SELECT k, (y = k)::INT AS hit, p[k + 1] AS p FROM pr, range(3) t(k)),
    r AS (SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS r FROM e),
    a AS (SELECT k, sum(hit) AS w, (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit))) AS auc FROM r GROUP BY k)
    SELECT round(sum(auc * w) / sum(w), 9) AS roc_auc FROM a""")
def roc_auc_ovr(spark, sf_dir):
    return _round(metrics.roc_auc_ovr(multi(spark, sf_dir), [], 3), "roc_auc")


@query(f"WITH {SCORES_SQL} SELECT fold, arg_min(y, n * 10 + y)::INT AS minority FROM (SELECT fold, y, count(*) AS n FROM s GROUP BY fold, y) GROUP BY fold")
def minority_class(spark, sf_dir):
    return metrics.minority_class(scores(spark, sf_dir), ["fold"])


@query(f"""WITH {SCORES_SQL}, mi AS (SELECT fold, arg_min(y, n * 10 + y) AS c FROM (SELECT fold, y, count(*) AS n FROM s GROUP BY fold, y) GROUP BY fold)
    SELECT fold, round(coalesce(2.0 * count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (pred = c), 0), 0), 9) AS f1 FROM s JOIN mi USING (fold) GROUP BY fold""")
def f1_binary(spark, sf_dir):
    return _round(metrics.f1(scores(spark, sf_dir), ["fold"], 2), "f1")


@query(f"""WITH {MULTI_SQL}, d AS (SELECT y, list_position(p, list_max(p)) - 1 AS pred FROM pr),
    f AS (SELECT k, count(*) FILTER (y = k) AS n, coalesce(2.0 * count(*) FILTER (y = k AND pred = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER (pred = k), 0), 0) AS f FROM d, range(3) t(k) GROUP BY k)
    SELECT round(sum(f * n) / sum(n), 9) AS f1 FROM f""")
def f1_weighted(spark, sf_dir):
    return _round(metrics.f1(multi(spark, sf_dir), [], 3), "f1")


@query(f"WITH {SCORES_SQL}, a AS (SELECT fold, round(avg((y = pred)::INT), 9) AS accuracy, count(*) AS n FROM s GROUP BY fold) SELECT fold, accuracy FROM a")
def all_metrics_accuracy(spark, sf_dir):
    return _round(metrics.all_metrics(scores(spark, sf_dir), ["fold"], 2), "accuracy").select("fold", "accuracy")


PAIRS_SQL = "pr AS (SELECT user_id, round(avg(value) FILTER (event_id % 2 = 0), 6) AS a, round(avg(value) FILTER (event_id % 2 = 1), 6) AS b FROM events GROUP BY user_id)"


def pairs(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.avg(F.when(even, F.col("value"))), 6).alias("a"), F.round(F.avg(F.when(~even, F.col("value"))), 6).alias("b"))


@query(f"""WITH {PAIRS_SQL} SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses,
    round(median(a), 5) AS median_a, round(median(b), 5) AS median_b, round(avg(a), 5) AS mean_a, round(avg(b), 5) AS mean_b FROM pr""")
def paired_counts(spark, sf_dir):
    return _round(metrics.paired_counts(pairs(spark, sf_dir), "a", "b"), "median_a", "median_b", "mean_a", "mean_b", digits=5)


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT round(a - b, 6) AS d FROM pr WHERE a <> b),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
    SELECT round(sum(r) FILTER (d > 0), 3) AS w_plus, round(sum(r) FILTER (d < 0), 3) AS w_minus, count(*) AS n FROM r""")
def wilcoxon_stats(spark, sf_dir):
    d = pairs(spark, sf_dir).select(F.round(F.col("a") - F.col("b"), 6).alias("a"), F.lit(0.0).alias("b"))
    return _round(metrics.wilcoxon_sums(d, "a", "b"), "w_plus", "w_minus", digits=3).select("w_plus", "w_minus", "n")


@query(f"WITH {PAIRS_SQL} SELECT count(a - b) AS n, round(avg(a - b), 6) AS mean_diff, round(stddev_samp(a - b), 6) AS sd_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(a - b))), 6) AS t FROM pr")
def paired_t(spark, sf_dir):
    return _round(metrics.t_statistics(pairs(spark, sf_dir), "a", "b"), "mean_diff", "sd_diff", "t", digits=6)


# ---- runtimes ----------------------------------------------------------------------------------------------------

RUNS_SQL = """r AS (SELECT 'd' || (user_id % 20) AS dataset, event_type AS estimator, event_id % 2 AS split, event_id % 5 AS run, value + 1 AS runtime,
    (user_id % 6 + 1) * 16 AS L, event_id % 7 + 1 AS n, user_id FROM events)"""


def runs(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("d"), u % 20).alias("dataset"), F.col("event_type").alias("estimator"), (e % 2).alias("split"), (e % 5).alias("run"),
        (F.col("value") + 1).alias("runtime"), ((u % 6 + 1) * 16).alias("L"), (e % 7 + 1).alias("n"), "user_id")


MIN_SQL = "m AS (SELECT dataset, estimator, min(runtime) AS t_min FROM r GROUP BY dataset, estimator)"
TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {RUNS_SQL} SELECT dataset, estimator, split, round(min(runtime), 6) AS t_min FROM r GROUP BY ALL")
def min_over_runs(spark, sf_dir):
    return _round(relational.min_over_runs(runs(spark, sf_dir), ["dataset", "estimator", "split"]), "t_min", digits=6)


@query(f"WITH {RUNS_SQL}, m AS (SELECT dataset, estimator, split, min(runtime) AS t FROM r GROUP BY ALL) SELECT dataset, estimator, round(sum(t), 6) AS transform_time FROM m GROUP BY ALL")
def sum_of_min_over_splits(spark, sf_dir):
    return _round(relational.sum_of_min_over_splits(runs(spark, sf_dir), ["dataset", "estimator"]), "transform_time", digits=6)


@query(f"WITH {RUNS_SQL} SELECT dataset, estimator, round(avg(runtime), 9) AS mean_runtime FROM r GROUP BY ALL")
def mean_by_estimator_dataset(spark, sf_dir):
    return _round(relational.mean_by(runs(spark, sf_dir), ["dataset", "estimator"], ["runtime"]), "mean_runtime")


@query(f"WITH {RUNS_SQL} SELECT estimator, L AS bin, round(avg(n), 9) AS mean_score, round(median(runtime), 9) AS median_runtime, count(*) AS n, count(DISTINCT dataset) AS n_items FROM r GROUP BY estimator, L")
def median_count_distinct(spark, sf_dir):
    df = runs(spark, sf_dir).withColumnRenamed("L", "bin").withColumnRenamed("n", "score")
    return _round(relational.summary_by_bin(df, ["estimator", "bin"], "score", "runtime", "dataset"), "mean_score", "median_runtime")


@query(f"WITH {RUNS_SQL}, {MIN_SQL} SELECT dataset, estimator, round(t_min / sum(t_min) OVER (PARTITION BY dataset), 9) AS share FROM m")
def share_of_total(spark, sf_dir):
    m = relational.min_over_runs(runs(spark, sf_dir), ["dataset", "estimator"])
    return _round(relational.share_of_total(m, ["dataset"], "t_min"), "share").select("dataset", "estimator", "share")


@query(f"WITH {RUNS_SQL} SELECT dataset, " + ", ".join(f"round(avg(runtime) FILTER (estimator = '{t}'), 9) AS {t}" for t in TYPES) + " FROM r GROUP BY dataset")
def pivot_mean(spark, sf_dir):
    return _round(relational.pivot_mean(runs(spark, sf_dir), ["dataset"], "estimator", TYPES, "runtime"), *TYPES)


@query(f"WITH {RUNS_SQL} SELECT dataset, " + ", ".join(f"round(avg(runtime) FILTER (estimator = '{t}' AND split = {s}), 9) AS {t}_{s}" for t in TYPES for s in (0, 1)) + " FROM r GROUP BY dataset")
def pivot_two_levels(spark, sf_dir):
    names = [f"{t}_{s}" for t in TYPES for s in (0, 1)]
    return _round(relational.pivot_two_levels(runs(spark, sf_dir), ["dataset"], ["estimator", "split"], names, "runtime"), *names)


@query("""WITH w AS (SELECT o_orderkey, o_totalprice::DOUBLE AS total, o_custkey::DOUBLE AS fit, 2.0::DOUBLE AS transform FROM orders)
    SELECT o_orderkey, 'total' AS stage, total AS time FROM w UNION ALL SELECT o_orderkey, 'fit', fit FROM w UNION ALL SELECT o_orderkey, 'transform', transform FROM w""")
def unpivot_stages(spark, sf_dir):
    w = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("total"), F.col("o_custkey").cast("double").alias("fit"), F.lit(2.0).alias("transform"))
    return relational.unpivot(w, ["o_orderkey"], ["total", "fit", "transform"])


@query(f"""WITH {RUNS_SQL}, m AS (SELECT dataset, L, estimator, min(runtime) AS t FROM r GROUP BY ALL)
    SELECT a.dataset, a.L, round(a.t, 6) AS t_base, round(b.t, 6) AS t_other, round(a.t / b.t, 9) AS speedup FROM m a JOIN m b ON a.dataset = b.dataset AND a.L = b.L WHERE a.estimator = 'click' AND b.estimator = 'view'""")
def speedup_join(spark, sf_dir):
    m = relational.min_over_runs(runs(spark, sf_dir), ["dataset", "L", "estimator"])
    s = relational.speedup(m.where("estimator = 'click'"), m.where("estimator = 'view'"), ["dataset", "L"])
    return _round(_round(s, "speedup"), "t_base", "t_other", digits=6)


@query(f"WITH {RUNS_SQL} SELECT estimator, L, n, count(*) AS c FROM r WHERE NOT (estimator = 'click' AND L = 96 AND n = 7) AND NOT (estimator = 'view' AND L = 16 AND n = 1) GROUP BY ALL")
def exclude_cells_anti(spark, sf_dir):
    cells = spark.createDataFrame([("click", 96, 7), ("view", 16, 1)], "estimator string, L long, n long")
    return relational.exclude_cells(runs(spark, sf_dir), cells).groupBy("estimator", "L", "n").agg(F.count("*").alias("c"))


@query(f"WITH {RUNS_SQL} SELECT estimator, CASE estimator WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' END AS label, count(*) AS c FROM r GROUP BY ALL")
def map_lookup(spark, sf_dir):
    names = spark.createDataFrame([("click", "Click"), ("view", "View")], "estimator string, label string")
    return relational.map_lookup(runs(spark, sf_dir), names, "estimator").groupBy("estimator", "label").agg(F.count("*").alias("c"))


@query("SELECT a.doc_id, a.quality AS a, b.toxic AS b FROM labels a LEFT JOIN (SELECT doc_id, nullif(toxic, 1) AS toxic FROM labels) b USING (doc_id) WHERE b.toxic IS NOT NULL AND a.quality IS NOT NULL")
def drop_null_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), F.nullif("toxic", F.lit(1)).alias("b"))
    return relational.drop_null_pairs(df, "a", "b")


@query("SELECT count(*) FILTER (nullif(toxic, 1) IS NULL) AS null_toxic, count(*) FILTER (quality IS NULL) AS null_quality FROM labels")
def null_counts(spark, sf_dir):
    return relational.null_counts(table(spark, sf_dir, "labels").select(F.nullif("toxic", F.lit(1)).alias("toxic"), "quality"), ["toxic", "quality"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_per_key(spark, sf_dir):
    return relational.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "event_id")


@query(f"""WITH {PAIRS_SQL} SELECT count(*) FILTER (a / b >= 1 AND a - b >= 0) AS faster_better, count(*) FILTER (a / b >= 1 AND NOT a - b >= 0) AS faster_worse,
    count(*) FILTER (NOT a / b >= 1 AND a - b >= 0) AS slower_better, count(*) FILTER (NOT a / b >= 1 AND NOT a - b >= 0) AS slower_worse FROM pr""")
def quadrant_counts(spark, sf_dir):
    p = pairs(spark, sf_dir).select((F.col("a") / F.col("b")).alias("x"), (F.col("a") - F.col("b")).alias("y"))
    return relational.quadrant_counts(p, "x", "y")


@query(f"WITH {RUNS_SQL} SELECT estimator, round(avg(runtime - n), 8) AS mean_error, round(avg(abs(runtime - n)), 8) AS mean_abs_error, round(max(abs(runtime - n)), 8) AS max_abs_error FROM r GROUP BY estimator")
def custom_error_aggregates(spark, sf_dir):
    df = runs(spark, sf_dir).withColumn("e", F.col("runtime") - F.col("n"))
    return _round(relational.error_summary(df, ["estimator"], "e"), "mean_error", "mean_abs_error", "max_abs_error", digits=8)


@query("SELECT o_orderkey, least(o_totalprice::DOUBLE, o_custkey::DOUBLE * 100) AS best FROM orders")
def row_minimum(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("a"), (F.col("o_custkey").cast("double") * 100).alias("b"))
    return relational.row_minimum(df, ["a", "b"]).select("o_orderkey", "best")


@query(f"WITH {RUNS_SQL}, m AS (SELECT dataset, L, estimator, min(runtime) AS t FROM r GROUP BY ALL) SELECT dataset, L, arg_min(estimator, (t, estimator)) AS winner, round((max(t) / min(t) - 1) * 100, 6) AS percent_slower FROM m GROUP BY dataset, L")
def winner_by_cell(spark, sf_dir):
    m = relational.min_over_runs(runs(spark, sf_dir), ["dataset", "L", "estimator"])
    return _round(relational.winner(m, ["dataset", "L"], "estimator", "t_min"), "percent_slower", digits=6)


@query("SELECT l::BIGINT AS length, n::BIGINT AS n FROM (SELECT unnest([16, 32, 64]) AS l), (SELECT unnest([1, 3, 10]) AS n)")
def parameter_grid(spark, sf_dir):
    g = relational.grid(spark, length=[16, 32, 64], n=[1, 3, 10])
    return relational.shuffled(g, 0).select(F.col("length").cast("long").alias("length"), F.col("n").cast("long").alias("n"))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(list_zip(embedding, range(64)), lambda p: {'v': p[1], 'i': p[2]})), lambda s: s.i), ',') AS positions FROM embeddings")
def argsort_idiom(spark, sf_dir):
    order = F.transform(F.sort_array(F.transform("embedding", lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda s: s["i"].cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(order, ",").alias("positions"))


# ---- fits --------------------------------------------------------------------------------------------------------

LINES_SQL = """ln AS (SELECT L, regr_slope(t / n, 1.0 / n) AS setup, regr_intercept(t / n, 1.0 / n) AS marginal, avg(t) AS mean FROM g GROUP BY L)"""
GRID_SQL = "g AS (SELECT L, n, min(runtime) + n * 3.0 AS t FROM r GROUP BY L, n)"


def fit_grid(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("L", "n").agg((F.min("runtime") + F.col("n") * 3.0).alias("t"))


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, {LINES_SQL} SELECT L, round(any_value(setup), 6) AS setup, round(any_value(marginal), 6) AS marginal,
    round(1 - sum(pow(t - setup - marginal * n, 2)) / nullif(sum(pow(t - mean, 2)), 0), 6) AS r2 FROM g JOIN ln USING (L) GROUP BY L""")
def fit_setup_marginal(spark, sf_dir):
    return _round(fits.setup_and_marginal(fit_grid(spark, sf_dir), ["L"]), "setup", "marginal", "r2", digits=6)


@query(f"WITH {RUNS_SQL}, {GRID_SQL} SELECT n, round(sum(L * t) / sum(L * L), 8) AS slope FROM g GROUP BY n")
def fit_origin(spark, sf_dir):
    return _round(fits.through_origin(fit_grid(spark, sf_dir).withColumn("x", F.col("L").cast("double")), ["n"], "x", "t"), "slope", digits=8)


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, s AS (SELECT n, sum(120.0 * 120) AS s11, sum(120.0 / L * 120) AS s12, sum(120.0 / L * 120 / L) AS s22, sum(120.0 * t) AS s1y, sum(120.0 / L * t) AS s2y FROM g GROUP BY n)
    SELECT n, round((s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12), 6) AS A, round((s1y * s12 - s2y * s11) / (s11 * s22 - s12 * s12), 4) AS B FROM s""")
def fit_kappa_curve(spark, sf_dir):
    g = fit_grid(spark, sf_dir).withColumns({"x1": F.lit(120.0), "x2": F.lit(120.0) / F.col("L")})
    return _round(_round(fits.two_terms(g, ["n"], "x1", "x2", "t"), "A", digits=6), "B", digits=4)


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, p AS (SELECT n, regr_slope(ln(greatest(t, 1e-300)), ln(L)) AS P FROM g GROUP BY n)
    SELECT n, round(any_value(P), 6) AS P, round(regr_intercept(t, pow(L, P)), 3) AS A, round(regr_slope(t, pow(L, P)), 3) AS C FROM g JOIN p USING (n) GROUP BY n""")
def fit_power_law(spark, sf_dir):
    f = fits.power_law(fit_grid(spark, sf_dir), ["n"], "L", "t")
    return _round(_round(f, "P", digits=6), "A", "C", digits=3).select("n", "P", "A", "C")


STUDY_SQL = """g AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'approx' ELSE 'exact' END AS mode, CASE WHEN event_id % 2 = 0 THEN 'samples' ELSE 'intervals' END AS variant,
    (user_id % 6 + 1) * 16 AS L, (event_id // 2) % 7 + 1 AS n, min(value + 1) + ((event_id // 2) % 7 + 1) * CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS t FROM events GROUP BY ALL)"""


@query(f"""WITH {STUDY_SQL.replace('GROUP BY ALL', 'GROUP BY 1, 2, 3, 4, event_id % 2, (event_id // 2) % 7')},
    f AS (SELECT L, mode, variant, regr_slope(t / n, 1.0 / n) AS c, regr_intercept(t / n, 1.0 / n) AS s FROM g GROUP BY ALL),
    k AS (SELECT mode, median((ci - cs) / 120) AS kappa FROM (SELECT L, mode, max(c) FILTER (variant = 'samples') AS cs, max(c) FILTER (variant = 'intervals') AS ci FROM f GROUP BY L, mode) GROUP BY mode),
    x AS (SELECT *, CASE mode WHEN 'approx' THEN 6 * L * 1.25 ELSE 6 * L * (log2(L) - 2.5) END AS x FROM f),
    t AS (SELECT mode, sum(x * s) FILTER (variant = 'samples') / sum(x * x) FILTER (variant = 'samples') AS a, sum(x * s) FILTER (variant = 'intervals') / sum(x * x) FILTER (variant = 'intervals') AS b FROM x GROUP BY mode)
    SELECT mode, round(kappa, 6) AS kappa, round(a, 8) AS tau_scalar, round(b, 8) AS tau_vec, round(a - b, 8) AS delta, CASE WHEN a > b THEN round(kappa * 120 / (a - b), 2) ELSE 'inf'::DOUBLE END AS nl_threshold FROM k JOIN t USING (mode)""")
def dispatch_threshold(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    half = F.floor(e / 2) % 7 + 1
    g = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type").isin("click", "view"), "approx").otherwise("exact").alias("mode"), F.when(e % 2 == 0, "samples").otherwise("intervals").alias("variant"),
        ((u % 6 + 1) * 16).alias("L"), half.alias("n"), (F.col("value") + 1).alias("v")).groupBy("mode", "variant", "L", "n").agg(
        (F.min("v") + F.col("n") * F.when(F.col("variant") == "samples", 2.0).otherwise(1.0)).alias("t_min"))
    s = fits.dispatch_study(g, 120)
    return _round(_round(_round(s, "kappa", digits=6), "tau_scalar", "tau_vec", "delta", digits=8), "nl_threshold", digits=2)


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, {LINES_SQL}, p AS (SELECT t, setup + marginal * n AS p FROM g JOIN ln USING (L)), m AS (SELECT avg(t) AS m FROM p)
    SELECT round(1 - sum(pow(t - p, 2)) / sum(pow(t - m, 2)), 6) AS r2, round(avg(abs((t - p) / t)) * 100, 6) AS mape, round(max(abs((t - p) / t)) * 100, 6) AS max_ape FROM p, m""")
def holdout_errors(spark, sf_dir):
    g = fit_grid(spark, sf_dir)
    line = fits.setup_and_marginal(g, ["L"]).select("L", "setup", "marginal")
    p = g.join(line, "L").withColumn("p", F.col("setup") + F.col("marginal") * F.col("n"))
    return _round(fits.holdout_errors(p, "t", "p"), "r2", "mape", "max_ape", digits=6)


@query(f"""WITH {RUNS_SQL}, {GRID_SQL}, {LINES_SQL}, o AS (SELECT a.L, a.setup AS c1, a.marginal AS s1, a.setup + 2.0 AS c2, a.marginal - 0.25 AS s2 FROM ln a)
    SELECT L, round(CASE WHEN s1 > s2 AND (c2 - c1) / (s1 - s2) > 0 THEN (c2 - c1) / (s1 - s2) END, 6) AS n_star FROM o""")
def crossover_n(spark, sf_dir):
    line = fits.setup_and_marginal(fit_grid(spark, sf_dir), ["L"])
    n = fits.crossover(F.col("setup"), F.col("marginal"), F.col("setup") + 2.0, F.col("marginal") - 0.25)
    return line.select("L", F.round(n, 6).alias("n_star"))


@query()
def joint_least_squares(spark, sf_dir):
    """The joint fit of three terms from per-task triangular factors."""
    g = fit_grid(spark, sf_dir).select(F.lit(1.0).alias("one"), F.col("L").cast("double").alias("L"), F.col("n").cast("double").alias("n"), "t")
    beta, r2, condition = fits.least_squares(g, ["one", "L", "n"], "t")
    return spark.createDataFrame([(*map(float, beta), float(r2), float(condition))], "one double, L double, n double, r2 double, condition double")


def _train_test(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    f = X.interval_features(e, ["vec_id", "label"], "embedding", LENGTH, "approx", ("raw",)).withColumnRenamed("label", "y")
    return f.where("vec_id % 3 <> 0"), f.where("vec_id % 3 = 0")


@query()
def ridge_predict(spark, sf_dir):
    from dyadix.operators.classify import RidgeCV

    train, test = _train_test(spark, sf_dir)
    return RidgeCV(10).fit(train).transform(test).select("vec_id", "y", "pred")


@query()
def extra_trees_predict(spark, sf_dir):
    from dyadix.operators.classify import ExtraTrees

    train, test = _train_test(spark, sf_dir)
    return ExtraTrees(10).fit(train).transform(test).select("vec_id", "y", metrics.argmax(F.col("proba")).alias("pred"))


SIGN_SQL = "(list_sum(list_transform(embedding[1:{}], lambda v: v::DOUBLE)) > 0)::INT"


def _signs(spark, sf_dir, points, x, length, names):
    """(train, test) of features of the series ``x(embedding)``, with y: whether the vector's first points add up to more than 0."""
    own = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.aggregate(F.slice(own, 1, points), F.lit(0.0), lambda a, v: a + v) > 0).cast("int"))
    f = X.interval_features(e.select("vec_id", "y", x(own).alias("x")), ["vec_id", "y"], "x", length, "approx", names)
    return f.where("vec_id % 3 <> 0"), f.where("vec_id % 3 = 0")


def _against_the_larger_class(out):
    """(y, n, above_the_larger_class): by class of out(y, pred), whether all predictions together beat the larger class."""
    per = out.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("right"))
    whole = per.agg((F.sum("right") > F.max("n")).alias("above_the_larger_class"), F.lit(1).alias("k"))
    return per.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k").select("y", "n", "above_the_larger_class")  # one row of one verdict


@query(f"SELECT {SIGN_SQL.format(4)} AS y, count(*) AS n, true AS above_the_larger_class FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1")
def extra_trees_accuracy(spark, sf_dir):
    """Whether 20 trees learn the sign of the first four points' sum from the features, better than the larger class alone."""
    from dyadix.operators.classify import ExtraTrees

    train, test = _signs(spark, sf_dir, 4, lambda x: x, LENGTH, ("raw",))
    return _against_the_larger_class(ExtraTrees(2, trees=20, seed=1).fit(train).transform(test).select("y", metrics.argmax(F.col("proba")).alias("pred")))


WIDE = sum(len(layout.features(n)) for n in layout.representation_lengths(10 * LENGTH).values())


@query(f"SELECT {SIGN_SQL.format(LENGTH)} AS y, count(*) AS n, count(*) AS n_predicted, {WIDE}::BIGINT AS n_features FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1")
def ridge_wide(spark, sf_dir):
    """Ridge regression on over 5,000 features, of series of ten waves under the vector: a prediction for every test row."""
    from dyadix.operators.classify import RidgeCV

    waves = lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.transform(x, lambda v, i: v * F.cos(j * i / 10))))
    train, test = _signs(spark, sf_dir, LENGTH, waves, 10 * LENGTH, layout.REPRESENTATIONS)
    out = RidgeCV(2).fit(train).transform(test)
    return out.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("pred").isin(0, 1)).alias("n_predicted"), F.max(F.size("features")).cast("long").alias("n_features"))


@query()
def forest_predict(spark, sf_dir):
    from dyadix.operators.classify import Forest

    train, test = _train_test(spark, sf_dir)
    return Forest(10).fit(train).transform(test).select("vec_id", "y", metrics.argmax(F.col("proba")).alias("pred"))


@query()
def gaussian_series(spark, sf_dir):
    return series.gaussian(spark, 100, LENGTH)


from dyadix import study_queries as _more  # noqa: E402, F401  registers the queries of the estimator, readers and studies
