"""Queries over event times: rates, increases, quantiles, ratios, grids, nearest points, limits, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import timeseries as ts
from quernstone.session import scratch, table
from quernstone.streaming import streams

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def bucket_sql(seconds: int, c: str = "ts") -> str:
    return f"time_bucket(INTERVAL {seconds} SECONDS, {c}, TIMESTAMP '1970-01-01')"


@query(f"SELECT {bucket_sql(300)} AS bucket, event_type, count(*) / 300 AS rate FROM events GROUP BY 1, 2")
def rate_5m_by_type(spark, d):
    return ts.event_rate(events(spark, d), 300, ["event_type"])


@query(f"SELECT {bucket_sql(86400)} AS bucket, count(*) AS increase, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def increase_1d(spark, d):
    return events(spark, d).groupBy(ts.bucket(F.col("ts"), 86400).alias("bucket")).agg(F.count(F.lit(1)).alias("increase"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""
WITH s AS (SELECT user_id, ts, event_id, CAST(event_id // 50 % 7 * 10 + event_id % 50 AS DOUBLE) AS v FROM events),
i AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT time_bucket(INTERVAL 21600 SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket, round(sum(CASE WHEN before IS NULL THEN 0 WHEN v < before THEN v ELSE v - before END) / 21600, 9) AS rate FROM i GROUP BY 1
""")
def counter_rate_resets(spark, d):
    """A counter for each user that falls back now and then."""
    s = events(spark, d).select("user_id", "ts", "event_id", (F.expr("event_id div 50 % 7 * 10 + event_id % 50")).cast("double").alias("value"))
    w = ts.counter_rate(s, 21600, ["user_id"])
    return w.select("bucket", F.round("rate", 9).alias("rate"))


@query("SELECT time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) FILTER (event_type = 'error') * 100.0 / greatest(count(*), 1) AS error_pct FROM events GROUP BY 1")
def error_ratio(spark, d):
    e = events(spark, d).groupBy(ts.bucket(F.col("ts"), 3600).alias("bucket")).agg(F.count_if(F.rlike("event_type", F.lit("^err"))).alias("bad"), F.count(F.lit(1)).alias("n"))
    return e.select("bucket", ts.ratio(F.col("bad"), F.col("n")).alias("error_pct"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') * 100.0 / greatest(count(*) FILTER (event_type IN ('view', 'click')), 5) AS hit_pct FROM events GROUP BY 1")
def hit_ratio_clamped(spark, d):
    e = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type").isin("view", "click")).alias("n"))
    return e.select("user_id", ts.ratio(F.col("hits"), F.col("n"), 5.0).alias("hit_pct"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def p95_value(spark, d):
    return ts.exact_quantile(events(spark, d), "value", 0.95, ["event_type"]).select("event_type", F.round("quantile", 6).alias("p95"))


@query("SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY 1")
def p95_sketched(spark, d):
    """The sketch's 95th percentile, and whether its rank among all values is within two hundredths of the right one."""
    e = events(spark, d)
    sketch = ts.sketched_quantile(e, "value", 0.95, ["event_type"], 400)
    below = e.select("event_type", "value").join(sketch, "event_type").groupBy("event_type", "n").agg(F.count_if(F.col("value") < F.col("quantile")).alias("lt"), F.count_if(F.col("value") <= F.col("quantile")).alias("le"))
    return below.select("event_type", "n", ((F.col("lt") <= F.col("n") * 0.97) & (F.col("le") >= F.col("n") * 0.93)).alias("within"))


BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]
HIST_SQL = "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 'infinity'::DOUBLE]) AS le) GROUP BY 1, 2"


@query(HIST_SQL)
def histogram_buckets(spark, d):
    return ts.histogram(events(spark, d), "value", BOUNDS, ["event_type"])


@query(f"""
WITH h AS ({HIST_SQL}), t AS (SELECT *, max(n) OVER (PARTITION BY event_type) * 0.95 AS rank, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM t WHERE n >= rank)
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 9) AS quantile FROM f WHERE k = 1
""")
def hist_quantile_95(spark, d):
    h = ts.histogram(events(spark, d), "value", BOUNDS, ["event_type"])
    return ts.bucket_quantile(h, 0.95, ["event_type"]).select("event_type", F.round("quantile", 9).alias("quantile"))


# Counters at the points of a grid

START, END, STEP, WINDOW = "2024-01-02 00:00:00", "2024-01-30 00:00:00", 21600, 86400
POINTS_SQL = f"points AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL {STEP} SECONDS)) AS point)"


def rates_sql(series: str, tie: str = "0") -> str:
    """CTEs from `samples` (series.., ts, v, and the tie) to `rates` (series.., point, increase, rate)."""
    return f"""
i AS (SELECT *, {tie} AS tie, lag(v) OVER (PARTITION BY {series} ORDER BY ts, {tie}) AS before FROM samples),
t AS (SELECT *, sum(CASE WHEN before IS NULL THEN 0 WHEN v < before THEN v ELSE v - before END) OVER (PARTITION BY {series} ORDER BY ts, tie) AS total FROM i),
{POINTS_SQL},
w AS (
  SELECT {series}, point, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(v, {{'a': ts, 'b': tie}}) AS v0, arg_max(total, {{'a': ts, 'b': tie}}) - arg_min(total, {{'a': ts, 'b': tie}}) AS rise
  FROM points JOIN t ON ts > point - INTERVAL {WINDOW} SECONDS AND ts <= point GROUP BY ALL),
g AS (
  SELECT *, (epoch_us(t1) - epoch_us(t0)) / 1e6 AS sampled, (epoch_us(t0) - epoch_us(point)) / 1e6 + {WINDOW} AS before, (epoch_us(point) - epoch_us(t1)) / 1e6 AS after,
    (epoch_us(t1) - epoch_us(t0)) / 1e6 / (n - 1) AS gap FROM w WHERE n > 1 AND t1 > t0),
e AS (
  SELECT *, least(CASE WHEN before >= gap * 1.1 THEN gap / 2 ELSE before END, CASE WHEN rise > 0 AND v0 >= 0 THEN sampled * (v0 / rise) ELSE 1e300 END) AS s, CASE WHEN after >= gap * 1.1 THEN gap / 2 ELSE after END AS f FROM g),
rates AS (SELECT {series}, point, rise * ((sampled + s + f) / sampled) AS increase, rise * ((sampled + s + f) / sampled) / {WINDOW} AS rate FROM e)"""


COUNTER_SQL = "samples AS (SELECT user_id, ts, event_id, CAST(event_id // 50 % 7 * 10 + event_id % 50 AS DOUBLE) AS v FROM events)"


@query(f"WITH {COUNTER_SQL}, {rates_sql('user_id', 'event_id')} SELECT user_id, point, round(increase, 6) AS increase, round(rate, 9) AS rate FROM rates")
def rate_grid_counter(spark, d):
    """increase(counter[1d]) and rate(counter[1d]) each six hours, of a counter for each user that falls back now and then."""
    s = events(spark, d).select("user_id", "ts", "event_id", (F.expr("event_id div 50 % 7 * 10 + event_id % 50")).cast("double").alias("value"))
    rates = ts.rates_at(s, ["user_id"], START, END, STEP, WINDOW, tie="event_id")
    return rates.select("user_id", "point", F.round("increase", 6).alias("increase"), F.round("rate", 9).alias("rate"))


@query(f"WITH {COUNTER_SQL.replace('SELECT user_id', 'SELECT event_type, user_id')}, {rates_sql('event_type, user_id', 'event_id')} SELECT event_type, point, round(sum(rate), 9) AS rate FROM rates GROUP BY 1, 2")
def rate_grid_by_type(spark, d):
    """sum by (event_type)(rate(counter[1d]))."""
    s = events(spark, d).select("event_type", "user_id", "ts", "event_id", (F.expr("event_id div 50 % 7 * 10 + event_id % 50")).cast("double").alias("value"))
    return ts.rates_at(s, ["event_type", "user_id"], START, END, STEP, WINDOW, by=["event_type"], tie="event_id").select("event_type", "point", F.round("rate", 9).alias("rate"))


HOURLY_SQL = """
h AS (SELECT event_type, le, time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') AS ts, count(*) FILTER (value <= le) AS n
  FROM events, (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 'infinity'::DOUBLE]) AS le) GROUP BY ALL),
samples AS (SELECT event_type, le, ts, CAST(sum(n) OVER (PARTITION BY event_type, le ORDER BY ts) AS DOUBLE) AS v FROM h)"""


@query(f"""
WITH {HOURLY_SQL}, {rates_sql('event_type, le')},
m AS (SELECT event_type, point, le, max(rate) OVER (PARTITION BY event_type, point ORDER BY le) AS n FROM rates),
q AS (SELECT *, max(n) OVER p * 0.9 AS rank, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(n) OVER p AS total FROM m WINDOW w AS (PARTITION BY event_type, point ORDER BY le), p AS (PARTITION BY event_type, point)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type, point ORDER BY le) AS k FROM q WHERE n >= rank)
SELECT event_type, point, round(CASE WHEN total = 0 THEN NULL WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 6) AS quantile FROM f WHERE k = 1
""")
def quantile_of_rates(spark, d):
    """histogram_quantile(0.9, sum by (le, event_type)(rate(bucket[1d]))) of buckets that are counters, read each hour."""
    e = events(spark, d).withColumn("hour", ts.bucket(F.col("ts"), 3600))
    h = ts.histogram(e, "value", BOUNDS, ["event_type", "hour"]).withColumnRenamed("hour", "ts")
    counters = h.withColumn("value", F.sum("n").over(Window.partitionBy("event_type", "le").orderBy("ts")).cast("double")).drop("n")
    q = ts.quantile_of_rates(counters, 0.9, ["event_type", "le"], START, END, STEP, WINDOW, ["event_type"])
    return q.select("event_type", "point", F.round("quantile", 6).alias("quantile"))


@query(f"""
WITH h AS (SELECT event_type, time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS c, CAST(sum(floor(value)) AS BIGINT) AS s FROM events GROUP BY ALL),
samples AS (SELECT event_type, kind, ts, CAST(sum(CASE kind WHEN 'sum' THEN s ELSE c END) OVER (PARTITION BY event_type, kind ORDER BY ts) AS DOUBLE) AS v FROM h, (SELECT unnest(['sum', 'count']) AS kind)),
{rates_sql('event_type, kind')},
b AS (SELECT event_type, point, sum(rate) FILTER (kind = 'sum') AS s, sum(rate) FILTER (kind = 'count') AS c FROM rates GROUP BY 1, 2)
SELECT event_type, point, round(CASE WHEN c > 0 THEN s / c END, 6) AS mean FROM b
""")
def mean_of_rates(spark, d):
    """rate(sum[1d]) / rate(count[1d]) of counters read each hour."""
    h = events(spark, d).groupBy("event_type", ts.bucket(F.col("ts"), 3600).alias("ts")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor("value")).alias("s"))
    both = h.select("event_type", "ts", F.explode(F.array(F.struct(F.lit("sum").alias("kind"), F.col("s").alias("n")), F.struct(F.lit("count").alias("kind"), F.col("c").alias("n")))).alias("x")).select("event_type", "ts", "x.*")
    counters = both.withColumn("value", F.sum("n").over(Window.partitionBy("event_type", "kind").orderBy("ts")).cast("double")).drop("n")
    m = ts.mean_of_rates(counters, "kind", ["event_type"], START, END, STEP, WINDOW, ["event_type"])
    return m.select("event_type", "point", F.round("mean", 6).alias("mean"))


@query(f"""
WITH {POINTS_SQL}
SELECT user_id, point, arg_max(value, {{'a': ts, 'b': event_id}}) AS value FROM points JOIN events ON ts > point - INTERVAL 10800 SECONDS AND ts <= point GROUP BY 1, 2
""")
def gauge_grid(spark, d):
    """Each user's last value of the three hours before each point."""
    return ts.gauges_at(events(spark, d), ["user_id"], START, END, STEP, 10800, tie="event_id").select("user_id", "point", "value")


@query("""
WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
d AS (SELECT *, n - lag(n) OVER w AS delta, n - first_value(n) OVER w AS since_first FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, arg_max(n, day) AS last_n, arg_max(delta, day) AS last_delta, arg_max(since_first, day) AS since_first, max(abs(delta)) AS largest_delta FROM d GROUP BY 1
""")
def snapshot_delta_summary(spark, d):
    c = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return ts.delta_summary(c, ["event_type"], "day", "n")


@query("SELECT event_type, round(sum(value) / greatest(count(*), 1), 6) AS mean FROM events GROUP BY 1")
def avg_from_sums(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.sum("value") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mean"))


@query("""
SELECT point, (SELECT count(*) FROM events WHERE ts > point - INTERVAL 5 MINUTES AND ts <= point) AS n
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-10 06:00:00', INTERVAL 120 SECONDS)) AS point)
""")
def range_grid(spark, d):
    length, step = ts.RANGES["6h"]
    del length
    return ts.on_grid(events(spark, d), "2024-01-10 00:00:00", "2024-01-10 06:00:00", step, 300)


@query("""
SELECT event_type, point, (SELECT count(*) FROM events e WHERE e.event_type = k.event_type AND ts > point - INTERVAL 5 MINUTES AND ts <= point) AS n
FROM (SELECT DISTINCT event_type FROM events) k, (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-11 00:00:00', INTERVAL 600 SECONDS)) AS point)
""")
def range_grid_by_type(spark, d):
    return ts.on_grid(events(spark, d), "2024-01-10 00:00:00", "2024-01-11 00:00:00", 600, 300, ["event_type"])


@query("""
SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), ts, event_id) AS n FROM events) WHERE n = 1 ORDER BY value DESC, user_id LIMIT 12
""")
def nearest_asof(spark, d):
    return ts.nearest(events(spark, d), "user_id", "2024-01-15 12:00:00", tie="event_id")


@query("SELECT user_id, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)) WHERE n = 1")
def latest_value(spark, d):
    e = events(spark, d).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return e.groupBy("user_id").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id")).alias("l")).select("user_id", "l.*")


@query("""
WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, n, n - lag(n) OVER (ORDER BY day) AS delta, n - first_value(n) OVER (ORDER BY day) AS since_first FROM c
""")
def snapshot_deltas(spark, d):
    c = events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("series", F.lit("events"))
    return ts.deltas(c, ["series"], "day", "n").drop("series").withColumn("day", F.col("day").cast("string"))


@query("SELECT b AS ts, event_id FROM (SELECT time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') AS b, max(event_id) AS event_id FROM events GROUP BY 1) ORDER BY ts DESC LIMIT 24")
def append_snapshots(spark, d):
    e = events(spark, d).select(ts.bucket(F.col("ts"), 3600).alias("ts"), "event_id")
    return ts.last_snapshots(e, "ts", "event_id", 24)


@query("SELECT round(count(*) / 300.0, 6) AS rps, round(quantile_cont(value, 0.95) * 1000, 2) AS p95_ms, round(count(*) FILTER (event_type = 'error') * 100.0 / greatest(count(*), 1), 2) AS error_pct, count(DISTINCT user_id) AS users, coalesce(round(avg(value) FILTER (event_type = 'none'), 2), 0) AS idle FROM events")
def kpi_snapshot(spark, d):
    """Five numbers, each with a default where nothing was measured."""
    e = events(spark, d)
    rest = e.agg(
        F.round(F.count(F.lit(1)) / 300.0, 6).alias("rps"),
        F.round(ts.ratio(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1))), 2).alias("error_pct"),
        F.countDistinct("user_id").alias("users"),
        F.coalesce(F.round(F.avg(F.when(F.col("event_type") == "none", F.col("value"))), 2), F.lit(0.0)).alias("idle"),
    )
    p95 = ts.exact_quantile(e, "value", 0.95).select(F.round(F.col("quantile") * 1000, 2).alias("p95_ms"))
    return rest.join(p95, how="left", on=F.lit(True)).select("rps", "p95_ms", "error_pct", "users", "idle")  # a row each


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(greatest(max(value) - least(min(value), 0), 1) * 0.08, 6) AS pad FROM events GROUP BY 1")
def axis_minmax(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn("pad", F.round(F.greatest(F.col("high") - F.least("low", F.lit(0.0)), F.lit(1.0)) * 0.08, 6))


@query("SELECT event_type AS adapter, count(DISTINCT user_id) AS runs, count(*) FILTER (value > 90) AS errors, count(*) AS jobs, round(sum(value), 2) AS seconds FROM events GROUP BY 1")
def run_metrics(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("adapter")).agg(F.countDistinct("user_id").alias("runs"), F.count_if(F.col("value") > 90).alias("errors"), F.count(F.lit(1)).alias("jobs"), F.round(F.sum("value"), 2).alias("seconds"))


LIMITED_SQL = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (
  SELECT user_id, event_id, ts, k, ts AS window_start, CAST(1 AS BIGINT) AS n_in_window FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.ts, o.k, CASE WHEN o.ts >= w.window_start + INTERVAL 12 HOURS THEN o.ts ELSE w.window_start END, CASE WHEN o.ts >= w.window_start + INTERVAL 12 HOURS THEN 1 ELSE w.n_in_window + 1 END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, window_start, n_in_window, n_in_window <= 2 AS allowed FROM w
"""


@query(LIMITED_SQL)
def ratelimit_fixed(spark, d):
    """Two requests in twelve hours for each user."""
    e = events(spark, d).select("user_id", "event_id", "ts")
    return ts.fixed_windows(e, "user_id", "ts", 43200, 2).select("user_id", "event_id", "window_start", "n_in_window", "allowed")


@query("SELECT source FROM (SELECT 'src' || user_id AS source, max(ts) AS last FROM events GROUP BY 1) WHERE last <= TIMESTAMP '2024-01-30 06:00:00'")
def due_sources(spark, d):
    e = events(spark, d).select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("source"), F.col("ts").alias("ran_at"))
    return streams.due_sources(e.select("source").distinct(), e, "2024-01-30 18:00:00")


# Streams: a batch's rows, read as a stream to its end


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result, written batch by batch and read back: a complete result replaces the one before."""
    spark = stream.sparkSession
    where = scratch(spark, "stream")
    schema = stream.schema

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is repeated writes the same folder again
        batch.write.mode("overwrite").parquet(f"{where}/rows" if mode == "complete" else f"{where}/rows/batch={n}")

    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{where}/rows").select(*schema.fieldNames())


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT event_type AS keyword FROM events")
def stream_dedup(spark, d):
    e = _event_stream(spark, d).select(F.concat(F.lit(" "), F.upper("event_type")).alias("keyword"))
    return _drained(streams.new_keywords(e), "append")


@query(f"SELECT {bucket_sql(3600)} AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    return _drained(streams.counters(_event_stream(spark, d), 3600, ["event_type"]), "complete")


@query(LIMITED_SQL)
def stream_ratelimit(spark, d):
    """The decisions of ratelimit_fixed, as requests arrive."""
    limited = streams.rate_limit_decisions(_event_stream(spark, d), "user_id", "event_id", 43200, 2)
    return _drained(limited, "append").select("user_id", "event_id", "window_start", "n_in_window", "allowed")


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n_in_window, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) <= 25 AS allowed FROM events")
def stream_quota(spark, d):
    """Twenty-five requests a day for each source."""
    return _drained(streams.quota_decisions(_event_stream(spark, d), "event_type", "event_id", 25), "append").select("event_type", "event_id", "n_in_window", "allowed")


@query("""
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (
  SELECT user_id, ts AS t, k, ts AS since FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.ts, o.k, CASE WHEN o.ts >= w.since + INTERVAL 9 DAYS THEN o.ts ELSE w.since END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, t AS "at" FROM w WHERE t = since
""")
def stream_expiring(spark, d):
    """A user's event is admitted, and again nine days after; what comes meanwhile isn't."""
    changes = _drained(streams.expiring(_event_stream(spark, d), "user_id", order=["event_id"]), "append")
    return changes.filter("change = 'admitted'").select("user_id", "at")


@query("SELECT DISTINCT lower(p_type) AS keyword FROM part UNION SELECT DISTINCT event_type FROM events")
def stream_keyword_queue(spark, d):
    """The store knows the catalogue's types already; the queue brings these and event types; a run that is repeated from its beginning adds nothing."""
    store = scratch(spark, "keywords")
    known = table(spark, d, "part").select(F.lower("p_type").alias("keyword")).distinct()
    known.write.parquet(f"{store}/run=known/batch=0")
    queue = _event_stream(spark, d).select(F.concat(F.lit(" "), F.upper("event_type")).alias("keyword")).unionByName(_part_stream(spark, d))
    for k in range(2):
        streams.store_new_keywords(queue, store, f"{store}-state-{k}")
    return streams.known_keywords(spark, store)


def _part_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "part").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(d).select(F.upper("p_type").alias("keyword"))


# Gauges and labels


@query(f"""
WITH s AS (SELECT user_id % 20 AS cpu, ts, event_id, sum(1 + event_id % 5) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS v FROM events),
l AS (SELECT cpu, ts, max(v) AS v FROM s GROUP BY cpu, ts),
i AS (SELECT *, lag(v) OVER (PARTITION BY cpu ORDER BY ts) AS before FROM l),
r AS (SELECT {bucket_sql(86400)} AS bucket, cpu, sum(CASE WHEN before IS NULL THEN 0 ELSE v - before END) / 86400 AS rate FROM i GROUP BY 1, 2)
SELECT bucket, round(100 - avg(rate) * 100, 6) AS used FROM r GROUP BY 1
""")
def gauge_used_share(spark, d):
    e = events(spark, d).select((F.col("user_id") % 20).alias("cpu"), "ts", "event_id")
    summed = ts.running_sum(e.withColumn("v", 1 + F.col("event_id") % 5), ["cpu"], "v", tie="event_id")
    idle = summed.groupBy("cpu", "ts").agg(F.max("total").cast("double").alias("value"))
    return ts.used_share(idle, 86400, ["cpu"]).select("bucket", F.round("used", 6).alias("used"))


@query("SELECT o_orderdate AS ts, sum(o_totalprice)::DECIMAL(18, 2) - (sum(o_totalprice) FILTER (o_orderstatus = 'O'))::DECIMAL(18, 2) AS used FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0")
def gauge_used_amount(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "ts")
    amount = F.sum(F.col("o_totalprice")).cast("decimal(18,2)").alias("value")
    return ts.used_amount(o.groupBy("ts").agg(amount), o.filter("o_orderstatus = 'O'").groupBy("ts").agg(amount))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'route ' || user_id WHEN 2 THEN 'job ' || user_id ELSE 'serie' END AS label FROM events")
def series_labels(spark, d):
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    labels = F.when(k == 0, F.create_map(F.lit("route"), F.lit("x"), F.lit("adapter"), F.col("event_type"))).when(k == 1, F.create_map(F.lit("job"), F.lit("y"), F.lit("route"), F.concat(F.lit("route "), user))).when(k == 2, F.create_map(F.lit("job"), F.concat(F.lit("job "), user))).otherwise(F.create_map(F.lit("le"), F.lit("1")))
    return table(spark, d, "events").select("event_id", ts.series_label(labels).alias("label"))
