"""Rates, ratios and quantiles of metric series.

Samples are rows (series, ts, value) of counters that may be reset, or plain events. Two kinds of rates: of tumbling windows, increases
by the window's length, a reset counting from zero and nothing extrapolated; and at the points of a grid, from what a sliding window
before each point holds, extrapolated to the window's edges as the monitoring system's own query language does.
Quantiles of cumulative buckets interpolate linearly inside a bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.session import scratch

#: range: (its length, its step), in seconds (fixed values)
RANGES = {"5m": (300, 10), "15m": (900, 15), "1h": (3600, 30), "6h": (21600, 120), "24h": (86400, 600)}


#: Seconds that a series is summed in side by side.
SPAN = 86_400


def increases(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value", tie: str | None = None, span: int = SPAN) -> DataFrame:
    """Adds `increase` over each series' sample before; after a reset the value itself; the first has none."""
    return _risen(samples, series, ts, value, tie, span).drop("total")


def running_increase(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value", tie: str | None = None, span: int = SPAN) -> DataFrame:
    """Adds `total`: how much the counter has risen since its series' first sample, over all resets."""
    return _risen(samples, series, ts, value, tie, span).drop("increase")


def _risen(samples: DataFrame, series: list[str], ts: str, value: str, tie: str | None, span: int) -> DataFrame:
    """Adds increase and total. A series is summed in spans of so many seconds side by side. A row a span then tells what it adds and what was added
    between the last sample of one and the first of the next, so no task needs a whole series."""
    place = [ts] + [tie] * bool(tie)
    own = Window.partitionBy(*series, "_span").orderBy(*place)
    rise = lambda now, before: F.when(before.isNull(), F.lit(0.0)).when(now < before, now).otherwise(now - before)
    dealt = samples.withColumn("_span", F.floor(F.unix_seconds(ts) / span)).withColumns({"_step": rise(F.col(value), F.lag(value).over(own)), "_nth": F.row_number().over(own)})
    rows = dealt.withColumn("_inside", F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = dealt.groupBy(*series, "_span").agg(F.min_by(value, F.struct(*place)).alias("_first"), F.max_by(value, F.struct(*place)).alias("_last"), F.sum("_step").alias("_sum"))
    line = Window.partitionBy(*series).orderBy("_span")
    joints = spans.withColumns({"_edge": rise(F.col("_first"), F.lag("_last").over(line)), "_past": F.coalesce(F.lag("_sum").over(line), F.lit(0.0))})
    base = joints.withColumn("_base", F.sum(F.col("_edge") + F.col("_past")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = _of_span(rows, base, series, ["_edge", "_base"])
    return found.select(*samples.columns, F.when(F.col("_nth") == 1, F.col("_edge")).otherwise(F.col("_step")).alias("increase"), (F.col("_base") + F.col("_inside")).alias("total"))


def running_sum(rows: DataFrame, series: list[str], value: str, ts: str = "ts", tie: str | None = None, span: int = SPAN) -> DataFrame:
    """Adds `total`, the sum of the values of a series up to each row, by spans side by side."""
    own = Window.partitionBy(*series, "_span").orderBy(*[ts] + [tie] * bool(tie)).rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.withColumn("_span", F.floor(F.unix_seconds(ts) / span))
    line = Window.partitionBy(*series).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*series, "_span").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(line), F.lit(0)))
    return _of_span(dealt.withColumn("_inside", F.sum(value).over(own)), base, series, ["_base"]).select(*rows.columns, (F.col("_base") + F.col("_inside")).alias("total"))


def _of_span(rows: DataFrame, spans: DataFrame, series: list[str], columns: list[str]) -> DataFrame:
    """rows with columns of their span, a row a span; labels may be null."""
    known = spans.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(series)], F.col("_span").alias("_of"), *columns)
    same = F.col("_span") == F.col("_of")
    for k, c in enumerate(series):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return rows.join(known, same)


def bucket(ts: Column, seconds: int) -> Column:
    """Beginning of the window that holds the time, windows aligned to the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def event_rate(events: DataFrame, seconds: int, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Events a second in tumbling windows."""
    return events.groupBy(bucket(F.col(ts), seconds).alias("bucket"), *(by or [])).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate"))


def counter_rate(samples: DataFrame, seconds: int, series: list[str], by: list[str] | None = None) -> DataFrame:
    """sum by (..)(rate(counter[window])) in tumbling windows."""
    return increases(samples, series).groupBy(bucket(F.col("ts"), seconds).alias("bucket"), *(by or [])).agg((F.sum("increase") / F.lit(seconds)).alias("rate"))


def ratio(part: Column, whole: Column, least: float = 1.0) -> Column:
    """Percent of at least `least`."""
    return part * 100.0 / F.greatest(whole, F.lit(least))


def histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative buckets: le and how many values are no more than it; infinity last. One pass, partial counts shuffle."""
    les = [*bounds, float("inf")]
    wide = rows.groupBy(*(by or [])).agg(*[F.count_if(F.col(value) <= F.lit(le)).alias(f"b{k}") for k, le in enumerate(les)])
    return wide.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(float(le)).alias("le"), F.col(f"b{k}").alias("n")) for k, le in enumerate(les)])).alias("b")).select(*(by or []), "b.le", "b.n")


def bucket_quantile(buckets: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """The quantile that cumulative buckets (le, n) give: counts, or rates. In the bucket of infinity it is the largest finite bound. A
    bucket with less than a smaller one counts as much as that; without a bucket of infinity, or with nothing in it, there is no quantile."""
    groups = by or []
    listed = buckets.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("_b"))
    upto = lambda x, i: F.struct(x["le"].alias("le"), F.array_max(F.transform(F.slice("_b", 1, i + 1), lambda y: y["n"])).alias("n"))
    listed = listed.withColumn("b", F.transform("_b", upto))
    total = F.when(F.get("b", F.size("b") - 1)["le"] == float("inf"), F.get("b", F.size("b") - 1)["n"])
    rank = total * F.lit(q)
    at = F.array_position(F.transform("b", lambda x: x["n"] >= rank), True).cast("int") - 1
    work = listed.withColumns({"_rank": rank, "_at": at, "_total": total})
    here, before = F.get("b", F.col("_at")), F.get("b", F.col("_at") - 1)
    low, below = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["n"], F.lit(0))
    inside = low + (here["le"] - low) * (F.col("_rank") - below) / (here["n"] - below)
    value = F.when(F.col("_total") == 0, F.lit(None)).when(here["le"] == float("inf"), before["le"]).otherwise(inside)
    return work.select(*groups, value.cast("double").alias("quantile"))


#: Edges that a group's values are cut at, and the sketch's size: about 1.3 % of rank error.
EDGES, SKETCH = 32, 200


def sketched_quantile(rows: DataFrame, value: str, q: float, by: list[str] | None = None, k: int = SKETCH) -> DataFrame:
    """by.., n, quantile: a value whose rank is q * n but for the sketch's error (1.3 % of n at k = 200, less with a greater one). One pass, a few
    kilobytes a group, whatever its size."""
    sketch = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*(by or [])).agg(F.kll_sketch_agg_double(value, k).alias("_s"), F.count(F.lit(1)).alias("n"))
    return sketch.filter("n > 0").select(*(by or []), "n", F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias("quantile"))


def exact_quantile(rows: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """by.., quantile: exact, interpolated between the two values beside rank q * (n - 1).

    A sketch gives each group EDGES cuts, which only balance the work: counts between them tell in which cut each rank lies, and of the
    values in these alone, counted, the ranked ones are picked. So a task holds a few cuts' distinct values in order, not a group's.
    A sketch differs from one evaluation to the next, so the cuts are written once, a row a group."""
    groups = by or []
    sound = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("_v"))
    sketch = sound.groupBy(*groups).agg(F.kll_sketch_agg_double("_v").alias("_s"), F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    edges = sketch.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_n", F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(e / EDGES)) for e in range(1, EDGES)]).alias("_edges"))
    where = scratch(rows.sparkSession, "quantile-cuts")
    edges.write.parquet(where)
    edges = rows.sparkSession.read.schema(edges.schema).parquet(where)
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    cut = sound.join(edges, same).withColumn("_cut", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).select(*groups, "_v", "_n", "_cut")
    line = Window.partitionBy(*groups).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*groups, "_cut").agg(F.count(F.lit(1)).alias("_in"), F.first("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_in").over(line), F.lit(0)))
    rank = F.lit(q) * (F.col("_n") - 1)
    asked = counts.withColumns({"_lo": F.floor(rank), "_hi": F.ceil(rank)}).filter((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_in") > F.col("_lo")))
    mine = asked.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col("_cut").alias("_own"), "_before", "_lo", "_hi")
    inside = cut.join(mine, same & (F.col("_cut") == F.col("_own"))).groupBy(*groups, "_cut", "_before", "_lo", "_hi", "_n", "_v").agg(F.count(F.lit(1)).alias("_many"))
    upto = Window.partitionBy(*groups, "_cut").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_many").over(upto))
    at = lambda r: F.min(F.when(F.col("_end") > F.col(r), F.col("_v")))
    found = placed.groupBy(*groups).agg(at("_lo").alias("_low"), at("_hi").alias("_high"), F.first(F.lit(q) * (F.col("_n") - 1) - F.col("_lo")).alias("_part"))
    return found.select(*groups, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))


# Range vectors: what a sliding window before each point of a grid holds


def _points(rows: DataFrame, start: str, end: str, step: int, window: int, ts: str) -> DataFrame:
    """rows once for each point of the grid within whose window they lie: `_k`, the number of the point. By arithmetic, no join."""
    first, last = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    t, unit = F.unix_micros(F.col(ts)), step * 1_000_000
    lo = F.greatest(F.ceil((t - first) / unit), F.lit(0)).cast("long")
    hi = F.least(F.ceil((t + window * 1_000_000 - first) / unit) - 1, F.floor((last - first) / unit)).cast("long")
    near = rows.filter((t > first - window * 1_000_000) & (t <= last)).withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    return near.select(*rows.columns, F.explode(F.sequence("_lo", "_hi")).alias("_k"))


def _point(start: str, step: int) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.col("_k") * step * 1_000_000)


def range_vectors(samples: DataFrame, series: list[str], start: str, end: str, step: int, window: int, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """series.., point, n, first_ts, first_value, last_ts, rise: of the samples in (point - window, point], how many there are, the ends, and
    the increase between them over all resets. Points without samples have no row. Only differences of running sums count,
    so samples before the first window aren't summed; null values are no samples."""
    at = F.unix_micros(F.col(ts))
    low, high = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    near = samples.filter(F.col(value).isNotNull() & (at > low - window * 1_000_000) & (at <= high))
    rows = running_increase(near, series, ts, value, tie)
    seen = F.struct(F.col(ts).alias("ts"), *([F.col(tie).alias("tie")] if tie else []), F.col(value).cast("double").alias("v"), F.col("total"))
    ends = _points(rows, start, end, step, window, ts).groupBy(*series, "_k").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("a"), F.max(seen).alias("b"))
    return ends.select(*series, _point(start, step).alias("point"), "n", F.col("a.ts").alias("first_ts"), F.col("a.v").alias("first_value"), F.col("b.ts").alias("last_ts"), (F.col("b.total") - F.col("a.total")).alias("rise"))


def increase_at(vectors: DataFrame, window: int) -> Column:
    """The increase of a counter over the window, from range_vectors(); null with fewer than two samples.

    The samples' increase is carried on at the mean rate to the window's edges: on a side where the nearest sample is further away than 1.1 mean gaps
    by half a gap only, and at the beginning no further than to where the counter would have been zero."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    c = lambda name: vectors[name]
    sampled = seconds(c("first_ts"), c("last_ts"))
    some = lambda x: F.nullif(x, F.lit(0))
    gap = sampled / some(c("n") - 1)
    near = lambda x: F.when(x >= gap * 1.1, gap / 2).otherwise(x)
    before = near((F.unix_micros(c("first_ts")) - F.unix_micros(c("point"))) / 1e6 + window)
    zero = F.when((c("rise") > 0) & (c("first_value") >= 0), sampled * (c("first_value") / some(c("rise"))))
    after = near(seconds(c("last_ts"), c("point")))
    return F.when((c("n") > 1) & (sampled > 0), c("rise") * ((sampled + F.least(before, F.coalesce(zero, before)) + after) / some(sampled)))


def rates_at(samples: DataFrame, series: list[str], start: str, end: str, step: int, window: int, by: list[str] | None = None, **how) -> DataFrame:
    """sum by (..)(rate(counter[window])) at the points of a grid: by.., point, rate, increase. Without `by` a row a series."""
    v = range_vectors(samples, series, start, end, step, window, **how)
    rates = v.select(*series, "point", increase_at(v, window).alias("increase")).filter("increase IS NOT NULL").withColumn("rate", F.col("increase") / window)
    return rates if by is None else rates.groupBy(*by, "point").agg(F.sum("rate").alias("rate"), F.sum("increase").alias("increase"))


def quantile_of_rates(samples: DataFrame, q: float, series: list[str], start: str, end: str, step: int, window: int, by: list[str], le: str = "le", **how) -> DataFrame:
    """histogram_quantile(q, sum by (le, ..)(rate(bucket[window]))) at the points of a grid: by.., point, quantile."""
    rates = rates_at(samples, series, start, end, step, window, [*by, le], **how)
    return bucket_quantile(rates.select(*by, "point", F.col(le).alias("le"), F.col("rate").alias("n")), q, [*by, "point"])


def mean_of_rates(samples: DataFrame, kind: str, series: list[str], start: str, end: str, step: int, window: int, by: list[str], **how) -> DataFrame:
    """rate(sum[window]) / rate(count[window]) at the points of a grid: by.., point, mean. `kind` is the column that tells samples of
    'sum' from those of 'count'; both are rated in one pass. Null where nothing was counted."""
    rates = rates_at(samples, [*series, kind], start, end, step, window, **how)
    of = lambda k: F.sum(F.when(F.col(kind) == k, F.col("rate")))
    both = rates.groupBy(*by, "point").agg(of("sum").alias("_sum"), of("count").alias("_count"))
    return both.select(*by, "point", F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).alias("mean"))


def gauges_at(samples: DataFrame, series: list[str], start: str, end: str, step: int, lookback: int = 300, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Each series' last value within the lookback before each point: series.., point, value."""
    near = _points(samples.filter(F.col(value).isNotNull()), start, end, step, lookback, ts)
    last = near.groupBy(*series, "_k").agg(F.max_by(value, F.struct(ts, *[tie] * bool(tie))).alias("value"))
    return last.select(*series, _point(start, step).alias("point"), "value")


def grid(start: str, end: str, step: int) -> Column:
    """The points of a range query."""
    return F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {step} seconds"))


def on_grid(events: DataFrame, start: str, end: str, step: int, window: int, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Events in the `window` seconds up to each point of the grid. Each event finds its points by arithmetic; points without
    events are there with zero."""
    counted = _points(events.select(*(by or []), ts), start, end, step, window, ts).groupBy(*(by or []), "_k").agg(F.count(F.lit(1)).alias("n"))
    keys = events.select(*by).distinct() if by else events.sparkSession.range(1)
    points = keys.select(*(by or []), F.posexplode(grid(start, end, step)).alias("_k", "point")).withColumn("_k", F.col("_k").cast("long"))
    return points.join(counted, [*(by or []), "_k"], "left").select(*(by or []), "point", F.coalesce("n", F.lit(0)).alias("n"))


def nearest(points: DataFrame, series: str, at: str, ts: str = "ts", value: str = "value", most: int = 12, tie: str | None = None) -> DataFrame:
    """Each series' point nearest to a time, the earlier of two; then the largest values. One aggregation."""
    gap = F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(F.lit(at).cast("timestamp")))
    order = [gap, F.col(ts)] + ([F.col(tie)] if tie else [])
    near = points.groupBy(series).agg(F.min_by(F.struct(ts, value), F.struct(*order)).alias("p")).select(series, "p.*")
    return near.orderBy(F.desc(value), series).limit(most)


def deltas(snapshots: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    w = Window.partitionBy(*series).orderBy(ts)
    return snapshots.withColumns({"delta": F.col(value) - F.lag(value).over(w), "since_first": F.col(value) - F.first(value).over(w)})


def delta_summary(snapshots: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """A row a series: its last value, the last delta, the delta since the first snapshot, and the largest absolute delta of two neighbours."""
    steps = deltas(snapshots, series, ts, value)
    last = lambda c: F.max_by(c, ts).alias(f"last_{c}" if c != "since_first" else c)
    return steps.groupBy(*series).agg(last(value), last("delta"), last("since_first"), F.max(F.abs("delta")).alias("largest_delta"))


def last_snapshots(snapshots: DataFrame, ts: str, arrival: str, n: int) -> DataFrame:
    """The last n times, of each the one that arrived last."""
    best = snapshots.groupBy(ts).agg(F.max_by(F.struct(*[F.col(c) for c in snapshots.columns]), F.col(arrival)).alias("r")).select("r.*")
    return best.orderBy(F.desc(ts)).limit(n)


def fixed_windows(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Rate limiting by windows that begin with a key's first event outside the window before; later
    events of the window over `most` are denied. Adds window_start, n_in_window, allowed.

    Where the next window begins depends on where the one before did. A key's history is walked by batches in order, in
    constant memory and window by window, not event by event; keys are spread over tasks."""
    out = T.StructType([*events.schema.fields, T.StructField("window_start", events.schema[ts].dataType), T.StructField("n_in_window", T.LongType()), T.StructField("allowed", T.BooleanType())])
    names = events.columns
    length = np.timedelta64(seconds, "s")

    def run(batches):
        current, start, n = None, None, 0
        for pdf in batches:
            times, keys = pdf[ts].to_numpy().astype("datetime64[ns]"), pdf[key]
            starts, counts = np.empty(len(pdf), "datetime64[ns]"), np.empty(len(pdf), np.int64)
            edges = [*np.flatnonzero(np.append(True, (keys != keys.shift())[1:])), len(pdf)] if len(pdf) else [0]
            for a, b in zip(edges, edges[1:]):
                own = keys.iloc[a]
                if own != current:
                    current, start, n = own, times[a], 0
                while a < b:
                    if times[a] >= start + length:
                        start, n = times[a], 0
                    stop = a + int(np.searchsorted(times[a:b], start + length))
                    starts[a:stop], counts[a:stop] = start, np.arange(n + 1, n + 1 + stop - a)
                    n, a = n + stop - a, stop
            pdf = pdf[names].copy()
            pdf["window_start"], pdf["n_in_window"] = starts, counts
            pdf["allowed"] = pdf["n_in_window"] <= most
            yield pdf

    return events.repartition(key).sortWithinPartitions(key, ts).mapInPandas(run, out)


def used_share(idle: DataFrame, seconds: int, series: list[str]) -> DataFrame:
    """Per bucket, the percentage that isn't idle: 100 less 100 times the mean over the series of the idle counter's rate.

    idle: ts, the series' columns, and value, a counter of idle seconds."""
    rates = counter_rate(idle, seconds, series, series)
    return rates.groupBy("bucket").agg((F.lit(100.0) - F.avg("rate") * 100).alias("used"))


def used_amount(total: DataFrame, available: DataFrame, value: str = "value") -> DataFrame:
    """total less available wherever both were measured: ts, used."""
    free = available.select("ts", F.col(value).alias("_free"))
    return total.select("ts", F.col(value).alias("_all")).join(free, "ts").select("ts", (F.col("_all") - F.col("_free")).alias("used"))


#: Which of a series' labels names it, the first that it has (fixed values).
LABELS = ["adapter", "route", "path", "handler", "container_label_com_docker_compose_service", "container", "name", "job"]


def series_label(labels: Column) -> Column:
    """labels: a map."""
    return F.coalesce(*[F.element_at(labels, n) for n in LABELS], F.lit("serie"))
