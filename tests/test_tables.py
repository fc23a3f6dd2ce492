import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.operators import keywords, match, relational, timeseries
from quernstone.sources import sinks

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_filters_that_are_absent(spark):
    df = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(10)), (2, "a", at(20))], "user_id int, action string, created_at timestamp")
    assert relational.filtered(df, {"user_id": None, "action": ""}, "created_at", at(5), None).count() == 3
    assert relational.filtered(df, {"action": "a"}, "created_at", at(0), at(20)).count() == 2
    assert relational.owned(df, 2).count() == 2


def test_overrides_and_diff(spark):
    base = spark.createDataFrame([("r1", "a", "user"), ("r2", "a", "admin")], "resource string, action string, min_role string")
    over = spark.createDataFrame([("r2", "a", "user"), ("r9", "a", "user")], "resource string, action string, min_role string")
    got = {r.resource: (r.min_role, r.customized) for r in relational.overridden(base, over, ["resource", "action"], "min_role").collect()}
    assert got == {"r1": ("user", False), "r2": ("user", True)}
    now = relational.overridden(base, over, ["resource", "action"], "min_role").drop("customized")
    assert [r.resource for r in relational.changed_rules(now, base, ["resource", "action"], "min_role").collect()] == ["r2"]


def test_role_levels(spark):
    df = spark.createDataFrame([("admin",), ("user",), ("nobody",), (None,)], "r string")
    assert [r[0] for r in df.select(relational.role_level(F.col("r"))).collect()] == [3, 0, None, None]
    roles = spark.createDataFrame([("user", 0), ("admin", 3)], "role string, level int")
    rules = spark.createDataFrame([(1,), (3,), (3,)], "min_level int")
    assert {r.role: r.allowed for r in relational.allowed_counts(roles, rules).collect()} == {"user": 0, "admin": 3}


def test_overlay_and_connections(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, t string, u string")
    detail = spark.createDataFrame([(1, " ", "new")], "id int, t string, u string")
    assert sorted(map(tuple, relational.overlaid(base, detail, "id", ["t", "u"]).collect())) == [(1, "a", "new"), (2, "b", "y")]
    got = relational.connections(spark.createDataFrame([("g",), ("h",)], "provider string"), spark.createDataFrame([("g",), ("g",)], "provider string"))
    assert sorted(map(tuple, got.collect())) == [("g", True, 2), ("h", False, 0)]


def test_counters_and_funnel(spark):
    df = spark.createDataFrame([(s,) for s in ["saved", "applied", "interviewing", "accepted", "rejected", "saved"]], "status string")
    assert tuple(relational.status_counters(df, "status").first()) == (2, 2, 1, 1)
    assert tuple(relational.funnel(df, "status").first()) == (6, 4, 1, 67, 17)
    assert tuple(relational.funnel(df.limit(0), "status").first()) == (0, 0, 0, 0, 0)


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, relational.inserted_if_new(t, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, relational.upserted(t, new.distinct(), ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    events = relational.status_changes(t, new.distinct(), "id", "v", F.lit(T0)).collect()
    assert [(e.id, e.from_status, e.to_status) for e in events] == [(2, "b", "B")]
    rest, n = relational.cleared(t, F.col("v") == "a")
    assert rest.count() == 1 and n.first().deleted == 1
    read = spark.createDataFrame([(1, None), (2, T0)], "id int, read_at timestamp")
    assert {r.id: r.read_at for r in relational.marked_read(read, F.col("id") > 0, F.lit(at(1))).collect()} == {1: at(1), 2: T0}
    filled = relational.backfill(spark.createDataFrame([("m", None), (None, "h"), ("k", "h")], "mail string, h string"), "mail", "h", F.upper("mail"))
    assert sorted((str(r.mail), r.h, r.changed) for r in filled.collect()) == [("None", "M", True), ("None", "h", False), ("k", "h", False)]


def test_payload_sinks(spark, tmp_path):
    now = F.lit(at(0))
    stored = spark.createDataFrame([("a", at(-1)), ("b", at(1)), ("c", None)], "id string, expires_at timestamp")
    fresh = sinks.new_payloads(spark.createDataFrame([(x,) for x in "aabcd"], "id string"), stored, "id", now).collect()
    assert sorted(r.id for r in fresh) == ["a", "d"] and fresh[0].expires_at == T0 + timedelta(days=9)
    payload = stored.withColumn("payload", F.when(F.col("id") == "b", '{"x": 1}').otherwise("{bad"))
    got = sinks.payloads_of(spark.createDataFrame([("b",), ("c",), ("z",)], "id string"), payload, "id", now, "x int").collect()
    assert [tuple(r) for r in got] == [("b", 1)]
    path = f"{tmp_path}/index"
    first = spark.createDataFrame([("k1", "v", "1"), ("k2", "v", "1")], "kind string, value string, id string")
    sinks.publish_index(first, path)
    sinks.publish_index(spark.createDataFrame([("k1", "v", "9")], "kind string, value string, id string"), path)
    assert sorted((r.kind, r.id) for r in sinks.published_index(spark, path).collect()) == [("k1", "9"), ("k2", "1")]
    assert [r.id for r in sinks.published_index(spark, path, ["k2"]).collect()] == ["1"] and sinks.published_index(spark, f"{tmp_path}/none").count() == 0
    made = []
    for hit in (False, True):
        df, there = sinks.result_cache(spark, f"{tmp_path}/cache", "k", lambda: made.append(1) or first)
        assert (there, df.count(), len(made)) == (hit, 2, 1)
    assert sinks.result_cache(spark, f"{tmp_path}/cache", "k", lambda: first.limit(1), seconds=0)[1] is False
    assert [r.id for r in sinks.sample_of(first, "id", 1).collect()] == ["1"] and sinks.sample_of(first, "id", 0).count() == 2


def test_counters_that_are_reset(spark):
    df = spark.createDataFrame([("a", at(0), 5.0), ("a", at(1), 9.0), ("a", at(2), 2.0), ("a", at(3), 2.0), ("b", at(1), 7.0)], "s string, ts timestamp, value double")
    got = {(r.s, r.ts): r.increase for r in timeseries.increases(df, ["s"]).collect()}
    assert got == {("a", at(0)): 0, ("a", at(1)): 4, ("a", at(2)): 2, ("a", at(3)): 0, ("b", at(1)): 0}
    assert timeseries.counter_rate(df, 300, ["s"]).first().rate == pytest.approx(6 / 300)


@pytest.mark.parametrize(("q", "want"), [(0.5, 1.5), (0.95, 4.0), (0.1, 0.5), (1.0, 4.0)])
def test_bucket_quantiles(spark, q, want):
    df = spark.createDataFrame([(1.0, 2), (2.0, 8), (4.0, 9), (float("inf"), 10)], "le double, n long")
    assert timeseries.bucket_quantile(df, q).first().quantile == pytest.approx(want)
    assert timeseries.bucket_quantile(spark.createDataFrame([(1.0, 0), (float("inf"), 0)], "le double, n long"), q).first().quantile is None


def test_histogram_then_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 50)], "v double")
    assert [(r.le, r.n) for r in timeseries.histogram(df, "v", [1.0, 5.0]).collect()] == [(1.0, 2), (5.0, 4), (float("inf"), 5)]


def test_grid_against_counting(spark):
    events = [(at(m),) for m in (0, 4, 5, 6, 9, 30)]
    got = timeseries.on_grid(spark.createDataFrame(events, "ts timestamp"), "2024-01-01 00:00:00", "2024-01-01 00:12:00", 120, 300).collect()
    assert len(got) == 7
    for r in got:
        assert r.n == sum(r.point - timedelta(minutes=5) < t <= r.point for (t,) in events)


def test_nearest_and_latest(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(10), 2.0), ("b", at(4), 9.0), ("c", at(5), 3.0)], "s string, ts timestamp, value double")
    got = timeseries.nearest(df, "s", "2024-01-01 00:05:00", most=2).collect()
    assert [(r.s, r.value) for r in got] == [("b", 9.0), ("c", 3.0)]


def test_fixed_windows(spark):
    df = spark.createDataFrame([("k", at(m)) for m in (0, 1, 2, 15, 16, 40)] + [("j", at(1))], "k string, ts timestamp")
    got = {(r.k, r.ts): (r.window_start, r.n_in_window, r.allowed) for r in timeseries.fixed_windows(df, "k", "ts", 900, 2).collect()}
    assert got == {
        ("k", at(0)): (at(0), 1, True), ("k", at(1)): (at(0), 2, True), ("k", at(2)): (at(0), 3, False), ("k", at(15)): (at(15), 1, True),
        ("k", at(16)): (at(15), 2, True), ("k", at(40)): (at(40), 1, True), ("j", at(1)): (at(1), 1, True),
    }


def test_keywords(spark):
    seeds = keywords.normalised(spark.createDataFrame([("  Go  Developer ", 0), ("developer", 1), ("go developer", 2), ("", 3), ("backend engineer", 4), ("java", 5)], "keyword string, ordinal int"))
    titles = spark.createDataFrame([("developer", ["backend", "web"], 0), ("backend engineer", ["backend"], 1), ("unused", ["web"], 2)], "name string, categories array<string>, ordinal int")
    tech = spark.createDataFrame([("go", ["backend"], 0), ("java", ["backend", "web"], 1), ("rust", ["backend"], 2)], "name string, categories array<string>, ordinal int")
    got = [r.keyword for r in keywords.combined(seeds, titles, tech).orderBy("ordinal").collect()]
    assert got == ["go developer", "developer", "backend engineer", "java", "java developer", "go backend engineer", "java backend engineer"]
    again = keywords.normalised(spark.createDataFrame([(k, i) for i, k in enumerate(got)], "keyword string, ordinal int"))
    assert {r.keyword for r in keywords.combined(again, titles, tech).collect()} >= set(got)


def test_pair_limit_counts_pairs(spark, monkeypatch):
    monkeypatch.setattr(keywords, "MOST_PAIRS", 1)
    seeds = spark.createDataFrame([("developer", 0), ("java", 1), ("go", 2)], "keyword string, ordinal int")
    titles = spark.createDataFrame([("developer", ["b"], 0)], "name string, categories array<string>, ordinal int")
    tech = spark.createDataFrame([("java", ["b"], 0), ("go", ["b"], 1)], "name string, categories array<string>, ordinal int")
    assert [r.keyword for r in keywords.combined(seeds, titles, tech).orderBy("ordinal").collect()] == ["developer", "java", "go", "java developer"]


def test_cache_keys():
    key = lambda **k: keywords.SearchConfig(**k).key()
    assert key(keywords=["B ", "a", "b"], sources=["X", "x"]) == key(keywords=["A", "b"], sources=["x "])
    assert key(keywords=["a"]) != key(keywords=["a"], remote_only=True) != key(keywords=["a"], location="SP")


def test_query_variants(spark):
    kw = spark.createDataFrame([("dev",), ("qa",)], "keyword string")
    syn = spark.createDataFrame([("dev", "developer"), ("qa", "tester"), ("dev", "tester")], "keyword string, synonym string")
    assert {r.query: r.keywords for r in keywords.query_variants(kw, syn).collect()} == {"dev": ["dev"], "qa": ["qa"], "developer": ["dev"], "tester": ["dev", "qa"]}


def test_high_matches_by_rare_terms(spark):
    """The pairs that a share leaves are those of the whole join that have it."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    texts = spark.createDataFrame([(k, " ".join(rng.sample(words, rng.randint(1, 7)))) for k in range(80)], "id int, text string")
    profiles = spark.createDataFrame([(u, w, rng.choice([0.0, 1.0, 4.0]), 0) for u in range(20) for w in rng.sample(words, rng.randint(1, 5))], "user_id int, term string, years double, ordinal int")
    every = {(r.user_id, r.id): r.match_score for r in match.score_profiles(texts, profiles).collect()}
    some = {(r.user_id, r.id): r.match_score for r in match.score_profiles(texts, profiles, match.HIGH_SHARE).collect()}
    assert {k: v for k, v in some.items() if v >= match.HIGH} == {k: v for k, v in every.items() if v >= match.HIGH} and some.items() <= every.items() and len(some) < len(every)


def test_rate_limit_windows_across_batches(spark):
    rng = random.Random(5)
    rows = sorted((rng.choice("aab"), at(rng.random() * 400)) for _ in range(500))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = timeseries.fixed_windows(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 600, 3).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, start, n = [], {}, {}
    for k, t in rows:
        if k not in start or t >= start[k] + timedelta(seconds=600):
            start[k], n[k] = t, 0
        n[k] += 1
        want.append((k, t, start[k], n[k], n[k] <= 3))
    assert sorted(map(tuple, got)) == sorted(want)


# Rates at the points of a grid


def brute_rate(samples, point, window):
    """One series' increase over the window before a point, from its definition. samples: (seconds, value), in order."""
    own = [(t, v) for t, v in samples if point - window < t <= point]
    if len(own) < 2 or own[0][0] == own[-1][0]:
        return None
    rise = sum(b if b < a else b - a for (_, a), (_, b) in zip(own, own[1:]))
    sampled = own[-1][0] - own[0][0]
    gap = sampled / (len(own) - 1)
    before, after = own[0][0] - (point - window), point - own[-1][0]
    before = gap / 2 if before >= gap * 1.1 else before
    if rise > 0 and own[0][1] >= 0:
        before = min(before, sampled * own[0][1] / rise)
    after = gap / 2 if after >= gap * 1.1 else after
    return rise * (sampled + before + after) / sampled


def test_rates_on_a_grid_against_brute_force(spark):
    import random
    from datetime import datetime, timedelta, timezone

    from quernstone.operators import timeseries as ts

    rng = random.Random(3)
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows, by = [], {}
    for series in ("a", "b", None):
        t, v = -4000.0, 0.0
        while t < 4000:
            t += rng.choice([5, 15, 15, 15, 30, 400 if rng.random() < 0.05 else 15])
            v = float(rng.randint(0, 3)) if rng.random() < 0.03 else v + rng.randint(0, 9)
            rows.append((series, zero + timedelta(seconds=t), v if rng.random() > 0.02 else None))
            if rows[-1][2] is not None:
                by.setdefault(series, []).append((t, v))
    rows += [("one", zero + timedelta(seconds=50), 5.0), ("flat", zero + timedelta(seconds=20), 4.0), ("flat", zero + timedelta(seconds=40), 4.0)]
    by |= {"one": [(50, 5.0)], "flat": [(20, 4.0), (40, 4.0)]}
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double").repartition(5)
    for span in (86_400, 600):
        total = ts.running_increase(df.filter("value IS NOT NULL"), ["s"], span=span).collect()
        for series, own in by.items():
            got = [r.total for r in sorted((r for r in total if r.s == series), key=lambda r: r.ts)]
            want = [sum(b if b < a else b - a for (_, a), (_, b) in zip(own[: k + 1], own[1 : k + 1])) for k in range(len(own))]
            assert got == want
    got = {(r.s, (r.point.replace(tzinfo=timezone.utc) - zero).total_seconds()): (r.increase, r.rate) for r in ts.rates_at(df, ["s"], "2024-01-01 00:00:00", "2024-01-01 01:00:00", 10, 300).collect()}
    want = {(s, p): x for s, own in by.items() for p in range(0, 3601, 10) if (x := brute_rate(own, p, 300)) is not None}
    assert got.keys() == want.keys() and len(got) > 900
    assert all(abs(got[k][0] - x) < 1e-9 * max(1, x) and abs(got[k][1] - x / 300) < 1e-9 for k, x in want.items())
    summed = ts.rates_at(df.filter("s IN ('a', 'b')"), ["s"], "2024-01-01 00:00:00", "2024-01-01 00:10:00", 10, 300, by=[]).collect()
    assert len(summed) == 61 and all(abs(r.rate - (want["a", p] + want["b", p]) / 300) < 1e-9 for r in summed for p in [(r.point.replace(tzinfo=timezone.utc) - zero).total_seconds()])


def test_quantiles_of_odd_buckets(spark):
    from quernstone.operators import timeseries as ts

    inf = float("inf")
    rows = [("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", inf, 4.0), ("falls", 1.0, 3.0), ("falls", 2.0, 2.0), ("falls", inf, 4.0), ("empty", 1.0, 0.0), ("empty", inf, 0.0), ("open", 1.0, 2.0), ("high", 1.0, 1.0), ("high", inf, 100.0)]
    df = spark.createDataFrame(rows, "g string, le double, n double")
    got = {r.g: r.quantile for r in ts.bucket_quantile(df, 0.75, ["g"]).collect()}
    assert got == {"ok": 1.5, "falls": 1.0, "empty": None, "open": None, "high": 1.0}


def test_pages_of_a_published_order(spark, tmp_path):
    from quernstone.operators import paging

    rows = [(k * 7 % 101 % 13, k) for k in range(500)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    order = [F.col("a").desc(), F.col("b")]
    paging.publish_order(df, order, str(tmp_path / "o"), 9)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert paging.total_of(spark, str(tmp_path / "o")) == 500
    for page, limit in [(1, 20), (3, 100), (4, 37), (25, 20), (14, 37), (26, 20), (1, 100), (500, 1), (501, 1)]:
        got = paging.page_at(spark, str(tmp_path / "o"), df.schema, order, paging.Page(page, limit))
        assert [tuple(r) for r in got.collect()] == want[(page - 1) * limit : page * limit]
    deep = paging.page_at(spark, str(tmp_path / "o"), df.schema, order, paging.Page(20, 20))
    assert "PartitionFilters: [_part" in deep._jdf.queryExecution().executedPlan().toString()


def test_a_small_batch_goes_to_the_store(spark, tmp_path):
    from quernstone.operators import dedup

    store = spark.range(5000).selectExpr("id % 4000 AS id", "'p' AS payload", "cast(null AS timestamp) AS expires_at")
    store.write.parquet(str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    spark.createDataFrame([(3990,), (3999,), (4000,), (4001,), (None,)], "id long").write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    fresh = dedup.new_only(batch, stored, "id")
    assert sorted((r.id for r in fresh.collect()), key=str) == [4000, 4001, None]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("LeftSemi") :]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and first.index("parquet") < first.index("BroadcastExchange")


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantiles_against_sorting(spark, q):
    import math

    from quernstone.operators import timeseries as ts

    rng = random.Random(5)
    rows = [("one", 3.0), ("two", 1.0), ("two", 2.0), ("same", 7.0)] + [("same", 7.0)] * 300 + [("many", rng.gauss(0, 9)) for _ in range(3000)] + [(None, float(rng.randint(0, 5))) for _ in range(500)] + [("none", None), ("nan", math.nan), ("many", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.quantile for r in ts.exact_quantile(df, "v", q, ["g"]).collect()}
    by = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(g, []).append(v)

    def exact(xs):
        xs = sorted(xs)
        p = q * (len(xs) - 1)
        lo, hi = xs[math.floor(p)], xs[math.ceil(p)]
        return lo + (hi - lo) * (p - math.floor(p))

    assert got.keys() == by.keys() and all(abs(got[g] - exact(xs)) < 1e-12 for g, xs in by.items())
    (every,) = ts.exact_quantile(df, "v", q).collect()
    assert abs(every.quantile - exact([v for xs in by.values() for v in xs])) < 1e-12
    for r in ts.sketched_quantile(df, "v", q, ["g"]).collect():
        xs = by[r.g]
        assert r.n == len(xs) and sum(x < r.quantile for x in xs) <= (q + 0.03) * len(xs) + 1 and sum(x <= r.quantile for x in xs) >= (q - 0.03) * len(xs) - 1


def test_profiles_are_of_all_that_users_ordered(spark, tmp_path):
    """What wasn't given back counts, and every name's first word."""
    import duckdb

    from quernstone.plans.table_queries import QUERIES

    names = ["a b", "b a", "c a", "d x", "c b", "a c"]
    rows = {
        "part": ([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string"),
        "orders": ([(1, 7), (2, 8), (3, 9)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(1, 0, "N"), (1, 2, "R"), (2, 0, "N"), (2, 1, "N"), (2, 2, "N"), (2, 3, "R"), (3, 3, "R"), (3, 2, "N")], "l_orderkey long, l_partkey long, l_returnflag string"),
    }
    con = duckdb.connect()
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query, sql = QUERIES["match_high_new"]
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert got == con.execute(sql).fetchall() == [(7, "a c", 98)]
