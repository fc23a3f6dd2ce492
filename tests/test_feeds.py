import json
from datetime import datetime, timedelta

from quernstone.sources import feeds
from quernstone.streaming import streams


def read(spark, feed, *docs, **columns):
    rows = [(d if isinstance(d, str) else json.dumps(d), *columns.values()) for d in docs]
    raw = spark.createDataFrame(rows, "value string" + "".join(f", {c} string" for c in columns))
    return [r for r in feeds.READERS[feed](feeds.parsed(raw, feed)).collect()]


def test_adzuna(spark):
    got = read(spark, "adzuna", {"results": [{"title": " Dev ", "company": {"display_name": "ACME"}, "location": {"display_name": "SP"}, "redirect_url": " ", "url": "http://u", "salary_min": 1000.5, "salary_max": 2000, "created": "2024"}, {"title": "B"}]}, "{corrupt", keyword="go")
    assert len(got) == 2
    assert (got[0].id, got[0].title, got[0].company, got[0].url, got[0].salary, got[0].source, got[0].keywords) == ("http://u", "Dev", "ACME", "http://u", "1000.5-2000", "Adzuna", ["go"])
    assert got[1].salary == "" and got[1].location == ""


def test_greenhouse(spark):
    job = {
        "id": 7, "title": "Engineer", "content": "&lt;p&gt;Build&lt;/p&gt;", "absolute_url": "", "updated_at": "2024-01-01",
        "metadata": [{"name": "Level", "value": "3"}, {"name": "x", "value": None}], "departments": [{"name": "Eng"}, {"name": "eng"}],
        "offices": [{"name": "HQ", "location": "Berlin"}], "location": {"name": "Remote"},
    }
    (r,) = read(spark, "greenhouse", {"jobs": [job]}, board="ACME")
    assert (r.id, r.company, r.location, r.modality, r.postedAt) == ("greenhouse:7", "ACME", "Remote | Berlin | HQ", "Remoto", "2024-01-01")
    assert r.description == "Build\n\nDepartamentos: Eng\n\nEscritórios: HQ - Berlin\n\nMetadados: Level: 3"


def test_lever(spark):
    doc = {
        "id": "x1", "text": "Dev", "applyUrl": "http://a", "createdAt": 1700000000000, "country": "BR", "categories": {"location": "SP", "commitment": "Full", "allLocations": ["SP", "Rio"]},
        "lists": [{"text": "Must", "content": "<li>Go</li>"}], "description": "<b>Hi</b>", "salaryRange": {"min": 10.0, "max": 20.0, "currency": "USD", "interval": "year"}, "workplaceType": "hybrid",
    }
    (r,) = read(spark, "lever", doc)
    assert (r.id, r.url, r.location, r.modality, r.salary, r.postedAt) == ("lever:x1", "http://a", "SP | Rio | BR", "Híbrido", "10 - 20 USD year", "2023-11-14T22:13:20Z")
    assert r.description == "Hi\n\nMust: Go"


def test_gupy_ids_of_both_kinds(spark):
    a, b = read(spark, "gupy", {"data": [{"id": 5, "name": "A", "city": "X", "state": "", "country": "BR", "isRemoteWork": True, "jobUrl": "http://j"}, {"id": "k", "name": "B", "workplaceType": "on-site", "careerPageUrl": "http://k"}, {"id": "n", "name": "no address"}, {"id": "u", "jobUrl": "http://no-title"}]})
    assert (a.id, a.location, a.modality, b.id, b.modality) == ("gupy:5", "X / BR", "Remoto", "gupy:k", "Presencial")


def test_inhire(spark):
    doc = {"slug": "acme", "tenantName": "", "jobsPage": [{"displayName": "Dev & Ops", "jobId": "1", "status": "Published", "workplaceType": "Remote"}, {"displayName": "No", "jobId": "2", "status": "draft"}]}
    (r,) = read(spark, "inhire", doc)
    assert (r.id, r.company, r.url, r.modality) == ("inhire:acme:1", "acme", "https://acme.inhire.app/vagas/1/dev-and-ops", "Remoto")


def test_jooble_and_muse(spark):
    got = read(spark, "jooble", {"totalCount": 1, "jobs": [], "results": [{"title": "T", "company": "C", "location": "L", "id": 0, "link": ""}]})
    assert got[0].id == "T|C|L"
    doc = {"results": [{"id": 9, "name": "N", "company": {"name": "C"}, "refs": {"landing_page": "http://m"}, "locations": [{"name": "A"}, {"name": "B"}], "levels": [{"name": "Senior"}], "contents": "<p>x</p>"}]}
    (r,) = read(spark, "themuse", doc)
    assert (r.id, r.location, r.description, r.url) == ("9", "A, B", "x Senior", "http://m")
    raw = feeds.parsed(spark.createDataFrame([(json.dumps(doc),)], "value string"), "themuse")
    detail = spark.createDataFrame([("9", "<i>more</i>")], "id string, contents string")
    assert feeds.themuse(raw, detail).first().description == "more Senior"


def test_linkedin_cards(spark):
    html = '<ul><li><a href="http://l/1?t=2"></a><h3 class="base-search-card__title"> Dev &amp; Co </h3><h4 class="base-search-card__subtitle">ACME</h4><span class="job-search-card__location">SP</span><time datetime="2024-02-01">x</time></li><li>ad</li></ul>'
    (r,) = feeds.linkedin(spark.createDataFrame([(html,)], "html string")).collect()
    assert (r.id, r.title, r.company, r.location, r.postedAt) == ("http://l/1", "Dev & Co", "ACME", "SP", "2024-02-01")


def test_unified_and_catalogues(spark):
    one = feeds.parsed(spark.createDataFrame([('{"results": [{"title": "a", "url": "u"}]}',)], "value string"), "adzuna")
    two = feeds.parsed(spark.createDataFrame([('{"data": [{"id": 1, "name": "b", "jobUrl": "http://b"}]}',)], "value string"), "gupy")
    assert {r.source for r in feeds.unified({"adzuna": one, "gupy": two}).collect()} == {"Adzuna", "Gupy"}
    assert feeds.unified({"adzuna": one, "gupy": two}, ["gupy"]).columns == feeds.JOB
    cat = feeds.catalog(spark.createDataFrame([("", "b", "B", 0), ("a", "", "A", 1), ("a", "", "A2", 2)], "slug string, site string, name string, ordinal int"))
    assert [tuple(r) for r in cat.collect()] == [("a", "A"), ("b", "B")]
    tokens = {r.token for r in feeds.board_candidates(spark.createDataFrame([("Acme Labs Inc",)], "name string"), "name").collect()}
    assert {"acmelabsinc", "acme-labs-inc", "acmelabs"} <= tokens


def drained(stream, mode="append"):
    name = "t" + str(abs(hash(stream)))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


T0 = datetime(2024, 1, 1)


def test_streams(spark, tmp_path):
    rows = [(" Go ", T0), ("go", T0 + timedelta(minutes=1)), ("", T0), ("java", T0 + timedelta(minutes=16)), ("GO", T0 + timedelta(minutes=30))]
    spark.createDataFrame(rows, "keyword string, ts timestamp").coalesce(1).write.json(f"{tmp_path}/in")
    events = streams.keyword_events(spark, f"{tmp_path}/in")
    assert {r.keyword for r in drained(streams.new_keywords(events)).collect()} == {"go", "java"}
    assert drained(streams.new_ids(events, "keyword")).count() == 5
    assert sum(r.n for r in drained(streams.counters(events, 900, ["keyword"]), "complete").collect()) == 5


def test_rate_limited_stream_is_the_batch(spark, tmp_path):
    rows = [("k", T0 + timedelta(minutes=m)) for m in (0, 1, 2, 15, 16, 40)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    got = sorted((r.ts, r.n_in_window, r.allowed) for r in drained(streams.rate_limited(stream, "k", 900, 2)).collect())
    assert [(n, a) for _, n, a in got] == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True)]


def test_scheduled_runs_go_on_where_the_last_ended(spark, tmp_path):
    schema = "k string, ts timestamp"
    seen = []
    for part in range(2):
        spark.createDataFrame([(f"x{part}", T0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streams.run_available(stream, f"{tmp_path}/check", lambda df, n: seen.extend(r.k for r in df.collect()))
    assert seen == ["x0", "x1"]
