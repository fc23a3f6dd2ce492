import itertools

import pytest
from pyspark.sql import functions as F

from quernstone.functions import infer, taxonomy
from quernstone.operators import classify, dedup, index, match, paging, search

JOB = "id string, title string, company string, location string, url string, modality string, description string, source string, sources array<string>, keyword string, keywords array<string>, ordinal int"


def jobs(spark, *rows):
    base = {"id": "", "title": "", "company": "", "location": "", "url": "", "modality": "", "description": "", "source": "", "sources": None, "keyword": "", "keywords": None, "ordinal": 0}
    names = list(base)
    return spark.createDataFrame([tuple({**base, "ordinal": k, **r}[n] for n in names) for k, r in enumerate(rows)], JOB)


def test_merge_is_by_ordinal_and_longest(spark):
    rows = [
        {"title": "Dev", "company": "ACME", "location": "SP", "url": "http://a/x?y", "description": "first", "source": "A", "keyword": "go"},
        {"title": "DEV!", "company": "acme", "location": "sp", "url": "http://a/x", "description": "second", "source": "B", "sources": ["B", "C"], "keywords": ["java", "go"]},
        {"title": "dév", "company": "Acme", "location": "SP", "source": "D"},
        {"title": "Other", "company": "", "url": "http://a/y/#z", "source": "A"},
        {"title": "Another", "url": "http://a/y", "source": "B", "sources": ["B"]},
        {"title": "Dev", "company": "ACME", "source": "E"},
    ]
    want = None
    for order in itertools.islice(itertools.permutations(range(6)), 0, 720, 97):
        df = jobs(spark, *[{**rows[k], "ordinal": k} for k in order])
        got = {r.ordinal: r for r in dedup.merge_records(df).collect()}
        assert sorted(got) == [0, 3, 5]
        plain = {k: tuple(map(str, (r.title, r.url, r.description, r.source, r.sources, r.keyword, r.keywords))) for k, r in got.items()}
        want = want or plain
        assert plain == want
    r = got[0]
    assert (r.title, r.url, r.description, r.source, r.sources, r.keyword, r.keywords) == ("DEV!", "http://a/x?y", "first", "A, B, C", ["A", "B", "C"], "go", ["go", "java"])
    assert got[3].title == "Another" and got[3].sources == ["A", "B"]
    assert got[5].merge_key.endswith("|sem-local")


@pytest.mark.parametrize(
    ("row", "family", "scope", "confidence"),
    [
        ({"title": "Engenheiro de Software Back-end", "description": "Golang e Kafka"}, "backend", True, 0.99),
        ({"title": "Motorista", "description": "Java"}, "other", False, 0.0),
        ({"title": "Banco de Talentos - Backend"}, "other", False, 0.0),
        ({"title": "Cozinheiro"}, "other", False, 0.0),
        ({"title": "Pessoa", "description": "pandas"}, "data", False, 0.43),
    ],
)
def test_classification(spark, row, family, scope, confidence):
    c = classify.classify(jobs(spark, row)).first().classification
    assert (c.primaryFamily, c.inScope, c.confidence) == (family, scope, confidence)


def test_classification_details(spark):
    c = classify.classify(jobs(spark, {"title": "Senior Mobile Developer", "description": "React Native, Node.js and C#"})).first().classification
    assert c.primaryFamily == "mobile" and "frontend" in c.relatedFamilies and c.technologies == ["csharp", "javascript", "node.js", "react", "react-native"] and c.seniority == "senior"
    blocked = classify.classify(jobs(spark, {"title": "Motorista Senior", "description": "python"})).first().classification
    assert (blocked.technologies, blocked.seniority, blocked.reasons) == (["python"], "senior", ["vaga administrativa: motorista"])


def test_scores_by_rows_and_by_expressions_agree(spark):
    texts = [(k, t) for k, t in enumerate(["backend back end api go", "frontend designer ux", "", "metadata engineer sql", "ios android flutter react native dart"])]
    df = spark.createDataFrame(texts, "id int, t string")
    rows = {(r.id, r.family): r.score for r in classify.score_rows(df, "id", "t", classify.term_table(spark)).collect()}
    exprs = {(r.id, s.family): s.score for r in df.select("id", classify.scores(F.col("t")).alias("s")).collect() for s in r.s}
    assert rows == exprs and rows[(0, "backend")] == 4 + 4 + 4 + 4 + 1 and rows[(3, "data")] == 5


def test_funnel_and_top_counts(spark):
    df = classify.classify(jobs(spark, {"title": "Backend", "source": "A"}, {"title": "Cook", "description": "java", "source": "", "sources": ["A"]}, {"title": "Cook", "keywords": ["x"]}))
    got = {r.source: tuple(r)[1:] for r in classify.funnel(df).collect()}
    assert got == {"A": (2, 1, 1, 1, 0, 1), "unknown": (1, 0, 1, 0, 1, 0)}
    counts = spark.createDataFrame([("s", x) for x in "aabbc"] + [("s", " ")], "source string, l string")
    assert classify.top_counts(counts, "source", F.col("l"), 3).first().top == ["a=2", "b=2", "c=1"]


def test_places(spark):
    values = ["São Paulo, SP", "Remote - Worldwide", "Lisboa, Portugal", "London", "Curitiba / Santa Catarina", "Remoto, Recife", "", "Berlin, Germany"]
    got = [tuple(r.p) for r in spark.createDataFrame([(v,) for v in values], "x string").select(infer.place(F.lower(F.translate("x", "ãéç,/-", "aec   "))).alias("p")).collect()]
    assert got[0] == ("Brasil", "Brasil", "América do Sul", "SP", "sao paulo")
    assert got[1] == ("", "Global / Remoto", "Global / Remoto", "", "")
    assert got[2][:3] == ("Portugal", "Portugal", "Europa") and got[2][4] == "lisboa"
    assert got[3][0] == "Reino Unido" and got[3][4] == "london"
    assert got[4][3] == "PR" and got[5][:4] == ("Brasil", "Brasil", "América do Sul", "PE") and got[6] == ("",) * 5 and got[7][2] == "Europa"


def test_levels_and_models_differ_by_place(spark):
    df = spark.createDataFrame([("dev aprendiz",), ("vaga remota global",), ("hybrid remote",)], "t string")
    got = df.select(infer.level_index(F.col("t")), infer.level_search(F.col("t")), infer.model_index(F.col("t")), infer.model_search(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("pleno", "estagio", "presencial", "presencial"), ("pleno", "pleno", "remoto", "remoto"), ("pleno", "pleno", "hibrido", "hibrido")]


def sample(spark):
    return classify.classify(
        jobs(
            spark,
            {"id": "1", "title": "Senior Backend Developer", "location": "São Paulo, Brasil", "description": "Node.js, remote"},
            {"id": "2", "title": "Estagio Frontend", "location": "Lisboa", "description": "React híbrido"},
            {"id": "3", "title": "Data Engineer", "location": "Remote", "description": "python sql clt"},
            {"id": "", "title": "Backend", "location": "", "description": "without an id"},
        )
    )


def test_index_kinds(spark):
    kw = spark.createDataFrame([("Node.js",), ("data engineer",), ("",)], "keyword string")
    got = {(r.kind, r.value, r.id) for r in index.build(sample(spark), "id", kw).collect()}
    assert {("keyword", "node js", "1"), ("keyword", "nodejs", "1"), ("keyword", "node", "1"), ("keyword", "data engineer", "3"), ("keyword", "data", "3"), ("keyword", "node.js", "1")} <= got
    assert {("level", "senior", "1"), ("model", "remoto", "1"), ("state", "sp", "1"), ("city", "lisboa", "2"), ("contract", "clt", "3"), ("continent", "global remoto", "3"), ("seniority", "estagio", "2")} <= got
    assert {("family", "backend", "1"), ("technology", "node js", "1"), ("keyword", "python", "3"), ("all", "", "2")} <= got
    assert not any(i == "" for _, _, i in got)


def test_search_paths(spark):
    rows = sample(spark).filter("id <> ''")
    ix = index.build(rows, "id", spark.createDataFrame([("node js",), ("python",)], "keyword string")).cache()
    run = lambda **q: search.search(rows, ix, search.Query.parse(q), paging.Page.parse(q.get("page"), q.get("limit")))
    ids = lambda r: [x.id for x in r[0].collect()]
    assert (ids(run(family="backend,frontend", technology="node.js")), run(family="backend")[1]) == (["1"], "index")
    assert ids(run(level="intern")) == ["2"] and ids(run(model="hybrid,Híbrido")) == ["2"]
    assert ids(run(country="Brasil")) == ["1"] and ids(run()) == ["1", "2", "3"] and ids(run(limit="1", page="2")) == ["2"]
    out = run(state="xx")
    assert out[1] == "fallback" and ids(out) == ["1", "2", "3"]
    scored = search.search(rows, ix, search.Query(match_sort="desc"), paging.Page(1, 10), [("python", 3), ("SQL", 1)])[0].collect()
    assert [(r.id, r.match_score) for r in scored] == [("3", 98), ("1", 45), ("2", 45)]


@pytest.mark.parametrize(
    ("profile", "text", "want"),
    [
        ([("Node.js", 4)], "nodejs dev", 55 + 35 + 4),
        ([("Go", 1), ("Java", 3)], "java", 55 + 26 + 4),
        ([("Go", 0), ("Java", 0.2), ("SQL", 1)], "go java sql", 99 - 0),
        ([("Go", 5)], "golang", 45),
        ([], "go", None),
        ([("go", 1), (" GO ", 9), ("rust", 1)], "go", 55 + 32 + 4),
    ],
)
def test_match_scores(spark, profile, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert match.score(df, F.col("t"), profile).first().match_score == want


@pytest.mark.parametrize(("page", "limit", "want"), [(None, None, (1, 100)), ("0", "0", (1, 100)), ("-3", "500", (1, 100)), ("x", "y", (1, 100)), ("3", "20", (3, 20)), ("2abc", "-1", (2, 1))])
def test_pages(page, limit, want):
    p = paging.Page.parse(page, limit)
    assert (p.page, p.limit) == want


def test_page_totals():
    assert paging.Page(2, 10).totals(25) == {"page": 2, "limit": 10, "total": 25, "totalPages": 3, "hasNext": True, "hasPrev": True}
    assert paging.Page(1, 10).totals(0)["totalPages"] == 0
    assert paging.Page.of_list(9, 99, 120) == paging.Page(3, 50) and paging.Page.of_list(0, 0, 0) == paging.Page(1, 1)


def test_families_are_listed():
    assert len(taxonomy.FAMILIES) == 11 and len(taxonomy.TECHNOLOGIES) == 33 and len(taxonomy.COUNTRIES) == 18 and len(taxonomy.CITIES) == 25


def listed_by_brute_force(rows):
    """One record after another, the later one over the earlier."""
    import re
    import unicodedata

    def plain(x):
        x = "".join(c for c in unicodedata.normalize("NFD", x or "") if unicodedata.category(c) != "Mn").lower()
        return " ".join(re.findall(r"[^\W_]+", x))

    def key(r):
        t, c, p = plain(r["title"]), plain(r["company"]), plain(r["location"])
        if t and c:
            return f"identity:{t}|{c}|{p or 'sem-local'}"
        u = re.sub("/+$", "", re.sub("[?#].*$", "", (r["url"] or "").strip()))
        return f"url:{u}" if u else f"fallback:{t}|{c}|{p}|{plain(r['source'])}"

    def words(r):
        return [w for w in dict.fromkeys([*(x.strip() for x in r["keywords"] or []), *(x.strip() for x in re.split("[,;|]+", r["keyword"] or ""))]) if w]

    out = {}
    for k, r in enumerate(rows):
        k = key(r)
        own = {**r, "_k": words(r), "_s": [x.strip() for x in [*(r["sources"] or []), r["source"] or ""] if x.strip()]}
        if k not in out:
            out[k] = {**own, "keyword": ", ".join(own["_k"]), "source": r["source"] or ""}
            continue
        e = out[k]
        new = {**e, **{c: v for c, v in own.items() if v is not None}}
        for c in ("title", "company", "location", "url"):
            new[c] = max([(e[c] or "").strip(), (r[c] or "").strip()], key=len)
        new["_k"], new["_s"] = list(dict.fromkeys(e["_k"] + own["_k"])), list(dict.fromkeys(e["_s"] + own["_s"]))
        new["source"], new["sources"], new["keyword"] = ", ".join(new["_s"]) or e["source"], new["_s"] or None, ", ".join(new["_k"])
        out[k] = new
    return out


def test_list_merge_against_one_record_after_another(spark):
    import random

    rng = random.Random(2)
    pick = lambda *xs: rng.choice(xs)
    rows = [
        {
            "title": pick("Dev", "DEV!", " Dév ", "", None), "company": pick("ACME", "acme", "", None), "location": pick("SP", "sp", "", None), "url": pick("http://a/x?y", "http://a/x/", "http://a/yy", "", None), "description": pick("one", "", None),
            "source": pick("A", " B ", "", None), "sources": pick(None, [], ["A", "C"], [" "]), "keyword": pick("go; java", "go", "", None), "keywords": pick(None, [], ["java", " sql "], ["go"]),
        }
        for _ in range(300)
    ]
    got = {r.merge_key: r for r in dedup.merge_listed(jobs(spark, *rows).repartition(4)).collect()}
    want = listed_by_brute_force(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        assert (r.title or "", r.company or "", r.location or "", r.url or "", r.description, r.source, r.keyword, r.keywords) == (w["title"] or "", w["company"] or "", w["location"] or "", w["url"] or "", w["description"], w["source"], w["keyword"], w["_k"]), k


def test_a_hot_key_brings_distinct_values_only(spark):
    df = spark.range(20_000).selectExpr("id AS ordinal", "'Dev' AS title", "'ACME' AS company", "'' AS location", "'' AS url", "concat('s', id % 7) AS source", "array(concat('s', id % 7)) AS sources", "'' AS keyword", "array(concat('k', id % 3), 'all') AS keywords")
    (r,) = dedup.merge_records(df).collect()
    assert r.sources == [f"s{k}" for k in range(7)] and r.keywords == ["k0", "all", "k1", "k2"]
    lists = dedup.united(df.withColumn("m", F.lit(1)), ["m"], F.col("ordinal"), {"sources": F.col("sources"), "keywords": F.col("keywords")})
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") < plan.index("min(at") and plan.count("partial_min(at") == 1


@pytest.mark.parametrize(
    ("pages", "size", "taken"),
    [
        ([["a", "b"], ["c", "d"], ["c", "d"], ["e", "f"]], None, 2),
        ([["a", "b"], ["b", "a"], ["a", "b"], ["c", "d"]], None, 2),
        ([["a", "b"], ["c"], ["d", "e"]], 2, 2),
        ([["a", "b"], ["c"], ["d", "e"]], None, 3),
        ([["a", "b"], [], ["d", "e"]], None, 1),
        ([["", None], ["", " "], ["x", "y"]], None, 3),
        ([["a", ""], ["a"], ["b"]], None, 1),
    ],
)
def test_pages_until_one_repeats(spark, pages, size, taken):
    rows = [(f, k + 1, i, x) for f in ("one", "two") for k, page in enumerate(pages) for i, x in enumerate(page)] + [("other", 1, 0, "a")]
    df = spark.createDataFrame(rows, "feed string, page int, place int, k string").repartition(3)
    got = dedup.pages_taken(df, ["feed"], "page", "place", F.col("k"), size).collect()
    want = [r for r in rows if r[0] == "other" or r[1] <= taken]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_needles_against_every_text(spark):
    import random

    from quernstone.operators import phrases

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abn", k=rng.randint(1, 4)))
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 30)))) for k in range(120)] + [(500, None), (501, ""), (7, "ab nab")]
    needles = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    got = {tuple(r) for r in phrases.containing(df, "id", "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()}
    want = {(k, n) for k, t in texts for n in needles if t and n and n in t}
    assert got == want and len(want) > 500
    plan = phrases.containing(df, "id", "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("NestedLoop") == 3  # of the vocabulary with one row of lengths each


def test_rows_that_cost_much_are_dealt_out(spark, tmp_path):
    """A narrow table of one file is work for several tasks, and a classification's distinct entries don't shuffle again."""
    from quernstone.plans import job_queries, text_queries

    part = spark.range(25_001).selectExpr("id AS p_partkey", "'red ring' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "CAST(id % 50 AS int) AS p_size", "1.0D AS p_retailprice")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    d = str(tmp_path)
    assert job_queries.jobs(spark, d).rdd.getNumPartitions() == 3
    for name in ("feed_greenhouse", "feed_linkedin"):
        assert job_queries.QUERIES[name][0](spark, d).rdd.getNumPartitions() == 3
    for name in ("slug_parts", "norm_punctuation_parts"):
        assert text_queries.QUERIES[name][0](spark, d).rdd.getNumPartitions() == 3
    assert text_queries.keyed_jobs(spark, d).rdd.getNumPartitions() == 3
    for name in ("index_structured", "index_classification"):
        plan = job_queries.QUERIES[name][0](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


def test_titles_are_made_once_a_row(spark):
    """A technology title's text stands once in the plan, however many words it is compared with."""
    from quernstone.functions import filters

    rows = spark.createDataFrame([("Software Engineer", ""), ("Motorista", "")], "t string, d string").select(filters.technology_job(F.col("t"), F.col("d")).alias("x"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 4
    assert [r.x for r in rows.collect()] == [True, False]
