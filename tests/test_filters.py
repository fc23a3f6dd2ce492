import hashlib
import hmac
import json

from pyspark.sql import functions as F

from quernstone.functions import filters, secrets, text
from quernstone.operators import projections, relational, timeseries
from quernstone.sources import sinks

KEY = b"0123456789abcdef0123456789abcdef"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_technology_titles(spark):
    rows = [
        ("Desenvolvedor Backend", "", True), ("Motorista de Van", "Java e Python", False), ("Banco de Talentos - Desenvolvedor", "", False), ("", "Java", False), ("Analista de Sistemas", "Java", True),
        ("Analista de Sistemas", "planilhas", False), ("Java Developer", None, True), ("Java", "", False), ("Assistente de Desenvolvedor", "", True), (None, "Java", False), ("Vendedor de Software", "aws", False),
    ]
    df = spark.createDataFrame(rows, "t string, d string, want boolean")
    assert [r for r in df.select("t", "want", filters.technology_job(F.col("t"), F.col("d")).alias("got")).collect() if r.got != r.want] == []


def test_requests(spark):
    df = spark.createDataFrame([(1, "Go Dev", "Berlin", False, "en"), (2, "Go Dev", "Lisboa", True, ""), (3, "Sales", "Berlin", False, None), (4, "go-dev", "São Paulo", False, "PT")], "id int, t string, place string, remote boolean, lang string")
    ids = lambda **asked: [r.id for r in df.filter(filters.request_match(filters.Request(**asked), F.col("t"), F.col("remote"), [F.col("place")], F.col("lang"))).collect()]
    assert ids() == [1, 2, 3, 4] and ids(keyword="Go/Dev") == [1, 2, 4] and ids(location=" berlin ") == [1, 2, 3]
    assert ids(remote_only=True, location="x") == [2] and ids(language="pt") == [2, 3, 4]


def test_lists_and_places(spark):
    df = spark.createDataFrame([(["a", "b"], "Olá, Mundo go"), ([], "go"), (["c"], "mundo")], "k array<string>, t string")
    pick = lambda search, chosen: [r.t for r in df.filter(filters.list_match(F.col("k"), F.col("t"), search, chosen)).collect()]
    assert pick("", []) == ["Olá, Mundo go", "go", "mundo"] and pick("GO; mundo", []) == ["Olá, Mundo go"] and pick("", ["b", "c"]) == ["Olá, Mundo go", "mundo"]
    assert one(spark, filters.continent(F.lit(" Remote, UK "))) == "Europa" and one(spark, filters.continent(F.lit(None))) == "Desconhecido"
    assert one(spark, filters.place_match(F.lit("Brasil"), "América do Sul", "Brasil")) and not one(spark, filters.place_match(F.lit("Chile"), country="Brasil"))
    assert one(spark, filters.model_filter_of(F.array(F.lit("Presencial"), F.lit("Híbrido"), F.lit("Híbrido")))) == "HibridoPresencial"


def test_secrets(spark):
    for key in ("k", "x" * 64, "y" * 100):
        for value in ("", "a@b.c", "ção"):
            assert one(spark, secrets.hmac_sha256(F.lit(value), key)) == hmac.new(key.encode(), value.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("",), ("x",), ("São Paulo " * 50,), (None,)], "v string").withColumn("e", secrets.encrypted(F.col("v"), KEY, "k1")).persist()
    rows = df.select("v", "e", secrets.decrypted(F.col("e"), KEY).alias("back"), secrets.decrypted(F.col("e"), KEY[::-1]).alias("wrong")).collect()
    assert all(r.back == r.v and r.wrong is None for r in rows) and rows[1].e.split(":")[:2] == ["v1", "k1"] and [len(p) for p in rows[1].e.split(":")[2:]] == [24, 32, 2]
    assert one(spark, secrets.decrypted(F.lit("v2:a:b:c:d"), KEY)) is None and one(spark, secrets.decrypted_or_plain(F.lit(""), F.lit("plain"), KEY)) == "plain"


def test_detail_text(spark):
    data = {"a": ["<b>one two</b>", {"b": "no", "c": ["three &amp; four", 5, None]}], "d": "\\u003cp\\u003efive"}
    page = f'<script id="__NEXT_DATA__">{json.dumps(data)}</script><script type="application/json">{{broken</script><style>s</style><p>six</p>'
    assert one(spark, text.detail_text(F.lit(page))) == "one two three & four five six"
    many = "<script type='application/json'>" + json.dumps([f"text {k}" for k in range(400)]) + "</script>"
    got = one(spark, text.detail_text(F.lit(many)))
    assert got.endswith("text 299") and one(spark, text.detail_text(F.lit("x " * 20_000))) == ("x " * 20_000)[:12_000] and one(spark, text.detail_text(F.lit(None))) == ""


def test_views(spark):
    jobs = spark.createDataFrame([(0, None, " ", "", "not a url", "", "Remote work", "", ["A ", "a", "A", "", "b", "c", "d", "e", "f"], "k", "", ["X"]), (1, "Sr Dev", "C", "P", "https://x/y", "híbrido", "", "2024-02-29T01", [], "", "S", [])], "ordinal int, title string, company string, location string, url string, modality string, description string, postedAt string, keywords array<string>, keyword string, source string, sources array<string>")
    a, b = projections.recommended(jobs).orderBy(F.desc("status"), "jobTitle").collect()
    assert (a.jobTitle, a.company, a.location, a.type, a.tags, a.source) == (projections.NO_TITLE, projections.NO_COMPANY, projections.NO_PLACE, "Remoto", ["k", "A", "a", "b", "c", "d"], "X") and a.jobLink == "https://jobs.invalid/X%7C0"
    assert (b.type, b.level, b.tags, b.posted, b.jobLink) == ("Híbrido", "Sênior", ["Geral"], "29/02/2024", "https://x/y")


def test_names_guards_and_labels(spark):
    taken = spark.createDataFrame([("ana",), ("ana_1",), ("user",)] + [("bob",)] + [(f"bob_{k}",) for k in range(1, 21)], "username string")
    got = {r.base: r.username for r in projections.usernames(spark.createDataFrame([("Aná",), ("",), ("bob",), ("new",)], "base string"), taken, "base").collect()}
    assert (got["Aná"], got[""], got["new"]) == ("ana_2", "user_1", "new") and got["bob"].startswith("bob_") and got["bob"] not in {r.username for r in taken.collect()} | {"bob_"} or int(got["bob"][4:]) <= 20
    accounts = spark.createDataFrame([(1, "g"), (1, "h"), (2, "g"), (3, "g")], "u int, p string")
    allowed = {(r.u, r.p): r.allowed for r in relational.disconnectable(accounts, spark.createDataFrame([(3,)], "u int"), "u", "p").collect()}
    assert allowed == {(1, "g"): True, (1, "h"): True, (2, "g"): False, (3, "g"): True}
    assert one(spark, timeseries.series_label(F.create_map(F.lit("job"), F.lit("j"), F.lit("path"), F.lit("p")))) == "p"


def test_keyword_files(spark, tmp_path):
    (tmp_path / "keywords.json").write_text(json.dumps({"KEYWORDS": [" Go ", "go", "Rust"]}))
    path = f"{tmp_path}/stored"
    words = lambda df: [r.keyword for r in df.orderBy("ordinal").collect()]
    assert words(sinks.load_keywords(spark, path, f"{tmp_path}/keywords.json")) == ["go", "rust"] and words(sinks.load_keywords(spark, path)) == []
    sinks.save_keywords(spark.createDataFrame([("B ", 2), ("a", 1)], "keyword string, ordinal long"), path)
    assert words(sinks.load_keywords(spark, path, f"{tmp_path}/keywords.json")) == ["a", "b"]
