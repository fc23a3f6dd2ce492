import pytest
from pyspark.sql import functions as F

from quernstone.functions import predicates, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.fold, "  Ação/É  C#-Dev_1 ", "acao e c dev 1"),
        (text.fold, "été ÅNGSTRÖM", "ete angstrom"),
        (text.fold, "", ""),
        (text.soft, "A&amp;B - São/Paulo ", "a&b são paulo"),
        (text.accents_pt, " São João ", "sao joao"),
        (text.punctuation_to_space, "A.b,c;d|e (f) [g]", "a b c d e f g"),
        (text.ui_text, "Olá, Mundo!", "ola, mundo!"),
        (text.username, "José da Silva!", "josedasilva"),
        (text.username, "a" * 30, "a" * 20),
        (text.digits, "+1 (55) 9-x", "1559"),
        (text.url_key, "https://A.b/c/?q=1#x ", "https://A.b/c"),
        (text.url_key, "not a url?x", "not a url"),
        (text.url_ui, "HTTPS://A.B/Path/?q", "https://a.b/Path"),
        (text.strip_html, "<p>a<script>var x='</p>'</script> b</p>\n<style>p{}</style>c", "a b c"),
        (text.strip_tags, "<b>x</b>&y", "x &y"),
        (text.strip_html, "&lt;script&gt;x()&lt;/script&gt;&lt;p&gt;Hi&lt;/p&gt; &amp;lt;b&amp;gt;", "Hi <b>"),
        (text.strip_html, "Ol&aacute;,&nbsp;&eacute;&#x27;s &#233;", "Olá, é's é"),
        (text.strip_tags, "&lt;style&gt;p&lt;/style&gt;&middot;", "p ·"),
        (text.soft, "Caf&Eacute;&nbsp;/&ndash;", "café –"),
        (text.punctuation_to_space, "a&#46;b&semi;c", "a b c"),
        (text.slug, "P&amp;D &Ccedil;", "p-and-d-c"),
        (text.unescaped, "&amp;lt; &notit; &notin &copy &#0; &#xD800; &#x110000; &#128; &#129; &#; &x; &", "&lt; ¬it; ¬in © � � � € \x81 &#; &x; &"),
        (text.slug, "Ação &amp; Reação -- 2!", "acao-and-reacao-2"),
        (text.initials, "  ana  maria braga", "AM"),
        (text.initials, "ana", "A"),
        (text.date_label, "2024-03-09T10:00:00Z", "09/03/2024"),
        (text.date_label, "soon", "Não informado"),
        (text.char_sum_score, "ab", 70 + (97 + 98) % 26),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_labels(spark):
    assert one(spark, " a  b ", lambda x: text.compact_label(x, "none")) == "a b"
    assert one(spark, " ", lambda x: text.compact_label(x, "none")) == "none"
    assert one(spark, "x" * 91, lambda x: text.compact_label(x, "none")) == "x" * 90 + "..."
    assert one(spark, 1536, text.bytes_label, "long") == "1.5 KiB" and one(spark, 12, text.bytes_label, "long") == "12 B"
    assert one(spark, 1700000000123, text.epoch_ms, "long") == "2023-11-14T22:13:20Z"


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.unique_trimmed, [" a", "b", "a ", "", "A"], ["a", "b", "A"]),
        (text.unique_ci, ["B", " a", "b", "A"], ["B", "a"]),
        (text.non_empty, ["", " x ", " "], ["x"]),
    ],
)
def test_lists(spark, f, value, want):
    assert one(spark, value, f, "array<string>") == want


def test_splits(spark):
    assert one(spark, "a, b,,c d ", text.split_csv) == ["a", "b", "c d"]
    assert one(spark, "a;b\nc  d,a", text.split_search) == ["a", "b", "c", "d"]
    assert one(spark, "a|b; c", text.split_multi) == ["a", "b", "c"]


def test_salary(spark):
    rows = [(1000.0, 2000.5, "BRL", "month", "d"), (1000.0, None, "BRL", "", "d"), (None, 5.0, "", "", "d"), (None, None, "BRL", "", " d ")]
    df = spark.createDataFrame(rows, "a double, b double, c string, i string, d string")
    got = [r[0] for r in df.select(text.salary_range(*[F.col(c) for c in "abcid"])).collect()]
    assert got == ["1000 - 2000.5 BRL month", "A partir de 1000 BRL", "Até 5", "d"]


def test_longest_counts_bytes_and_keeps_the_first(spark):
    df = spark.createDataFrame([("ab", 1), ("é", 2), ("cd", 3), ("x", 0)], "t string, o int")
    assert df.agg(text.longest(F.col("t"), F.col("o"))).first()[0] == "ab"


@pytest.mark.parametrize(
    ("value", "needle", "want"),
    [
        ("metadata engineer", "data engineer", True),
        ("metadata", "data", False),
        ("a go b", "go", True),
        ("golang", "go", False),
        ("x", "", False),
        ("", "a", False),
    ],
)
def test_token_or_phrase(spark, value, needle, want):
    assert one(spark, value, lambda x: predicates.token_match(x, needle)) is want
    assert one(spark, value, lambda x: predicates.token_match(x, F.lit(needle))) is want


def test_keyword_forms(spark):
    assert one(spark, "senior nodejs dev", lambda x: predicates.keyword_match(x, F.lit("node js dev"))) is True
    assert one(spark, "node and js", lambda x: predicates.keyword_match(x, F.lit("node js"))) is False
    assert one(spark, "golang developer", lambda x: predicates.all_terms(x, F.lit("go developer"))) is True
    assert one(spark, "c# node.js", lambda x: predicates.synonym_groups(x, [["c#", "java"], ["node.js"]])) is True
    assert predicates.fold_word("C# / .NET Árvore") == "c net arvore"


def test_fold_is_idempotent(spark):
    values = ["Ação", "ß É x̂ y", "日本 ﬁ Ω", "a_b-c"]
    df = spark.createDataFrame([(v,) for v in values], "x string").select(text.fold(F.col("x")).alias("y"))
    assert all(r.y == r.z for r in df.withColumn("z", text.fold(F.col("y"))).collect())


def test_every_reference(spark):
    import html
    import random

    from quernstone.functions.entities import html5

    pick = random.Random(1)
    names = sorted(html5)
    texts = ["&" + n + pick.choice(["", "x", " ", ";"]) for n in names]
    texts += ["".join(pick.choice(["&", pick.choice(names), ";", "#34", " ", "é"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", text.unescaped(F.col("t")).alias("u")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != html.unescape(t)] == []
    assert one(spark, None, text.unescaped) is None


@pytest.mark.parametrize("name", ["html_strip_pages", "html_strip_tags_pages", "unescaped_pages"])
def test_references_of_pages_are_those_of_their_sql(spark, tmp_path, name):
    """Titles are cut inside references: what lacks its semicolon stays in these queries."""
    import duckdb

    from quernstone.plans.text_queries import QUERIES

    pages = [(1, "u", "<title>a and&amp</title>&amp;b"), (2, "u", "<p>x &lt y&nbs</p>&lt;i&gt;z"), (3, "u", "&amp;amp &#39 &#39;")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = QUERIES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("few", [0, 64])
def test_long_texts_are_looked_through_once(spark, monkeypatch, few):
    """A text of 120,000 words: passages and needles in time that grows with its length, not with its square."""
    import time

    from quernstone.operators import phrases, search

    monkeypatch.setattr(phrases, "FEW", few)  # without it, all needles are looked up by joins
    words = [f"w{i}" for i in range(120_000)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2")], "id long, t string")
    passages = spark.createDataFrame([(1, " ".join(words[90_000:90_020])), (2, "99 w100 w101"), (3, "9 w110000"), (4, " ".join(words[5:15][::-1]))], "item long, p string")
    began = time.monotonic()
    assert sorted(tuple(r) for r in search.passages_in(texts, "id", "t", passages, "item", "p").collect()) == [(1, 1), (2, 1), (3, 1)]
    needles = spark.createDataFrame([("9999 w1",), ("119999",), ("1 w2",), ("w7 w8 w9",), ("2 w1",)], "n string")
    assert sorted(tuple(r) for r in phrases.containing(texts, "id", "t", needles, "n").collect()) == [(1, "1 w2"), (1, "119999"), (1, "2 w1"), (1, "9999 w1"), (1, "w7 w8 w9"), (2, "1 w2")]
    assert time.monotonic() - began < 90
