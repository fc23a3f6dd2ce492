import pytest

from quernstone.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, score string, rejected int"
WORDS = {
    "en": "the of and to in that was for with from house water people between through".split(),
    "de": "der die und nicht mit auf eine wurde durch zwischen haus wasser leute straße über".split(),
    "fr": "le les des une dans pour avec entre maison eau gens était être où château".split(),
}


def rows(n=120):
    import random

    rng = random.Random(5)
    out = []
    for k in range(n):
        lang = list(WORDS)[k % 3]
        words = rng.choices(WORDS[lang], k=rng.choice([3, 10, 60, 400]))
        out.append((k, " ".join(words).capitalize() + ".", lang, "x", 1))
    return out


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    dictionaries = L.learn(df.filter(~L.held_out()), "text", "lang", "doc_id")
    assert list(dictionaries) == ["de", "en", "fr"]
    truth = {r[0]: r[2] for r in rows()}
    got = L.predictions(df, dictionaries).withColumn("held_out", L.held_out()).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_results(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    dictionaries = L.learn(df, "text", "lang", "doc_id")
    odd = [(1, None, None, None, None), (2, "", "en", "", 1), (3, "12 -- 3", None, "", 1), (None, "der die und nicht mit Straße über durch eine leute", None, "", 1), (5, "the of and " * 20000, "en", "", 1), (5, "the of and " * 20000, "en", "", 1)]
    got = [tuple(r) for r in L.predictions(spark.createDataFrame(odd, SCHEMA), dictionaries).collect()]
    assert [(r[0], r[1]) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en"), (5, "en")]
    assert [r[2] for r in got[:3]] == [0.0] * 3 and [r[3] for r in got[:3]] == [True] * 3
    kept = L.keep_identified(spark.createDataFrame(odd, SCHEMA), dictionaries)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [None, 5, 5]
    assert L.predictions(df.limit(0), dictionaries).count() == 0
    assert {r.lang_pred for r in L.predictions(df, L.learn(df.limit(0), "text", "lang", "doc_id")).collect()} == {"und"}


@pytest.mark.parametrize("bound", [5, 20])
def test_sample_is_bounded(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "SAMPLE_ROWS", bound)
    df = spark.createDataFrame([(k, "w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10], "en", "", 1) for k in range(100)], SCHEMA)
    assert len(L.learn(df, "text", "lang", "doc_id")["en"].split()) == bound


def test_texts_without_a_letter(spark):
    dictionaries = L.learn(spark.createDataFrame(rows(), SCHEMA), "text", "lang", "doc_id")
    classify = L.classifier(dictionaries)
    for odd in ("²", "½ ² Ⅷ ①②", "_ 12", "́̂", " \n\t", "🙂"):
        assert classify(odd) == ("und", 0.0, True)
    assert classify("ª ² der und nicht")[0] == "de"


def by_hand(text, dictionaries):
    """Sizes by a fresh compressor for each piece, with nothing shared or prepared."""
    import itertools
    import unicodedata

    import zstandard

    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    plain = " ".join(w for w, _ in itertools.groupby(words))
    n = -(-len(plain) // L.PIECE)
    step = -(-len(plain) // n)

    def size(lang, part):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=L.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(part.encode()))

    cut = [plain[k * step : (k + 1) * step] for k in range(n)]
    total = {lang: sum(size(lang, x) for x in cut) for lang in dictionaries}
    least, next_ = sorted(total.values())[:2]
    if least == next_:
        more = [" ".join(x.split()[k:] + x.split()[:k]) for x in cut for k in range(min(L.TURNS, len(x.split())))] + [f" {x} " for x in cut]
        total = {lang: sum(size(lang, x) for x in more) for lang in dictionaries}
        least, next_ = sorted(total.values())[:2]
    return min(lang for lang in total if total[lang] == least), min(1.0, 4 * (1 - least / next_))


def test_against_brute_force(spark):
    df = spark.createDataFrame([*rows(60), (1000, "the der le", "en", "", 1), (1001, "xyzzy", None, "", 1), (1002, None, "de", "", 1), (1003, "Été À l'ÉCOLE ́ 12 " * 90, None, "", 1)], SCHEMA)
    dictionaries = L.learn(df.filter(~L.held_out()), "text", "lang", "doc_id")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in L.predictions(df, dictionaries).collect():
        lang, score = by_hand(texts[r.doc_id], dictionaries)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score))


def test_a_dictionary_has_a_share_of_each_text():
    long, short = ["abc " * 60] * 8, [["hello"], ["world"]]
    d = L.dictionary([long, *short], 400)
    assert len(d) <= 400 and b"hello" in d and b"world" in d
    tail = ["a " * 100, "b c " * 100, "tail end"]
    assert b"tail" in L.dictionary([tail, *[["x y"]] * 5], 200)
    assert L.dictionary([["..."]]) == b" " * 8


def test_stretches_come_from_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr(L, "STRETCH_CHARS", 10)
    text = "".join(chr(97 + k % 26) * 7 + " " for k in range(500)) + "thisistheend"
    (d,) = L.learn(spark.createDataFrame([(1, text, "en", "", 1)], SCHEMA), "text", "lang", "doc_id").values()
    assert b"istheend" in d and d.startswith(b"aaaaaaa")


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(k, t, lang, "s", "p") for k, t, lang, *_ in rows(30)], "doc_id long, text string, lang string, `a.b` string, rejected string")
    kept = L.keep_identified(df, L.learn(df, "text", "lang", "doc_id"))
    assert kept.columns == df.columns and {r["a.b"] for r in kept.collect()} == {"s"}


@pytest.mark.parametrize("ids", [1, 10, 100, 5000])
def test_rows_that_share_ids_are_sampled_one_by_one(spark, monkeypatch, ids):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 40)
    reached = []
    monkeypatch.setattr(L, "dictionary", lambda texts: reached.append(len(texts)) or b"".join(x for t in texts for x in map(str.encode, t)))
    df = spark.range(5000).selectExpr(f"id % {ids} AS doc_id", "concat('w', id) AS text", "if(id < 30, 'few', 'many') AS lang")
    got = L.learn(df.unionAll(df).unionAll(df), "text", "lang", "doc_id")
    assert sorted(got) == ["few", "many"] and sorted(reached) == [30, 40]


def test_a_row_that_is_most_of_the_table_counts_once(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 20)
    reached = []
    monkeypatch.setattr(L, "dictionary", lambda texts: reached.append(texts) or b"x")
    df = spark.range(2000).selectExpr("if(id < 1900, 7, id) AS doc_id", "if(id < 1900, 'same', concat('w', id)) AS text", "'en' AS lang")
    assert L.learn(df, "text", "lang", "doc_id") == {"en": b"x"}
    assert len(reached[0]) == 20 and sum(t == ["same"] for t in reached[0]) <= 1


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    df = spark.range(400).selectExpr("id AS doc_id", "concat('w', id) AS text", "concat('l', cast(least(sqrt(id), 9) as int)) AS lang")
    assert sorted(L.learn(df, "text", "lang", "doc_id")) == ["l7", "l8", "l9"]
