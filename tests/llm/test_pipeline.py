import random

import numpy as np

import corpus_pipeline as C
from quernstone.llm import langid, sentpieces, unitdedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that was for with from house water people between through light garden winter yellow morning".split(),
    "de": "der die und nicht mit auf eine wurde durch zwischen haus wasser leute straße über garten winter gelb morgen licht".split(),
}


def sentence(rng, lang):
    words = rng.choices(WORDS[lang], k=rng.randint(6, 12))
    return " ".join(w + rng.choice(["", "", "s", "en", "ly", "ung", "heit"]) for w in words).capitalize() + "."


def corpus():
    rng = random.Random(11)
    docs = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        docs.append((k, "\n".join(" ".join(sentence(rng, lang) for _ in range(5)) for _ in range(4)), lang, f"src{k % 5}"))
    passage = " ".join(sentence(rng, "en") for _ in range(8))
    for k in (4, 8, 20):
        d = docs[k]
        words = d[1].split(" ")
        docs[k] = (d[0], " ".join(words[:30] + [passage] + words[30:]), *d[2:])
    for k in range(6):  # near copies: one word in about 180
        words = docs[k][1].split(" ")
        words[50] = "changed"
        docs.append((100 + k, " ".join(words), docs[k][2], "src9"))
    docs += [(200 + k, docs[7][1], "en", None) for k in range(4)] + [(300, "123 -- 45", "en", "src0"), (301, "", None, "src1"), (302, None, None, None)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs], passage


def test_stages_against_brute_force(spark, tmp_path):
    docs, passage = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    steps = {}
    now = df
    for name, stage in C.STAGES:
        now = stage(spark, now, str(tmp_path)).persist()
        steps[name] = now
        if name != "encode":
            assert now.columns == df.columns
    rows = {name: {r.doc_id: r for r in step.collect()} for name, step in steps.items()}
    dictionaries = langid.learn(df, "text", "lang", "doc_id")
    classify = langid.classifier(dictionaries)
    assert set(rows["language_id"]) == {d for d, t, *_ in docs if not classify(t)[2]} and not {300, 301, 302} & set(rows["language_id"])
    shingles = {d: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t, *_ in docs if d in rows["language_id"]}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    gone = set()
    ids = sorted(shingles)
    for k, b in enumerate(ids):
        if any(alike(a, b) >= 0.8 for a in ids[:k]):
            gone.add(b)
    assert set(rows["near_dedup"]) == set(ids) - gone and {100, 101, 102, 103, 104, 105, 200, 201, 202, 203} & set(ids) <= gone
    kept = sorted(rows["near_dedup"])
    texts = {d: rows["near_dedup"][d].text for d in kept}
    seen, cut = {}, {}
    for d in kept:
        own = set()
        one = unitdedup.Cut([texts[d]])
        _, place, h1, h2, _ = (x.tolist() for x in one.units())
        for at, *digest in sorted(zip(place, h1, h2)):
            if seen.setdefault(tuple(digest), (d, at)) != (d, at):
                own.add(at)
        spans = one.removed(0, own)
        at, out = 0, ""
        for a, b in [*spans, (len(texts[d]), 0)]:
            out += texts[d][at:a]
            at = b
        cut[d] = out
    assert {d: r.text for d, r in rows["substring_dedup"].items()} == cut
    assert all(r.n_chars == len(r.text) for r in rows["substring_dedup"].values())
    assert [d for d in sorted(cut) if passage in cut[d]] == [4]
    assert {d: tuple(r) for d, r in rows["mix_sources"].items()} == {d: tuple(r) for d, r in rows["substring_dedup"].items()}
    encoder = sentpieces.Encoder(sentpieces.Pieces(sentpieces.model_path()))
    want = {d: np.frombuffer(x, "<u2").tolist() for d, x in zip(cut, encoder.encode(list(cut.values())))}
    assert {d: r.ids for d, r in rows["encode"].items()} == want and all(r.same for r in rows["encode"].values())
    out = C.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids for r in out.collect()} == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_the_mix_outlives_files(spark, tmp_path):
    """Read again from many files, the rows still tell the order of the mix: less than a block off each source's share."""
    docs, _ = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = C.run(spark, str(tmp_path))
    out.repartition(13).write.parquet(f"{tmp_path}/out")
    rows = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.mix_slot, r.mix_place))
    mixed = C.mixing.mix(out.select("doc_id", "source", "lang", "n_chars"), **C.MIX).orderBy("slot", "place").collect()
    assert [(r.doc_id, r.mix_slot, r.mix_place) for r in rows] == [(r.doc_id, r.slot, r.place) for r in mixed] and len({r.mix_slot for r in rows}) > 3
    assert len({(r.source, r.mix_place) for r in rows}) == len(rows)


def test_columns_of_any_name(spark, tmp_path):
    docs, _ = corpus()
    extra = ["a.b", "kept", "_id", "_key", "repeats", "slot", "weight", "rejected", "same", "mix_slot", "h1", "row"]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", *[f"'{c}' AS `{c}`" for c in extra])
    now = df
    for name, stage in C.STAGES[:-1]:
        now = C.materialize(stage(spark, now, str(tmp_path)), name)
        assert now.columns == df.columns
        assert {r[c] for r in now.select(*[f"`{c}`" for c in extra]).collect() for c in extra} == set(extra)
    out = C.encode(spark, now, str(tmp_path))
    assert out.columns == [*[c for c in df.columns if c not in ("text", "same", "mix_slot")], "mix_slot", "mix_place", "n_pieces", "ids", "same"]
    assert out.count() == now.count()
