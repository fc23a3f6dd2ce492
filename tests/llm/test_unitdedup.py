import random

import pytest
import regex

from quernstone.llm import unitdedup as U

SCHEMA = "doc_id long, text string, kept_by string, lang string"


CLAUSE = regex.compile(r"(?<=[.!?…]['\")\]]*)[^\S\n]+|(?<=[\p{Ll}\p{N},;:])[^\S\n]+(?=\p{Lu}\p{Ll}*)")
SCRIPTLESS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"(?V1)[{SCRIPTLESS}]\p{{M}}*|[[\p{{L}}\p{{N}}\p{{M}}]--[{SCRIPTLESS}]]+")


def slow_spans(text):
    """Clauses (start, end, first of the line) and their words, line by line."""
    spans, words, start = [], [], 0
    for own in text.split("\n"):
        at, first = 0, len(spans)
        for gap in [*CLAUSE.finditer(own), None]:
            a, b = gap.span() if gap else (len(own), 0)
            if a > at:
                spans.append((start + at, start + a, first))
                words.append([m[0].lower() for m in WORD.finditer(own, at, a)])
            at = b
        start += len(own) + 1
    return spans, words


def slow_units(text):
    """(position, what the unit is told by, words), by the definition."""
    spans, words = slow_spans(text)
    out, lines = [], {}
    for k, w in enumerate(words):
        lines.setdefault(spans[k][2], []).append(k)
        if w:
            out.append((2 * k, ("clause", *w), len(w)))
    for first, ks in lines.items():
        line = [w for k in ks for w in words[k]]
        if len(ks) > 1 and len(line) >= U.LINE_WORDS:
            out.append((2 * first + 1, ("line", *line), len(line)))
    flat = [(w, len(own) > U.LONG) for own in words for w in own]
    if any(long for _, long in flat):
        h = [int(U.Cut([w]).hash[0][0]) for w, _ in flat]
        cuts = [i for i in range(len(h)) if i == 0 or all(h[i] <= h[j] for j in range(max(0, i - U.REACH), min(len(h), i + U.REACH + 1)))]
        ranges = [(i, j) for i, j in zip(cuts, [*cuts[1:], len(h)]) if any(long for _, long in flat[i:j])]
        out += [(U.PIECES + k, ("piece", *(w for w, _ in flat[i:j])), j - i) for k, (i, j) in enumerate(ranges)]
    return sorted(out)


def units(text):
    doc, at, h1, h2, words = U.Cut([text]).units()
    return sorted(zip(at.tolist(), zip(h1.tolist(), h2.tolist()), words.tolist()))


def slow(docs):
    """Over all units in rank order: what has been seen before is a repeat."""
    seen, out = {}, {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        for at, unit, _ in slow_units(text or ""):
            first = seen.setdefault(unit, (d, at))
            if first != (d, at) and at < U.PIECES:
                out.setdefault(d, set()).add(at)
    return out


ODD = [
    "", " ", "\n", "\n\n", "a", ".", ") x", "'\" A", "... Abc", "a. ", "a.\n", " a.  \n b. C", "x.)\"'] Y", "1 A, B; C: D e F", "日本語。テスト abcはい", "สวัสดีครับ hello ไทย", "é̀ x̀. ́ a", "ǅ Ǆ. İstanbul ß", "a B c D", "́́", "日́本áb日", "A) b. (C", "x\x1cY\x85Z",
]


def test_units_by_the_definition():
    """Many texts at once give what each gives alone, and that is what regular expressions find line by line."""
    rng = random.Random(20)
    alphabet = ["a", "b", "Cd", "E", "é", "日", "ไ", "1", ".", "!", "…", ",", ")", "'", " ", " ", "  ", "\n", "-", "́"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)] + [" ".join(rng.choices(["ab", "c", "De", "f.", "日本", "ghi"], k=300)) for _ in range(10)]
    told, digests = {}, {}
    cut = U.Cut(texts)
    doc, at, h1, h2, words = (x.tolist() for x in cut.units())
    by = {}
    for d, *unit in zip(doc, at, zip(h1, h2), words):
        by.setdefault(d, []).append(tuple(unit))
    for d, text in enumerate(texts):
        spans, own = cut.spans(d)
        assert (spans, own) == (slow_spans(text)[0], [len(w) for w in slow_spans(text)[1]])
        got, want = sorted(by.get(d, [])), slow_units(text)
        assert got == units(text)
        assert [(a, n) for a, _, n in got] == [(a, n) for a, _, n in want]
        for (_, digest, _), (_, unit, _) in zip(got, want):
            assert told.setdefault(digest, unit) == unit and digests.setdefault(unit, digest) == digest


def sentence(rng, n=None):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n or rng.randint(4, 14))).capitalize() + "."


def test_units_cover_the_text():
    text = 'One two. Three "four." Five\n\nsix, seven Eight nine\n  \n… Ten! 1.5 eleven'
    spans, words = U.Cut([text]).spans(0)
    assert [text[a:b].strip() for a, b, _ in spans if text[a:b].strip()] == ["One two.", 'Three "four."', "Five", "six, seven", "Eight nine", "…", "Ten!", "1.5 eleven"]
    assert sum(words) == 13
    assert all(a < b for a, b, _ in spans)


def test_removal_ends_and_spares_what_is_not_repeated():
    """Units without words, alone in lines, at line ends and between repeats, in any mix with repeated units."""
    rng = random.Random(11)
    parts = ["--", "...", "  ", "Of.", "\n", "\n---\n", "Alpha beta gamma delta epsilon zeta."] + [sentence(rng, 9) for _ in range(4)]
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(1, 12)))
        spans, words = U.Cut([text]).spans(0)
        at = [p for p, _, _ in units(text) if p < U.PIECES]
        repeated = set(rng.sample(at, rng.randint(0, len(at))))
        gone = U.removable(len(text), spans, words, repeated)
        assert all(a < b for a, b in gone) and all(x[1] <= y[0] for x, y in zip(gone, gone[1:]))
        for k, (a, b, first) in enumerate(spans):
            if words[k] and not {2 * k, 2 * first + 1} & repeated:
                assert not any(s < b and a < e for s, e in gone)


def docs_with_passages():
    rng = random.Random(3)
    passage = " ".join(sentence(rng, 9) for _ in range(8))
    boiler = sentence(rng, 12)
    docs = []
    for d in range(12):
        lines = [" ".join(sentence(rng) for _ in range(4)) for _ in range(4)]
        if d % 3 == 0:
            w = lines[1].split()
            lines[1] = " ".join(w[:7]) + " " + passage + " " + " ".join(w[7:])
        if d % 2 == 0:
            lines.insert(2, boiler)
        docs.append((d, "\n".join(lines)))
    return docs, passage, boiler


def test_passages_and_lines_stay_once(spark):
    docs, passage, boiler = docs_with_passages()
    df = spark.createDataFrame([(d, t, "x", "en") for d, t in docs], SCHEMA)
    got = {r.doc_id: r for r in U.deduplicated(df).collect()}
    assert [d for d, r in got.items() if passage in r.text] == [0] and [d for d, r in got.items() if boiler in r.text] == [0]
    for d, text in docs:
        r = got[d]
        assert r.text == "".join(text[s.start : s.end] for s in r.kept)
        assert sorted([*map(tuple, r.kept), *map(tuple, r.removed)])[0][0] == 0
        assert sum(s.end - s.start for s in [*r.kept, *r.removed]) == len(text)
        plain = text.replace(passage, "") if d else text
        plain = plain.replace(boiler + "\n", "") if d else plain
        assert r.text.split() == plain.split()


def test_repeats_against_brute_force(spark):
    docs, *_ = docs_with_passages()
    docs += [(20, docs[3][1]), (21, None), (22, ""), (23, "Of.\nOf.\nOf."), (24, "Of."), (25, (docs[1][1] + "\n") * 3)]
    df = spark.createDataFrame([(d, t, "x", "en") for d, t in docs], SCHEMA)
    got = {r.key: set(r.repeats) for r in U.repeats(df).collect()}
    assert got == slow(docs)
    cut = {r.doc_id: r for r in U.deduplicated(df).collect()}
    assert cut[20].text == "" and cut[23].text == "Of.\nOf.\nOf." and cut[24].text == "Of." and cut[21].text is None and cut[22].text == ""
    assert cut[25].text == ""


def test_chance_repeats_stay(spark):
    df = spark.createDataFrame([(1, "Short one. Alpha beta gamma delta.", None, None), (2, "Short one. Other words than those. Short one.", None, None)], SCHEMA)
    assert [r.text for r in U.deduplicated(df).orderBy("doc_id").collect()] == ["Short one. Alpha beta gamma delta.", "Short one. Other words than those. Short one."]


def test_ids_that_repeat_or_are_null(spark):
    line = "alpha beta gamma delta epsilon zeta"
    rows = [(None, line, None, "a"), (4, line, None, "b"), (4, line, None, "b"), (5, line.upper() + "!", None, "c"), (6, None, None, None)]
    got = sorted(((r.doc_id, r.text) for r in U.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, line), (4, ""), (4, ""), (5, ""), (6, None)], key=str)
    assert U.deduplicated(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_clashing_columns(spark):
    line = "alpha beta gamma delta epsilon zeta"
    df = spark.createDataFrame([(k, line, k, "x", "y", "z") for k in range(3)], "doc_id long, text string, Kept int, repeats string, `a.b` string, _key string")
    out = U.deduplicated(df)
    assert out.columns == ["doc_id", "text", "repeats", "a.b", "_key", "kept", "removed"]
    plain = U.deduplicated(df, spans=False)
    assert plain.columns == df.columns and sorted(map(tuple, plain.collect())) == [(0, line, 0, "x", "y", "z"), (1, "", 1, "x", "y", "z"), (2, "", 2, "x", "y", "z")]


def test_texts_under_null_and_shared_ids_are_their_own(spark):
    """A position that is repeated in one of them says nothing about the others' text at that position."""
    rng = random.Random(8)
    line = "alpha beta gamma delta epsilon zeta"
    own = [sentence(rng, 9) for _ in range(12)]
    rows = [(None, f"{line}\n{own[0]}"), (None, f"{own[1]}\n{line}"), (None, f"{own[2]}\n{own[3]}"), (7, f"{own[4]}\n{line}"), (7, f"{own[5]}\n{own[6]}"), (7, f"{line}\n{own[7]}"), (7, f"{own[5]}\n{own[6]}"), (8, own[8])]
    got = U.deduplicated(spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    text = "\n".join(r.text for r in got)
    assert text.count(line) == 1 and any(line in r.text for r in got if r.doc_id is None)
    assert [text.count(x) for x in own] == [1, 1, 1, 1, 1, 2, 2, 1, 1, 0, 0, 0]


def alphabet(first, last):
    return [chr(c) for c in range(ord(first), ord(last) + 1) if chr(c).isalpha()]


SCRIPTS = {"lower": (alphabet("a", "z"), " ", ""), "mid-sentence": (alphabet("a", "z"), " ", "."), "han": (alphabet("\u4e00", "\u9fa0"), "", "\u3002"), "danda": (alphabet("\u0915", "\u0939"), " ", "\u0964"), "arabic": (alphabet("\u0628", "\u064a"), " ", "\u06d4")}


@pytest.mark.parametrize("script", SCRIPTS)
def test_passages_without_ends_or_capitals(spark, script):
    """Passages of 60 words, pasted into the middle of other lines, go but for the words at their ends."""
    letters, gap, mark = SCRIPTS[script]
    rng = random.Random(script)
    word = lambda: "".join(rng.choices(letters, k=1 if script == "han" else rng.randint(3, 8)))
    def words(n):
        return gap.join(word() + (mark if k % 17 == 16 else "") for k in range(n))
    rows, shared = [], [words(60) for _ in range(10)]
    for k in range(30):
        rows.append((k, gap.join([words(rng.randint(20, 40)), shared[k % 10], words(rng.randint(20, 40))])))
    got = {r.doc_id: r for r in U.deduplicated(spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)).collect()}
    for d, text in rows:
        at = text.index(shared[d % 10])
        end = at + len(shared[d % 10])
        assert got[d].text == "".join(text[s.start : s.end] for s in got[d].kept)
        assert all(at <= s.start and s.end <= end + 1 for s in got[d].removed)
        gone = sum(s.end - s.start for s in got[d].removed)
        assert gone == 0 if d < 10 else gone > 0.4 * (end - at)
    assert sum(s.end - s.start for r in got.values() for s in r.removed) > 0.7 * 2 * sum(map(len, shared))
