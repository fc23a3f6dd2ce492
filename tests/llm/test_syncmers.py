import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import syncmers as S

SCHEMA = "doc_id long, text string, part string, ahead int"


def slow_anchors(text):
    """By the definition: windows of K code points whose smallest inner S-mer lies at an edge."""
    M64 = (1 << 64) - 1

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & M64
        return z ^ z >> 31

    def poly(s):
        h = 0
        for c in s:
            h = (h * S.MULTIPLIER + ord(c) + 1) & M64
        return h

    out = []
    for i in range(len(text) - S.K + 1):
        inner = [mix(poly(text[i + j : i + j + S.S])) for j in range(S.K - S.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, mix(poly(text[i : i + S.K]))))
    return out


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijé🙂", k=rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 60])
def test_anchors_by_definition(n, monkeypatch):
    text = words(random.Random(n), n)
    want = slow_anchors(text)
    for piece in (S.PIECE, 7):
        monkeypatch.setattr(S, "PIECE", piece)
        at, h = S.anchors(text)
        if len(text) >= S.K:
            assert list(zip(at.tolist(), h.tolist())) == want
    if 0 < len(text) < S.K:
        assert len(S.anchors(text)[0]) == 1


def test_anchors_are_context_free():
    rng = random.Random(1)
    shared = words(rng, 50)
    a, b = words(rng, 30) + shared + words(rng, 10), words(rng, 3) + shared
    at, bt = (dict(zip(h.tolist(), p.tolist())) for p, h in (S.anchors(a), S.anchors(b)))
    inside = [h for h, p in at.items() if a.index(shared) <= p <= a.index(shared) + len(shared) - S.K]
    assert len(inside) > 20
    assert {at[h] - bt[h] for h in inside} == {a.index(shared) - b.index(shared)}


def test_likeness():
    rng = random.Random(2)
    text, other = words(rng, 800), words(rng, 800)
    f = lambda t: S.print_of(t)
    assert S.likeness(f(text), f(text)) == 1 == S.likeness(f(""), f(""))
    assert S.likeness(f(text), f(other)) < 0.1 and S.likeness(f(text), f("")) == 0
    assert 0.1 < S.likeness(f(text), f(S.edited(text, other))) < 0.6


def slow(spark, rows):
    own = {r.text: r.h for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, own[r[1]]), reverse=True)
    out = []
    for k, (d, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        f, g, h = (S.print_of(x) for x in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, S.likeness(f, g), S.likeness(f, h), covered(t, e), covered(t, n)))
    return out


def covered(text, other):
    """Code points of text in passages of other, by the definition."""
    first, ties, out = {}, {}, set()
    for p, h in zip(*(x.tolist() for x in S.anchors(other))):
        first.setdefault(h, p)
    for p, h in zip(*(x.tolist() for x in S.anchors(text))):
        if h in first:
            ties.setdefault(p - first[h], []).append(p)
    for at in ties.values():
        if len(at) >= S.LEAST:
            out |= {x for p in at for x in range(p, p + S.K)}
    return len(out)


def test_matched_code_points():
    rng = random.Random(8)
    for _ in range(40):
        shared = words(rng, rng.randint(0, 60))
        a, b = words(rng, 30) + shared + words(rng, 10), words(rng, rng.randint(0, 30)) + shared + words(rng, 5) + shared[: rng.randint(0, 200)]
        got = S.matched(*S.anchors(a), *S.anchors(b))
        assert got == covered(a, b)
        if len(shared) > 150:
            assert 0.7 * len(shared) < got < len(shared) + 3 * S.K
    assert S.matched(*S.anchors(""), *S.anchors("")) == 0 == S.matched(*S.anchors(a), *S.anchors(""))


def test_ids_that_many_rows_share_are_cut(spark):
    rng = random.Random(3)
    rows = [(None if k % 2 == 0 else 5 if k % 4 == 1 else k, f"{k} {words(rng, 5)}", "x", 1) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r) for r in S.compared(df).collect()], key=key) == sorted(slow(spark, rows), key=key)
    sizes = S.with_next(df, "doc_id", "text").filter("ahead = 0 and doc_id is null").groupBy("part").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 100  # half of the 300 rows have no id


def test_passages_by_position(spark):
    rng = random.Random(12)
    shared = words(rng, 120)
    texts = [words(rng, 60) for _ in range(6)]
    rows = [(1, texts[0] + shared, None, 1), (None, texts[1], None, 1), (3, shared + texts[2], None, 1), (3, shared + texts[2], None, 1), (4, texts[3] + shared + texts[4] + shared, None, 1), (5, texts[5], None, 1), (6, None, None, 1), (7, "", None, 1)]
    got = sorted(tuple(r)[:5] for r in S.passages(spark.createDataFrame(rows, SCHEMA), every=2).collect())
    want = []  # by the definition: equal anchors, tied to their first place, on one shift
    first, ties = {}, {}
    for d, t in sorted({(d or 0, t) for d, t, *_ in rows if t}):
        for at, h in zip(*(x.tolist() for x in S.anchors(t))):
            if h % 2 == 0:
                f = first.setdefault(h, (d, at))
                if f != (d, at):
                    ties.setdefault((d, f[0], at - f[1]), set()).add(at)
    for (d, other, shift), at in ties.items():
        if len(at) >= S.LEAST:
            want.append((d, min(at), max(at) + S.K, other, min(at) - shift))
    assert got == sorted(want) and len(got) == 3
    for d, start, stop, other, there in got:
        text = {k: t for k, t, *_ in rows}
        assert text[d][start:stop] == text[other][there : there + stop - start] and stop - start > 0.8 * len(shared)
    assert S.passages(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 60])
def test_next_document_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(-50, 1000), words(rng, rng.randint(0, 40)), "x", 1) for _ in range(n)]
    if n == 60:
        rows += [(None, "null id", None, None), (None, "another null id", None, 1), (7, None, "", 1), (2000, "dup", None, 1), (2000, "dup", None, 1), (2000, "", None, 1), (1 << 62, "far", None, 1)]
    got = [tuple(r) for r in S.compared(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(slow(spark, rows), key=key)
    assert len({r[3] for r in got if r[0] == 2000}) <= 2


def test_fingerprints_and_empty(spark):
    df = spark.createDataFrame([(1, "some text of a document", None, 1), (2, None, None, 1)], SCHEMA)
    got = {r.doc_id: r for r in S.fingerprints(df).collect()}
    assert got[1].fingerprint == S.print_of("some text of a document") and got[2].n_anchors == 0
    assert S.compared(df.limit(0)).count() == 0
    assert np.all(S.sketch(S.anchors("")[1]) == S.EMPTY)
