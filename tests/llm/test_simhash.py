import os
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from quernstone.llm import simhash as S

SCHEMA = "doc_id long, text string, lang string, w0 string, node int"


def slow_fingerprint(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius):
    root = {d: d for d, _ in prints}
    changed = True
    pairs = [(a, b) for (a, x), (b, y) in combinations(prints, 2) if bin(x ^ y).count("1") <= radius]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def as_int(words):
    return sum(int(w) << 64 * k for k, w in enumerate(words))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "Ä b c D e f g a b c", "x " * 300, "É b  c\x0bd e"])
def test_fingerprint_is_as_defined(text):
    assert as_int(S.fingerprint(text, 3)) == slow_fingerprint(text, 3)


def test_long_texts_by_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(str(x) for x in rng.integers(0, 500, 4000))
    whole = S.fingerprint(text, 3).tolist()
    monkeypatch.setattr(S, "PIECE", 50)
    assert S.fingerprint(text, 3).tolist() == whole
    assert whole[0] == slow_fingerprint(text, 3)


@pytest.mark.parametrize(("lanes", "radius", "sizes"), [(1, 3, [1, 2, 3, 5, 64, 65, 200]), (4, 44, [2, 30, 64, 130]), (1, 0, [2, 70]), (1, 1, [9, 90])])
@pytest.mark.parametrize("sides", [False, True])
def test_links_against_all_pairs(lanes, radius, sizes, sides):
    rng = np.random.default_rng(lanes * 100 + radius)
    groups, words, side = [], [], []
    for g, n in enumerate(sizes):
        base = rng.integers(0, 2, (max(1, n // 6), 64 * lanes)).astype(bool)
        for _ in range(n):
            bits = base[rng.integers(0, len(base))].copy()
            bits[rng.choice(64 * lanes, rng.integers(0, radius + 2), replace=False)] ^= True
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            groups.append(g)
            side.append(bool(sides and rng.integers(0, 2)))
    words, groups, side = np.array(words), np.array(groups), np.array(side)
    root = S.links(words, groups, side, radius)
    for g in set(groups.tolist()):
        at = np.flatnonzero(groups == g)
        mixed = 0 < side[at].sum() < len(at)
        want = {int(i): int(i) for i in at}
        changed = True
        pairs = [(int(i), int(j)) for i, j in combinations(at, 2) if np.bitwise_count(words[i] ^ words[j]).sum() <= radius and (not mixed or side[i] != side[j])]
        while changed:
            changed = False
            for i, j in pairs:
                low = min(want[i], want[j])
                if (want[i], want[j]) != (low, low):
                    want[i] = want[j] = low
                    changed = True
        assert {int(i): int(root[i]) for i in at} == want


def test_exact_keys_cover_the_radius():
    keys = S.exact_keys(64, 3, 5)
    assert len(keys) == 10
    rng = np.random.default_rng(0)
    for _ in range(500):
        differ = set(rng.choice(64, 3, replace=False).tolist())
        assert any(not differ & set(k) for k in keys)


def near_copies(rng, n):
    out = []
    for d in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        out.append((d, " ".join(words)))
    return out


def test_components_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = near_copies(rng, 40)
    base = rows[3][1].split()
    for k in range(60):
        w = list(base)
        w[k] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300, rows[5][1]), (301, None), (302, ""), (303, "  "), (304, "Hi"), (305, "hi")]
    monkeypatch.setattr(S, "CHUNK", 8)
    df = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.w0, r.component_id) for r in S.near_duplicates(df, shingle=3, bits=64, radius=3, bands=5).collect()}
    prints = [(d, slow_fingerprint(t, 3)) for d, t in rows]
    want = slow_components(prints, 3)
    assert {d: x[0] & (1 << 64) - 1 for d, x in got.items()} == dict(prints)
    assert {d: x[1] for d, x in got.items()} == want
    assert got[301][1] == got[302][1] == got[303][1] == 301


def test_null_ids_ties_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", None, "", 1), (5, "a b c d", None, "", 1), (5, "a b c d", None, "", 1), (2, "z y x w", None, "", 1), (5, "z y x w", None, "", 1)], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df, shingle=3, bits=64, radius=3, bands=5).collect()), key=str)
    assert got == [(2, 2), (5, 2), (5, 2), (5, 2), (None, None)]
    assert S.near_duplicates(df.limit(0), shingle=3, bits=64, radius=3, bands=5).count() == 0
    assert S.near_duplicates(df.limit(0), radius=2, bands=4).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    rows = [(d, t) for d, t in near_copies(rng, 30)]
    for k in range(5):  # one word in 150: shingles about 0.93 alike
        w = rows[k][1].split()
        w[70] = "changed"
        rows.append((50 + k, " ".join(w)))
    rows += [(60, rows[9][1]), (9, rows[9][1])]
    df = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    kept = S.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def overlapping(rng, name, similarity, n=200):
    """Two texts of n shingles each, with distinct words, whose sets of shingles have this Jaccard similarity, about."""
    same = round(2 * n * similarity / (1 + similarity))
    words = [f"{name}{x}" for x in rng.permutation(n + 4)]
    return " ".join(words), " ".join(words[: same + 4] + [f"{name}y{k}" for k in range(n - same)])


def test_stage_goes_by_the_real_similarity(spark):
    """400 pairs: those of 0.8 or more lose one, the others none; the fingerprints' own distance tells neither."""
    rng = np.random.default_rng(12)
    rows, pairs = [], {}
    for k in range(400):
        s = (0.6, 0.7, 0.8, 0.85)[k % 4]
        a, b = overlapping(rng, f"p{k}", s)
        x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
        pairs[2 * k] = (s, len(x & y) / len(x | y))
        rows += [(2 * k, a), (2 * k + 1, b)]
    df = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    kept = {r.doc_id for r in S.keep_one_per_group(df, shingle=5, similarity=0.8).collect()}
    assert set(pairs) <= kept
    lost = [j for d, (_, j) in pairs.items() if d + 1 in kept and j >= 0.8]
    assert not [j for d, (_, j) in pairs.items() if d + 1 not in kept and j < 0.8]
    assert len(lost) <= 0.02 * sum(j >= 0.8 for _, j in pairs.values())


def test_stage_follows_links_and_not_stars(spark, monkeypatch):
    """0 - 1 - 2 are a chain; 3 and 4 alike, and both too far from 0, which their fingerprints may join; different texts
    under one id are rows of their own."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(S, "CHUNK", 2)
    base = [f"w{x}" for x in rng.permutation(300)]
    swap = lambda k, to: " ".join(base[: 300 - k] + [f"{to}{i}" for i in range(k)])
    other = swap(70, "z")
    texts = [" ".join(base), swap(25, "a"), " ".join([f"b{i}" for i in range(20)] + swap(25, "a").split()[20:]), other, other + " end"]
    rows = [*enumerate(texts), (9, "one two three four five six"), (9, "seven eight nine ten eleven twelve"), (9, "one two three four five six"), (None, texts[0])]
    df = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    assert near(0, 1) and near(1, 2) and not near(0, 2) and near(3, 4) and not any(near(i, j) for i in range(3) for j in (3, 4))
    got = sorted(((r.doc_id, r.text) for r in S.keep_one_per_group(df).collect()), key=str)
    assert got == sorted([(0, texts[0]), (3, other), (9, rows[5][1]), (9, rows[6][1]), (None, texts[0])], key=str)
    grouped = S.alike([np.unique(np.array([hash(x) & (1 << 63) - 1 for x in s], np.uint64)) for s in sets], np.zeros(5, bool), 0.8)
    assert grouped.tolist() == [0, 0, 0, 3, 3]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_groups_in_chunks_against_all_pairs(spark, monkeypatch, chunk):
    """Copies of one text, chains that leave it and texts apart: whatever the chunks, reachability by all pairs."""
    monkeypatch.setattr(S, "ALIKE_CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for grp in range(5):
        base = rng.integers(0, 1 << 62, 100)
        for k in range(4 if grp == 4 else 30):
            own = base.copy()
            if k % 3 == 1:
                own[: 9 * (k // 3)] = rng.integers(0, 1 << 62, 9 * (k // 3))  # a few, and too many, differ
            elif k % 3 == 2:
                own = np.roll(np.arange(100) + 1000 * grp + 9 * k, 0)  # each is alike to the next only
            node = int(rng.integers(-(1 << 60), 1 << 60))
            sets[node] = (grp, set(own.tolist()))
            rows.append((grp, node, bytearray(np.unique(own.astype(np.uint64)).tobytes())))
    got = {r.node: r.root for r in S._alike_in_groups(spark, spark.createDataFrame(rows, "grp long, node long, shingles binary"), 0.8).collect()}
    root = {n: n for n in sets}
    for _ in sets:
        for a, (g, x) in sets.items():
            for b, (h, y) in sets.items():
                if g == h and len(x & y) >= 0.8 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in sets} == root and len(set(root.values())) > 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_groups_of_the_table_against_all_pairs(spark):
    """Recall and precision on real rows: the groups are those of all pairs at 0.8 or more, no more and no fewer."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r.doc_id: r.grp for r in S.similar_groups(docs).collect()}
    sets = {r.doc_id: frozenset(S.shingle_set(r.text, 5).tolist()) for r in docs.select("doc_id", "text").collect()}
    holders, root = {}, {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for d, own in sorted(sets.items()):
        shared = Counter(o for h in own for o in holders.get(h, ())) if own else Counter({o: 0 for o in holders.get(None, ())})
        for o, n in shared.items():
            if n >= 0.8 * (len(own) + len(sets[o]) - n):
                a, b = sorted((find(o), find(d)))
                root[b] = a
        for h in own or [None]:
            holders.setdefault(h, []).append(d)
    want = {}
    for d in sets:
        want.setdefault(find(d), set()).add(d)
    got = {}
    for d, g in group.items():
        got.setdefault(g, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(sets)
