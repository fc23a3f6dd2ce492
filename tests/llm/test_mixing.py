import hashlib
import math
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from quernstone.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, slot string, place int"


def pfair(rows, shares):
    total = sum(shares)
    assert [r.slot for r in rows] == list(range(len(rows)))
    seen = Counter()
    for r in rows:
        assert r.place == seen[r.i]
        a = shares[r.i]
        assert r.place * total // a <= r.slot < math.ceil((r.place + 1) * total / a)
        seen[r.i] += 1
        assert all(abs(seen[i] - a * (r.slot + 1) / total) < 1 for i, a in enumerate(shares))
    return seen


@pytest.mark.parametrize("size", [(1 << 20, 256), (13, 4)])
def test_schedule_is_pfair(spark, monkeypatch, size):
    monkeypatch.setattr(M, "ROUND", size[0])
    monkeypatch.setattr(M, "RUN", size[1])
    for shares in ([17, 5, 1, 9, 2], [1], [3, 3]):
        rows = M.schedule(spark, shares, sum(shares)).orderBy("slot").collect()
        assert pfair(rows, shares) == dict(enumerate(shares))
        assert M.schedule(spark, shares, 1).count() == 1


def data():
    n = {"a": 700, "b": 90, "c": 33, None: 50}
    return [(k * 7 + i, s, f"t{i}", "x", 1) for k, s in enumerate(n) for i in range(n[s])]


@pytest.mark.parametrize("bucket", [10, 2048])
def test_all_rows_and_less_than_a_block_off(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    rows = data()
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, source string, text string")
    got = M.mix(df, weights={"a": 5, "b": 2}, block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(r[:2] for r in rows)
    weights, total = {"a": 5, "b": 2, "c": 1, None: 1}, 9
    slots = {}
    places = defaultdict(list)
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
        assert r.block == r.place // 8 and r.release <= r.slot < r.deadline
        places[r.source].append((r.place, hashlib.md5(str(r.doc_id).encode()).hexdigest()))
    for p in places.values():
        assert [x[0] for x in sorted(p)] == list(range(len(p)))
        assert [x[1] for x in sorted(p)] == sorted(x[1] for x in p)
    gap = next(t for t in range(10**6) if t not in slots)
    assert {r.within for r in got if r.slot < gap} == {True} and not any(r.within for r in got if r.slot > gap)
    seen = Counter()
    for t in range(gap):
        seen[slots[t][0]] += 1
        assert all(abs(seen[s] - w * (t + 1) / total) < 1 for s, w in weights.items())


def test_rows_of_one_id_are_dealt_out_by_the_other_columns(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)
    df = spark.range(1000).selectExpr("cast(null as long) AS doc_id", "'a' AS source", "id AS n")
    plan = M.mix(df, order=["doc_id", "n"], weights={"a": 2})
    got = plan.collect()
    assert sorted(r.place for r in got) == list(range(1000))
    parts = F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(""), F.col("n").cast("string"))), 1, 8), 16, 10).cast("long") * 63 / F.lit(1 << 32))
    assert df.groupBy(parts).count().agg(F.max("count")).first()[0] < 60


def test_rows_as_they_are(spark):
    rows = data() + [(None, "a", None, None, None), (None, "a", None, None, None), (1, "b", "", "y", 2), (1, "b", "", "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.mixed(df, weights={"a": 3})
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == Counter(rows)
    assert M.mixed(df.limit(0)).count() == 0


def test_many_sources_and_odd_weights(spark):
    """No bound on the number of sources or the sum of weights: sources of equal weight take their group's blocks in turn."""
    weights = {"s0": 1_000_003, "s1": 70_001, "s2": 40}
    df = spark.range(9_000).selectExpr("id AS doc_id", "concat('s', cast(pmod(id * id, 4001) as string)) AS source")
    got = M.mix(df, weights=weights, default=9, block_rows=2).select("doc_id", "source", "weight", "slot", "release", "deadline", "block", "within").collect()
    assert len(got) == 9_000
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got})
    assert all(r.release <= r.slot < r.deadline for r in got)
    many = len({r.source for r in got if r.source not in weights})
    assert many > 1_900 and {r.weight for r in got} == {9, *weights.values()}
    assert {r.deadline - r.release for r in got if r.weight == 9} <= {(sum(weights.values()) + 9 * many) // 9 + k for k in (0, 1, 2)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b", "x", k, "y") for k in range(60)], "doc_id long, source string, slot string, place int, `a.b` string")
    out = M.mix(df)
    assert out.columns == ["doc_id", "source", "a.b", *M.ADDED] and out.count() == 60
    assert M.mixed(df).columns == df.columns and {r.slot for r in M.mixed(df).collect()} == {"x"}
    named = M.placed(df, names={"slot": "mix_slot", "place": "mix_place"})
    assert named.columns == [*df.columns, "mix_slot", "mix_place"]
    assert sorted(r.mix_slot for r in named.collect()) == sorted(r.slot for r in out.collect())


def test_weights_are_positive(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError, match="positive"):
        M.mix(df, weights={"a": 0})
