import hashlib
import math

import duckdb
import numpy as np
import pytest

from quernstone.llm import kdclusters as K

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"
SF = "/root/testdata/sf0.001"


def brute(rows, width=64, k=40, rounds=5):
    keep = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in keep if i is not None)[:k]
    z = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(z))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in keep]
        new = []
        for j, c in enumerate(z):
            of = [x for (_, x), o in zip(keep, own) if o == j]
            new.append([sum(col) // len(of) for col in zip(*of)] if of else c)
        z = new
    last = [(i, *nearest(x)) for i, x in keep]
    by = {}
    for _, d, j in last:
        by[j] = by.get(j, 0) + d
    return sorted((str(i), j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, z[j])).encode()).hexdigest()) for i, d, j in last)


def rows_of(df):
    return sorted((str(r.id), r.cluster, r.distance, int(r.cluster_inertia), int(r.inertia), r.centroid_sha256) for r in df.collect())


def spread(rng, n, width, centres=9):
    at = rng.normal(size=(centres, width))
    return [(k, (at[k % centres] + rng.normal(size=width) * 0.05).astype("f4").tolist()) for k in range(n)]


@pytest.mark.parametrize(("tree", "leaf", "parts"), [(8192, 32, 1), (64, 4, 5), (50, 7, 3)])
def test_against_all_distances(spark, monkeypatch, tree, leaf, parts):
    monkeypatch.setattr(K, "TREE_ROWS", tree)
    monkeypatch.setattr(K, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(1)
    rows = spread(rng, 500, 6)
    rows += [(700 + k, rows[3][1]) for k in range(150)] + [(9, rows[5][1]), (None, rows[8][1])]
    rows += [(900, None), (901, [None] * 6), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [1.0] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(parts)
    assert rows_of(K.clustered(df, width=6)) == brute(rows, 6)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(200)]  # centroids that are equal
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = rows_of(K.clustered(df, width=2))
    assert got == brute(rows, 2) and len({r[1] for r in got}) == 2


@pytest.mark.parametrize("n", [1, 39, 40, 41])
def test_few_rows(spark, n):
    rows = spread(np.random.default_rng(n), n, 64)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert rows_of(K.clustered(df)) == brute(rows)


def test_extreme_entries_are_bounded(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=64) * 10.0 ** rng.integers(0, 30)).tolist()) for k in range(100)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    bounded = [(i, [min(max(math.floor(256 * float(np.float32(c))), -K.BOUND), K.BOUND) / 256 for c in v]) for i, v in rows]
    want = brute([(i, [float(c) for c in v]) for i, v in bounded])
    assert [r[:2] for r in rows_of(K.clustered(df))] == [r[:2] for r in want]


def test_pruning_leaves_every_nearest_centroid():
    rng = np.random.default_rng(7)
    for _ in range(30):
        x = rng.integers(-50, 50, (rng.integers(1, 400), 3))
        z = rng.integers(-50, 50, (12, 3))
        order, cuts = K.kd_order(x)
        assert sorted(order.tolist()) == list(range(len(x)))
        x, first = x[order], cuts[:-1]
        tree = K.Tree(np.diff(cuts), np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.add.reduceat(x, first), [x[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])])
        n, lo, hi, s = tree.levels[-1]
        assert (n.sum(), s.sum(axis=0).tolist(), lo[0].tolist(), hi[0].tolist()) == (len(x), x.sum(axis=0).tolist(), x.min(axis=0).tolist(), x.max(axis=0).tolist())
        done, left, some = tree.filtered(z)
        may = dict(zip(left.tolist(), some))
        for level, nodes, own in done:
            for node, c in zip(nodes, own):
                for leaf in range(node << level, min((node + 1) << level, len(cuts) - 1)):
                    may[leaf] = np.arange(len(z)) == c
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            d = ((x[a:b, None] - z[None]) ** 2).sum(axis=2)
            assert set(np.flatnonzero((d == d.min(axis=1, keepdims=True)).any(axis=0))) <= set(np.flatnonzero(may[k]))


def test_whole_nodes_are_assigned_without_points():
    x = np.concatenate([np.random.default_rng(c).integers(-9, 9, (256, 4)) + c * 1000 for c in range(4)])
    order, cuts = K.kd_order(x)
    x, first = x[order], cuts[:-1]
    tree = K.Tree(np.diff(cuts), np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.add.reduceat(x, first), [])
    done, left, _ = tree.filtered(np.array([[c * 1000] * 4 for c in range(4)]))
    assert not len(left) and max(level for level, _, _ in done) >= 2


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = K.op12_clusters(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = sorted(tuple(r) for r in K.op12_clusters(spark, SF).collect())
    assert got == sorted(con.execute(K.OP12_SQL).fetchall()) and len(got) == 500
