import math

import numpy as np
import pytest

from quernstone.llm import vectors as V
from quernstone.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string"


def brute(rows, k=16):
    """The contract by whole-number sums and an eigendecomposition of the covariance."""
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in keep]
    fit = sorted(set(xs))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(v * n - t) / n for v, t in zip(x, s)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for (i, _), x in zip(keep, xs):
        c = np.array([(v * n - t) / n for v, t in zip(x, s)])
        out += [(i, j + 1, n, sum((v * n - t) ** 2 for v, t in zip(x, s)), c @ u[:, j] / math.sqrt(e[j]) if e[j] > 1e-9 else None, e[j] / e.sum()) for j in range(min(k, len(e)))]
    return out


def check(got, want):
    got = sorted(got, key=lambda r: (r.id is None, r.id or 0, r.component, int(r.deviation)))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
    assert [(r.id, r.component, r.n, int(r.deviation)) for r in got] == [w[:4] for w in want]
    for j in {r.component for r in got}:
        a = [r.whitened for r in got if r.component == j]
        b = [w[4] for w in want if w[1] == j]
        if b[0] is None:
            assert a == [None] * len(a)
            continue
        sign = np.sign(np.dot(a, b))
        assert np.allclose(a, np.array(b) * sign, rtol=1e-8, atol=1e-8)
    assert np.allclose([r.explained for r in got], [w[5] for w in want], rtol=1e-8, atol=1e-14)
    assert all(r.identity_error < 1e-9 for r in got)


def table(rng, n, d):
    scale = np.geomspace(1, 0.05, d)
    return [(k, (rng.normal(size=d) * scale).astype("f4").tolist()) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_against_eigenvectors(spark, parts):
    rng = np.random.default_rng(3)
    rows = table(rng, 400, 20)
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + [(5, rows[7][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [math.nan] + rows[0][1][1:]), (2003, [math.inf] + rows[0][1][1:]), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(parts)
    got = W.whitened(df).collect()
    check(got, brute([r for r in rows if r[1] is None or len(r[1]) == 20]))


def test_far_from_zero_loses_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=5) / 8 + 1e5).astype("f4").tolist()) for k in range(300)]
    check(W.whitened(spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)).collect(), brute(rows))


def test_constant_dimensions_and_few_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [1.5, float(k % 3), float(rng.normal()), 2.0]) for k in range(50)]
    got = W.whitened(spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)).collect()
    check(got, brute(rows))
    same = W.whitened(spark.createDataFrame([(k, [0.5, 0.25], 1, "a", "b") for k in range(3)], SCHEMA)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, 0.0)] * 6


def test_extreme_entries_count_as_the_bound(spark):
    rows = [(k, [1e30 * (-1) ** k, float(k)], 1, "a", "b") for k in range(6)]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    n, xs = 6, [((1 << 40) * (-1) ** k + W.SHIFT, 64 * k + W.SHIFT) for k in range(6)]
    s = [sum(c) for c in zip(*xs)]
    assert {r.id: int(r.deviation) for r in got} == {k: sum((n * v - t) ** 2 for v, t in zip(x, s)) for k, x in enumerate(xs)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = W.op11_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = table(rng, 100, 24)
    spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    check(W.op11_whitening(spark, str(tmp_path)).withColumnRenamed("vec_id", "id").collect(), brute(rows))


def test_merging_keeps_the_order_of_many_parts(spark):
    parts = spark.createDataFrame([(k, bytearray(f"{k},".encode())) for k in range(0, 1000, 3)], "part long, state binary").repartition(5)
    assert V.merged(parts, b"".join) == "".join(f"{k}," for k in range(0, 1000, 3)).encode()
    assert V.merged(parts.limit(0), b"".join) is None
