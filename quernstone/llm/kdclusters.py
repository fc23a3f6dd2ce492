"""Centroid clustering by kd-tree filtering, in whole numbers.

A vector's entries become floor(SCALE * c). Each task orders some thousand of its vectors as a kd-tree, halving the widest dimension
of a box until a leaf is left, and writes a row a leaf: ids, points, their number, sums and box. These rows stay for all rounds.

In a round a task rebuilds the upper nodes from its leaves (their numbers and sums add up, their boxes join) and filters the centroids down the tree: of the
centroids that reach a node, those go that lie strictly farther from every place of its box than the one nearest to the box's middle. A
node with one centroid left is assigned whole, by its number and sums, and its points aren't read; a leaf with several is
resolved point by point. All of it is exact, ties included: equally far centroids never go, and of these the smaller number wins.

Tasks send a number and sums a centroid, so only as much as there are centroids and dimensions comes to the driver, or goes to the tasks.

Defined results: rows whose vector is null, has a null or non-finite entry, or another number of entries than WIDTH, are dropped; an entry
beyond a bound (BOUND up to 64 entries, less for longer vectors) counts as the bound, so that every squared distance fits a long; rows without an id are assigned but begin no centroid; of equal hashes (repeated
ids) the smaller vector comes first; with fewer rows than centroids each begins one; repeated rows are all returned; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import materialize, named, ship
from quernstone.llm.vectors import rows_of, usable, whole

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: The largest entry of vectors of up to 64 entries, as a whole number.
BOUND = 1 << 27
#: Vectors of a tree, and of a leaf at most.
TREE_ROWS, LEAF_ROWS = 8192, 32


def bound_of(width: int) -> int:
    """So that width * (2 * bound)^2 is 2^62 at most."""
    return BOUND >> max(0, -(-(width - 1).bit_length() // 2) - 3)


# One tree ---------------------------------------------------------------------------------------


def kd_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which the leaves follow each other, and where they begin and end. Their number is a power of two."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(x) / LEAF_ROWS)))))
    order = np.arange(len(x))
    cuts = [0, len(x)]
    for _ in range(depth):
        finer = [0]
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            box = x[own]
            dim = int(np.argmax(box.max(axis=0) - box.min(axis=0)))
            order[a:b] = own[np.argpartition(box[:, dim], (b - a) // 2)]
            finer += [a + (b - a) // 2, b]
        cuts = finer
    return order, np.array(cuts)


class Tree:
    """Leaves in kd order; levels[0] has the leaves' numbers, boxes and sums, each further level those of pairs."""

    def __init__(self, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray, points: list[bytes]):
        self.points, width = points, lo.shape[1]
        self.levels = [(counts, lo, hi, sums)]
        while len(counts) > 1:
            if len(counts) % 2:  # one without a sibling
                counts, sums = np.append(counts, 0), np.vstack((sums, np.zeros((1, width), np.int64)))
                lo, hi = np.vstack((lo, lo[-1:])), np.vstack((hi, hi[-1:]))
            counts, sums = counts[::2] + counts[1::2], sums[::2] + sums[1::2]
            lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            self.levels.append((counts, lo, hi, sums))

    def leaf(self, k: int) -> np.ndarray:
        return np.frombuffer(self.points[k], "<i4").reshape(-1, self.levels[0][1].shape[1]).astype(np.int64)

    def filtered(self, z: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Nodes assigned whole: (level, nodes, centroids) each; and the leaves left with the centroids that may be nearest there."""
        done = []
        nodes = np.arange(1)
        some = np.ones((1, len(z)), bool)
        for level in range(len(self.levels) - 1, -1, -1):
            _, lo, hi, _ = self.levels[level]
            some = undominated(some, lo[nodes], hi[nodes], z)
            one = some.sum(axis=1) == 1
            if one.any():
                done.append((level, nodes[one], some[one].argmax(axis=1)))
            nodes, some = nodes[~one], some[~one]
            if level:
                nodes, some = np.concatenate((nodes * 2, nodes * 2 + 1)), np.vstack((some, some))
                real = nodes < len(self.levels[level - 1][0])
                nodes, some = nodes[real], some[real]
        return done, nodes, some


def squared(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and z, exact: in doubles where these hold them, else in longs."""
    if max(np.abs(x).max(initial=0), np.abs(z).max(initial=0)) < 1 << 20 and x.shape[1] < 1 << 10:
        xf, zf = x.astype(np.float64), z.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ zf.T) + (zf * zf).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in z], axis=1)


def undominated(some: np.ndarray, lo: np.ndarray, hi: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Which of the centroids at each box stay. p being a place in the box, |z - p|^2 - |b - p|^2 = |z|^2 - |b|^2 - 2 p (z - b)
    is least at the corner that lies on the side of z; where it is positive there, b is nearer everywhere."""
    if not len(some):
        return some
    far = np.where(some, squared(lo + hi, 2 * z), np.iinfo(np.int64).max)
    best = z[far.argmin(axis=1)]
    norm = (z * z).sum(axis=1)
    out = np.empty_like(some)
    step = max(1, (1 << 22) // z.size)  # boxes at a time
    for at in range(0, len(some), step):
        s = slice(at, at + step)
        u = z[None] - best[s][:, None]
        corner = np.where(u > 0, hi[s][:, None], lo[s][:, None])
        out[s] = some[s] & (norm[None] - (best[s] ** 2).sum(axis=1)[:, None] - 2 * (corner * u).sum(axis=2) <= 0)
    return out


def trees_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, Tree]]:
    """The trees of a batch of leaves, or what it has of them."""

    def matrix(name: str, kind: str, rows: slice) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name)[rows].to_pylist()), kind).reshape(-1, width).astype(np.int64)

    at = 0
    for _, same in groupby(batch.column("tree").to_pylist()):
        rows = slice(at, at + sum(1 for _ in same))
        at = rows.stop
        counts = batch.column("n")[rows].to_numpy().astype(np.int64)
        yield rows, Tree(counts, matrix("lo", "<i4", rows), matrix("hi", "<i4", rows), matrix("sums", "<i8", rows), batch.column("points")[rows].to_pylist())


# On Spark ---------------------------------------------------------------------------------------

LEAVES = "tree long, ids array<long>, points binary, n int, lo binary, hi binary, sums binary"


def leaves(rows: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """A row a leaf of the tasks' trees. No shuffle."""
    ship(rows.sparkSession)

    def built(tree: int, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order, cuts = kd_order(x)
        x, ids = x[order], ids.take(pa.array(order))
        first = cuts[:-1]
        packed = [
            pa.array([tree] * len(first), pa.int64()),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), ids),
            pa.array([x[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            pa.array(np.diff(cuts).astype(np.int32)),
            *(pa.array([r.astype(kind).tobytes() for r in f.reduceat(x, first)], pa.binary()) for f, kind in ((np.minimum, "<i4"), (np.maximum, "<i4"), (np.add, "<i8"))),
        ]
        return pa.RecordBatch.from_arrays(packed, names=[f.split()[0] for f in LEAVES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, xs, held = [], [], 0
        for batch in rows_of(batches, LEAF_ROWS * 64):
            keep, c = usable(batch.column(1), width)
            ids.append(batch.column(0).take(pa.array(keep)))
            xs.append(whole(c, scale, bound_of(width)))
            held += len(keep)
            if held >= TREE_ROWS:
                yield built(number, pa.concat_arrays(ids), np.concatenate(xs))
                number, ids, xs, held = number + 1, [], [], 0
        if held:
            yield built(number, pa.concat_arrays(ids), np.concatenate(xs))

    return rows.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("v")).mapInArrow(run, LEAVES)


def first_centroids(rows: DataFrame, id_col: str, vec_col: str, width: int, scale: int, k: int, salt: str) -> np.ndarray:
    """The vectors of the k ids with the smallest SHA-256 of salt and id: k rows come to the driver."""
    v = named(vec_col).cast("array<double>")
    sound = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    best = rows.filter(sound & named(id_col).isNotNull()).select(v.alias("v"), F.sha2(F.concat(F.lit(salt), named(id_col).cast("string")), 256).alias("h")).orderBy("h", "v").limit(k)
    got = [r.v for r in best.collect()]
    return whole(np.array(got, np.float64).reshape(-1, width), scale, bound_of(width))


def moved(trees: DataFrame, z: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floors of their vectors' means, and themselves where they have none."""
    k, width = z.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, tree in trees_of(batch, width):
                done, left, some = tree.filtered(z)
                for level, nodes, own in done:
                    n, _, _, s = tree.levels[level]
                    np.add.at(counts, own, n[nodes])
                    np.add.at(sums, own, s[nodes])
                for leaf, may in zip(left, some):
                    x, numbers = tree.leaf(leaf), np.flatnonzero(may)
                    own = numbers[squared(x, z[numbers]).argmin(axis=1)]
                    order = np.argsort(own, kind="stable")
                    found, first = np.unique(own[order], return_index=True)
                    counts += np.bincount(own, minlength=k)
                    sums[found] += np.add.reduceat(x[order], first)
        some = np.flatnonzero(counts)
        table = np.column_stack((counts, sums))[some]  # place 0 has the number of vectors
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(width + 1, dtype=np.int32), len(some))), pa.array(table.ravel())], names=["cluster", "place", "s"])

    totals = trees.drop("ids").mapInArrow(run, "cluster int, place int, s long").groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {(c, p): int(s) for c, p, s in totals.collect()}
    return np.array([[got[c, p] // got[c, 0] for p in range(1, width + 1)] if (c, 0) in got else z[c].tolist() for c in range(k)], np.int64).reshape(k, width)


def assigned(trees: DataFrame, z: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector."""
    width = z.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, tree in trees_of(batch, width):
                done, left, some = tree.filtered(z)
                own = np.full(len(tree.points), -1)
                for level, nodes, cluster in done:
                    for node, c in zip(nodes, cluster):
                        own[node << level : (node + 1) << level] = c
                may = dict(zip(left.tolist(), some))
                cluster, distance = [], []
                for k in range(len(tree.points)):
                    x = tree.leaf(k)
                    numbers = np.flatnonzero(may[k]) if own[k] < 0 else own[k : k + 1]
                    far = squared(x, z[numbers])
                    at = far.argmin(axis=1)
                    cluster.append(numbers[at].astype(np.int32))
                    distance.append(far[np.arange(len(x)), at])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[rows].flatten(), pa.array(np.concatenate(cluster)), pa.array(np.concatenate(distance))], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")


def clustered(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:") -> DataFrame:
    """id, cluster, distance, cluster_inertia and inertia (decimals), centroid (its components joined by commas), centroid_sha256."""
    spark = rows.sparkSession
    schema = "id long, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid string, centroid_sha256 string"
    trees = materialize(leaves(rows, id_col, vec_col, width, scale), "kd-leaves")
    z = first_centroids(rows, id_col, vec_col, width, scale, k, salt)
    if not len(z):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        z = moved(trees, z)
    own = materialize(assigned(trees, z), "kd-assigned")
    by = own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    inertia = {c: s for c, s in by.collect()}  # a row a centroid
    names = [",".join(map(str, c)) for c in z.tolist()]
    table = [(c, s, sum(inertia.values()), names[c], hashlib.sha256(names[c].encode()).hexdigest()) for c, s in inertia.items()]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid string, centroid_sha256 string")
    return own.join(known, "cluster").select(*[f.split()[0] for f in schema.replace("(38,0)", "").split(", ")])


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""
a{r} AS (SELECT rid, min({{'d': list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS m FROM v, c{r} GROUP BY rid),
s{r} AS (SELECT m.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, {WIDTH + 1}) t(i) GROUP BY ALL),
c{r + 1} AS (
  SELECT c, list(floor(CAST(s AS DOUBLE) / n)::BIGINT ORDER BY i) AS z FROM s{r} GROUP BY c
  UNION ALL SELECT c, z FROM c{r} WHERE c NOT IN (SELECT c FROM s{r})),"""


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS z FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}),
{"".join(map(_round_sql, range(ROUNDS)))}
last AS (SELECT rid, min({{'d': list_sum(list_transform(list_zip(x, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS m FROM v, c{ROUNDS} GROUP BY rid)
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(z, ',')) AS centroid_sha256
FROM last JOIN v USING (rid) JOIN c{ROUNDS} ON c = m.c
"""
