"""SimHash near-duplicate groups by bit-sliced comparison.

Texts become fingerprints, equal fingerprints become one node, and nodes that agree on all bits
of at least one of several keys meet in a bucket. Buckets are compared bit-sliced: bit plane b
holds bit b of 64 fingerprints a machine word, the differing planes go through a carry-save adder
into vertical counters, and a word is abandoned once all its lanes exceed the radius. A bucket
reports a star for each group it finds, never its pairs, and stars are joined into components.

Defined results: null or blank texts have fingerprint 0 and link like any other; a null id gets a
null component and links nothing; rows that share an id link what any of their texts link;
repeated rows are all returned; a very long text is hashed in pieces, whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.shared import free, kept, materialize, named, release, ship, sliced

SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of text split into words at a time.
PIECE = 1 << 22
#: Nodes of a bucket that meet in one task; larger buckets are split into chunks, and chunk pairs are dealt out.
CHUNK = 4096
#: The same where the sets of shingles themselves are compared.
ALIKE_CHUNK = 128
#: Rows that a task compares in one go.
GATHER = 65_536


# Fingerprints ---------------------------------------------------------------------------------


def _word_pieces(data: bytes, keep: int) -> Iterator[list[bytes]]:
    """Words of data by pieces; each piece begins with the last `keep` words of the one before."""
    at, tail = 0, []
    while at < len(data):
        end = len(data)
        if at + PIECE < end and (gap := SPACE.search(data, at + PIECE)):
            end = gap.start()
        words = tail + data[at:end].split()
        if len(words) > len(tail):
            yield words
        tail, at = words[len(words) - keep :] if keep else [], end
    return


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles, repeats included, by pieces."""
    data = (text or "").encode("utf-8", "replace").lower()
    seen = False
    first: list[bytes] = []
    for words in _word_pieces(data, size - 1):
        first = words
        if len(words) < size:
            continue
        seen = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - size + 1
        digest = xxhash.xxh64_intdigest
        yield np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)
    if not seen and first:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(first), 42)], np.uint64)


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """h, and for wider fingerprints further 64-bit hashes mixed from it: (n, lanes)."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for k in range(1, lanes):
        z = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: str | None, size: int, lanes: int = 1) -> np.ndarray:
    """64 * lanes bits: a bit is 1 if set in over half the shingle hashes."""
    ones, n = np.zeros(64 * lanes, np.int64), 0
    for h in shingle_hashes(text, size):
        for at in range(0, len(h), 65_536):
            part = _lanes(h[at : at + 65_536], lanes)
            ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(h)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, lanes: int) -> DataFrame:
    """One row a row of docs: doc_id, w0, w1 ..: the fingerprint's 64-bit words."""
    ship(docs.sparkSession)
    names = [f"w{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                w = np.stack([fingerprint(x, size, lanes) for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for k in range(lanes))], names=["doc_id", *names])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


# Buckets --------------------------------------------------------------------------------------


def exact_keys(bits: int, radius: int, bands: int) -> list[list[int]]:
    """Bit sets such that any two fingerprints within the radius agree on all bits of one: `bands`
    bands, of which at least bands - radius hold no difference, taken that many together."""
    from itertools import combinations

    edges = [round(bits * k / bands) for k in range(bands + 1)]
    return [[b for k in some for b in range(edges[k], edges[k + 1])] for some in combinations(range(bands), bands - radius)]


def similarity_keys(bits: int, similarity: float, nodes: int, recall: float) -> list[list[int]]:
    """Bit sets of which fingerprints at this Jaccard similarity share one with this probability.

    The width follows the number of nodes, so that a bucket of unlike texts holds about 1,024 of
    them at every size; the number of sets follows from the width."""
    width = max(12, math.ceil(math.log2(max(2, nodes))) - 10)
    agree = 1 - expected_distance(bits, similarity) / bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    order = [b * 37 % bits for b in range(bits)]  # 37 is odd, bits a power of two: a permutation
    turn = [[(b * (2 * r + 1) + r * 11) % bits for b in order] for r in range(tables * width // bits + 1)]
    flat = [b for one in turn for b in one]
    return [sorted(set(flat[t * width : (t + 1) * width])) for t in range(tables)]


def expected_distance(bits: int, similarity: float) -> float:
    """Hamming distance expected between fingerprints of sets of equal size at this Jaccard similarity."""
    return bits * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radius_for(bits: int, similarity: float, deviations: float = 1) -> int:
    """The expected distance and so many standard deviations of it."""
    d = expected_distance(bits, similarity)
    return math.floor(d + deviations * math.sqrt(d * (1 - d / bits)))


def _bucketed(nodes: DataFrame, lanes: int, keys: list[list[int]]) -> DataFrame:
    """nodes once for each key: bucket, node, words."""
    names = [f"w{k}" for k in range(lanes)]
    weights = [(np.array(k), np.uint64(1) << np.arange(len(k), dtype=np.uint64)) for k in keys]
    shift = np.uint64(max(len(k) for k in keys))
    assert int(shift) + math.ceil(math.log2(len(keys) + 1)) < 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(lanes)], axis=1)
            if not len(words):
                continue
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            for t, (cols, weight) in enumerate(weights):
                key = (bits[:, cols].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) | (np.uint64(t) << shift)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["bucket", "node", *names])

    return nodes.select("node", *names).mapInArrow(run, "bucket long, node long, " + ", ".join(f"{n} long" for n in names))


def _cells(nodes: DataFrame, lanes: int, keys: list[list[int]]) -> DataFrame:
    """Buckets of two or more, dealt out as cells. A bucket of more than CHUNK nodes becomes chunks by
    a hash of the node, and each pair of chunks a cell: no task holds more than about two chunks of a bucket."""
    rows = _bucketed(nodes, lanes, keys)
    # written before the join: right above the aggregation it would need each bucket in one task
    sizes = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "bucket-sizes")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    return (
        rows.join(sizes, "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side"), "node", *[f"w{k}" for k in range(lanes)])
    )


# Bit-sliced comparison ------------------------------------------------------------------------


def planes(words: np.ndarray) -> np.ndarray:
    """Bit planes of (n, lanes) fingerprints: (bits, ceil(n / 64)), lane i of word i // 64 is row i."""
    n = len(words)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    full = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    full[:, :n] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def within(differ, n_planes: int, dead: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose planes differ at most `radius` times, as words of bits.

    differ(b, words) gives plane b of the differences at those words; `dead` has the lanes that
    don't count. The counters start so that they overflow on exceeding the radius. Two planes
    a step go through a carry-save adder into the lowest counter, the carry ripples up."""
    size = len(dead)
    every = ~np.uint64(0)
    m = max(1, radius.bit_length())
    start = (1 << m) - radius - 1
    at = np.flatnonzero(dead != every)
    over = dead[at]
    count = [np.full(len(at), every if start >> j & 1 else 0, np.uint64) for j in range(m)]
    for b in range(0, n_planes, 2):
        x, y = differ(b, at), differ(b + 1, at)
        u = count[0] ^ x
        carry = (count[0] & x) | (u & y)
        count[0] = u ^ y
        for j in range(1, m):
            carry, count[j] = count[j] & carry, count[j] ^ carry
        over = over | carry
        if b % 16 == 14 and b + 2 < n_planes:
            alive = over != every
            left = np.count_nonzero(alive)
            if not left:
                at = at[:0]
                over = over[:0]
                break
            if left < 0.75 * len(at):  # blocks all of whose lanes exceed the radius are abandoned
                at, over, count = at[alive], over[alive], [c[alive] for c in count]
    out = np.zeros(size, np.uint64)
    out[at] = ~over
    return out


def _lanes_set(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i] in root, in place; roots are the smallest positions."""
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = lo != hi
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _neighbours(words: np.ndarray, group: np.ndarray, side: np.ndarray | None, radius: int, root: np.ndarray) -> None:
    """Links rows of the same group by shifting the planes against themselves, one lane further each time."""
    n, p = len(words), planes(words)
    for d in range(1, 65):
        same = np.zeros(p.shape[1] * 64, bool)
        same[: n - d] = group[: n - d] == group[d:]
        if not same.any():
            return
        if side is not None:
            same[: n - d] &= side[: n - d] != side[d:]
        dead = ~np.packbits(same, bitorder="little").view(np.uint64)
        right = np.zeros_like(p)
        if d < 64:
            right = p >> np.uint64(d)
            right[:, :-1] |= p[:, 1:] << np.uint64(64 - d)
        else:
            right[:, :-1] = p[:, 1:]
        diff = p ^ right
        hits = _lanes_set(within(lambda b, at: diff[b][at], len(p), dead, radius))
        _hook(root, hits, hits + d)


def _square(words: np.ndarray, side: np.ndarray | None, radius: int, root: np.ndarray, first: int) -> None:
    """Links rows of one large group: blocks of 64 rows against all planes."""
    n, p = len(words), planes(words)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    every = ~np.uint64(0)
    ask = np.flatnonzero(~side) if side is not None else np.arange(n)
    valid = np.zeros(p.shape[1] * 64, bool)
    valid[:n] = side if side is not None else True
    dead0 = ~np.packbits(valid, bitorder="little").view(np.uint64)
    for at in range(0, len(ask), 64):
        q = ask[at : at + 64]
        lo = q[0] // 64 if side is None else 0  # the words before hold pairs already seen
        mask = np.where(bits[q].T == 1, every, np.uint64(0))  # (bits, asked)
        wide = p.shape[1] - lo
        dead = np.tile(dead0[lo:], len(q))

        def differ(b: int, pos: np.ndarray, mask=mask, lo=lo, wide=wide) -> np.ndarray:
            k, w = np.divmod(pos, wide)
            return p[b, lo + w] ^ mask[b, k]

        hits = _lanes_set(within(differ, len(p), dead, radius))
        k, lane = np.divmod(hits, wide * 64)
        _hook(root, first + q[k], first + lo * 64 + lane)


def links(words: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Root position of each row: rows of a group (given in order) that are within the radius, directly
    or through others of the group, share one. In a group with both sides only rows of different sides are compared."""
    n = len(words)
    root = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    size = ends - starts
    small = np.repeat(size <= 64, size)
    split = np.add.reduceat(side.astype(np.int64), starts)
    mixed = np.repeat((split > 0) & (split < size), size)
    for pick, by in ((small & ~mixed, None), (small & mixed, side)):
        at = np.flatnonzero(pick)
        if len(at):
            own = np.arange(len(at))
            _neighbours(words[at], group[at], None if by is None else by[at], radius, own)
            root[at] = at[own]
    for a, b in zip(starts[size > 64].tolist(), ends[size > 64].tolist()):
        _square(words[a:b], side[a:b] if mixed[a] else None, radius, root, a)
    return root


def _links_of_cells(cells: DataFrame, lanes: int, radius: int) -> DataFrame:
    def joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(parts)
        col = [t.column(k).to_numpy() for k in range(t.num_columns)]
        words = np.stack([c.view(np.uint64) for c in col[5:]], axis=1)
        new = np.r_[True, (col[0][1:] != col[0][:-1]) | (col[1][1:] != col[1][:-1]) | (col[2][1:] != col[2][:-1])]
        return col[4], words, np.cumsum(new), col[3].astype(bool)

    def found(node: np.ndarray, words: np.ndarray, group: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        root = node[links(words, group, side, radius)]
        a, b = np.minimum(node, root), np.maximum(node, root)
        some = a != b
        pair = np.unique(np.stack([b[some], a[some]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= GATHER:
                node, words, group, side = joined(held)
                cut = int(np.searchsorted(group, group[-1]))  # the last cell may go on in the next batch
                if cut:
                    yield found(node[:cut], words[:cut], group[:cut], side[:cut])
                    held = [b.slice(0) for b in pa.Table.from_batches(held).slice(cut).to_batches()]
                    rows -= cut
        if rows:
            yield found(*joined(held))

    ordered = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "side", "node")
    return ordered.mapInArrow(run, "u long, v long")


# Components -----------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for nodes of edges (u, v): root is the smallest node reachable, left out where it is the node itself.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars. Each step
    is a map-side combined minimum and a join. The minimum is written before the join: right above the aggregation the
    join would need each node's edges in one task; apart from it, adaptive execution splits those of a hub."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "links-large")
        release(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "links-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialize(small, "links")
        for done in (now, large, low):
            release(done)
        now, before = after, was
        was = state(now)
        if was == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._written_to = now._written_to  # type: ignore[attr-defined]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 3, bands: int = 5) -> DataFrame:
    """doc_id, fingerprint words w0.., component_id (the smallest doc_id reachable) for each row of docs.

    The keys are chosen so that every pair within the radius meets."""
    spark, lanes = docs.sparkSession, bits // 64
    names = [f"w{k}" for k in range(lanes)]
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, lanes), "fingerprints")
    some = prints.filter("doc_id is not null")
    nodes = materialize(some.groupBy(*names).agg(F.min("doc_id").alias("node")), "nodes")
    found = _links_of_cells(_cells(nodes, lanes, exact_keys(bits, radius, bands)), lanes, radius)
    # Two fingerprints may share their smallest id if rows share an id; then ids link, too.
    repeated = materialize(some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    ids = some.join(repeated, "doc_id", "left_semi").join(nodes, names).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).filter("u <> v")
    stars = components(spark, found.unionByName(ids))
    roots = materialize(nodes.join(stars, "node", "left").select(*names, F.coalesce("root", "node").alias("component_id")), "roots")
    linked = prints.join(roots, names, "left")
    out = materialize(linked.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "near-duplicates")
    for done in (prints, nodes, repeated, stars, roots):
        release(done)
    return out


def hex_words(names: list[str]) -> Column:
    """The fingerprint as lowercase hex, highest word first."""
    return F.lower(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in reversed(names)]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.shared import documents

    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", hex_words(["w0"]).alias("fingerprint"), "component_id")


# Groups by the real similarity ----------------------------------------------------------------


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, in order; none for a blank text."""
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_print(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """fingerprint() of distinct shingles: 64 * lanes bits."""
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(_lanes(hashes[at : at + 65_536], lanes).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1 and h2 of the text, and the text, of rows with an id."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), *_text_hashes(text_col), named(text_col).cast("string").alias("text")).filter("doc_id is not null")


def _set_prints(rows: DataFrame, size: int, lanes: int) -> DataFrame:
    """doc_id, h1, h2, node (a hash of the text's set of shingles) and the set's fingerprint."""
    ship(rows.sparkSession)
    names = [f"w{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x, size) for x in batch.column(3).to_pylist()]
            w = np.stack([set_print(x, lanes) for x in sets])
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            cols = [pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for k in range(lanes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node), *cols], names=["doc_id", "h1", "h2", "node", *names])

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, node long, " + ", ".join(f"{n} long" for n in names))


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """grp, node and the text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x, size).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["grp", "node", "shingles"])

    return rows.select("grp", "node", "text").mapInArrow(run, "grp long, node long, shingles binary")


def _text_hashes(text_col: str) -> list[Column]:
    text = named(text_col).cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Root position of each set: sets whose Jaccard similarity is `similarity` or more, directly or through others,
    share one. With both sides, sets of side 0 are compared with all."""
    n = len(sets)
    root = np.arange(n)
    size = np.array([len(x) for x in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    order = np.argsort(term, kind="stable")
    holders = np.repeat(np.arange(n), size)[order]  # of each term, one after another
    first = np.r_[0, np.cumsum(np.bincount(term))]
    ask = np.flatnonzero(~side) if side.any() and not side.all() else np.arange(n)
    for i in ask.tolist():
        if size[i]:
            own = term[at[i] : at[i + 1]]
            shared = np.bincount(np.concatenate([holders[first[t] : first[t + 1]] for t in own.tolist()]), minlength=n)
            hits = np.flatnonzero(shared >= similarity * (size[i] + size - shared) - 1e-9)
        else:
            hits = np.flatnonzero(size == 0)
        _hook(root, np.full(len(hits), i), hits)
        if not root.any():  # all are one group
            break
    return root


def _links_in_cells(dealt: DataFrame, similarity: float) -> DataFrame:
    """dealt: grp, lo, hi (a cell of a group), side, node, shingles. Links u, v of nodes of a cell: stars, never all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            node = np.array(nodes, np.int64)
            root = node[alike(sets, np.array(sides, bool), similarity)]
            some = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some])], names=["u", "v"])

        for batch in sliced(batches):
            for grp, lo, hi, side, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, lo, hi) != now:
                    if len(nodes) > 1:
                        yield found()
                    now, nodes, sides, sets = (grp, lo, hi), [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.frombuffer(shingles, np.uint64))
        if len(nodes) > 1:
            yield found()

    return dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "side", "node").mapInArrow(run, "u long, v long")


def _alike_in_groups(spark: SparkSession, groups: DataFrame, similarity: float) -> DataFrame:
    """groups: grp, node, shingles. (node, root) of nodes that are alike to others of their group, directly or through others,
    by exact comparison.

    A group is cut into chunks, and each is compared within itself and with the group's smallest node; what is near copies of
    one text is then joined. Only nodes that didn't join the smallest one are compared with all chunks."""
    sizes = materialize(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / ALIKE_CHUNK).cast("int")), "group-sizes")
    rows = groups.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    at = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))
    cell = ["grp", "lo", "hi", "side", "node", "shingles"]
    first = components(spark, _links_in_cells(rows.withColumns({"lo": F.explode(at), "hi": F.lit(0), "side": F.lit(False)}).select(*cell), similarity))
    joined = groups.select("grp", "node").join(sizes.filter("chunks > 1"), "grp").join(first, "node", "left")
    rest = materialize(joined.filter(F.coalesce("root", "node") != F.col("leader")).select("grp", "node"), "group-rest")
    asked = materialize(rest.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ALIKE_CHUNK).cast("int").alias("asks")), "group-asks")
    if asked.isEmpty():
        return first
    again = rows.join(asked, "grp")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = again.join(rest, ["grp", "node"], "left_semi").withColumns({"lo": F.pmod(F.xxhash64("node"), F.col("asks")).cast("int"), "side": F.lit(False)}).withColumn("hi", every("chunks"))
    answer = again.withColumns({"hi": F.col("own"), "side": F.lit(True)}).withColumn("lo", every("asks"))
    more = _links_in_cells(ask.select(*cell).unionByName(answer.select(*cell)), similarity)
    return components(spark, first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 256, deviations: float = 3, recall: float = 0.995) -> DataFrame:
    """doc_id, h1, h2 (of the text) and grp of each row with an id. Rows share a group if their sets of shingles have a Jaccard
    similarity of `similarity` or more, directly or through others.

    Fingerprints only find who may be alike: within the distance expected at the similarity and `deviations` of it,
    by keys shared with probability `recall`. Whatever they join is compared by the sets themselves, inside
    the joined group and not along its stars, whose ends needn't be alike."""
    spark, lanes = docs.sparkSession, bits // 64
    names = [f"w{k}" for k in range(lanes)]
    rows, row = _told(docs, id_col, text_col), ["doc_id", "h1", "h2"]
    prints = materialize(_set_prints(rows, shingle, lanes), "set-prints")
    nodes = materialize(prints.groupBy("node", *names).agg(F.min(F.struct(*row)).alias("row")), "nodes")
    keys = similarity_keys(bits, similarity, nodes.count(), recall)
    stars = components(spark, _links_of_cells(_cells(nodes, lanes, keys), lanes, radius_for(bits, similarity, deviations)))
    near = stars.select("node", F.col("root").alias("grp")).unionByName(stars.select(F.col("root").alias("node"), F.col("root").alias("grp")).distinct())
    # one row of each node that may be alike to another; only these rows' shingles are compared, and written
    asked = materialize(nodes.select("node", "row.*").join(near, "node"), "near-nodes")
    sets = materialize(_sets(rows.join(asked, row), shingle).dropDuplicates(["grp", "node"]), "shingle-sets")
    found = _alike_in_groups(spark, sets, similarity)
    out = materialize(prints.select(*row, "node").join(found, "node", "left").select(*row, F.coalesce("root", "node").alias("grp")), "near-groups")
    for done in (prints, nodes, stars, asked, sets, found):
        release(done)
    return out


def keep_one_per_group(docs: DataFrame, **how) -> DataFrame:
    """docs without the near copies: of each group one row stays, of the smallest doc_id, and among texts
    of that id of the smallest hash. Texts that differ under one id are rows of their own. Rows without a doc_id stay."""
    groups = similar_groups(docs, **how)
    row = F.struct("doc_id", "h1", "h2")
    best = groups.groupBy("grp").agg(F.min(row).alias("best"))
    stays = materialize(best.select("best.*"), "near-kept")
    mark = [free(docs, n) for n in ("_id", "_h1", "_h2")]
    marks = [F.col("doc_id").cast("long"), *_text_hashes("text")]
    marked = docs.select("*", *(c.alias(n) for c, n in zip(marks, mark)))
    stays = stays.toDF(*mark)
    found = marked.join(stays, mark, "left_semi")
    twice = groups.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "h1", "h2").toDF(*mark).join(stays, mark, "left_semi")
    blank = docs.filter(F.col("doc_id").cast("long").isNull())
    if twice.isEmpty():
        return found.select(*kept(docs)).unionByName(blank)
    once = found.join(twice, mark, "left_semi").dropDuplicates(mark)
    return found.join(twice, mark, "left_anti").unionByName(once).select(*kept(docs)).unionByName(blank)
