"""Document fingerprints from closed syncmers.

A k-mer of a text's code points is a closed syncmer if the smallest of its inner s-mers lies at one of its
edges. Whether it is one depends on its own k code points only, so an edit moves the anchors
near it and no others: shared passages keep their anchors wherever they stand.

`passages` matches by position: an anchor that other texts have before is tied to its first occurrence of all, and ties
of two texts with the same shift between their positions make a passage. `compared` does the same for a text against its edited form and against the
next document, and counts the code points that such passages cover. Each anchor has one tie, however many texts share it:
no pairs are made within a group. Both places of a copied passage may be tied to a third.

A fingerprint keeps the smallest anchor hash of each of BINS ranges of hash values, 16 bits of it, as hex.
The likeness of two fingerprints is the share of equal bins among those that either has: an estimate
of the Jaccard similarity of their anchor sets.

Defined results: a null text counts as empty; a text without a syncmer (shorter than K) has one anchor, its
whole self; the empty text has none, its fingerprint is all `----`, and its likeness is 1 to another such and 0 to
any other; equal texts have equal fingerprints; a very long text is hashed in pieces, whole; rows of the same id follow each other by a hash of their text, descending,
and then by the text; null ids come last; an id that many rows share, and null ids, are several parts' work; in `passages` a document
is its id and its text, repeated rows are one; a table of one row is its own next; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import documents, materialize, named, parts_for, ship, sliced

#: Code points of a syncmer and of its inner s-mers; K is a power of two times S.
K, S = 16, 4
BINS = 64
#: Anchors that passages() uses: one of so many, by their hash; and how many a passage has at least.
EVERY, LEAST = 8, 3
#: Stands for a null id: the last in descending order.
NO_ID = -(1 << 63)
#: Code points hashed at a time.
PIECE = 1 << 18

MULTIPLIER = 0x9E3779B97F4A7C15
EMPTY = np.uint64((1 << 64) - 1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _piece(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a stretch of at least K code points."""
    h, size, power = code.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    inner = None
    while size < K:  # polynomial hashes of twice the length each time
        if size == S:
            inner = _mix(h)
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power & (1 << 64) - 1
        size *= 2
    assert inner is not None
    window, low, reach = K - S + 1, inner, 1
    while reach < window:
        step = min(reach, window - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    at = np.flatnonzero((low == inner[: len(low)]) | (low == inner[window - 1 :]))
    return at, _mix(h[at])


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and hashes of all closed syncmers of the whole text."""
    code = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    if len(code) < K:
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = int.from_bytes(hashlib.sha256(code.tobytes()).digest()[:8], "little")
        return np.zeros(1, np.int64), np.array([whole], np.uint64)
    at, h = zip(*((p + start, x) for start in range(0, len(code) - K + 1, PIECE) for p, x in [_piece(code[start : start + PIECE + K - 1])]))
    return np.concatenate(at), np.concatenate(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, EMPTY where it has none."""
    h = np.sort(h)
    edges = np.arange(BINS + 1, dtype=np.float64) * (2.0**64 / BINS)
    first = np.searchsorted(h, edges[:-1].astype(np.uint64))
    last = np.append(first[1:], len(h))
    out = np.full(BINS, EMPTY)
    some = first < last
    out[some] = h[first[some]]
    return out


def matched(at: np.ndarray, h: np.ndarray, at_: np.ndarray, h_: np.ndarray, least: int = LEAST) -> int:
    """Code points of a text that stand in another one, too, in the same order: each anchor is tied to its first occurrence there, ties of the
    same shift make a passage, and passages of `least` anchors or more count, from their anchors' first code points to their last."""
    first, where = np.unique(h_, return_index=True)
    if not len(first) or not len(h):
        return 0
    k = np.minimum(np.searchsorted(first, h), len(first) - 1)
    tied = first[k] == h
    own = at[tied]
    shift = own - at_[where[k[tied]]]
    order = np.lexsort((own, shift))
    own, shift = own[order], shift[order]
    edges = np.flatnonzero(np.r_[True, shift[1:] != shift[:-1]]) if len(own) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[edges, len(own)])
    own = np.sort(own[np.repeat(counts >= least, counts)])
    if not len(own):
        return 0
    return int(np.minimum(np.diff(own), K).sum()) + K


def print_of(text: str | None) -> str:
    return fingerprint(sketch(anchors(text)[1]))


def fingerprint(sk: np.ndarray) -> str:
    return "".join("----" if x == EMPTY else f"{int(x) & 0xFFFF:04x}" for x in sk)


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those that either fingerprint has."""
    pairs = [(a[k : k + 4], b[k : k + 4]) for k in range(0, len(a), 4)]
    held = [x == y for x, y in pairs if (x, y) != ("----", "----")]
    return sum(held) / len(held) if held else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, n_anchors of each row: no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            hashes = [anchors(t)[1] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(sketch(h)) for h in hashes], pa.string()), pa.array(map(len, hashes), pa.int64())], names=["doc_id", "n_chars", "fingerprint", "n_anchors"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string, n_anchors long")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least: int = LEAST) -> DataFrame:
    """doc_id, start, stop, other_id, other_start, n_anchors: what a text shares with an earlier one (by id, null first, and
    text hash), or with an earlier place of its own, in code points.

    First occurrences are written before the join, which adaptive execution can then split at very frequent anchors."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for key, own, text in zip(*(c.to_pylist() for c in batch.columns)):
                at, h = anchors(text)
                some = h % np.uint64(every) == 0
                at, h = at[some], h[some]
                for a in range(0, len(h), 100_000):
                    part = slice(a, a + 100_000)
                    n = len(h[part])
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([own] * n, pa.int64()), pa.array(at[part], pa.int64()), pa.array(h[part].view(np.int64))], names=["key", "own", "at", "h"])

    text = named(text_col).cast("string")
    rows = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("own"), text.alias("text")).filter("length(text) > 0")
    found = materialize(rows.mapInArrow(run, "key long, own long, at long, h long"), "anchors")
    firsts = found.groupBy("h").agg(F.min(F.struct("key", "own", "at")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = materialize(firsts.select("h", F.col("f.key").alias("key_"), F.col("f.own").alias("own_"), F.col("f.at").alias("at_")), "first-anchors")
    ties = found.join(firsts, "h").filter("key <> key_ or own <> own_ or at <> at_")
    runs = ties.groupBy("key", "own", "key_", "own_", (F.col("at") - F.col("at_")).alias("shift")).agg(F.min("at").alias("start"), (F.max("at") + K).alias("stop"), F.countDistinct("at").alias("n_anchors")).filter(F.col("n_anchors") >= least)
    null = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return runs.select(null("key").alias("doc_id"), "start", "stop", null("key_").alias("other_id"), (F.col("start") - F.col("shift")).alias("other_start"), "n_anchors")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt out in descending order of the id and of a hash of the text: part, ahead, doc_id, own, text. Each part ends with
    a copy of the row that follows it in the whole order (ahead = 1), the last part with the first row of all.

    The ids alone give the parts' bounds: an id that is several bounds is cut at even steps of the hash, one that is one
    begins a part. Texts shuffle once, and the rows that are copied, one a part, are looked up by their keys."""
    spark = docs.sparkSession
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keys = [F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("own")]
    rows = docs.select(*keys, text.alias("text"))
    parts = parts_for(rows)
    cuts = rows.select(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = np.sort(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part_of(key: pd.Series, own: pd.Series) -> pd.Series:
        # how many bounds are at or before a row; part 0 has the largest keys
        k = key.to_numpy()
        left, right = np.searchsorted(bounds, k), np.searchsorted(bounds, k, side="right")
        many = right - left
        inside = np.floor((own.to_numpy() / 2.0**64 + 0.5) * many).astype(np.int64) + 1
        return pd.Series((len(bounds) - left - np.minimum(inside, many)).astype("int32"))

    dealt = rows.withColumn("part", part_of("key", "own"))
    # the first row of each part, a row a part; texts are read for it only where an id is cut
    cut = len(np.unique(bounds)) < len(bounds)
    narrow = rows.select("key", F.col("own") if cut else F.lit(0).cast("long").alias("own"))
    tops = sorted(tuple(r) for r in narrow.withColumn("part", part_of("key", "own")).groupBy("part").agg(F.max(F.struct("key", "own")).alias("top")).select("part", "top.key", "top.own").collect())
    if not tops:
        return dealt.select("part", F.lit(0).alias("ahead"), F.col("key").alias("doc_id"), "own", "text")
    wanted = spark.createDataFrame([(tops[i - 1][0], key, own) for i, (_, key, own) in enumerate(tops)], "to int, key long, top long")
    # of rows with the same id that of the largest hash comes first, and then that of the largest text
    found = rows.join(F.broadcast(wanted), "key").filter(F.lit(not cut) | (F.col("own") == F.col("top")))
    ahead = found.groupBy(F.col("to").alias("part"), "key").agg(F.max(F.struct("own", "text")).alias("r")).select("part", "key", "r.own", "r.text")
    every = dealt.select("part", F.lit(0).alias("ahead"), "key", "own", "text").unionByName(ahead.select("part", F.lit(1).alias("ahead"), "key", "own", "text"))
    ordered = every.repartitionById(parts, "part").sortWithinPartitions("part", "ahead", F.col("key").desc(), F.col("own").desc(), F.col("text").desc())
    return ordered.select("part", "ahead", F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "own", "text")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, its likeness to that and to the next document's, and how many of its code points stand
    in passages of these (matched by position). A task holds one row's anchors at a time, and those of the one before."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, matched_edited long, matched_next long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row waits for the one that follows
        for batch in sliced(batches, 100):
            out = []
            for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                at, h = anchors(text)
                own = fingerprint(sketch(h))
                if held and held[0] == part:
                    _, held_id, before, its, at_, h_ = held
                    other = edited(before, text)
                    to, other_h = anchors(other)
                    theirs = fingerprint(sketch(other_h))
                    digest = hashlib.sha256(other.encode("utf-8", "replace")).hexdigest()
                    out.append((held_id, len(before), digest, its, theirs, likeness(its, theirs), likeness(its, own), matched(at_, h_, to, other_h), matched(at_, h_, at, h)))
                held = None if ahead else (part, doc_id, text, own, at, h)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return with_next(docs, id_col, text_col).select("part", "ahead", "doc_id", "text").mapInArrow(run, schema)


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
