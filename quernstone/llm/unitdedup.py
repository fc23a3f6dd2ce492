"""Substring dedup by hashing lines and the clauses in them.

Texts are cut into lines, and lines into clauses: after a sentence's end, and before a capital letter that
begins a word after a lower-case one, since a passage pasted into a line begins in the middle of another sentence.
Where a clause is long (no sentence ends or capitals to cut at, or a script without them) its words are cut once more,
by content: a piece begins at a word whose hash is least among its neighbours', wherever the text around it begins or ends.
Each unit is its words in lower case, hashed to 96 bits; a word is a run of letters, digits and their marks, or in scripts that
don't put spaces between words a character. The texts of a batch are cut and hashed together, as arrays. Digests are
grouped over all documents. The earliest occurrence by (document id, hash of the text, position) stays, every other one is a repeat.

Repeats are removed where they are more than chance: a whole line of LINE_WORDS words or more, or a
run of consecutive repeated clauses and pieces (over line ends, too) of RUN_WORDS words or more. What is kept has its spans in
the original text, `kept`, and what is removed its own, `removed`.

Defined results: a null text counts as empty and stays null; blank lines stay, and go with the removed line
before them never; a row's document is its id and its text: different texts under one id, or under null ids, are documents
of their own (ranked by id, null first, then by a hash of the text), equal rows are one and don't make repeats of each other;
repeated rows are all returned; an empty table gives no rows; other columns pass through untouched, but for one named
`kept` or `removed` where those are asked for, whose place they take.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.shared import documents, free, map_rows, materialize, named, release, ship, sliced
from quernstone.llm.shared import kept as kept_columns

#: Words of a line that is removed as a repeat of its own, and of a run of clauses, at least.
LINE_WORDS, RUN_WORDS = 5, 25
#: Stands for a null id: ranks before all.
NO_ID = -(1 << 63)

GAP = regex.compile(r"^[^\p{L}\p{N}\p{M}\s\p{Ps}\p{Pi}]*[^\S\n]*")

#: Words of a clause above which it is cut into pieces: a passage of 2 * LONG + RUN_WORDS words or more has as many
#: inside the clauses it shares with its surroundings, or is in pieces there.
LONG = 12
#: Neighbours on each side that a piece's first word is compared with.
REACH = 2
#: Position of a text's first piece; those of clauses and lines are below.
PIECES = 1 << 30
#: Characters of texts that are cut together; a longer text is cut alone.
TOGETHER = 1 << 20

#: What a character is. A clause ends at white space after END and any CLOSE, or between AHEAD and UPPER.
CLASSES = {
    "WORD": r"[\p{L}\p{N}\p{M}]",
    "DENSE": r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]",
    "MARK": r"\p{M}",
    "SPACE": r"[^\S\n]",
    "AHEAD": r"[\p{Ll}\p{N},;:]",
    "UPPER": r"\p{Lu}",
    "END": "[.!?\u2026]",
    "CLOSE": r"['\")\]]",
}
WORD, DENSE, MARK, SPACE, AHEAD, UPPER, END, CLOSE = (np.uint8(1 << k) for k in range(8))
#: A unit's kind goes into its digest, so that a line of several clauses is not compared with a clause.
PART_SEED, LINE_SEED, PIECE_SEED = 1, 2, 3
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its classes as bits, and its lower case."""
    every = "".join("\0" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    kind = np.zeros(len(every), np.uint8)
    for k, pattern in enumerate(CLASSES.values()):
        for m in regex.finditer(f"{pattern}+", every):
            kind[m.start() : m.end()] |= np.uint8(1 << k)
    low = np.arange(len(every), dtype=np.uint32)
    for m in regex.finditer(r"[\p{Lu}\p{Lt}]", every):
        low[m.start()] = ord(m[0].lower()[0])
    return kind, low


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashed(values: np.ndarray, begins: np.ndarray, factor: int, seed: int) -> np.ndarray:
    """A hash of each stretch of values: stretch k goes from begins[k] to the next one's beginning."""
    size = np.diff(np.append(begins, len(values)))
    offset = np.arange(len(values)) - np.repeat(begins, size)
    powers = np.full(int(size.max()), factor, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return _mix(np.add.reduceat(values * powers[offset], begins) + np.uint64(seed))


class Cut:
    """Texts cut into clauses, words and pieces, as arrays over all of them. Offsets count in the texts joined by line ends."""

    def __init__(self, texts: list[str]):
        kinds, lower = _tables()
        self.texts = texts
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, kind = len(code), kinds[code]
        breaks = np.flatnonzero(code == 10)
        line_start, line_end = np.append(0, breaks + 1), np.append(breaks, n)

        # white space that parts clauses
        edges = np.diff(np.r_[False, kind & SPACE > 0, False].astype(np.int8))
        gap, after = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        inside = gap > 0
        gap, after = gap[inside], after[inside]
        inside = code[gap - 1] != 10
        gap, after = gap[inside], after[inside]
        padded = np.append(kind, np.uint8(0))  # what is before the first and after the last character has no class
        last = np.maximum.accumulate(np.where(kind & CLOSE, -1, np.arange(n)))[gap - 1] if len(gap) else gap
        following = padded[after]
        parted = (padded[last] & END > 0) | ((kind[gap - 1] & AHEAD > 0) & (following & UPPER > 0))
        gap, after = gap[parted], after[parted]
        closing = np.append(code, 10)[after] == 10  # white space at the end of a line begins no clause
        filled = line_end > line_start
        self.start = np.sort(np.concatenate((line_start[filled], after[~closing])))
        ends = line_end[filled]
        self.end = np.sort(np.concatenate((gap, ends[~np.isin(ends, after[closing])])))
        self.line = np.searchsorted(line_start, self.start, "right") - 1
        m = len(self.start)
        new = np.append(True, self.line[1:] != self.line[:-1])[:m]
        self.first = np.maximum.accumulate(np.where(new, np.arange(m), 0)) if m else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.clauses = np.searchsorted(self.doc, np.arange(len(texts) + 1))

        # words, and their hashes
        at = np.flatnonzero(kind & WORD)
        k = kind[at]
        begins = np.append(True, at[1:] != at[:-1] + 1)[: len(at)]
        dense, letter = k & DENSE > 0, k & MARK == 0
        if dense.any():
            head = np.maximum.accumulate(np.where(letter | begins, np.arange(len(at)), 0))
            begins |= letter & (dense | np.append(False, dense[head[:-1]]))
        word = np.flatnonzero(begins)
        self.word_start = at[word]
        self.word_end = at[np.append(word[1:], len(at)) - 1] + 1 if len(at) else at
        values = (lower[code[at]] + np.uint32(1)).astype(np.uint64)
        self.hash = [_hashed(values, word, f, 0) if len(word) else np.zeros(0, np.uint64) for f in FACTORS]
        self.clause = np.searchsorted(self.start, self.word_start, "right") - 1
        self.words = np.bincount(self.clause, minlength=m)
        self._cut_pieces()

    def _cut_pieces(self) -> None:
        """Pieces that touch a long clause, as ranges of words."""
        long = self.words[self.clause] > LONG
        none = np.zeros(0, np.int64)
        if not long.any():
            self.piece_first, self.piece_stop, self.piece_doc, self.piece_begins, self.piece_kept = none, none, none, none, none
            return
        doc, h = self.doc[self.clause], self.hash[0]
        first = np.ones(len(h), bool)
        for d in range(1, REACH + 1):
            same = doc[d:] == doc[:-d]
            first[d:] &= (h[d:] <= h[:-d]) | ~same
            first[:-d] &= (h[:-d] <= h[d:]) | ~same
        first |= np.append(True, doc[1:] != doc[:-1])
        begins = np.flatnonzero(first)
        kept = np.logical_or.reduceat(long, begins)
        self.piece_begins, self.piece_kept = begins, kept
        self.piece_first, self.piece_stop = begins[kept], np.append(begins[1:], len(h))[kept]
        self.piece_doc = doc[self.piece_first]

    def _digests(self, begins: np.ndarray, seed: int) -> list[np.ndarray]:
        return [_hashed(h, begins, f, seed) for h, f in zip(self.hash, FACTORS)]

    def units(self) -> tuple[np.ndarray, ...]:
        """text, position, digest (64 and 32 bits) and words of every unit with a word. Clause k of a text has position 2k, the line
        that begins with it 2k + 1, piece k PIECES + k. A line that is one clause has no digest of its own: the clause stands for it."""
        out: list[tuple[np.ndarray, ...]] = []
        if len(self.clause):
            some = np.flatnonzero(self.words)
            begins = np.flatnonzero(np.append(True, self.clause[1:] != self.clause[:-1]))
            place = np.arange(len(self.start)) - self.clauses[self.doc]
            out.append((self.doc[some], 2 * place[some], *self._digests(begins, PART_SEED), self.words[some]))
            heads = self.first[self.clause]
            begins = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
            heads = heads[begins]
            clauses = np.bincount(self.first, minlength=len(self.start))[heads]
            words = np.diff(np.append(begins, len(self.clause)))
            pick = (clauses > 1) & (words >= LINE_WORDS)
            out.append((self.doc[heads][pick], 2 * place[heads][pick] + 1, *(d[pick] for d in self._digests(begins, LINE_SEED)), words[pick]))
        if len(self.piece_first):
            place = np.arange(len(self.piece_doc)) - np.searchsorted(self.piece_doc, self.piece_doc)
            digests = (d[self.piece_kept] for d in self._digests(self.piece_begins, PIECE_SEED))
            out.append((self.piece_doc, PIECES + place, *digests, self.piece_stop - self.piece_first))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none.astype(np.uint32), none
        doc, at, h1, h2, words = (np.concatenate(c) for c in zip(*out))
        return doc, at, h1, (h2 >> np.uint64(32)).astype(np.uint32), words

    def spans(self, d: int) -> tuple[list[tuple[int, int, int]], list[int]]:
        """Clauses of text d: (start, end, first clause of the line); and how many words each has."""
        own, base = slice(self.clauses[d], self.clauses[d + 1]), self.base[d]
        first = self.first[own] - self.clauses[d]
        return list(zip((self.start[own] - base).tolist(), (self.end[own] - base).tolist(), first.tolist())), self.words[own].tolist()

    def removed(self, d: int, repeats: set[int]) -> list[tuple[int, int]]:
        """Spans of text d to remove, given its repeated positions: removable(), and runs of words that repeated
        pieces, alone or with repeated clauses, cover."""
        text, (spans, words) = self.texts[d], self.spans(d)
        whole = removable(len(text), spans, words, {p for p in repeats if p < PIECES})
        marked = sorted(p - PIECES for p in repeats if p >= PIECES)
        if not marked:
            return whole
        base = self.base[d]
        first, stop = np.searchsorted(self.clause, (self.clauses[d], self.clauses[d + 1]))
        starts, ends = (self.word_start[first:stop] - base).tolist(), (self.word_end[first:stop] - base).tolist()
        p = np.searchsorted(self.piece_doc, d) + np.array(marked)
        covered = np.zeros(len(starts) + 1, bool)
        for i, j in zip((self.piece_first[p] - first).tolist(), (self.piece_stop[p] - first).tolist()):
            covered[i:j] = True
        for a, b in [*((a, b) for k, (a, b, _) in enumerate(spans) if 2 * k in repeats), *whole]:
            covered[bisect_left(starts, a) : bisect_left(starts, b)] = True
        edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
        gone = list(whole)
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i >= RUN_WORDS:
                gap = text[ends[j - 1] : starts[j] if j < len(starts) else len(text)]
                # the gap after goes with the run, but not a line break or an opening mark of what stays
                gone.append((starts[i], ends[j - 1] + len(gap) - len(GAP.sub("", gap, count=1))))
        out: list[tuple[int, int]] = []
        for a, b in sorted(gone):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def removable(length: int, spans: list[tuple[int, int, int]], words: list[int], repeats: set[int]) -> list[tuple[int, int]]:
    """Spans of a text of that length to remove, given its clauses and its repeated clauses and lines."""
    gone = [False] * len(spans)
    ends: dict[int, int] = {}
    for k, (_, _, first) in enumerate(spans):
        ends[first] = k + 1
    for first, end in ends.items():
        whole = 2 * first + 1 in repeats or (end == first + 1 and 2 * first in repeats)
        if whole and sum(words[first:end]) >= LINE_WORDS:
            gone[first:end] = [True] * (end - first)
    k = 0
    while k < len(spans):
        if words[k] and (2 * k in repeats or gone[k]):
            end = k
            # a unit without words, such as a rule of dashes, doesn't break a run
            while end < len(spans) and (2 * end in repeats or gone[end] or not words[end]):
                end += 1
            while end > k and not words[end - 1]:
                end -= 1
            if sum(words[k:end]) >= RUN_WORDS:
                gone[k:end] = [True] * (end - k)
            k = end
        else:
            k += 1
    out: list[tuple[int, int]] = []
    for k, (a, b, first) in enumerate(spans):
        if not gone[k]:
            continue
        # the gap after a removed unit goes with it; a line removed to its end takes its line break
        stop = spans[k + 1][0] if k + 1 < len(spans) and spans[k + 1][2] == first else min(length, b + 1)
        if k + 1 >= ends[first] and not all(gone[first : k + 1]):
            stop = b
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], stop)
        else:
            out.append((a, stop))
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= TOGETHER):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _units_of(docs: DataFrame) -> DataFrame:
    """key, own (the text's hash), at, digest of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            key, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in _groups(texts):
                doc, at, h1, h2, _ = Cut(texts[a:b]).units()
                if len(doc):
                    order = np.lexsort((at, doc))  # the key and the text's hash of a document's units then take hardly any room
                    doc = doc[order] + a
                    yield pa.RecordBatch.from_arrays([pa.array(key[doc]), pa.array(own[doc]), pa.array(at[order].astype(np.int32)), pa.array(h1[order].view(np.int64)), pa.array(h2[order].view(np.int32))], names=["key", "own", "at", "h1", "h2"])

    return docs.select("key", "own", "text").mapInArrow(run, "key long, own long, at int, h1 long, h2 int")


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id, and a hash of the text."""
    return [F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(named(text_col).cast("string")).alias("own")]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (the id, NO_ID for null), own (the text's hash) and the positions of repeated lines and clauses, a row a document that has some."""
    units_only = F.filter("repeats", lambda x: x < PIECES)
    return _repeats(docs, id_col, text_col).withColumn("repeats", units_only).filter("size(repeats) > 0")


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """repeats() with the positions of pieces among them.

    Only digests that more than one row has take part in the join, and only repeats come out of it. The first
    occurrences are written before it: right above the aggregation that finds them, the join would need
    each digest's rows in one task; apart from it, adaptive execution splits those of very frequent units."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*_document(id_col, text_col), named(text_col).cast("string").alias("text"))
    found = materialize(_units_of(rows), "units")
    first = materialize(found.groupBy("h1", "h2").agg(F.min(F.struct("key", "own", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", F.col("first.key").alias("first_key"), F.col("first.own").alias("first_own"), F.col("first.at").alias("first_at")), "first-units")
    later = found.join(first, ["h1", "h2"]).filter("key <> first_key or own <> first_own or at <> first_at").select("key", "own", "at")
    out = materialize(later.groupBy("key", "own").agg(F.collect_set("at").alias("repeats")), "repeated-units")
    release(found)
    release(first)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs with the text cut, and where `spans` is set with `kept` and `removed`: arrays of (start, end) in the original text."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    at, width = docs.columns.index(text_col), len(docs.columns)
    mark = [free(docs, n) for n in ("_key", "_own")]
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_document(id_col, text_col), mark)))
    own = free(docs, "repeats")
    found = _repeats(docs, id_col, text_col).toDF(*mark, own)
    with_repeats = keyed.join(found, mark, "left").select(*kept_columns(docs), named(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in sliced(batches):
            texts, cut, kept = batch.column(at).to_pylist(), [], []
            repeated = batch.column(width).to_pylist()
            marked = [k for k, r in enumerate(repeated) if r]
            gone_from: dict[int, list[tuple[int, int]]] = {}
            for a, b in _groups([texts[k] for k in marked]):
                own = Cut([texts[k] for k in marked[a:b]])
                gone_from.update((k, own.removed(d, set(repeated[k]))) for d, k in enumerate(marked[a:b]))
            for k, text in enumerate(texts):
                gone = gone_from.get(k, [])
                stay, start = [], 0
                for a, b in [*gone, (len(text or ""), 0)]:
                    if a > start:
                        stay.append((start, a))
                    start = b
                if gone:
                    texts[k] = "".join(text[a:b] for a, b in stay)
                cut.append([{"start": a, "end": b} for a, b in gone])
                kept.append([{"start": a, "end": b} for a, b in stay])
            columns = [*batch.columns, *([pa.array(kept, kind), pa.array(cut, kind)] if spans else [])]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield columns

    return map_rows(with_repeats, run, [T.StructField("kept", span), T.StructField("removed", span)] if spans else []).drop(own)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", "kept", "removed", F.size("removed").cast("long").alias("n_removed"))
