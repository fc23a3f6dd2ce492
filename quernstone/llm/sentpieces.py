"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

Texts are cut into marked words: a word with the mark of the space before it. No piece of such a
model goes over the beginning of a marked word, so a text's ids are its words' ids one after another.
The distinct new words of a batch are sorted, which walks their trie depth-first: each word keeps the
forward scores of the prefix that it shares with the word before and computes the rest.

A forward step takes the best of (score of the shorter prefix) + (gain of the piece that follows it); the best way back from the end
gives the ids. The gain depends on the model's kind, which is read from its file. In a unigram model it is the
piece's score. A BPE model ranks merges, and adding its ranks up gives other ids than its merges do; there the gain is that
of a pair of neighbours: 0 if merging leaves the piece as it is right after the one before it, minus infinity if
not, so that of all ways exactly one, that of the model's own merges, has a finite score.
A character without a piece costs the unknown's score in both.

Defined results: a null text counts as empty and has no ids; a text's own mark characters count as
spaces, so that it decodes with spaces there (`same` is false for it); characters without a piece become their UTF-8 bytes'
ids; runs of spaces are merged as the library merges them; repeated rows are all returned; null ids are
returned as null; an empty table gives no rows; other columns are kept by `encoded`, but for one that has the
name of a column it adds (n_pieces, ids, same), whose place that takes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.shared import documents, map_rows, named, ship, sliced

MARK = "▁"
#: Entries of an encoder's word and pair caches; beyond, they start anew.
CACHE = 400_000
#: Texts encoded together, and their characters, at most; a longer text is encoded alone.
TOGETHER, TOGETHER_CHARS = 500, 1_000_000

ONE_SPACE = re.compile(" [^ \n]*|[^ \n]+|\n")
RUNS = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: What stands before a word's first piece, and after a character without a piece.
START, UNKNOWN = -1, -2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _field(data: bytes, number: int) -> bytes | int | None:
    """A field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = data[at : at + n], at + n
        if key >> 3 == number:
            return value
    return None


def model_kind(path: str) -> str:
    """The kind that a model file states: field 3 of its trainer's settings, which are field 2 (fixed values)."""
    with open(path, "rb") as f:
        settings = _field(f.read(), 2)
    return {1: "unigram", 2: "bpe"}[_field(settings, 3) or 1 if settings else 1]


class Pieces:
    """A model file's pieces, scores and kind."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.library, self.library.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.kind = kind or model_kind(path)
        normal = [k for k in range(n) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        self.id = {m.id_to_piece(k).replace(MARK, " "): k for k in normal}
        self.score = {m.id_to_piece(k).replace(MARK, " "): m.get_score(k) for k in normal}
        self.scores = {k: self.score[p] for p, k in self.id.items()}
        self.text = {k: p for p, k in self.id.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.unknown_score = min(self.score.values()) - 10
        self.raw: list[bytes] = [b""] * n
        for p, k in self.id.items():
            self.raw[k] = p.encode()
        for b, k in enumerate(self.byte):
            self.raw[k] = bytes([b])
        if any(" " in p.lstrip(" ") for p in self.id):
            raise ValueError("a piece goes over the beginning of a word")

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by score leaves of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes distinct words in sorted order, sharing the states of common prefixes, and keeps their ids."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.words: dict[str, bytes] = {"\n": self._unknown("\n") if "\n" not in pieces.id else np.array([pieces.id["\n"]], np.uint16).tobytes()}
        self.pairs: dict[int, float] = {}
        self.runs: dict[int, bytes] = {}

    def _unknown(self, char: str) -> bytes:
        return np.array([self.p.byte[b] for b in char.encode("utf-8", "replace")], np.uint16).tobytes()

    def _stays(self, before: int, piece: int) -> bool:
        """Whether merging leaves this piece as it is right after that one."""
        text = self.p.text
        if before < 0:
            return self.p.merged(text[piece]) == [text[piece]]
        return self.p.merged(text[before] + text[piece]) == [text[before], text[piece]]

    def learn(self, words: list[str]) -> None:
        """words: distinct, sorted; runs of spaces are not among them."""
        gain, only = (self._gain_bpe, True) if self.p.kind == "bpe" else (self._gain_unigram, False)
        ids, longest, unknown = self.p.id, self.p.longest, self.p.unknown_score
        last: list[int] = [START]  # of the best way to each prefix: its last piece, UNKNOWN for a character without one
        size: list[int] = [0]  # that piece's characters
        score: list[float] = [0.0]  # the forward scores
        prior = ""
        for w in words:
            n = 0
            for a, b in zip(prior, w):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], size[n + 1 :], score[n + 1 :]
            for i in range(n + 1, len(w) + 1):
                best, piece, length = score[i - 1] + unknown, UNKNOWN, 1
                if not only or w[i - 1] in ids:
                    for m in range(1, min(i, longest) + 1):
                        k = ids.get(w[i - m : i])
                        if k is not None and (s := score[i - m] + gain(last[i - m], k)) > best:
                            best, piece, length = s, k, m
                            if only:  # no other way has a finite gain
                                break
                last.append(piece)
                size.append(length)
                score.append(best)
            self.words[w] = self._collected(w, last, size)
            prior = w

    def _gain_bpe(self, before: int, piece: int) -> float:
        pair = max(before, START) << 16 | piece
        stays = self.pairs.get(pair)
        if stays is None:
            stays = self.pairs[pair] = 0.0 if self._stays(max(before, START), piece) else -math.inf
        return stays

    def _gain_unigram(self, before: int, piece: int) -> float:
        return self.p.scores[piece]

    def _collected(self, w: str, last: list[int], size: list[int]) -> bytes:
        out, i = [], len(w)
        while i:
            out.append(self._unknown(w[i - 1]) if last[i] == UNKNOWN else last[i].to_bytes(2, "little"))
            i -= size[i]
        return b"".join(reversed(out))

    def _run(self, n: int) -> bytes:
        """Ids of n marks in a row; their merges all have the same score, and the library settles them."""
        if n not in self.runs:
            self.runs[n] = np.array(self.p.library.encode(" " * (n - 1)) or [self.p.id[" "]], np.uint16).tobytes()
        return self.runs[n]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids as unsigned 16-bit bytes."""
        if len(self.words) > CACHE:
            self.__init__(self.p)
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        split, plain = [], []
        for t in texts:
            marked = " " + t.replace(MARK, " ") if t else ""
            plain.append("  " not in marked)
            split.append((ONE_SPACE if plain[-1] else RUNS).findall(marked))
        new: set[str] = set()
        for s, simple in zip(split, plain):
            new.update(s if simple else [w.lstrip(" ").join((" " * w.startswith(" "), "")) for w in s])
        self.learn(sorted(new.difference(self.words)))
        get = self.words.__getitem__
        return [b"".join(map(get, s)) if simple else b"".join(map(self._with_run, s)) for s, simple in zip(split, plain)]

    def _with_run(self, w: str) -> bytes:
        n = len(w) - len(w.lstrip(" "))
        if n < 2:
            return self.words[w]
        own = self.words[" " + w[n:]]
        if own[:2] == self.p.id[" "].to_bytes(2, "little"):
            return self._run(n) + own[2:]
        return self._run(n - 1) + own

    def decode(self, ids: np.ndarray) -> str:
        raw = self.p.raw
        return b"".join([raw[k] for k in ids.tolist()]).decode("utf-8", "replace")[1:]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < TOGETHER and (end == at or chars + len(texts[end]) <= TOGETHER_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def encoded(docs: DataFrame, model: str, text_col: str = "text", kind: str | None = None, check: bool = True) -> DataFrame:
    """docs with n_pieces, ids and, where `check` is set, same: whether the ids decode to the text. No shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    added = [T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("same", T.BooleanType())] * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder = Encoder(Pieces(model, kind))
        for batch in sliced(batches):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for a, b in _groups(texts):
                data = encoder.encode(texts[a:b])
                ends = np.cumsum([0, *(len(d) // 2 for d in data)], dtype=np.int32)
                values = np.frombuffer(b"".join(data), "<u2")
                cols = [*batch.slice(a, b - a).columns, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))]
                if check:
                    cols.append(pa.array([encoder.decode(values[i:j]) == t for i, j, t in zip(ends[:-1], ends[1:], texts[a:b])], pa.bool_()))
                yield cols

    return map_rows(docs, run, added)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids give null."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Pieces(model))
        for ids in batches:
            yield ids.map(lambda x: None if x is None else encoder.decode(np.asarray(x, np.int64)))

    return rows.withColumn(text_col, text_of(named(ids_col)))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir).select("doc_id", "text"), model_path()).drop("text")
