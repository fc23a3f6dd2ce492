"""Token ids as flat binary files.

A data set is a folder of parts in ascending order of the document id. Part k has
`part-k.ids` (unsigned 16-bit little-endian token ids, nothing else; a vocabulary of more than 65,536 is an error, not truncated), `part-k.docs` (the
documents' ids, signed 64-bit) and `part-k.offsets` (unsigned 64-bit: where each document starts among
all tokens of the data set, and the end of the last). A part's tokens are written when they are
encoded; its offsets need the tokens of the parts before, which come from a prefix sum over one count
a part. Readers map the files into memory.

Defined results: a null text counts as empty; an empty text has only the end id; a very long text is encoded whole; a null document id
sorts first and is read back as null; rows of the same id are ordered by a hash of their text and all written, and a
part may begin among them, so that an id that many rows share is many parts' work; an empty table gives a data set without parts; other columns are not read.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import documents, fresh_path, materialize, named, parts_for, posix, ship, sliced

#: Stands for a null document id in the files.
NO_ID = -(1 << 63)
#: Entries of each of an encoder's two tables of known ids; beyond, a table starts anew with its last batch.
CACHE = 800_000
#: Rows that are encoded together, and new words that the tokenizer gets as a line.
ROWS, LINE = 4000, 500

#: What the tokenizer file states as its pre-tokenizer's pattern (fixed value).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What a text must not have if its words are to be encoded one by one: what begins special tokens, characters that only
#: Python takes for space, and the letter whose lower case depends on its place.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\u03a3")


def _pieces(chunk: str) -> list[str]:
    """The words of a text without spaces. Most have letters and then punctuation only, and need no pattern."""
    head = chunk.rstrip(string.punctuation)
    return [x for x in (head, chunk[len(head) :]) if x] if not head or head.isalpha() else WORD.findall(chunk)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Known:
    """Ids by string, as Arrow arrays: those of a batch of distinct strings, which `make` gives for the ones not met before."""

    def __init__(self, make: Callable[[list[str]], pa.Array]) -> None:
        self.make, self.names, self.ids = make, pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def __call__(self, some: pa.Array) -> pa.Array:
        at = pc.index_in(some, value_set=self.names)
        new = some.filter(at.is_null())
        names = pa.concat_arrays([self.names, new])
        ids = pa.concat_arrays([self.ids, self.make(new.to_numpy(zero_copy_only=False).tolist())])
        place = at.fill_null(0).to_numpy().copy()
        place[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.names), len(names))
        out = ids.take(pa.array(place))
        self.names, self.ids = (names, ids) if len(names) <= CACHE else (some, out)
        return out


def _joined(ids: pa.Array, offsets: pa.Array) -> pa.Array:
    """The ids between each two offsets as one entry."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids), pa.scalar(b"", pa.large_binary()))


@cache
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> their ids as unsigned 16-bit bytes, by the tokenizers library.

    The vocabulary marks the end of a word and no token goes over a space, so a text's ids are its words'
    ids one after another. Arrow splits a batch's texts at spaces and puts the chunks' ids together again; in between, the
    words of chunks not met before are encoded by the file's own model. Texts that need more than that go through the whole
    tokenizer. So do chunks with characters that Python's Unicode tables don't have: the tokenizer's and `regex` may have them
    already, and not class and lower-case them alike. A process has one encoder, as reading the file takes as long as encoding
    some megabytes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    full, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    size = full.get_vocab_size()
    if size > 1 << 16:
        raise ValueError("ids need more than 16 bits")
    ends = np.zeros(1 << 16, bool)
    for token, k in full.get_vocab().items():
        ends[k] = token.endswith("</w>")
    letters = _byte_letters()
    del letters[32]  # parts the words of a line

    def whole(text: str) -> bytes:
        return np.array(full.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def words_ids(new: list[str]) -> pa.Array:
        lines = (" ".join(new[k : k + LINE]).encode("utf-8").decode("latin-1").translate(letters) for k in range(0, len(new), LINE))
        ids = np.concatenate([np.zeros(0, np.uint16), *(np.array(bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint16) for line in lines)])
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(new):
            raise AssertionError("a word has no end token")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(2 * np.append(0, stops)), pa.py_buffer(ids)])

    words = _Known(words_ids)

    def chunks_ids(new: list[str]) -> pa.Array:
        strange = {x for x in set().union(*(c for c in new if not c.isascii())) if unicodedata.category(x) == "Cn"}
        odd = {c: whole(c) for c in new if not strange.isdisjoint(c)} if strange else {}
        parts = [[] if c in odd else _pieces(c) for c in new]
        flat = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
        out = _joined(words(flat.dictionary).take(flat.indices), pa.array(list(accumulate(map(len, parts), initial=0)), pa.int32()))
        return pa.array([odd.get(c, x) for c, x in zip(new, out.to_pylist())], pa.large_binary()) if odd else out

    chunks = _Known(chunks_ids)

    def by_words(text: str) -> bool:
        first, a, b, c, d, sigma = WHOLE
        odd = first in text or a in text or b in text or c in text or d in text or (not text.isascii() and (sigma in text or not unicodedata.is_normalized("NFC", text)))
        return not odd

    def encode(texts: list[str]) -> list[bytes]:
        plain = [by_words(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([t.lower() if own else "" for t, own in zip(texts, plain)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        out = _joined(chunks(coded.dictionary).take(coded.indices), split.offsets).to_pylist()
        return [x if own else whole(t) for t, own, x in zip(texts, plain, out)]

    return encode


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the data set to `folder`, a mounted folder that all executors see, and returns a row a part:
    part, file, documents, tokens, base.

    One shuffle deals the texts out by ranges of the id, and of a hash of the text within an id; the number of parts follows
    the size of docs. A task writes under a name of its own attempt
    and renames, so that a repeated or a second attempt leaves whole files; the table says which count."""
    spark = docs.sparkSession
    ship(spark)
    place = posix(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:06d}-{context.taskAttemptId()}"
        encode = word_encoder(tokenizer)
        end = np.array([end_id], np.uint16).tobytes()
        os.makedirs(place, exist_ok=True)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        tokens = 0
        path = f"{place}/{name}.ids"
        with open(path + ".tmp", "wb", buffering=1 << 20) as out:
            for some in sliced(batches, ROWS):
                data = encode([x or "" for x in some.column(1).to_pylist()])
                for d in data:
                    out.write(d)
                    out.write(end)
                n = np.fromiter(map(len, data), np.int64, len(data)) // 2 + 1
                sizes.append(n)
                tokens += int(n.sum())
                ids.append(some.column(0).fill_null(NO_ID).to_numpy())
        if not ids:
            os.unlink(path + ".tmp")
            return
        for suffix, data in (("docs", np.concatenate(ids)), ("sizes", np.concatenate(sizes))):
            with open(f"{place}/{name}.{suffix}.tmp", "wb") as out:
                out.write(data.astype("<i8").tobytes())
        for suffix in ("ids", "docs", "sizes"):
            os.replace(f"{place}/{name}.{suffix}.tmp", f"{place}/{name}.{suffix}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{place}/{name}"], "documents": [sum(map(len, ids))], "tokens": [tokens]})

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    rows = rows.withColumn("own", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts_for(rows), "doc_id", "own").sortWithinPartitions("doc_id", "own", "text").select("doc_id", "text")
    written = materialize(rows.mapInArrow(run, "part int, file string, documents long, tokens long"), "token-parts")
    listed = sorted((tuple(r) for r in written.collect()), key=lambda r: r[0])  # a row a part
    bases = [0, *accumulate(r[3] for r in listed)]
    table = spark.createDataFrame(pd.DataFrame({"part": [r[0] for r in listed], "file": [r[1] for r in listed], "documents": [r[2] for r in listed], "tokens": [r[3] for r in listed], "base": bases[:-1]}), "part int, file string, documents long, tokens long, base long")
    return _offsets(table, len(listed))


def _offsets(table: DataFrame, parts: int) -> DataFrame:
    """Turns the sizes of each part into offsets among all tokens, now that the part's base is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                if os.path.exists(f"{file}.sizes"):
                    sizes = np.fromfile(f"{file}.sizes", "<i8")
                    with open(f"{file}.offsets.tmp", "wb") as out:
                        out.write((np.concatenate(([0], np.cumsum(sizes))) + base).astype("<u8").tobytes())
                    os.replace(f"{file}.offsets.tmp", f"{file}.offsets")
            yield batch

    return materialize(table.repartition(max(1, parts)).mapInArrow(run, table.schema), "token-table")


def read(parts: DataFrame) -> DataFrame:
    """A row a document, from the files: doc_id, start, n_tokens, ids_crc32."""
    ship(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                docs = np.memmap(f"{file}.docs", "<i8", "r")
                offsets = np.memmap(f"{file}.offsets", "<u8", "r").astype(np.int64)
                tokens = np.memmap(f"{file}.ids", "<u2", "r")
                for at in range(0, len(docs), 5000):
                    stops = offsets[at : at + 5001] - base
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                    own = np.array(docs[at : at + 5000])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(stops[:-1] + base), pa.array(np.diff(stops)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(file: str, base: int, k: int) -> np.ndarray:
    """The ids of the k-th document of a part, without reading the rest."""
    offsets = np.memmap(f"{file}.offsets", "<u8", "r")
    return np.memmap(f"{file}.ids", "<u2", "r")[int(offsets[k]) - base : int(offsets[k + 1]) - base]


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = write(documents(spark, sf_dir), fresh_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read(parts)
