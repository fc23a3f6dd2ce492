"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become an 8-bit grey image 64 pixels
wide (PNG, lossless). Writers put each image once into the tar shard of their task, under the SHA-256
of its bytes as its name; a shard that is full is followed by another. Rows carry digest, shard, offset and length.
Which shard's copy of a digest counts is settled by a minimum over the small index, so that payloads never
shuffle; copies of the same content by other tasks stay in their shards unused.

Readers take the columns from the index: a range read of the image's header fills width, height and
depth without the payload; features need the payload, read by the same offsets.

Defined results: a null text counts as empty (one row of 64 zeros); equal texts have equal values in every
column; a very long text is one image, whole; a null id is returned as null; repeated rows are all returned; an empty table writes no shard; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import documents, fresh_path, materialize, named, posix, release, ship, sliced

WIDTH = 64
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: What identifies a PNG file, and the bytes up to the end of its header chunk (fixed values).
SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
HEADER_BYTES = 33
#: Stored bytes that a reader holds at a time (a larger image alone), and images.
READ_BYTES, READ_ROWS = 16 << 20, 500


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """8-bit grey PNG: each row of WIDTH samples after a filter byte of 0, deflated."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("no image header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_image(data: bytes) -> bytes:
    """The samples of an image that to_image() wrote."""
    width, height, _ = read_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit average hash of the image brought to 8 by 8: band k
    of the rows and eighth j of the columns against the mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = x.reshape(len(x), 8, 8).sum(axis=2, dtype=np.int64)
    edges = np.arange(8) * len(x) // 8
    upto = np.concatenate((np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)))
    last = np.maximum(np.concatenate((edges[1:], [len(x)])), edges + 1)
    cells = (upto[last] - upto[edges]) / ((last - edges)[:, None] * 8)
    bits = np.packbits(cells.ravel() > cells.mean()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};ahash={bits}"


class Shard:
    """A tar file being written; add() returns where the content of a member lies."""

    def __init__(self, path: str):
        self.path, self.size = path, 0
        self.file = open(path + ".tmp", "wb", buffering=1 << 20)  # noqa: SIM115

    def add(self, name: str, data: bytes) -> int:
        head = tarfile.TarInfo(name)
        head.size = len(data)
        block = head.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(block + data + bytes(-len(data) % 512))
        at = self.size + len(block)
        self.size = at + len(data) + -len(data) % 512
        return at

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()
        os.replace(self.path + ".tmp", self.path)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns the rows' media columns: doc_id, n_bytes, digest, shard, offset, length."""
    ship(docs.sparkSession)
    place = posix(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        os.makedirs(place, exist_ok=True)
        shard: Shard | None = None
        n = 0
        have: dict[bytes, tuple[str, int, int]] = {}  # by digest, of this shard
        for batch in sliced(batches):
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                n_bytes, payload = payload_of(text)
                image = to_image(payload)
                digest = hashlib.sha256(image).digest()
                if digest not in have:
                    if shard is None or shard.size > SHARD_BYTES:
                        if shard:
                            shard.close()
                        have.clear()
                        shard = Shard(f"{place}/{name}-{n:04d}.tar")
                        n += 1
                    have[digest] = (shard.path, shard.add(digest.hex(), image), len(image))
                out.append((n_bytes, digest, *have[digest]))
            if out:
                n_bytes_, digests, shards, offsets, lengths = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes_, pa.int64()), pa.array(digests, pa.binary()), pa.array(shards), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    written = materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "media-index")
    return written


def addressed(index: DataFrame) -> DataFrame:
    """A row a digest: the copy that counts."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.*")


def headers(places: DataFrame) -> DataFrame:
    """digest, width, height, depth by range reads of the headers alone."""
    ship(places.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digest, data in _ranges(batches, lambda length: min(length, HEADER_BYTES)):
            width, height, depth = (pa.array(c, pa.int32()) for c in zip(*map(read_header, data)))
            yield pa.RecordBatch.from_arrays([digest, width, height, depth], names=["digest", "width", "height", "depth"])

    return _by_shard(places).mapInArrow(run, "digest binary, width int, height int, depth int")


def _by_shard(places: DataFrame) -> DataFrame:
    """Readers of one shard side by side, in ranges of offsets, so that a large shard is several tasks' work."""
    stretch = F.floor(F.col("offset") / (8 << 20))
    return places.repartition("shard", stretch).sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], size) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The first size(length) bytes of each image, some images at a time."""
    file, name = None, None
    for batch in batches:
        start, held, data = 0, 0, []
        for k, (shard, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")))):
            n = size(length)
            if data and (held + n > READ_BYTES or len(data) == READ_ROWS):
                yield batch.column("digest").slice(start, k - start), data
                start, held, data = k, 0, []
            if shard != name:
                if file:
                    file.close()
                file, name = open(shard, "rb", buffering=0), shard  # noqa: SIM115
            file.seek(offset)
            data.append(file.read(n))
            held += n
        if data:
            yield batch.column("digest").slice(start), data
    if file:
        file.close()


def features(places: DataFrame) -> DataFrame:
    """A row a digest, from the stored bytes read back."""
    ship(places.sparkSession)
    schema = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(data: bytes) -> tuple:
        payload = from_image(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        for digest, data in _ranges(batches, lambda length: length):
            cols = zip(*map(one, data))
            yield pa.RecordBatch.from_arrays([digest, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return _by_shard(places).mapInArrow(run, schema)


def members(path: str) -> dict[str, bytes]:
    """All members of a shard, by any tar reader's view of it."""
    with tarfile.open(path) as t:
        return {m.name: io.BytesIO(t.extractfile(m).read()).getvalue() for m in t.getmembers()}


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(documents(spark, sf_dir), fresh_path(spark, "media"))
    places = materialize(addressed(rows), "media-places")
    # the metadata columns come from the headers alone, what needs the payload from the whole images
    # and are written: a join above a join on the same key couldn't split the rows of a frequent digest
    found = materialize(features(places).join(headers(places), "digest"), "media-columns")
    release(places)
    out = rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")
