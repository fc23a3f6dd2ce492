"""Legacy archives: ARC files become WARC files.

An ARC file begins with a version block: a header line of the file itself, a line with the version, and a line that names the fields. Records
follow, each a header line and as many bytes as that line declares last. The lines differ by version: five fields in version 1, ten in version 2 (with
result code, checksum, location, offset and file name before the length). Files are plain or have a gzip member a record.

The converter makes of each record a WARC record: an identifier derived from the file's name and the place in it, so that a repeated task
makes the same; a date from the 14 (or 12, or 8) digits; a type by what the record is (the file's own block is `warcinfo`, what begins with an HTTP status line
`response`, anything else `resource`); and digests of block and payload. Of responses with equal payloads of at least LEAST
bytes, one stays, that of the largest key, and the others become `revisit` records: headers only, and the identifier of the one that stays.

On Spark: files are scanned side by side, an index row a record (place, digest, size, key); which record stays is a maximum a digest over
that narrow index; then tasks take stretches of files, read records by ranges and write WARC files. Payloads never shuffle. Files that tasks finished
are named in a written table, so those of repeated or lost tasks don't count. Archives are read back file by file.

Defined results: a null text is an empty payload; a null key is smaller than any other; of equal keys the record that comes last by file and
place stays; equal payloads below LEAST bytes all stay responses; a URL that is null or empty is `about:blank`, blanks and control characters in it are
escaped; a record cut off by the file's end keeps what is there, and its WARC record says so (`WARC-Truncated`); a header line that can't be read ends a plain
file and skips a gzip member: the index has a row with the `problem`, no WARC record; a table without rows makes no archives; repeated
rows are records of their own; other columns are not read. One record at a time is in memory, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.shared import fresh_path, materialize, named, posix, release, ship, sliced

#: Fields of a header line by version (fixed values).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Bytes after which a writer begins another archive, and those of the stretches that converting tasks take.
ARCHIVE_BYTES, STRETCH_BYTES = 100 << 20, 16 << 20
#: Bytes of a payload from which on repeats become revisits.
LEAST = 1000
#: The HTTP header that carries a record's key, and the date of captures that have none.
KEY, DATE = "X-Archive-Key", "19970101000000"
#: What a revisit is, by the WARC standard (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6
READ = 1 << 14


# ARC --------------------------------------------------------------------------------------------


class ArcRecord(NamedTuple):
    offset: int
    size: int  # bytes in the file, compressed or not
    fields: dict[str, str]
    content: bytes
    missing: int  # bytes that the header declares and the file lacks
    problem: str | None


def escaped(url: str | None) -> str:
    """A URL without characters that would end a field."""
    text = re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return text or "about:blank"


def version_block(version: int, name: str, date: str = DATE) -> bytes:
    """The first record of an ARC file."""
    names = " ".join(FIELDS[version])
    body = f"{version} 0 quernstone\n{names}\n".encode()
    more = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, name: str, offset: int) -> bytes:
    """A header line of the version, the content, and the line end that parts records."""
    more = f" 200 {zlib.crc32(content):08x} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime}{more} {len(content)}\n".encode("utf-8", "replace") + content + b"\n"


def fields_of(line: bytes, version: int) -> dict[str, str] | None:
    """A header line by its version; fields are counted from the end, since old URLs may hold blanks. None if it is no header."""
    names = FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit() or not re.fullmatch(r"\d{8}(\d{4}(\d\d)?)?", parts[2]):
        return None
    return dict(zip(names, parts))


def version_of(data: bytes) -> tuple[int, dict[str, str], int] | None:
    """Version, header fields and end of a version block; None where data is none. Its header line has five fields or ten, whatever its version."""
    head, _, rest = data.partition(b"\n")
    number = rest[:1]
    if not head.startswith(b"filedesc://") or number not in (b"1", b"2"):
        return None
    version = int(number)
    fields = fields_of(head, version) or fields_of(head, 3 - version)
    return fields and (version, fields, len(head) + 1 + int(fields["Archive-length"]))


class _Reader:
    """Bytes of a plain file with the place read so far."""

    def __init__(self, file: BinaryIO):
        self.file, self.at = file, file.tell()

    def line(self) -> bytes:
        out = self.file.readline()
        self.at += len(out)
        return out

    def take(self, n: int) -> bytes:
        out = self.file.read(n)
        self.at += len(out)
        return out


def members(file: BinaryIO) -> Iterator[tuple[int, int, bytes | None]]:
    """Offset, size and content of each gzip member from where the file stands; a content of None is a stretch that can't be read, up
    to the next place with a member's first bytes."""
    at = file.tell()
    while True:
        file.seek(at)
        packer, out, used = zlib.decompressobj(31), [], 0
        while not packer.eof and (data := file.read(READ)):
            try:
                out.append(packer.decompress(data))
            except zlib.error:
                used = max(used, 1)
                break
            used += len(data) - len(packer.unused_data)
        if not used:
            return
        if not packer.eof:
            used = _next_member(file, at + 1) - at
        yield at, used, b"".join(out) if packer.eof else None
        at += used


def _next_member(file: BinaryIO, at: int) -> int:
    """The place of a member's first bytes from a place on, or the file's end."""
    while True:
        file.seek(at)
        data = file.read(READ)
        if (k := data.find(b"\x1f\x8b\x08")) >= 0:
            return at + k
        if len(data) < READ:
            return at + len(data)
        at += len(data) - 2


def read_arc(file: BinaryIO) -> Iterator[ArcRecord]:
    """All records of an ARC file, its version block first."""
    packed = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    version: int | None = None
    if packed:
        for at, size, data in members(file):
            if data is None:
                yield ArcRecord(at, size, {}, b"", 0, "damaged member")
            elif version is None:
                if (block := version_of(data)) is None:
                    yield ArcRecord(at, size, {}, b"", 0, "no version block")
                    return
                version = block[0]
                yield ArcRecord(at, size, block[1], data[data.index(b"\n") + 1 : block[2]], 0, None)
            else:
                yield parsed(at, size, data, version)
        return
    reader = _Reader(file)
    start = reader.take(1 << 16)
    if (block := version_of(start)) is None:
        if start:
            yield ArcRecord(0, len(start), {}, b"", 0, "no version block")
        return
    version = block[0]
    yield ArcRecord(0, block[2], block[1], start[start.index(b"\n") + 1 : block[2]], 0, None)
    file.seek(block[2])
    reader = _Reader(file)
    while True:
        at, line = reader.at, reader.line()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        fields = fields_of(line, version)
        if fields is None:
            yield ArcRecord(at, len(line), {}, b"", 0, "no header line")
            return
        n = int(fields["Archive-length"])
        content = reader.take(n)
        yield ArcRecord(at, reader.at - at, fields, content, n - len(content), None)


def parsed(at: int, size: int, data: bytes, version: int) -> ArcRecord:
    """The record in a member's bytes, or in those of a range of a plain file."""
    data = data.lstrip(b"\r\n") if data[:1] in (b"\r", b"\n") else data
    head, _, rest = data.partition(b"\n")
    fields = fields_of(head, version)
    if fields is None:
        return ArcRecord(at, size, {}, b"", 0, "no header line")
    n = int(fields["Archive-length"])
    return ArcRecord(at, size, fields, rest[:n], max(0, n - len(rest)), None)


def http_parts(content: bytes) -> tuple[bytes, bytes] | None:
    """Status line with headers (and the blank line), and the payload; None where content is no HTTP response."""
    if not content.startswith(b"HTTP/"):
        return None
    blank = re.search(rb"\n\r?\n", content)
    end = blank.end() if blank else len(content)
    return content[:end], content[end:]


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, sep, value = line.partition(b":")
        if sep and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


# WARC -------------------------------------------------------------------------------------------


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_of(name: str) -> str:
    return base64.b32decode(name.removeprefix("sha1:")).hex()


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def warc_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def converted(record: ArcRecord, file: str, stays: tuple[str, int, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record. stays: file, offset, URL and date digits of the record whose payload this one repeats."""
    f, content = record.fields, record.content
    url, date = f["URL"], warc_date(f["Archive-date"])
    base = [("WARC-Record-ID", record_id(file, record.offset)), ("WARC-Date", date)]
    cut = ("WARC-Truncated", "length" if record.missing else None)
    if record.offset == 0:
        block = f"software: quernstone\r\nformat: WARC File Format 1.1\r\ndescription: converted from {file}\r\n".encode()
        return warc_record([("WARC-Type", "warcinfo"), *base, ("WARC-Filename", file), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", sha1_name(block))], block)
    ip = f["IP-address"]
    base += [("WARC-Target-URI", url), ("WARC-IP-Address", None if ip in ("0.0.0.0", "-") else ip)]
    http = http_parts(content)
    if http is None:
        mime = "text/dns" if url.startswith("dns:") else f["Content-type"]
        return warc_record([("WARC-Type", "resource"), *base, cut, ("Content-Type", mime), ("WARC-Block-Digest", sha1_name(content)), ("WARC-Payload-Digest", sha1_name(content))], content)
    head, payload = http
    kind = ("Content-Type", "application/http; msgtype=response")
    if stays is None:
        return warc_record([("WARC-Type", "response"), *base, cut, kind, ("WARC-Block-Digest", sha1_name(content)), ("WARC-Payload-Digest", sha1_name(payload))], content)
    to = [("WARC-Refers-To", record_id(stays[0], stays[1])), ("WARC-Refers-To-Target-URI", stays[2]), ("WARC-Refers-To-Date", warc_date(stays[3])), ("WARC-Profile", PROFILE)]
    return warc_record([("WARC-Type", "revisit"), *base, *to, cut, kind, ("WARC-Block-Digest", sha1_name(head)), ("WARC-Payload-Digest", sha1_name(payload))], head)


def read_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of each record of a WARC file that has a gzip member a record."""
    for at, _, data in members(file):
        if data is None or not data.startswith(b"WARC/"):
            raise ValueError(f"damaged archive at byte {at}")
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = {}
        for line in head.split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            headers[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = rest[: int(headers["content-length"])]
        if headers.get("warc-block-digest", sha1_name(block)) != sha1_name(block):
            raise ValueError(f"block and digest differ at byte {at}")
        yield headers, block


# Files on Spark ---------------------------------------------------------------------------------


class Archive:
    """An archive of gzip members that a task writes; done() gives it its name."""

    def __init__(self, folder: str, name: str):
        self.name, self.path, self.size, self.records = name, f"{folder}/{name}", 0, 0
        self.file = open(self.path + ".tmp", "wb", buffering=1 << 20)  # noqa: SIM115

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.file.write(packed)
        self.size += len(packed)
        self.records += 1

    def done(self) -> tuple[str, int, int]:
        self.file.close()
        os.replace(self.path + ".tmp", self.path)
        return self.path, self.size, self.records


FILES = "file string, bytes long, records long"


def _written(archives: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*archives), (pa.string(), pa.int64(), pa.int64()))], names=["file", "bytes", "records"])


def write_arc(rows: DataFrame, folder: str, payload: Column, key: Column, url: Column, version: Callable[[int], int] = lambda task: 1 + task % 2) -> DataFrame:
    """Writes rows as legacy archives of HTTP responses, tasks in turn in version 1 and 2, and returns the files: file, bytes, records."""
    ship(rows.sparkSession)
    place = posix(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        which, done, archive = version(task.partitionId()), [], None
        os.makedirs(place, exist_ok=True)
        for batch in sliced(batches):
            for own, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or archive.size > ARCHIVE_BYTES:
                    done += [archive.done()] if archive else []
                    archive = Archive(place, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.arc.gz")
                    archive.add(version_block(which, archive.name))
                body = (text or "").encode("utf-8", "replace")
                known = "" if own is None else f"{KEY}: {own}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(body)}\r\n\r\n".encode()
                archive.add(arc_record(which, escaped(at), DATE, "text/html", head + body, archive.name, archive.size))
        if archive:
            yield _written([*done, archive.done()])

    out = rows.select(key.cast("long").alias("key"), url.cast("string").alias("url"), payload.cast("string").alias("text"))
    return materialize(out.mapInArrow(run, FILES), "arc-files")


INDEX = "file string, offset long, size long, packed boolean, version int, kind string, url string, date string, key long, payload_bytes long, digest binary, problem string"


def scanned(files: DataFrame) -> DataFrame:
    """The index of ARC files (column `file`, one task each): a row a record, version blocks and what can't be read included."""
    ship(files.sparkSession)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in INDEX.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        with open(posix(path), "rb", buffering=1 << 20) as file:
            packed = file.read(2) == b"\x1f\x8b"
            file.seek(0)
            version = 1
            for r in read_arc(file):
                url = r.fields.get("URL")
                if r.problem:
                    yield path, r.offset, r.size, packed, version, "problem", None, None, None, None, None, r.problem
                    continue
                if url.startswith("filedesc://") and r.offset == 0:
                    version, kind, key, payload = int(r.content[:1]), "warcinfo", None, None
                elif http := http_parts(r.content):
                    kind, key, payload = "response", http_field(http[0], KEY), http[1]
                else:
                    kind, key, payload = "resource", None, r.content
                number = int(key) if key and re.fullmatch(r"-?\d{1,19}", key) else None
                yield path, r.offset, r.size, packed, version, kind, url, r.fields["Archive-date"], number, None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).digest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return one_each(files.select("file")).mapInArrow(run, INDEX)


def one_each(files: DataFrame) -> DataFrame:
    """Files dealt out so that each is a task's, as far as there are tasks."""
    n = files.count()  # a number
    return files.repartition(max(1, min(n, 10_000)), "file") if n else files


def decided(index: DataFrame, least: int = LEAST) -> DataFrame:
    """The index with the place, URL and date of the record that a repeated payload refers to (null where a record stays).

    The digests that occur more than once are written before the join, which adaptive execution can then split at very frequent ones."""
    long = index.filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    best = long.groupBy("digest").agg(F.max(F.struct("key", "file", "offset", "url", "date")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = materialize(best.select("digest", F.col("b.file").alias("to_file"), F.col("b.offset").alias("to_offset"), F.col("b.url").alias("to_url"), F.col("b.date").alias("to_date")), "warc-stays")
    to = ["to_file", "to_offset", "to_url", "to_date"]
    other = (F.col("to_file") != F.col("file")) | (F.col("to_offset") != F.col("offset"))
    repeats = long.join(best, "digest", "left").select(*index.columns, *[F.when(other, F.col(c)).alias(c) for c in to])
    # what can't be a revisit has nothing to look up, and doesn't meet in one task for want of a key
    rest = index.filter(~F.coalesce((F.col("kind") == "response") & (F.col("payload_bytes") >= least), F.lit(False)))
    return repeats.unionByName(rest, allowMissingColumns=True)


def convert(index: DataFrame, folder: str) -> DataFrame:
    """Writes the WARC files of a decided index and returns them: file, bytes, records. A task takes stretches of ARC files, in order."""
    ship(index.sparkSession)
    place = posix(folder)

    def record(file: BinaryIO, offset: int, size: int, packed: bool, version: int) -> ArcRecord:
        file.seek(offset)
        data = file.read(size)
        data = zlib.decompress(data, 31) if packed else data
        if offset == 0:
            _, fields, end = version_of(data)
            return ArcRecord(0, size, fields, data[data.index(b"\n") + 1 : end], 0, None)
        return parsed(offset, size, data, version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        done, archive, file, name = [], None, None, None
        os.makedirs(place, exist_ok=True)
        for batch in batches:
            for path, offset, size, packed, version, to_file, to_offset, to_url, to_date in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    if file:
                        file.close()
                    file, name = open(posix(path), "rb", buffering=1 << 18), path  # noqa: SIM115
                if archive is None or archive.size > ARCHIVE_BYTES:
                    done += [archive.done()] if archive else []
                    archive = Archive(place, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz")
                stays = None if to_file is None else (os.path.basename(to_file), to_offset, to_url, to_date)
                archive.add(converted(record(file, offset, size, packed, version), os.path.basename(path), stays))
        if file:
            file.close()
        if archive:
            yield _written([*done, archive.done()])

    some = index.filter("problem IS NULL").select("file", "offset", "size", "packed", "version", "to_file", "to_offset", "to_url", "to_date")
    dealt = some.repartition("file", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset")
    return materialize(dealt.mapInArrow(run, FILES), "warc-files")


RECORDS = "record_id string, record_type string, target_uri string, date string, key long, payload_bytes long, payload_digest string, to_id string"


def read_back(files: DataFrame) -> DataFrame:
    """The records of WARC files (column `file`, one task each), digests checked: record_id, record_type, target_uri, date, key, payload_bytes, payload_digest
    (bare hex SHA-1), to_id. A revisit's size is that its kept headers declare."""
    ship(files.sparkSession)
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind, http = h["warc-type"], http_parts(block)
        payload = http[1] if http else block
        key = http_field(http[0], KEY) if http else None
        digest = h.get("warc-payload-digest")
        if kind == "revisit":
            n = http_field(http[0], "Content-Length") if http else None
        else:
            n = str(len(payload))
            if digest and digest != sha1_name(payload):
                raise ValueError(f"payload and digest differ in {h['warc-record-id']}")
        return h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], int(key) if key else None, int(n) if n else None, digest and hex_of(digest), h.get("warc-refers-to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(posix(path), "rb", buffering=1 << 20) as file:
                    held = []
                    for h, block in read_warc(file):
                        held.append(row(h, block))
                        if len(held) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return one_each(files.select("file")).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """records with refers_to, the key of the record that a revisit names. What is named is written first, for the same reason as in decided()."""
    wanted = records.filter("to_id IS NOT NULL").select(F.col("to_id").alias("record_id")).distinct()
    named_ = materialize(records.filter("record_type = 'response'").join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("to_id"), F.col("key").alias("refers_to")), "warc-named")
    found = records.filter("to_id IS NOT NULL").join(named_, "to_id", "left").select(*records.columns, "refers_to")
    return found.unionByName(records.filter("to_id IS NULL"), allowMissingColumns=True)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arcs = write_arc(pages, fresh_path(spark, "arc"), payload=named("html"), key=named("page_id"), url=named("url"))
    index = materialize(scanned(arcs), "arc-index")
    warcs = convert(decided(index), fresh_path(spark, "warc"))
    release(index)
    records = materialize(read_back(warcs), "warc-records")
    out = resolved(records).filter("record_type IN ('response', 'revisit')")
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND k > 1 THEN top END AS refers_to
FROM q
"""
