import gzip
import hashlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.llm import warc as A
from quernstone.llm.shared import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, file string"
SF = "/root/testdata/sf0.001"

V1 = (
    b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 75\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"http://a.example/x y 10.0.0.1 19961104142103 text/html 35\nHTTP/1.0 200 OK\nA: b\n\n<b>\nhello</b>\n"
    b"dns:a.example 10.0.0.2 199611041421 text/dns 8\n20200101\n"
    b"ftp://a.example/f 10.0.0.3 19961104 text/plain 5\nx\ny\n\n\n"
)
V2 = (
    b"filedesc://new.arc 0.0.0.0 20020923142103 text/plain 200 - - 0 new.arc 114\n2 0 Someone\n"
    b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n\n\n"
    b"http://a.example/ 10.0.0.1 20021104142103 text/html 302 abc http://b.example/ 209 new.arc 20\nHTTP/1.1 302 X\r\n\r\nhi\n"
)


def read(data):
    return list(A.read_arc(io.BytesIO(data)))


def test_version_1_by_hand():
    block, page, dns, ftp = read(V1)
    assert block.fields["Archive-length"] == "75" and block.content.startswith(b"1 0 Alexa")
    assert (page.fields["URL"], page.fields["IP-address"], page.fields["Archive-date"], page.content) == ("http://a.example/x y", "10.0.0.1", "19961104142103", b"HTTP/1.0 200 OK\nA: b\n\n<b>\nhello</b>")
    assert (dns.fields["Content-type"], dns.content, ftp.content) == ("text/dns", b"20200101", b"x\ny\n\n")
    assert V1[page.offset :].startswith(b"http://a.example/x y") and A.parsed(page.offset, page.size, V1[page.offset : page.offset + page.size], 1) == page
    assert A.http_parts(page.content)[1] == b"<b>\nhello</b>"


def test_version_2_by_hand():
    block, page = read(V2)
    assert block.fields["Filename"] == "new.arc"
    assert page.fields == {"URL": "http://a.example/", "IP-address": "10.0.0.1", "Archive-date": "20021104142103", "Content-type": "text/html", "Result-code": "302", "Checksum": "abc", "Location": "http://b.example/", "Offset": "209", "Filename": "new.arc", "Archive-length": "20"}
    assert page.content == b"HTTP/1.1 302 X\r\n\r\nhi"


def test_what_is_synthesised():
    _, page, dns, ftp = read(V1)

    def back(r, stays=None):
        packed = gzip.compress(A.converted(r, "old.arc", stays))
        ((h, block),) = A.read_warc(io.BytesIO(packed))
        return h, block

    h, block = back(page)
    assert block == page.content
    assert {k: h[k] for k in ("warc-type", "warc-target-uri", "warc-date", "warc-ip-address")} == {"warc-type": "response", "warc-target-uri": "http://a.example/x y", "warc-date": "1996-11-04T14:21:03Z", "warc-ip-address": "10.0.0.1"}
    assert A.hex_of(h["warc-payload-digest"]) == hashlib.sha1(b"<b>\nhello</b>").hexdigest()
    assert A.hex_of(h["warc-block-digest"]) == hashlib.sha1(page.content).hexdigest()
    assert h["warc-record-id"] == back(page)[0]["warc-record-id"] != back(dns)[0]["warc-record-id"]
    assert [back(r)[0][k] for r in (dns, ftp) for k in ("warc-type", "content-type", "warc-date")] == ["resource", "text/dns", "1996-11-04T14:21:00Z", "resource", "text/plain", "1996-11-04T00:00:00Z"]
    h, block = back(page, ("other.arc", 5, "http://o.example/", "19960101"))
    assert (h["warc-type"], block, h["warc-refers-to"], h["warc-refers-to-date"]) == ("revisit", b"HTTP/1.0 200 OK\nA: b\n\n", A.record_id("other.arc", 5), "1996-01-01T00:00:00Z")
    assert A.hex_of(h["warc-payload-digest"]) == hashlib.sha1(b"<b>\nhello</b>").hexdigest()
    assert back(read(V1)[0])[0]["warc-type"] == "warcinfo"


def test_damage():
    assert [r.problem for r in read(V1 + b"no header\nhttp://x 1 19990101 a 1\nz\n")] == [None] * 4 + ["no header line"]
    cut = read(V1[:-3])
    assert cut[-1].missing == 2 and b"WARC-Truncated: length" in A.converted(cut[-1], "f")
    assert [r.problem for r in read(b"<html>")] == ["no version block"] and read(b"") == []
    whole = [gzip.compress(x) for x in (A.version_block(2, "f.arc.gz"), *(A.arc_record(2, f"http://x/{k}", "19990101", "text/html", b"HTTP/1.0 200\n\n" + bytes([k]) * 90_000, "f", 0) for k in range(4)))]
    sound = read(b"".join(whole))
    assert [(r.problem, r.missing) for r in sound] == [(None, 0)] * 5 and sound[2].content[-1] == 1 and sound[4].offset + sound[4].size == sum(map(len, whole))
    broken = bytearray(whole[2])
    broken[12:] = b"\xff" * (len(broken) - 12)
    got = read(b"".join([*whole[:2], bytes(broken), *whole[3:]]))
    assert [r.problem for r in got] == [None, None, "damaged member", None, None] and [r.fields.get("URL") for r in got[3:]] == ["http://x/2", "http://x/3"]
    assert [r.problem for r in read(b"".join(whole)[:-5])] == [None] * 4 + ["damaged member"]
    with pytest.raises(ValueError, match="damaged"):
        list(A.read_warc(io.BytesIO(b"\x1f\x8b\x08 nothing")))


def test_plain_and_packed_files_on_spark(spark, tmp_path):
    (tmp_path / "old.arc").write_bytes(V1)
    (tmp_path / "new.arc").write_bytes(V2)
    (tmp_path / "bad.arc").write_bytes(b"<html>")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("old.arc", "new.arc", "bad.arc")], "file string")
    index = A.scanned(files)
    assert sorted((r.file.rsplit("/", 1)[1], r.kind) for r in index.collect()) == [("bad.arc", "problem"), ("new.arc", "response"), ("new.arc", "warcinfo"), ("old.arc", "resource"), ("old.arc", "resource"), ("old.arc", "response"), ("old.arc", "warcinfo")]
    records = A.read_back(A.convert(A.decided(index), fresh_path(spark, "warc"))).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in records if r.record_type != "warcinfo") == [("resource", 5), ("resource", 8), ("response", 2), ("response", 13)]
    assert sum(r.record_type == "warcinfo" for r in records) == 2


def brute(rows):
    out, groups = [], {}
    for i, (key, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((key is not None, key or 0, i))
    for data, of in groups.items():
        top = max(of)
        for has, key, i in of:
            again = len(data) >= 1000 and i != top[2]
            out.append((key if has else None, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[1] if again and top[0] else None))
    return sorted(out, key=str)


ROWS = [
    *[(k, f"http://x.example/{k}", "é" * 500) for k in range(30)],
    *[(100 + k, None, "ab" * 499 + "c") for k in range(3)],
    (200, "", None), (201, "has blanks \n\t", ""), (None, "u", "n" * 1000), (None, "u", "n" * 1000), (7, "dup", "d" * 2000), (7, "dup", "d" * 2000), (7, "dup", "d" * 2000),
    (300, "http://long.example", "long\r\n\r\n" * 300_000), (301, "u", "HTTP/1.1 200 OK\r\n\r\n" + "h" * 990), (-5, "filedesc://x", "z" * 1500), (None, "dns:x", "é" * 500),
]


@pytest.mark.parametrize(("parts", "size"), [(1, 100 << 20), (5, 1000)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, parts, size):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", size)
    df = spark.createDataFrame([(*r, "d", "f") for r in ROWS], SCHEMA).repartition(parts)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    out = A.op13_warc(spark, str(tmp_path))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(ROWS)


def test_archives_have_both_versions(spark):
    df = spark.createDataFrame([(*r, "d", "f") for r in ROWS], SCHEMA).repartition(4)
    files = A.write_arc(df, fresh_path(spark, "arc"), F.col("html"), F.col("page_id"), F.col("url"))
    index = A.scanned(files)
    assert {r.version for r in index.collect()} == {1, 2}
    assert index.filter("kind = 'response'").count() == len(ROWS) and index.filter("kind = 'warcinfo'").count() == files.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    assert A.op13_warc(spark, str(tmp_path)).count() == 0


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got = sorted((tuple(r) for r in A.op13_warc(spark, SF).collect()), key=str)
    assert got == sorted(con.execute(A.OP13_SQL).fetchall(), key=str) and len(got) == 50
