import hashlib
import zlib

import numpy as np
import pytest

from quernstone.llm import media as M
from quernstone.llm.shared import fresh_path

SCHEMA = "doc_id long, text string, digest string, shard int"
TEXTS = ["", None, "a", "x" * 64, "x" * 65, "Étion dans\nçouelle " * 300, "a", "\x00\x00", "x" * 64, "y" * 100_000]


@pytest.mark.parametrize("text", TEXTS)
def test_image_round_trip(text):
    n, payload = M.payload_of(text)
    assert n == len((text or "").encode()) and len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0")
    image = M.to_image(payload)
    assert M.from_image(image) == payload
    assert M.read_header(image[: M.HEADER_BYTES]) == (64, len(payload) // 64, 8)


def test_damage_is_noticed():
    image = bytearray(M.to_image(b"\1" * 640))
    image[45] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        M.from_image(bytes(image))


def test_feature_by_hand():
    payload = bytes(range(256)) * 8
    x = np.frombuffer(payload, np.uint8)
    f = M.feature_of(payload)
    assert f.startswith(f"mean={x.mean():.4f};std={x.std():.4f};ahash=")
    assert M.feature_of(payload) == f != M.feature_of(payload[::-1])


@pytest.mark.parametrize("shard", [1, 256 << 20])
def test_columns_against_the_texts(spark, monkeypatch, shard):
    monkeypatch.setattr(M, "SHARD_BYTES", shard)
    rows = [(k if k != 4 else None, t, None, 1) for k, t in enumerate(TEXTS)]
    index = M.store(spark.createDataFrame(rows, SCHEMA).repartition(3), fresh_path(spark, "media"))
    places = M.addressed(index)
    assert places.count() == len({M.payload_of(t)[1] for t in TEXTS})
    for r in places.collect():
        assert hashlib.sha256(M.members(r.shard)[r.digest.hex()]).digest() == bytes(r.digest)
    heads = {bytes(r.digest): (r.width, r.height, r.depth) for r in M.headers(places).collect()}
    found = {bytes(r.digest): r for r in M.features(places).collect()}
    got = {r.doc_id: (r.n_bytes, bytes(r.digest)) for r in index.collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        n, payload = M.payload_of(t)
        image = M.to_image(payload)
        digest = hashlib.sha256(image).digest()
        assert got[d] == (n, digest)
        r = found[digest]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), M.feature_of(payload))
        assert heads[digest] == (64, len(payload) // 64, 8)


def test_empty(spark):
    assert M.store(spark.createDataFrame([], SCHEMA), fresh_path(spark, "media")).count() == 0


def test_headers_read_nothing_else(spark):
    rows = [(k, t, None, 1) for k, t in enumerate(TEXTS)]
    places = M.addressed(M.store(spark.createDataFrame(rows, SCHEMA).coalesce(1), fresh_path(spark, "media")))
    found = places.collect()
    want = {bytes(r.digest): (r.width, r.height, r.depth) for r in M.headers(places).collect()}
    for shard in {r.shard for r in found}:  # all but the headers becomes noise
        data = bytearray(open(shard, "rb").read())
        heads = {b for r in found if r.shard == shard for b in range(r.offset, r.offset + M.HEADER_BYTES)}
        open(shard, "wb").write(bytes(x if k in heads else 255 for k, x in enumerate(data)))
    assert {bytes(r.digest): (r.width, r.height, r.depth) for r in M.headers(places).collect()} == want


def test_query_takes_metadata_from_headers(spark, tmp_path):
    spark.createDataFrame([(k, t, None, 1) for k, t in enumerate(TEXTS)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in M.op5_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        n, payload = M.payload_of(t)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].width, got[k].height, got[k].depth) == (n, len(payload), 64, len(payload) // 64, 8)


def test_rows_of_a_frequent_digest_are_dealt_out(spark, tmp_path):
    """Both sides of the last join come from files through exchanges of their own, so that adaptive execution may split either."""
    spark.createDataFrame([(k, "same", None, 1) for k in range(50)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.op5_media(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning(digest") == 2 and "Aggregate" not in plan
