import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from tokenizers import Tokenizer

from quernstone.llm import tokenfiles as F
from quernstone.llm.shared import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, part int"
TEXTS = [
    "", " ", "Hello  world", "don't WE'LL I'm 'sup 's 'S", "12 345 a1b2", "a\x1cb \x85c\xa0d　e", "Σίσυφος ΟΔΟΣ", "é café CAFÉ",
    "<|endoftext|> x <|ENDOFTEXT|> <|startoftext|>y", "日本語 한국어 🙂👍🏽 ", "!!'s ''ll ??", "İstanbul İ ǅ ß ﬁ", "x" * 300, "\x00\x01 �", "Étion dans, çouelle un éonierç\nle ch", "½ ² Ⅷ ٣",
]


def slow(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_what_the_whole_text_gives():
    encode = F.word_encoder(PATH)
    texts = [t for t in TEXTS] + [" ".join(TEXTS)]
    for _ in range(2):  # the second time from the caches
        assert [np.frombuffer(x, np.uint16).tolist() + [2] for x in encode(texts)] == [slow(t) for t in texts]


def test_a_word_of_all_batches_is_encoded_once(monkeypatch):
    seen = []

    class Seen:
        def __init__(self, own):
            self.__dict__["own"] = own

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def __getattr__(self, name):
            return getattr(self.own, name)

        def __setattr__(self, name, value):
            setattr(self.own, name, value)

        def encode_batch_fast(self, lines, **settings):
            seen.extend(w for line in lines for w in line.split())
            return self.own.encode_batch_fast(lines, **settings)

    monkeypatch.setattr(tokenizers, "Tokenizer", Seen)
    monkeypatch.setattr(F, "CACHE", 30)
    encode = F.word_encoder.__wrapped__(PATH)
    batches = [[" ".join(["common,", *(f"{a}{b}é" for b in "abcdefgh")]), "", f"common {a}"] for a in "abcdefghijklmnop"]
    for texts in batches:
        assert [np.frombuffer(x, np.uint16).tolist() + [2] for x in encode(texts)] == [slow(t) for t in texts]
    assert seen.count("common") == 1


def test_splits_at_the_spaces_of_the_whole_tokenizer():
    texts = [f"a{chr(c)}b {chr(c)}" for c in [*range(0x20), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, np.uint16).tolist() for x in F.word_encoder(PATH)(texts)] == [e.ids for e in whole]
    assert F.word_encoder(PATH)([]) == []


def test_characters_that_tables_class_differently():
    cps = [*range(0x80, 0x3400, 7), 0x558, 0x58B, 0x88F, 0xC5C, 0x1C89, 0xA7CB, 0x105C9, 0x10D50, 0x16EA0, 0x1E6C0, 0x323B0, 0x3D000, 0x10FFFF]
    texts = [f"A{chr(c)}b 1{chr(c)}! {chr(c)}X's {chr(c)}{chr(0x1C89)}" for c in cps]
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, np.uint16).tolist() for x in F.word_encoder(PATH)(texts)] == [e.ids for e in whole]


def test_an_id_that_many_rows_share_is_many_parts_work(spark):
    df = spark.createDataFrame([(k % 40 if k % 3 else None, f"text {k}", None, 1) for k in range(1200)], SCHEMA)
    parts = F.write(df, fresh_path(spark, "tokens"), PATH, end_id=2).collect()
    assert max(r.documents for r in parts) < 400 < sum(r.documents for r in parts) == 1200


def test_files_read_back(spark):
    rows = [(k * 7 % 31 - 5, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, None, "", 2), (400, "same", None, 1), (400, "same", None, 1), (400, "other", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = F.write(df, fresh_path(spark, "tokens"), PATH, end_id=2)
    got = sorted((tuple(r) for r in F.read(parts).collect()), key=lambda r: r[1])
    own = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    want, at = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, own[r[1]])):
        ids = slow(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    for r in parts.collect():
        assert F.tokens_of(r.file, r.base, r.documents - 1)[-1] == 2
        assert Path(r.file + ".ids").stat().st_size == 2 * r.tokens


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert F.read(F.write(df, fresh_path(spark, "tokens"), PATH, end_id=2)).count() == 0


def test_needs_a_mounted_folder(spark):
    with pytest.raises(ValueError, match="mounted"):
        F.write(spark.createDataFrame([(1, "a", "", 1)], SCHEMA), "hdfs://there/x", PATH, end_id=2)
