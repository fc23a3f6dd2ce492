import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quernstone.llm import sentpieces as P

SCHEMA = "doc_id long, text string, piece string"
TEXTS = [
    "", " ", "  ", "     x", "Hello  world", " a b ", "a\nb\tc\r\n", "a \n b", "ﬁ Å é　x", "▁x ▁", "\u200bq", "日本語 語 梦 龘 ▁", "\x00a", "🙂👍🏽 ok", "x" * 200, "ab" * 500, "▁" * 40, " " * 75 + "the",
    "der Straße\n\n\n  über", "<s> </s> <unk> <0x41>", "thth ththth erblethth aaaa aaaaa aaaaaaaa", "Étion dans, çouelle un éonierç\nle ch", "  梦   梦", "\n", "\n\n x", "1234567890 3.14", "don't I'm we'll",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


def ids(encoder, texts):
    return [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]


def test_ids_are_the_library_s(library):
    encoder = P.Encoder(P.Pieces(P.model_path()))
    for _ in range(2):
        got = ids(encoder, TEXTS)
        assert got == [library.encode(t) for t in TEXTS]
    assert [encoder.decode(np.array(x)) for x in got] == [library.decode(library.encode(t)) for t in TEXTS]


def test_random_words(library):
    rng = random.Random(1)
    for alphabet in ("ab", "aeht ", "abcdefghijklmnopqrstuvwxyz  \n", "éèabou ▁ß"):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
        assert ids(P.Encoder(P.Pieces(P.model_path())), texts) == [library.encode(t) for t in texts]


def test_unigram_is_viterbi(monkeypatch):
    """The states of shared prefixes give the best sum of scores, against all segmentations."""
    p = P.Pieces(P.model_path(), "unigram")
    p.id = {w: k for k, w in enumerate([" ", "a", "b", "ab", "ba", " a", "aba", "bab"])}
    p.score = dict(zip(p.id, [-3.0, -2.1, -2.3, -3.1, -3.2, -4.0, -4.9, -5.05]))
    p.scores = {k: p.score[w] for w, k in p.id.items()}
    p.longest = 3
    encoder = P.Encoder(p)
    rng = random.Random(2)
    words = sorted({" " + "".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(60)})
    encoder.learn(words)
    names = list(p.id)

    def best(w):
        if not w:
            return 0.0
        return max(p.score[w[:n]] + best(w[n:]) for n in (1, 2, 3) if w[:n] in p.score)

    for w in words:
        got = [names[k] for k in np.frombuffer(encoder.words[w], "<u2")]
        assert "".join(got) == w
        assert sum(p.score[x] for x in got) == pytest.approx(best(w))


def test_rows(spark, library):
    rows = [(k, t, "keep") for k, t in enumerate(TEXTS)] + [(None, None, None), (3, "dup", None), (3, "dup", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.encoded(df, P.model_path())
    assert got.columns == ["doc_id", "text", "piece", "n_pieces", "ids", "same"]
    back = P.decoded(got, P.model_path()).collect()
    assert len(back) == len(rows)
    for r in back:
        want = library.encode(r.text or "")
        assert (r.ids, r.n_pieces) == (want, len(want))
        assert r.same == (r.decoded == (r.text or "")) == ("▁" not in (r.text or ""))
    assert P.encoded(df.limit(0), P.model_path()).count() == 0
    again = P.encoded(got.withColumn("a.b", F.lit(1)).withColumnRenamed("n_pieces", "N_Pieces"), P.model_path())
    assert again.columns == ["doc_id", "text", "piece", "a.b", "n_pieces", "ids", "same"] and again.count() == len(rows)


def test_kind_is_read_from_the_file():
    assert P.model_kind(P.model_path()) == P.Pieces(P.model_path()).kind == "bpe"


def test_forward_scores_of_merges(library):
    """All ways to write a word as pieces: the one whose neighbours all stay as they are is the model's own, and there is one."""
    p = P.Pieces(P.model_path())
    encoder = P.Encoder(p)

    def ways(w):
        if not w:
            return [[]]
        return [[p.id[w[:n]], *rest] for n in range(1, len(w) + 1) if w[:n] in p.id for rest in ways(w[n:])]

    for w in (" the", " house", "ab", " aaaa", " erthe", "thth"):
        finite = [x for x in ways(w) if sum(encoder._gain_bpe(a, b) for a, b in zip([P.START, *x], x)) == 0]
        encoder.learn([w])
        assert [np.frombuffer(encoder.words[w], "<u2").tolist()] == finite
        if w.startswith(" "):
            assert finite == [library.encode(w[1:])]


def test_caches_start_anew(monkeypatch, library):
    monkeypatch.setattr(P, "CACHE", 3)
    monkeypatch.setattr(P, "TOGETHER", 2)
    encoder = P.Encoder(P.Pieces(P.model_path()))
    assert [ids(encoder, TEXTS[a:b]) for a, b in P._groups(TEXTS)] == [[library.encode(t) for t in TEXTS[a:b]] for a, b in P._groups(TEXTS)]
