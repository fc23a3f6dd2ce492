"""Language ID by compression: each language has a zstandard raw-content dictionary of its own text;
a text belongs to the language whose dictionary makes it smallest, unless the margin is narrow.

Texts are lower-cased, everything but letters and their marks becomes one space, a word repeated on the spot counts once,
and the result is compressed in pieces of PIECE characters, so that a long text is measured against the dictionaries
throughout and not against its own beginning. The sizes of all pieces count, whatever the text's length.

The dictionaries come from a bounded sample of the labelled rows: SAMPLE_ROWS rows a language at most,
those with the smallest hash of their id and text, a repeated row once, whatever number of rows share an id. Each of them has an equal share of the DICTIONARY_BYTES; a text that is longer than
that gives stretches from its beginning to its end, evenly spaced.

Defined results: a null text, or one without a letter (Unicode's category L), is `und` with score 0 and rejected; where two languages
tie, pieces are measured again with their words rotated, and what ties even so goes to the language that comes first by name; a null id counts as no held-out row and is not learned from;
repeated rows are all returned, and learned from once; a very long text is compressed in pieces, whole; without any labelled row every text is `und`; extra columns are kept
by `keep_identified`, whatever their names, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import documents, map_rows, materialize, named, release, ship, sliced

#: Rows a language that the dictionaries are taken from, at most.
SAMPLE_ROWS = 400
#: Languages that are learned, at most: those with the most rows (of equals the first by name). The rest counts as not labelled.
LANGUAGES = 100
#: Bytes of a dictionary, about.
DICTIONARY_BYTES = 100_000
#: Stretches that a sampled text is read in, and their characters: evenly spaced over the whole text.
STRETCHES, STRETCH_CHARS = 8, 250
#: Characters compressed at a time.
PIECE = 400
#: zstandard's level: below 7 or so, its matches in the dictionary are too few to tell languages apart.
LEVEL = 9
#: Rotations of a piece's words that settle a tie.
TURNS = 8
#: A text is rejected if the best size is not this share smaller than the second best.
MARGIN = 0.01

HASHES = 1 << 40
NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def normalised(text: str) -> str:
    """Lower-case words with single spaces between; a word repeated on the spot counts once."""
    return " ".join([w for w, _ in groupby(NO_LETTERS.sub(" ", text.lower()).split())])


def picks(rows: DataFrame) -> dict[str, int]:
    """For each language that is learned, the place up to which its rows are in the sample. rows: lang, place (of id and text, so
    repeated rows have one place).

    Distinct places are spread evenly, so a share of their range is ranked that holds about twice as many as wanted; where it holds
    fewer it is widened, at last to all. A row a language comes to the driver, of LANGUAGES languages at most."""
    places = materialize(rows.distinct(), "sample-places")
    many = places.groupBy("lang").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), "lang").limit(LANGUAGES)
    share = {lang: (2.0 * SAMPLE_ROWS + 100) / n for lang, n in many.collect()}
    found: dict[str, int] = {}
    while share:
        bound = _by_language({lang: min(HASHES, int(HASHES * x)) for lang, x in share.items()})
        near = places.filter(F.col("place") < bound).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("n") <= SAMPLE_ROWS)
        got = {lang: (n, last) for lang, n, last in near.groupBy("lang").agg(F.count(F.lit(1)), F.max("place")).collect()}
        settled = {lang: got[lang][1] for lang, x in share.items() if lang in got and (got[lang][0] == SAMPLE_ROWS or x >= 1)}
        found |= settled
        share = {lang: x * 4 for lang, x in share.items() if lang not in settled}
    release(places)
    return found


def _by_language(values: dict[str, int]) -> Column:
    """A value for each language, null for the others."""
    keys, longs = (F.array(*[F.lit(x) for x in xs]) for xs in (values.keys(), values.values()))
    return F.element_at(F.map_from_arrays(keys, longs.cast("array<long>")), F.col("lang"))


def learn(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> dict[str, bytes]:
    """A dictionary for each language. A place for each row is written, of which the smallest SAMPLE_ROWS a language are
    picked; then the picked rows' stretches are read, once for rows that are repeated: SAMPLE_ROWS * STRETCHES *
    STRETCH_CHARS characters a language at most come to the driver, of LANGUAGES languages at most (the most frequent ones)."""
    labelled = docs.filter(named(lang_col).isNotNull() & named(id_col).isNotNull() & named(text_col).isNotNull())
    rows = labelled.select(named(id_col).alias("id"), named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text"))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("id", "text"), F.lit(HASHES)).alias("place"))
    last = picks(rows.select("lang", "place"))
    if not last:
        return {}
    spare = F.greatest(F.length("text") - STRETCH_CHARS, F.lit(0))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substr(F.col("text"), F.floor(k * spare / (STRETCHES - 1)).cast("int") + 1, F.lit(STRETCH_CHARS)))
    parts = F.when(F.length("text") <= STRETCHES * STRETCH_CHARS, F.array("text")).otherwise(spaced)
    picked = rows.filter(F.col("place") <= _by_language(last)).select("lang", "place", parts.alias("parts")).groupBy("lang", "place").agg(F.min("parts").alias("parts"))
    texts: dict[str, list[tuple[int, list[str]]]] = {}
    for lang, place, some in picked.collect():
        texts.setdefault(lang, []).append((place, some))
    return {lang: dictionary([x for _, x in sorted(texts[lang])]) for lang in sorted(texts)}


def dictionary(texts: list[list[str]], size: int = DICTIONARY_BYTES) -> bytes:
    """Equal shares of all texts, each given as stretches of it: what short ones leave goes to the longer ones."""
    plain = [[p for x in some if (p := normalised(x).encode())] for some in texts]
    lengths = sorted(sum(map(len, some)) + len(some) for some in plain)
    room, share = size, size
    for k, n in enumerate(lengths):
        share = room // (len(lengths) - k)
        if n > share:
            break
        room -= n
    out = []
    for some in plain:
        each = max(1, share // max(1, len(some)))
        fits = sum(map(len, some)) + len(some) <= share
        out += some if fits else [x[:each] for x in some]
    return b" ".join(out)[:size] or b" " * 8


def classifier(dictionaries: dict[str, bytes]) -> Callable[[str | None], tuple[str, float, bool]]:
    """text -> (language, score, rejected). The score is the margin to the second best size, scaled to 0..1."""
    langs = sorted(dictionaries)
    packers = []
    for lang in langs:
        d = zstandard.ZstdCompressionDict(dictionaries[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def pieces(text: str) -> list[str]:
        step = -(-len(text) // -(-len(text) // PIECE))  # pieces of about the same length
        return [text[at : at + step] for at in range(0, len(text), step)]

    def sizes(parts: list[str]) -> list[int]:
        total = [0] * len(langs)
        for part in parts:
            data = part.encode("utf-8", "replace")
            for k, p in enumerate(packers):
                total[k] += len(p.compress(data))
        return total

    def turned(part: str) -> list[str]:
        """A piece with its words in every rotation, up to TURNS of them: bytes are coarse, their sum is less so."""
        words = part.split()
        return [" ".join(words[k:] + words[:k]) for k in range(min(TURNS, len(words)))] + [f" {part} "]

    def classify(text: str | None) -> tuple[str, float, bool]:
        plain = normalised(text) if text and LETTER.search(text) else ""
        if not plain or not langs:
            return "und", 0.0, True
        if len(langs) == 1:
            return langs[0], 1.0, False
        cut = pieces(plain)
        total = sizes(cut)
        if sorted(total)[0] == sorted(total)[1]:
            total = sizes([x for part in cut for x in turned(part)])
        (best, k), (second, _) = sorted((s, i) for i, s in enumerate(total))[:2]
        margin = 1 - best / second
        return langs[k], min(1.0, margin * 4), margin < MARGIN

    return classify


def predictions(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row. Only the text is looked at."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(dictionaries)
        for batch in sliced(batches):
            if batch.num_rows:
                lang, score, rejected = zip(*map(classify, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 3 == 1, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    dictionaries = learn(docs.filter(~held_out()), "text", "lang", "doc_id")
    out = predictions(docs, dictionaries)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told clearly, all columns as they are."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        classify = classifier(dictionaries)
        for batch in sliced(batches):
            keep = pa.array([not classify(x)[2] for x in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep).columns

    return map_rows(docs, run)
