"""From raw documents to token ids: each stage calls one operator and works on all that the one before kept.

Every stage takes nulls in any column, repeated rows, very long texts (worked on whole, in pieces) and an empty table, and hands on further columns of docs whatever their
names; `encode` puts a column of its own (mix_slot, mix_place, n_pieces, ids, same) in the place of one of that name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import langid, mixing, sentpieces, simhash, unitdedup
from quernstone.llm.shared import documents, materialize, named, release


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries don't tell clearly go: among them null texts and texts without a letter.
    Rows with a null id or language are judged like any other and not learned from; repeated rows are all kept."""
    dictionaries = langid.learn(docs, "text", "lang", "doc_id")
    return langid.keep_identified(docs, dictionaries)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words a shingle, a Jaccard similarity of 0.8 or more.
    Rows without an id stay; equal rows are copies; blank texts are alike."""
    return simhash.keep_one_per_group(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages stay where they come first; a document that has nothing of its own stays with an empty text, a
    null text stays null; equal rows are one document and all stay."""
    cut = unitdedup.deduplicated(docs, spans=False)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns])


#: How mix_sources and encode mix: the same rows by the same key have the same places. A stage between others returns the columns of
#: documents and no more, so encode works the places out again, from narrow columns; they aren't handed on.
MIX = {"order": ["doc_id", "lang", "n_chars"], "weights": mixing.WEIGHTS}


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix. Files don't keep an order when they are read again: encode states it in columns.
    A null source is a source of its own, null ids are an id like any other, repeated rows have places of their own."""
    return mixing.mixed(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids, checked by decoding, in place of the texts; and each row's place in the mix, whose order is (mix_slot, mix_place).
    A null text has no ids; `same` is false where a text has the mark that stands for spaces."""
    placed = mixing.placed(docs, names={"slot": "mix_slot", "place": "mix_place"}, **MIX)
    return sentpieces.encoded(placed, sentpieces.model_path()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can't express the learned dictionaries, fingerprints with a given seed, reachability and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs, before = materialize(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        release(before)  # what the stage before wrote; the table itself stays
    return docs
