"""Needles as substrings of folded texts, without comparing every text with every needle.

A needle may begin and end inside words. One of a word lies inside a token; of two, its first word ends a token and its second begins the
next one; of more, the words between are whole tokens. So many needles meet the texts' distinct tokens (the vocabulary, which is small beside the texts)
by parts of tokens, and texts by whole tokens: equi-joins all, of which Spark broadcasts what is small and splits what is frequent. A few needles are a literal of each row's expression: nothing is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As many needles as are looked for in each text itself.
FEW = 64


def _parts(token: Column, lengths: Column, begins: bool, ends: bool) -> Column:
    """The parts of a token that have one of the lengths: anywhere, or only those that begin, or end, it."""
    some = F.filter(lengths, lambda n: n <= F.length(token))
    if begins:
        return F.transform(some, lambda n: F.substr(token, F.lit(1), n))
    if ends:
        return F.transform(some, lambda n: F.substr(token, F.length(token) - n + 1, n))
    return F.array_distinct(F.flatten(F.transform(some, lambda n: F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substr(token, i, n)))))


def _tokens_with(vocabulary: DataFrame, words: DataFrame, begins: bool = False, ends: bool = False) -> DataFrame:
    """(token, word): which words (column `word`) are parts of which tokens. The words' lengths, a number each, come along in one row."""
    words = words.distinct()
    lengths = words.agg(F.collect_set(F.length("word")).alias("_lengths"))  # a few numbers, whatever the words
    cut = vocabulary.crossJoin(lengths).select("token", F.explode(_parts(F.col("token"), F.col("_lengths"), begins, ends)).alias("word"))
    return cut.join(words, "word").select("token", "word").distinct()


def containing(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(key, needle), once each, wherever a needle stands in a text. Texts and needles are folded: words with single blanks between.
    Empty needles stand nowhere; rows of the same key count as one text after another."""
    asked = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct().withColumn("_w", F.split("needle", " "))
    some = [r.needle for r in asked.select("needle").limit(FEW + 1).collect()]
    if 0 < len(some) <= FEW:
        return texts.select(key, F.explode(F.filter(F.array(*map(F.lit, some)), lambda n: F.contains(F.col(text), n))).alias("needle")).distinct()
    kinds = {r.n for r in asked.select(F.least(F.size("_w"), F.lit(3)).alias("n")).distinct().collect()}  # three numbers at most
    tokens = F.split(F.col(text), " ")
    own = texts.select(F.col(key).alias("_key"), tokens.alias("_t"))
    vocabulary = own.select(F.explode(F.array_distinct("_t")).alias("token")).filter("token <> ''").distinct()
    here = own.select("_key", F.explode(F.array_distinct("_t")).alias("token"))
    found = own.select("_key", F.lit("").alias("needle")).filter(F.lit(False))

    if 1 in kinds:
        one = asked.filter(F.size("_w") == 1).select(F.col("needle").alias("word"))
        found = found.unionByName(here.join(_tokens_with(vocabulary, one), "token").select("_key", F.col("word").alias("needle")))
    if 2 in kinds:
        two = asked.filter(F.size("_w") == 2).select("needle", F.get("_w", F.lit(0)).alias("head"), F.get("_w", F.lit(1)).alias("tail"))
        heads = _tokens_with(vocabulary, two.select(F.col("head").alias("word")), ends=True).toDF("first", "head")
        tails = _tokens_with(vocabulary, two.select(F.col("tail").alias("word")), begins=True).toDF("next", "tail")
        # neighbours as one string: distinct structs of an array would be found by comparing all with all
        pairs = F.array_distinct(F.zip_with("_t", F.slice("_t", 2, F.size("_t")), lambda a, b: F.concat(a, F.lit(" "), b)))
        near = own.select("_key", F.explode(pairs).alias("p")).filter("p IS NOT NULL").select("_key", F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("next"))
        found = found.unionByName(near.join(heads, "first").join(tails, "next").select("_key", "head", "tail").distinct().join(two, ["head", "tail"]).select("_key", "needle"))
    if 3 in kinds:
        more = asked.filter(F.size("_w") > 2).select("needle", F.get("_w", F.lit(1)).alias("token"))
        may = here.join(more, "token").select("_key", "needle").distinct()
        found = found.unionByName(may.join(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key").filter(F.contains("_text", F.col("needle"))).select("_key", "needle"))
    return found.distinct().select(F.col("_key").alias(key), "needle")
