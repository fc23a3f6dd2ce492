"""Inverted index as a long table (kind, value, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.infer import contract, level_index, model_index, place
from quernstone.functions.text import fold, unique_trimmed


#: Stands for the words `node js` side by side, or for `nodejs`.
PAIR = "\u0001"


def aliases_of(keyword: Column) -> Column:
    """Under which values a keyword's postings are kept."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(keyword), F.lit("/"), F.lit(" ")), r"\s+", " "))
    folded = fold(keyword)
    extra = F.when(F.contains(folded, F.lit("node js")), F.array(F.replace(folded, F.lit("node js"), F.lit("nodejs")), F.lit("nodejs"), F.lit("node"))).otherwise(F.expr("cast(array() as array<string>)"))
    return unique_trimmed(F.concat(F.array(plain, folded), extra))


def terms_of(keyword: Column) -> Column:
    terms = F.split(fold(keyword), " ")
    pair = (F.get(terms, F.lit(0)) == "node") & (F.get(terms, F.lit(1)) == "js")
    return unique_trimmed(F.when(pair, F.array_append(terms, F.lit("nodejs"))).otherwise(terms))


def token_postings(jobs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term) of distinct tokens: what single terms join with."""
    return jobs.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.split(text, " "))).alias("term")).filter("term <> ''")


def keyword_index(jobs: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """Jobs in which all terms of a keyword stand, under the keyword's aliases.

    A keyword's terms join the tokens, and a job that has as many of them as the keyword has distinct ones is a match. The pair
    `node js` in a keyword is one term, which a job has that has these words side by side, or `nodejs`; it is marked once a job."""
    marked = F.trim(F.regexp_replace(F.concat(F.lit(" "), F.col("folded"), F.lit(" ")), " node js(?= )", f" {PAIR}"))
    kw = keywords.select("keyword", fold(F.col("keyword")).alias("folded")).filter("folded <> ''").distinct().withColumn("folded", marked)
    terms = kw.select("keyword", F.array_distinct(F.split("folded", " ")).alias("t")).select("keyword", F.size("t").alias("need"), F.explode("t").alias("term"))
    tokens = F.array_distinct(F.split(text, " "))
    has = F.contains(F.col(text), F.lit("node js")) | F.array_contains(tokens, "nodejs")
    own = jobs.select(F.col(key).alias("id"), F.explode(F.when(has, F.array_append(tokens, F.lit(PAIR))).otherwise(tokens)).alias("term"))
    found = own.join(terms, "term").groupBy("id", "keyword").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need")).filter("have = need").select("id", "keyword")
    return found.select(F.lit("keyword").alias("kind"), F.explode(aliases_of(F.col("keyword"))).alias("value"), "id").distinct()


def subterm_index(jobs: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """Jobs under every single term of every keyword."""
    terms = keywords.select(F.explode(terms_of(F.col("keyword"))).alias("term")).distinct()
    return token_postings(jobs, key, text).join(terms, "term").select(F.lit("keyword").alias("kind"), F.col("term").alias("value"), "id").distinct()


def structured_index(jobs: DataFrame, key: str) -> DataFrame:
    """level, model, contract and the five kinds of place; blank values and those that mean all are left out."""
    text = fold(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "location", "modality", "description")]))
    base = jobs.select(F.col(key).alias("id"), text.alias("text"), place(fold(F.coalesce(F.col("location"), F.lit("")))).alias("p"))
    pairs = {"level": level_index(F.col("text")), "model": model_index(F.col("text")), "contract": contract(F.col("text")), **{k: F.col(f"p.{k}") for k in ("country", "location", "continent", "state", "city")}}
    long = base.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), fold(v).alias("value")) for k, v in pairs.items()])).alias("e")).select("e.kind", "e.value", "id")
    return long.filter(~F.col("value").isin("", "todos", "all")).distinct()


def classification_index(jobs: DataFrame, key: str) -> DataFrame:
    """family, technology and seniority; families and technologies also serve as keywords."""
    c = F.col("classification")
    families = F.array_distinct(F.concat(F.array(c["primaryFamily"]), c["relatedFamilies"]))
    entries = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), fold(v).alias("value")))
    every = F.concat(entries("family", families), entries("technology", c["technologies"]), entries("keyword", families), entries("keyword", c["technologies"]), F.array(F.struct(F.lit("seniority").alias("kind"), fold(c["seniority"]).alias("value"))))
    return jobs.filter(c.isNotNull()).select(F.explode(every).alias("e"), F.col(key).alias("id")).select("e.kind", "e.value", "id").filter("value <> ''").distinct()


def global_index(jobs: DataFrame, key: str) -> DataFrame:
    return jobs.select(F.lit("all").alias("kind"), F.lit("").alias("value"), F.col(key).alias("id")).distinct()


def build(jobs: DataFrame, key: str, keywords: DataFrame) -> DataFrame:
    """The whole index; rows without an id are skipped."""
    known = jobs.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    text = fold(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "location", "modality", "description")]))
    texts = known.select(key, text.alias("text"))
    parts = [keyword_index(texts, key, "text", keywords), subterm_index(texts, key, "text", keywords), structured_index(known, key), classification_index(known, key), global_index(known, key)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


