"""Rule-based classification with weighted word lists."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import taxonomy as T
from quernstone.functions.infer import seniority, source_of
from quernstone.functions.predicates import first_reason, fold_word
from quernstone.functions.text import compact_label, fold, once
from quernstone.operators.phrases import containing

WEIGHTS = (4, 1, -3)

Families = dict[str, tuple[Sequence[str], Sequence[str], Sequence[str]]]


def _table(values: dict, kind: str) -> Column:
    """A constant map: one literal, which the optimizer turns into a map once."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def standing(text: Column, terms: Iterable[str]) -> Column:
    """Which of the folded terms stand in a text: words as tokens, by one intersection, and phrases as substrings."""
    every = sorted({t for t in terms if t})
    one, several = ([t for t in every if (" " in t) == many] for many in (False, True))
    found = F.array_intersect(F.split(text, " "), F.array(*map(F.lit, one))) if one else F.expr("cast(array() as array<string>)")
    return F.concat(found, F.filter(F.array(*map(F.lit, several)), lambda p: F.contains(text, p))) if several else found


def _weights(families: Families) -> dict[str, list[dict[str, int]]]:
    """term -> what it adds to which family, by its place among the sorted names; a term that is listed twice adds twice."""
    out: dict[str, dict[int, int]] = {}
    for k, family in enumerate(sorted(families)):
        for terms, w in zip(families[family], WEIGHTS):
            for t in map(fold_word, terms):
                if t:
                    own = out.setdefault(t, {})
                    own[k] = own.get(k, 0) + w
    return {t: [{"k": k, "w": w} for k, w in own.items()] for t, own in out.items()}


def scores(text: Column, families: Families = T.FAMILIES, hits: Column | None = None) -> Column:
    """array<struct<score, family>> of positive scores, best first, ties by name: weighted sums of the terms that stand in the text. Every listed
    term counts, also one that folds as another. Expressions on the row: no shuffle. hits: what standing() gave for
    these terms and perhaps others."""
    weights = _weights(families)
    entries = F.flatten(F.transform(standing(text, weights) if hits is None else hits, lambda t: F.coalesce(F.element_at(_table(weights, "array<struct<k:int,w:int>>"), t), F.expr("cast(array() as array<struct<k:int,w:int>>)"))))
    names = sorted(families)
    sums = F.aggregate(entries, F.array(*[F.lit(0)] * len(names)), lambda acc, e: F.transform(acc, lambda x, i: F.when(i == e["k"], x + e["w"]).otherwise(x)))
    every = F.zip_with(sums, F.array(*map(F.lit, names)), lambda x, f: F.struct(x.alias("score"), f.alias("family")))
    found = F.filter(every, lambda s: s["score"] > 0)
    return F.array_sort(found, lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(F.when(a["family"] < b["family"], -1).when(a["family"] > b["family"], 1).otherwise(0)))


def term_table(spark: SparkSession, families: Families = T.FAMILIES) -> DataFrame:
    """family, term, weight: a row a listed term, repeats included. A few hundred rows."""
    rows = [(f, fold_word(t), w) for f, lists in families.items() for terms, w in zip(lists, WEIGHTS) for t in terms]
    return spark.createDataFrame(rows, "family string, term string, weight int")


def score_rows(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """The same scores as rows (key, family, score), for term tables too large for expressions.

    Terms of one word meet the texts' distinct tokens, those of several the pairs of neighbours: equi-joins, which Spark broadcasts if
    the terms are few enough."""
    single, several = terms.filter("instr(term, ' ') = 0"), terms.filter("instr(term, ' ') > 0")
    tokens = docs.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("term"))
    hits = tokens.join(single, "term").select(key, "family", "weight")
    phrases = containing(docs, key, text, several, "term").join(several, F.col("needle") == F.col("term")).select(key, "family", "weight")
    return hits.unionByName(phrases).groupBy(key, "family").agg(F.sum("weight").alias("score")).filter("score > 0")


def technologies(text: Column, aliases: dict[str, list[str]] = T.TECHNOLOGIES, hits: Column | None = None) -> Column:
    """Names, sorted, of which an alias stands in the text."""
    folded = {name: [f for a in own if (f := fold_word(a))] for name, own in aliases.items()}
    names: dict[str, list[str]] = {}
    for name, own in folded.items():
        for a in own:
            names.setdefault(a, []).append(name)
    found = F.transform(standing(text, names) if hits is None else hits, lambda t: F.coalesce(F.element_at(_table(names, "array<string>"), t), F.expr("cast(array() as array<string>)")))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def classify(jobs: DataFrame) -> DataFrame:
    """jobs with `classification`. A blocked title wins over scores but keeps technologies and seniority;
    a score of one names its family out of scope."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "location", "modality", "description")])
    text = F.col("_text")
    terms = [*_weights(T.FAMILIES), *[fold_word(a) for own in T.TECHNOLOGIES.values() for a in own]]
    work = once(jobs, "_text", fold(joined))  # each step once a row, however often the next one uses it
    work = once(work, "_hits", standing(text, terms))
    work = once(work, "_scores", scores(text, hits=F.col("_hits")))
    work = once(work, "_tech", technologies(text, hits=F.col("_hits")))
    work = once(work, "_title", fold(F.coalesce(F.col("title"), F.lit(""))))
    work = once(work, "_blocked", first_reason(F.col("_title"), T.BLOCKED_TITLES))
    best = F.get("_scores", F.lit(0))
    other = F.col("_blocked").isNotNull() | (F.size("_scores") == 0)
    related = F.transform(F.filter(F.slice("_scores", 2, F.greatest(F.size("_scores"), F.lit(1))), lambda s: s["score"] >= 3), lambda s: s["family"])
    extra = F.when((best["family"] == "mobile") & F.array_contains("_tech", "react-native"), F.array(F.lit("frontend"))).otherwise(F.expr("cast(array() as array<string>)"))
    confidence = F.round(F.least(F.lit(0.99), F.lit(0.35) + best["score"] * F.lit(0.08)), 2)
    reason = F.coalesce(F.col("_blocked"), F.when(F.size("_scores") == 0, "nenhuma familia reconhecida").when(best["score"] < 2, "score abaixo do minimo").otherwise("classificacao local por titulo descricao tecnologias"))
    out = F.struct(
        F.when(other, F.lit("other")).otherwise(best["family"]).alias("primaryFamily"),
        F.when(other, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.concat(related, extra))).alias("relatedFamilies"),
        F.col("_tech").alias("technologies"),
        seniority(text).alias("seniority"),
        F.when(other, F.lit(False)).otherwise(best["score"] >= 2).alias("inScope"),
        F.when(other, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.array(reason).alias("reasons"),
    )
    return once(work, "classification", out).drop("_text", "_hits", "_scores", "_tech", "_title", "_blocked")


def in_scope(jobs: DataFrame) -> DataFrame:
    return jobs.filter("classification.inScope")


def funnel(jobs: DataFrame) -> DataFrame:
    """Per source: what came in, what was approved, and what the rejected ones had."""
    rejected = ~F.col("classification.inScope")
    return jobs.groupBy(source_of(F.col("source"), F.col("sources")).alias("source")).agg(
        F.count(F.lit(1)).alias("input"),
        F.count_if(F.col("classification.inScope")).alias("approved"),
        F.count_if(rejected).alias("rejected"),
        F.count_if(rejected & (F.trim(F.coalesce("description", F.lit(""))) != "")).alias("rejected_with_description"),
        F.count_if(rejected & (F.size(F.coalesce("keywords", F.expr("cast(array() as array<string>)"))) > 0)).alias("rejected_with_keywords"),
        F.count_if(rejected & (F.size("classification.technologies") > 0)).alias("rejected_with_technologies"),
    )


def top_counts(rows: DataFrame, group: str, label: Column, k: int) -> DataFrame:
    """The k most frequent labels of each group as `label=count`, ties by label. Counts shuffle, not rows."""
    counts = rows.groupBy(group, compact_label(label, "unknown").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "label"))).filter(F.col("rank") <= k)
    return ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "n"))), lambda x: F.concat_ws("=", x["label"], x["n"].cast("string"))).alias("top"))
