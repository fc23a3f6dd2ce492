"""How well a job's text covers a profile's technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.predicates import fold_word, token_match
from quernstone.functions.text import comparable

HIGH = 85


def aliases(name: str) -> list[str]:
    folded = fold_word(name)
    out = [folded]
    if folded.endswith(" js"):
        out.append(folded[:-3] + "js")
    if folded.endswith("js") and len(folded) > 2:
        out.append(folded[:-2].rstrip() + " js" if not folded.endswith(" js") else folded)
    return [a for a in dict.fromkeys(out) if a]


def score(jobs: DataFrame, text: Column, profile: list[tuple[str, float]]) -> DataFrame:
    """Adds match_score and matched_technologies. Names that fold alike are one, the last years win; an empty
    profile gives no score. The profile is a literal: nothing is joined."""
    unique = {fold_word(n): (n.strip(), max(0.0, float(y))) for n, y in profile if n.strip()}
    if not unique:
        return jobs.withColumns({"match_score": F.lit(None).cast("int"), "matched_technologies": F.expr("cast(null as array<string>)")})
    folded = comparable(text)
    work = jobs.withColumn("_text", folded)
    hit = {}
    for key, (name, _) in unique.items():
        one = F.lit(False)
        for a in aliases(name):
            one = one | token_match(F.col("_text"), a)
        hit[key] = one
    total = sum(max(1.0, y) for _, y in unique.values())
    matched = F.filter(F.array(*[F.when(h, F.struct(F.lit(unique[k][0]).alias("name"), F.lit(max(1.0, unique[k][1])).alias("w"))) for k, h in hit.items()]), lambda x: x.isNotNull())
    work = work.withColumn("_m", matched)
    return scored(work, F.size("_m"), F.aggregate("_m", F.lit(0.0), lambda a, x: a + x["w"]) / F.lit(total)).withColumn("matched_technologies", F.transform("_m", lambda x: x["name"])).drop("_m", "_text")


def scored(rows: DataFrame, n: Column, coverage: Column) -> DataFrame:
    """45 without a match; else 55, up to 35 for the share of weight, and 4 a technology up to 9; 99 at most."""
    value = F.least(F.lit(99), F.lit(55) + F.floor(coverage * 35 + 0.5) + F.least(n * 4, F.lit(9)))
    return rows.withColumn("match_score", F.when(n == 0, F.lit(45)).otherwise(value).cast("int"))


#: The share of a profile's weight without which no number of technologies gives HIGH: 55 + 35 * share + 9.
HIGH_SHARE = (HIGH - 55 - 9 - 0.5) / 35


def score_profiles(texts: DataFrame, profiles: DataFrame, share: float = 0.0) -> DataFrame:
    """texts (id, text folded) by profiles (user_id, term folded, years): user_id, id, match_score for every pair that
    shares a technology and, where a share is given, at least that of the profile's weight.

    Terms meet tokens in an equi-join, so that users and texts never cross. With a share, only a profile's rarest terms look for
    texts: as many as it takes that the others together have less than the share. Their pairs are then scored with all terms."""
    last = profiles.groupBy("user_id", "term").agg(F.max_by("years", "ordinal").alias("years"))
    weights = last.withColumn("w", F.greatest(F.lit(1.0), F.greatest(F.lit(0.0), F.col("years"))))
    totals = weights.groupBy("user_id").agg(F.sum("w").alias("total"))
    tokens = texts.select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("term")).filter("term <> ''")
    asking = weights
    if share > 0:
        common = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("_many"))
        rest = Window.partitionBy("user_id").orderBy(F.coalesce("_many", F.lit(0)), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        ranked = weights.join(common, "term", "left").withColumn("_rest", F.sum("w").over(rest)).join(totals, "user_id")
        asking = ranked.filter(F.col("_rest") >= F.lit(share) * F.col("total") - 1e-9).select("user_id", "term", "w")
        pairs = tokens.join(asking, "term").select("user_id", "id").distinct()
        hits = pairs.join(weights, "user_id").join(tokens, ["id", "term"])
    else:
        hits = tokens.join(weights, "term")
    found = hits.groupBy("user_id", "id").agg(F.sum("w").alias("matched"), F.count(F.lit(1)).alias("n")).join(totals, "user_id")
    found = found.filter(F.col("matched") >= F.lit(share) * F.col("total") - 1e-9)
    return scored(found, F.col("n"), F.col("matched") / F.col("total")).select("user_id", "id", "match_score")


def high_matches(scores: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of HIGH or more that have no notification yet."""
    return scores.filter(F.col("match_score") >= HIGH).join(existing, keys, "left_anti")
