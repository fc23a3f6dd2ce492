"""Search keywords: normalised seeds, combinations with compatible titles, and the key of a search's result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.dedup import distinct_in_order

#: Compatible pairs that are evaluated, also those whose keyword is there already.
MOST_PAIRS = 200
#: What may follow a technology's name in a seed (fixed values).
ROLES = ["developer", "engineer", "analyst", "consultant", "architect"]


def normalised(seeds: DataFrame, keyword: str = "keyword", ordinal: str = "ordinal") -> DataFrame:
    """Trimmed, lower-cased, distinct, in order: keyword, ordinal."""
    return distinct_in_order(seeds, F.lower(F.trim(F.regexp_replace(keyword, r"\s+", " "))), ordinal).withColumnRenamed("value", "keyword")


def combined(seeds: DataFrame, titles: DataFrame, technologies: DataFrame) -> DataFrame:
    """seeds (keyword, ordinal, normalised) and `technology title` for seeds' titles and technologies that share a category.

    titles and technologies: name, categories, ordinal; catalogues of a few hundred rows. Pairs are evaluated title by title."""
    kw = seeds.select("keyword")
    mine = titles.join(kw, titles["name"] == kw["keyword"], "left_semi")
    spelled = technologies.withColumn("spelling", F.explode(F.concat(F.array("name"), F.array(*[F.concat("name", F.lit(f" {r}")) for r in ROLES]))))
    tech = spelled.join(kw, spelled["spelling"] == kw["keyword"], "left_semi").select("name", "categories", "ordinal").dropDuplicates(["name"])
    pairs = (
        mine.select(F.col("name").alias("title"), F.col("ordinal").alias("t"), F.explode("categories").alias("category"))
        .join(tech.select(F.col("name").alias("tech"), F.col("ordinal").alias("k"), F.explode("categories").alias("category")), "category")
        .select("title", "tech", "t", "k")
        .distinct()
    )
    some = pairs.orderBy("t", "k").limit(MOST_PAIRS).withColumn("n", F.row_number().over(Window.orderBy("t", "k")))
    most = seeds.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("most"))
    made = some.join(F.broadcast(most), F.lit(True)).select(F.concat_ws(" ", "tech", "title").alias("keyword"), (F.col("most") + F.col("n")).alias("ordinal"))
    return distinct_in_order(seeds.select("keyword", "ordinal").unionByName(made), F.col("keyword"), "ordinal").withColumnRenamed("value", "keyword")


def query_variants(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Queries that stand for keywords: each keyword itself and its synonyms, with the keywords that each came from."""
    own = keywords.select("keyword", F.col("keyword").alias("query"))
    more = keywords.join(synonyms, "keyword").select("keyword", F.col("synonym").alias("query"))
    return own.unionByName(more).groupBy("query").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


@dataclass
class SearchConfig:
    """What a search's result depends on."""

    keywords: Sequence[str] = ()
    location: str = ""
    geo_id: str = ""
    language: str = ""
    job_types: str = ""
    time_filter: str = ""
    remote_only: bool = False
    sources: Sequence[str] = field(default_factory=list)
    numbers: Sequence[int] = (0, 0, 0, 0, 0)

    def key(self) -> str:
        """Equal for searches that differ in order, case, blanks or repeats only."""
        clean = lambda values: sorted({v for x in values if (v := " ".join(x.split()).lower())})
        one = lambda x: x.strip().lower()
        return ":".join(["jobs", ",".join(clean(self.keywords)), *map(one, (self.location, self.geo_id, self.language, self.job_types, self.time_filter)), str(self.remote_only).lower(), ",".join(clean(self.sources)), *map(str, self.numbers)])
