"""Facet search over the inverted index, verified against the rows, with paging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.infer import country_search, level_search, model_search
from quernstone.functions.predicates import fold_word
from quernstone.functions.text import comparable
from quernstone.functions.text import once as text_once
from quernstone.operators.match import score
from quernstone.operators.paging import Page, page_of
from quernstone.operators.phrases import containing


@dataclass
class Query:
    """A parsed search. Facets that only the index knows (contract, continent, state, city) aren't verified,
    and so a search that falls back to the rows ignores them."""

    keywords: list[str] = field(default_factory=list)
    family: list[str] = field(default_factory=list)
    technology: list[str] = field(default_factory=list)
    type: list[str] = field(default_factory=list)
    level: str = ""
    seniority: str = ""
    location: str = ""
    country: str = ""
    contract: str = ""
    continent: str = ""
    state: str = ""
    city: str = ""
    match_sort: str = ""

    @classmethod
    def parse(cls, params: dict[str, str | list[str]]) -> Query:
        """From request parameters: lists repeat or have commas; `model` goes before `type`; the contract has three names."""

        def many(name: str) -> list[str]:
            raw = params.get(name) or []
            return [p.strip() for x in ([raw] if isinstance(raw, str) else raw) for p in x.split(",") if p.strip()]

        def one(*names: str) -> str:
            return next((many(n)[0] for n in names if many(n)), "")

        order = one("matchSort", "sort").lower()
        return cls(many("keywords"), many("family"), many("technology"), many("model") or many("type"), one("level"), one("seniority"), one("location"), one("country"), one("contract", "contractType", "jobTypes"), one("continent"), one("state"), one("city"), order if order in ("asc", "desc") else "")

    def facets(self) -> dict[str, list[str]]:
        """kind -> folded values; kinds without a value are left out."""
        raw = {"family": self.family, "technology": self.technology, "model": self.type, "level": [level_of(self.level)], "seniority": [level_of(self.seniority)], "country": [self.country], "contract": [self.contract], "continent": [self.continent], "state": [self.state], "city": [self.city], "location": [self.location]}
        folded = {k: [f for v in vs if (f := fold_word(v)) and f not in ("todos", "all")] for k, vs in raw.items()}
        return {k: v for k, v in folded.items() if v}


def variants(keyword: str) -> list[str]:
    """The values under which a keyword may be indexed: as typed, folded, with `js` joined or apart, and each term."""
    legacy = " ".join(keyword.strip().lower().replace("/", " ").split())
    folded = fold_word(keyword)
    terms = folded.split()
    joined = f"{terms[0]}js" if len(terms) > 1 and terms[1] == "js" and terms[0].isascii() else ""
    apart = f"{folded[:-2]} js" if len(folded) > 2 and folded.endswith("js") and " " not in folded and folded.isascii() else ""
    return list(dict.fromkeys(v for v in (legacy, folded, joined, apart, *terms) if v))


def ids_of_keywords(index: DataFrame, keywords: list[str]) -> DataFrame:
    """The union of all postings of all variants, as keyword, technology or family."""
    values = sorted({v for k in keywords for v in variants(k)})
    return index.filter(F.col("kind").isin("keyword", "technology", "family") & F.col("value").isin(values)).select("id").distinct()


def ids_of_facets(index: DataFrame, facets: dict[str, list[str]], keywords: list[str] | None = None) -> DataFrame:
    """Any value inside a facet, all facets together: one pass over the postings that count, one aggregation."""
    groups = [((F.col("kind") == kind) & F.col("value").isin(values), kind) for kind, values in facets.items()]
    if keywords:
        values = sorted({v for k in keywords for v in variants(k)})
        groups.append((F.col("kind").isin("keyword", "technology", "family") & F.col("value").isin(values), "keywords"))
    if not groups:
        return index.filter("kind = 'all'").select("id").distinct()
    wanted = groups[0][0]
    for g, _ in groups[1:]:
        wanted = wanted | g
    # a posting may serve a facet and the keywords, so each group is counted for itself
    seen = [F.max(g.cast("int")).alias(f"g{k}") for k, (g, _) in enumerate(groups)]
    every = F.lit(True)
    for k in range(len(groups)):
        every = every & (F.col(f"g{k}") == 1)
    return index.filter(wanted).groupBy("id").agg(*seen).filter(every).select("id")


#: Values that name the trainee level (fixed values).
TRAINEES = ("estagio trainee", "estagio", "trainee", "intern", "internship")


def level_of(value: str) -> str:
    folded = fold_word(value)
    return "estagio" if folded in TRAINEES else folded


def verify(rows: DataFrame, q: Query) -> DataFrame:
    """Re-checked on the rows: level and model by their search forms, place, type, family, technology, seniority. Folded texts and the
    level are computed once a row. `todos` and `all` ask for nothing."""
    asked = lambda value: fold_word(value) not in ("", "todos", "all")
    own = rows
    conditions: list[Column] = []

    def once(name: str, value: Column) -> Column:
        nonlocal own
        if name not in own.columns:
            own = text_once(own, name, value)
        return F.col(name)

    def level() -> Column:
        return once("_level", level_search(once("_title", comparable(F.coalesce("title", F.lit(""))))))

    if asked(q.level):
        conditions.append(level() == level_of(q.level))
    if asked(q.seniority):
        kind = comparable(F.coalesce("classification.seniority", F.lit("")))
        kind = F.when(kind.isin(*TRAINEES), "estagio").otherwise(kind)
        conditions.append((kind == level_of(q.seniority)) | (level() == level_of(q.seniority)))
    if asked(where := q.location or q.country):
        place = once("_place", comparable(F.coalesce("location", F.lit(""))))
        named = once("_country", country_search(place))
        conditions.append(F.when(named != "", named == fold_word(where)).otherwise(F.contains(place, F.lit(fold_word(where)))))
    if kinds := [fold_word(t) for t in q.type if asked(t)]:
        text = once("_text", comparable(F.concat_ws(" ", *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in ("title", "location", "modality", "description")])))
        conditions.append(model_search(text).isin(kinds))
    folded = lambda items: F.transform(items, comparable)
    if families := [fold_word(f) for f in q.family if asked(f)]:
        mine = F.array_append(folded(F.col("classification.relatedFamilies")), comparable(F.col("classification.primaryFamily")))
        conditions.append(F.arrays_overlap(mine, F.array(*map(F.lit, families))))
    if technologies := [fold_word(t) for t in q.technology if asked(t)]:
        conditions.append(F.arrays_overlap(folded(F.col("classification.technologies")), F.array(*map(F.lit, technologies))))
    for c in conditions:
        own = own.filter(F.coalesce(c, F.lit(False)))
    return own.select(*rows.columns)


def search(jobs: DataFrame, index: DataFrame, q: Query, page: Page, profile: list[tuple[str, float]] | None = None) -> tuple[DataFrame, str]:
    """A page of results and the path that gave it. The index finds ids, the rows verify them; an empty
    index result falls back to verifying all rows that the keywords name. Order is by match score where asked for, then by id."""
    facets = q.facets()
    if facets:
        # the ids are looked up once: what is tested for emptiness is what the rows are joined with
        ids, source = ids_of_facets(index, facets, q.keywords).persist(), "index"
        if ids.isEmpty():
            ids.unpersist()
            ids, source = (ids_of_keywords(index, q.keywords) if q.keywords else index.filter("kind = 'all'").select("id").distinct()), "fallback"
        rows = verify(jobs.join(ids, "id", "left_semi"), q)
    else:
        source = "keywords" if q.keywords else "all"
        rows = jobs.join(ids_of_keywords(index, q.keywords) if q.keywords else index.filter("kind = 'all'").select("id").distinct(), "id", "left_semi")
    if profile:
        rows = score(rows, F.concat_ws(" ", *[F.col(c) for c, kind in rows.dtypes if kind == "string"]), profile)
    order = [F.col("id")]
    if q.match_sort and profile:
        by = F.coalesce("match_score", F.lit(0))
        order = [by.desc() if q.match_sort == "desc" else by.asc(), *order]
    return page_of(rows, order, page), source


#: Words that a long passage is looked up by: a power of two.
ANCHOR = 8


def _looks(rows: DataFrame, words: Column) -> DataFrame:
    """rows with hashes of each of the words (_h1) and of ANCHOR words from each on (_h8), one of two shorter ones: a pass over a text a
    doubling. Near its end they are of fewer words."""
    rows, n = text_once(rows, "_h1", F.transform(words, lambda w: F.xxhash64(w))), 1
    while n < ANCHOR:
        own = F.col(f"_h{n}")
        rows = text_once(rows, f"_h{2 * n}", F.zip_with(own, F.slice(own, n + 1, F.size(own)), lambda a, b: F.xxhash64(a, b))).drop(*([f"_h{n}"] if n > 1 else []))
        n *= 2
    return rows


def passages_in(texts: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """(passage_key, key) wherever a folded passage stands in a folded text as a substring.

    A passage may begin and end inside words, so it is looked up by what follows its first word, ANCHOR words or
    if it has fewer than two more, its second word alone; passages of one or two words by parts of the vocabulary's tokens: equi-joins."""
    words = F.split(F.col(passage), " ")
    asked = passages.select(passage_key, passage, F.size(words).alias("_n"))
    second = F.lit(1)
    look = F.when(F.col("_n") >= ANCHOR + 2, F.get(f"_h{ANCHOR}", second)).otherwise(F.get("_h1", second))
    looked = _looks(asked.filter("_n > 2"), words).select(passage_key, look.alias("_look"))
    every = F.array_distinct(F.concat(f"_h{ANCHOR}", "_h1"))
    pairs = _looks(texts.select(key, text), F.split(text, " ")).select(key, F.explode(every).alias("_look")).join(looked, "_look").select(passage_key, key).distinct()
    stands = F.contains(F.col(text), F.col(passage))
    found = pairs.join(texts.select(key, text), key).join(asked.select(passage_key, passage), passage_key).filter(stands).select(passage_key, key)
    few = asked.filter("_n < 3").select(passage_key, passage)
    if few.isEmpty():
        return found
    short = containing(texts, key, text, few, passage).join(few, F.col("needle") == F.col(passage)).select(passage_key, key)
    return found.unionByName(short)
