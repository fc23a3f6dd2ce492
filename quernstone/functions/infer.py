"""Facets inferred from texts: the first rule that matches wins. Texts are folded before.

The index and the search infer level and model differently (all text against the title, tokens against stems);
a search result satisfies both, so both stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import taxonomy as T
from quernstone.functions.predicates import any_of, any_substring


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str, match=any_of) -> Column:
    out = F.lit(default)
    for value, words in reversed(list(rules)):
        out = F.when(match(text, words), F.lit(value)).otherwise(out)
    return out


def _level(text: Column, trainee: Sequence[str]) -> Column:
    return first_rule(text, [("estagio", trainee), ("senior", T.SENIOR), ("junior", T.JUNIOR)], "pleno")


def level_index(text: Column) -> Column:
    return _level(text, T.TRAINEE_INDEX)


def seniority(text: Column) -> Column:
    return _level(text, T.TRAINEE_CLASSIFIER)


def level_search(title: Column) -> Column:
    return _level(title, T.TRAINEE_SEARCH)


def model_index(text: Column) -> Column:
    return first_rule(text, T.MODEL_TOKENS, "presencial")


def model_search(text: Column) -> Column:
    return first_rule(text, T.MODEL_STEMS, "presencial", any_substring)


def contract(text: Column) -> Column:
    return first_rule(text, T.CONTRACTS, "")


def state(text: Column) -> Column:
    return first_rule(text, T.STATES, "")


def city(text: Column) -> Column:
    return first_rule(text, [(c, [c]) for c in T.CITIES], "")


def country_search(text: Column) -> Column:
    return first_rule(text, T.SEARCH_COUNTRIES, "")


def place(text: Column) -> Column:
    """struct<country, location, continent, state, city>. A state makes the country Brasil where none was named,
    over a remote place, too; of several states the first declared counts."""
    country = first_rule(text, [(c, a) for c, _, a in T.COUNTRIES], "")
    continent = first_rule(text, [(k, a) for _, k, a in T.COUNTRIES], "")
    remote = any_of(text, T.GLOBAL_WORDS)
    brazil = (country == "") & (state(text) != "")
    label = lambda named, home: F.when(brazil, F.lit(home)).when(named != "", named).when(remote, F.lit(T.GLOBAL_LABEL)).otherwise("")
    return F.struct(
        F.when(brazil, F.lit("Brasil")).otherwise(country).alias("country"),
        label(country, "Brasil").alias("location"),
        label(continent, "América do Sul").alias("continent"),
        state(text).alias("state"),
        city(text).alias("city"),
    )


def proficiency(years: Column) -> Column:
    out = F.lit(95)
    for limit, value in ((8, 85), (5, 70), (3, 55), (2, 40), (1, 25)):
        out = F.when(years < limit, F.lit(value)).otherwise(out)
    return F.when(years <= 0, F.lit(15)).otherwise(out)


def health(states: Column) -> Column:
    """Of an array of states: down before degraded before ok."""
    return F.when(F.exists(states, lambda s: s == "down"), "down").when(F.exists(states, lambda s: s == "degraded"), "degraded").otherwise("ok")


def source_of(source: Column, sources: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(source), F.lit("")), F.nullif(F.trim(F.get(sources, F.lit(0))), F.lit("")), F.lit("unknown"))


#: Beginnings of source names and the families that they stand for; the last one in any case (fixed values).
ADAPTERS = ["Adzuna", "Green House", "Lever", "The Muse", "Jooble"]
ANY_CASE = "linkedin"


def adapter_family(source: Column) -> Column:
    """The feed that a source's name begins with, or the name itself."""
    out = F.when(F.startswith(F.lower(source), F.lit(ANY_CASE)), F.lit(ANY_CASE)).otherwise(source)
    for name in reversed(ADAPTERS):
        out = F.when(F.startswith(source, F.lit(name)), F.lit(name)).otherwise(out)
    return out
