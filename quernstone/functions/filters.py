"""What a request, a list's controls or a feed's own rules let through, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import taxonomy as T
from quernstone.functions.infer import first_rule
from quernstone.functions.predicates import any_substring, fold_word
from quernstone.functions.text import fold, soft


@dataclass(frozen=True)
class Request:
    """What a feed is asked for; blank values ask for nothing."""

    keyword: str = ""
    language: str = ""
    location: str = ""
    remote_only: bool = False


def contains_soft(text: Column, needle: str) -> Column:
    return F.contains(soft(text), soft(F.lit(needle)))


def request_match(asked: Request, text: Column, remote: Column, places: Sequence[Column], language: Column | None = None) -> Column:
    """A job without a language passes any; a remote job passes any place."""
    out = F.lit(True)
    if asked.language.strip() and language is not None:
        own = F.coalesce(language, F.lit(""))
        out = out & ((own == "") | (F.lower(own) == asked.language.strip().lower()))
    if asked.keyword:
        out = out & contains_soft(text, asked.keyword)
    if asked.remote_only:
        out = out & remote
    if place := asked.location.strip():
        there = F.lit(False)
        for p in places:
            there = there | contains_soft(F.coalesce(p, F.lit("")), place)
        out = out & (remote | there)
    return out


def technology_job(title: Column, description: Column) -> Column:
    """Whether a title names a concrete technology job: a strong role, a technology with a role, or a generic
    title with either in the title or the description."""

    def of(x: Column) -> Column:
        t, both = x["t"], x["both"]
        strong = any_substring(t, T.STRONG_ROLES)
        paired = any_substring(t, T.SIGNALS) & any_substring(t, T.ROLE_SIGNALS)
        generic = any_substring(t, T.GENERIC_TITLES) & (any_substring(both, T.STRONG_ROLES) | any_substring(both, T.SIGNALS))
        barred = any_substring(t, T.HARD_NEGATIVE) & ~(strong | paired)
        return F.coalesce((t != "") & ~any_substring(t, T.NON_CONCRETE) & ~barred & (strong | paired | generic), F.lit(False))

    # as a lambda's variable the texts are made once a row, however many words they are compared with
    texts = F.struct(soft(title).alias("t"), soft(F.concat_ws(" ", title, description)).alias("both"))
    return F.get(F.transform(F.array(texts), of), F.lit(0))


def list_match(keywords: Column, text: Column, search: str, chosen: Sequence[str]) -> Column:
    """Any of the chosen keywords, and every term of the search (between commas, semicolons and slashes) somewhere in the text."""
    out = F.arrays_overlap(keywords, F.array(*[F.lit(c) for c in chosen])) if chosen else F.lit(True)
    for term in filter(None, map(fold_word, re.split(r"[,;/]+", search))):
        out = out & F.contains(fold(text), F.lit(term))
    return out


def model_match(model: Column, name: str) -> Column:
    """A filter that isn't known lets all through."""
    return model.isin(kinds) if (kinds := T.MODEL_FILTERS.get(name)) else F.lit(True)


def model_filter_of(models: Column) -> Column:
    """The filter that lets just these work models through; Todos if there is none."""
    own = F.array_join(F.array_sort(F.array_distinct(models)), "|")
    out = F.lit("Todos")
    for name, kinds in reversed(T.MODEL_FILTERS.items()):
        out = F.when(own == "|".join(sorted(kinds)), F.lit(name)).otherwise(out)
    return out


def _plain(location: Column) -> Column:
    return F.lower(F.trim(F.coalesce(location, F.lit(""))))


def continent(location: Column) -> Column:
    """By a list's own words, accents and all; the first continent that has one."""
    return first_rule(_plain(location), T.UI_CONTINENTS, "Desconhecido", any_substring)


def place_match(location: Column, continent_name: str = "Todos", country: str = "Todos") -> Column:
    out = F.lit(True) if continent_name == "Todos" else continent(location) == continent_name
    return out if country == "Todos" else out & F.contains(_plain(location), F.lit(country.strip().lower()))


def message_origin(kind: Column, title: Column) -> Column:
    words = F.lower(F.concat_ws(" ", kind, title))
    return F.when(any_substring(words, T.MENTOR_WORDS), "mentor").when(any_substring(words, T.RECRUITER_WORDS), "recruiter").otherwise("system")


def notification_type(kind: Column) -> Column:
    return F.when(kind == "high_match", "match").when(kind.isin("job_applied", "job_status_changed"), "success").otherwise("info")
