"""Token-or-phrase matching and the filters made of it.

A needle of one word must stand as a whole token; a needle of several is a plain substring, also inside other
words; an empty needle matches nothing. Texts and needles are folded before."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import ACCENTED, PLAIN



def fold_word(value: str) -> str:
    """The folding of a literal, as the column expression does it."""
    plain = value.translate(str.maketrans(ACCENTED, PLAIN))
    plain = "".join(c for c in plain if unicodedata.category(c) != "Mn").lower()
    return " ".join(re.findall(r"[^\W_]+", plain))


def token_match(text: Column, needle: str | Column) -> Column:
    if isinstance(needle, str):
        if not needle:
            return F.lit(False)
        if " " in needle:
            return F.contains(text, F.lit(needle))
        return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {needle} "))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    alone = F.contains(padded, F.concat(F.lit(" "), needle, F.lit(" ")))
    return F.when(needle == "", F.lit(False)).when(F.contains(needle, F.lit(" ")), F.contains(text, needle)).otherwise(alone)


def any_of(text: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [token_match(text, fold_word(n)) for n in needles], F.lit(False))


def any_substring(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def all_terms(text: Column, keyword: Column) -> Column:
    """Every term of the folded keyword stands in the text; `go` and `golang` stand for each other."""
    terms = F.filter(F.split(keyword, " "), lambda t: t != "")
    synonym = lambda t: F.when(t == "go", F.lit("golang")).when(t == "golang", F.lit("go")).otherwise(t)
    return (F.size(terms) > 0) & F.forall(terms, lambda t: token_match(text, t) | token_match(text, synonym(t)))


def keyword_match(text: Column, keyword: Column) -> Column:
    """Every term stands in the text, where the pair `node js` stands for `nodejs`, too."""
    marked = F.trim(F.regexp_replace(F.concat(F.lit(" "), keyword, F.lit(" ")), " node js(?= )", " \u0001"))
    terms = F.filter(F.split(marked, " "), lambda t: t != "")
    pair = token_match(text, "node js") | token_match(text, "nodejs")
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.when(t == "\u0001", pair).otherwise(token_match(text, t)))


def synonym_groups(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """At least one of each group; words with dots, pluses or hashes are substrings."""
    one = lambda w: F.contains(text, F.lit(w)) if re.search(r"[.#+]", w) else token_match(text, w)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [one(w) for w in g]) for g in groups], F.lit(True))


#: Terms of a feed's keywords and what stands for them (fixed values).
SYNONYMS = {
    "developer": ["developer", "engineer", "dev", "software"],
    "desenvolvedor": ["developer", "engineer", "dev", "software"],
    "engineer": ["engineer", "developer"],
    "frontend": ["frontend", "front-end", "front", "ui"],
    "front-end": ["frontend", "front-end", "front", "ui"],
    "backend": ["backend", "back-end", "server"],
    "node.js": ["node.js", "nodejs", "node"],
    "node": ["node.js", "nodejs", "node"],
    "golang": ["golang", "go"],
    "go": ["golang", "go"],
    "javascript": ["javascript", "js"],
    "typescript": ["typescript", "ts"],
    "c#": ["c#", "csharp"],
    ".net": [".net", "dotnet"],
}
#: A term of such a keyword, or a token of a text (fixed value).
TERM = r"[a-z0-9+#.]+"


def synonym_match(text: Column, keyword: str) -> Column:
    """Each term of the keyword, or what stands for it, is in the lower-cased text: as a token, with dots, pluses or hashes also as a
    substring. An empty keyword lets all through, one without a term none."""
    plain = keyword.strip().lower()
    if not plain:
        return F.lit(True)
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    one = lambda w: F.contains(F.lower(text), F.lit(w)) if re.search(r"[.#+]", w) else F.array_contains(tokens, w)
    groups = [SYNONYMS.get(t, [t]) for t in re.findall(TERM, plain)]
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(one, g)) for g in groups]) if groups else F.lit(False)


def first_reason(text: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """`prefix: term` of the first term that matches, in the order of the lists; else null."""
    return F.coalesce(*[F.when(token_match(text, fold_word(t)), F.lit(f"{prefix}: {t}")) for prefix, terms in groups for t in terms])
