"""Text normalisers as column expressions. They differ on purpose; each says what it keeps."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.entities import unescaped


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter and marks, and their bases."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _folding()

#: The accent map of one board's location names (fixed values).
PT_ACCENTED, PT_PLAIN = "áàãâéêíóôõúç", "aaaaeeiooouc"

#: Runs of white space of any script.
SPACES = r"[\s\x0B\x{85}\p{Z}]+"


def without_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{Mn}", "")


def fold(x: Column) -> Column:
    """Lower case, no accents, letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(without_accents(x)), r"[^\p{L}\p{N}]+", " "))


#: The same expression serves the index and comparisons.
comparable = index_value = fold


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACES, " "))


def soft(x: Column) -> Column:
    """Entities resolved, lower case, slashes and dashes to spaces; accents and other punctuation stay."""
    return collapse(F.translate(F.lower(unescaped(x)), "/-", "  "))


def accents_pt(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), PT_ACCENTED, PT_PLAIN)


def punctuation_to_space(x: Column) -> Column:
    return collapse(F.translate(F.lower(unescaped(x)), "/-_.,;:|()[]", " " * 12))


def ui_text(x: Column) -> Column:
    return F.lower(without_accents(x))


def trim_lower(x: Column) -> Column:
    return F.lower(F.trim(x))


def username(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(without_accents(x)), r"[^a-z0-9_]", ""), 1, 20)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def url_key(x: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"[?#].*$", ""), "/+$", "")


def url_ui(x: Column) -> Column:
    """Scheme and host in lower case, the path as it is, nothing after it."""
    plain = F.regexp_replace(F.trim(x), r"[?#].*$", "")
    origin = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return F.concat(F.lower(origin), F.regexp_replace(F.substr(plain, F.length(origin) + 1), "/+$", ""))


def strip_html(x: Column, closed: bool = False) -> Column:
    """Visible text: without scripts, styles and tags, also where these are written as character references; those that are
    left afterwards are resolved, too. closed: only references that have their semicolon."""
    bare = F.regexp_replace(F.regexp_replace(unescaped(x, closed), r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return tag_text(bare, closed)


def strip_tags(x: Column, closed: bool = False) -> Column:
    """The same with the text of scripts and styles."""
    return tag_text(unescaped(x, closed), closed)


def tag_text(x: Column, closed: bool = False) -> Column:
    """The text between tags, references resolved."""
    return collapse(unescaped(F.regexp_replace(x, r"<[^>]+>", " "), closed))


#: Texts of embedded JSON that a detail page gives, their characters at least, and characters of the whole, at most (fixed values).
DETAIL_STRINGS, DETAIL_LEAST, DETAIL_CHARS = 300, 3, 12_000
#: Scripts that hold a page's data (fixed value).
_DATA = re.compile(r"""(?is)<script[^>]*(?:id=["']__NEXT_DATA__["']|type=["']application/json["'])[^>]*>(.*?)</script>""")
_HIDDEN = re.compile(r"(?is)<(script|style)[^>]*>.*?</\1>")
_TAG = re.compile(r"(?is)<[^>]+>")


def _detail_plain(value: str) -> str:
    value = html.unescape(value)
    for code, char in (("\\u003c", "<"), ("\\u003e", ">"), ("\\u0026", "&")):
        value = value.replace(code, char)
    return " ".join(_TAG.sub(" ", value).split())[:DETAIL_CHARS]


def _detail(page: str) -> str:
    parts: list[str] = []
    for data in _DATA.findall(page):
        try:
            todo = [json.loads(html.unescape(data))]
        except ValueError:
            continue
        found: list[str] = []
        while todo and len(found) < DETAIL_STRINGS:  # depth first, in the order of the document
            value = todo.pop()
            if isinstance(value, str):
                if len(plain := _detail_plain(value)) >= DETAIL_LEAST:
                    found.append(plain)
            elif isinstance(value, (list, dict)):
                todo += reversed(list(value.values() if isinstance(value, dict) else value))
        parts += found
    return _detail_plain(" ".join([*parts, _TAG.sub(" ", _HIDDEN.sub(" ", page))]))


def detail_text(page: Column) -> Column:
    """The strings of a page's embedded JSON, however deep, and its visible text; empty for null."""

    def of_all(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: _detail(x) if x else "")

    return F.pandas_udf(of_all, "string")(page)


def slug(x: Column) -> Column:
    plain = F.lower(without_accents(F.replace(unescaped(x), F.lit("&"), F.lit(" and "))))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact_label(x: Column, fallback: str, most: int = 90) -> Column:
    text = F.coalesce(F.nullif(collapse(x), F.lit("")), F.lit(fallback))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def non_empty(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def unique_trimmed(items: Column) -> Column:
    """Distinct, in order."""
    return F.array_distinct(non_empty(items))


def unique_ci(items: Column) -> Column:
    """Distinct whatever the case, in order; the first spelling stays."""
    kept = non_empty(items)
    lower = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def join_non_empty(sep: str, *parts: Column) -> Column:
    return F.array_join(non_empty(F.array(*[F.coalesce(p, F.lit("")) for p in parts])), sep)


def split_csv(x: Column) -> Column:
    return non_empty(F.split(x, ","))


def split_search(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, r"[,\n;\s]+"), lambda w: w != ""))


def split_multi(x: Column, marks: str = r"[,;|]+") -> Column:
    return non_empty(F.split(x, marks))


def initials(x: Column) -> Column:
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def longest(x: Column, ordinal: Column) -> Column:
    """Aggregate: the longest by bytes, the first of equals."""
    return F.max_by(x, F.struct(F.octet_length(x), -ordinal))


def stable_id(title: Column, company: Column, location: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", fold(title), fold(company), fold(location)), 256), 1, 24)


def char_sum_score(x: Column) -> Column:
    """70 and the sum of the character codes modulo 26."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)
    return (F.lit(70) + F.aggregate(codes, F.lit(0), lambda a, c: a + c) % 26).cast("int")


def salary_range(low: Column, high: Column, currency: Column, interval: Column, description: Column) -> Column:
    num = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
    tail = lambda body: F.trim(F.concat_ws(" ", body, F.nullif(F.trim(currency), F.lit("")), F.nullif(F.trim(interval), F.lit(""))))
    some = lambda x: F.coalesce(x, F.lit(0.0)) > 0
    return (
        F.when(some(low) & some(high), tail(F.concat_ws(" - ", num(low), num(high))))
        .when(some(low), tail(F.concat(F.lit("A partir de "), num(low))))
        .when(some(high), tail(F.concat(F.lit("Até "), num(high))))
        .otherwise(F.coalesce(F.trim(description), F.lit("")))
    )


def bytes_label(n: Column) -> Column:
    out = F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def unit_label(value: Column, unit: Column) -> Column:
    """A measured value as a panel shows it, by its unit: percent, ms, seconds, bytes, or a count."""
    v = value.cast("double")
    fixed = lambda x, n: F.format_string(f"%.{n}f", x)
    whole = F.floor(v + 0.5).cast("long")  # halves go up
    minutes = F.concat(F.when(v >= 600, fixed(v / 60, 1)).otherwise(fixed(v / 60, 2)), F.lit(" min"))
    seconds = F.concat(F.when(v >= 10, fixed(v, 1)).otherwise(fixed(v, 2)), F.lit(" s"))
    grouped = F.replace(F.format_number(whole, 0), F.lit(","), F.lit("."))
    plain = F.regexp_replace(F.regexp_replace(F.when(v % 1 == 0, fixed(v, 0)).otherwise(fixed(v, 3)), "0+$", ""), r"\.$", "")
    out = (
        F.when(unit == "percent", F.concat(F.when(v >= 10, fixed(v, 1)).otherwise(fixed(v, 2)), F.lit("%")))
        .when(unit == "ms", F.concat(whole.cast("string"), F.lit(" ms")))
        .when(unit == "seconds", F.when(v >= 60, minutes).otherwise(seconds))
        .when(unit == "bytes", bytes_label(v))
        .otherwise(F.when(v >= 1000, grouped).otherwise(plain))
    )
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit("No data")).otherwise(out)


def date_label(x: Column) -> Column:
    """dd/mm/yyyy of an ISO date at the beginning, else of what can be read as a time, else a fixed phrase."""
    iso = F.regexp_extract(x, r"^(\d{4})-(\d{2})-(\d{2})", 0)
    parts = F.split(iso, "-")
    flipped = F.concat_ws("/", F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    read = F.date_format(F.try_to_timestamp(x), "dd/MM/yyyy")
    return F.coalesce(F.when(iso != "", flipped), read, F.lit("Não informado"))


def relative_time(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 60_000_000)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, F.lit("now"))
        .when(minutes < 60, label(minutes, " min"))
        .when(minutes < 1440, label(F.floor(minutes / 60), " h"))
        .when(minutes < 10080, label(F.floor(minutes / 1440), " d"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )


def epoch_ms(x: Column) -> Column:
    return F.date_format(F.timestamp_millis(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once a row, however often later expressions use it: a generator stands between,
    through which projections and filters don't carry the expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
