"""Character references of HTML as an expression: all named and numeric ones, in one pass over a text.

A text is cut at its references; each is decoded and put back in its place. Names come from HTML's own table as Python has it: those
with their semicolon, and some old ones that go without, of which the longest that begins a word counts. Numbers are code points; the
range of the C1 controls is read as Windows-1252, and what is no code point becomes U+FFFD."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z0-9]+;?)"
#: Those that have their semicolon.
CLOSED = REFERENCE.replace(";?", ";")
#: The longest name that goes without a semicolon.
LONGEST = max(len(n) for n in html5 if not n.endswith(";"))
#: References that are looked up before the table, as most texts have no others.
FREQUENT = ["amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;"]


def _windows(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


#: The values of the numbers from 128 to 159, in order.
C1 = [_windows(code) for code in range(128, 160)]


def _table(names: dict[str, str]) -> Column:
    """A constant map: one literal, which the optimizer turns into a map once."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _number(digits: Column, base: int) -> Column:
    """The character of a code point; more than eight significant digits are none."""
    plain = F.regexp_replace(digits, "^0+", "")
    code = F.when(F.length(plain) > 8, F.lit(1 << 40)).otherwise(F.conv(F.concat(F.lit("0"), plain), base, 10).cast("long"))
    wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), F.get(F.array(*map(F.lit, C1)), (code - 128).cast("int"))).otherwise(char)


def _decoded(reference: Column) -> Column:
    name = F.substr(reference, F.lit(2))
    digits = F.regexp_replace(name, "^#[xX]?|;$", "")
    full, old = _table(html5), _table({n: c for n, c in html5.items() if not n.endswith(";")})
    common = F.lit(None).cast("string")
    for n in FREQUENT:
        common = F.when(name == n, F.lit(html5[n])).otherwise(common)
    begun = [F.when(F.length(name) > n, F.concat(F.element_at(old, F.substring(name, 1, n)), F.substr(name, F.lit(n + 1)))) for n in range(LONGEST, 1, -1)]
    return F.when(name.startswith("#"), F.when(F.lower(F.substring(name, 2, 1)) == "x", _number(digits, 16)).otherwise(_number(digits, 10))).otherwise(F.coalesce(common, F.element_at(full, name), *begun, reference))


def unescaped(x: Column, closed: bool = False) -> Column:
    """x with its character references resolved, once: `&amp;lt;` becomes `&lt;`. closed: what has no semicolon at its end stays as it is."""
    pattern = CLOSED if closed else REFERENCE
    found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), _decoded)
    pieces = F.split(x, pattern, -1)
    joined = F.array_join(F.zip_with(pieces, found, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
    return F.when(F.contains(x, F.lit("&")), joined).otherwise(x)
