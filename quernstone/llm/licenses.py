"""License scans: fuzzy search for short notices.

A notice found with at most k edits has k + 1 pieces of which at least one stands exactly, so the notices are
split into k + 1 pieces each, and one automaton finds all pieces in a text. Each find places a window where the notice
would stand; windows of a notice that overlap become one. An edit spoils GRAM runs of GRAM characters at most, so a stretch that
has fewer of the notice's runs than k edits leave holds no find, and windows shrink to the stretches with enough of them. In
these the regex library matches the notice with at most k errors, giving the span and the number of errors.

Licenses differ by a few letters, as many as an edit or two change. So a notice has words that identify it (name, version, clauses); these
stand exactly, and edits go to the others. What is close to a notice but for its name has no label.

Beside it a base count: places where a phrase's words stand consecutively.

Words are runs of ASCII letters (lower-cased) and digits and of any characters beyond ASCII; a text is searched as its words
with single spaces between, so that punctuation and line breaks don't count as edits.

Defined results: a null text counts as empty: no words, no places, empty labels, score 0; a very long text is scanned whole, in
windows around what was found; of finds that overlap, that of the fewest errors for its length stays, of equals the longer, then the one by name; overlapping places of a phrase all
count; a null id is returned as null; repeated rows are all returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.shared import documents, named, ship, sliced

#: Phrases of the base count and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that the fuzzy search looks for and their labels. What stands in brackets tells a license from others: it must stand there word for word.
NOTICES = {
    "released under the [mit] license": "mit",
    "licensed under the [mit] license": "mit",
    "permission is hereby granted free of charge to [any person obtaining] a copy of this software": "mit",
    "with or without fee is [hereby granted provided that] the above copyright notice": "isc",
    "with or without fee is [hereby granted the software] is provided as is": "0bsd",
    "licensed under the [isc] license": "isc",
    "licensed under the [bsd] license": "bsd",
    "licensed under the [zlib] license": "zlib",
    "licensed under the [apache] license version [2 0]": "apache-2",
    "you may obtain a copy of the license at http www [apache org licenses license 2 0]": "apache-2",
    "licensed under [cc by 4 0]": "cc-by",
    "licensed under [cc by sa 4 0]": "cc-by-sa",
    "licensed under [cc by nd 4 0]": "cc-by-nd",
    "licensed under [cc by nc 4 0]": "cc-by-nc",
    "licensed under [cc by nc sa 4 0]": "cc-by-nc-sa",
    "licensed under [cc by nc nd 4 0]": "cc-by-nc-nd",
    "[creative commons attribution noncommercial]": "cc-by-nc",
    "[creative commons attribution 4 0] international": "cc-by",
    "[creative commons attribution sharealike]": "cc-by-sa",
    "[creative commons attribution noderivatives]": "cc-by-nd",
    "[creative commons attribution noncommercial sharealike]": "cc-by-nc-sa",
    "[creative commons attribution noncommercial noderivatives]": "cc-by-nc-nd",
    "[creative commons zero] v1 0 universal": "cc0",
    "licensed under the [gnu general public] license version [3]": "gpl-3",
    "licensed under the [gnu general public] license version [2]": "gpl-2",
    "licensed under the [gnu affero general public] license": "agpl",
    "licensed under the [gnu lesser general public] license": "lgpl",
    "licensed under the [mozilla public] license version [2 0]": "mpl-2",
    "licensed under the [eclipse public] license": "epl",
    "the [boost software] license version 1 0": "bsl-1",
    "[redistribution and use in source and binary forms] with or without modification are permitted": "bsd",
    "[neither the name] of the copyright holder nor the names of its contributors may be used to [endorse]": "bsd-3",
    "all [advertising materials] mentioning features or use of this software must display": "bsd-4",
    "the [origin of this software must not be misrepresented]": "zlib",
    "this is free and unencumbered software released into the [public domain]": "unlicense",
}
#: A notice may have one edit for so many characters.
CHARS_PER_EDIT = 10
#: Characters of the runs that a stretch is judged by before it is matched.
GRAM = 3
#: Characters that a verified window may have; a longer chain of windows is verified in overlapping stretches of this.
STRETCH = 4096

#: Upper case to lower, and everything that separates words to a space; bytes beyond ASCII stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str | None) -> str:
    """The text's words, lower-cased, with single spaces between."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(TABLE).split()).decode()


class Part(NamedTuple):
    """A stretch of a notice: exact words, or fuzzy ones with the pattern of their place (before, between or after exact ones)."""

    text: str
    pattern: regex.Pattern | None


class Notice(NamedTuple):
    text: str
    label: str
    edits: int
    parts: list[Part]
    grams: Counter[str]


def notice_of(marked: str, label: str) -> Notice:
    """A notice from its text with brackets around what is exact."""
    text = marked.replace("[", "").replace("]", "")
    edits = edits_of(text)
    pieces = [x for x in (p.strip() for p in re.split(r"(\[[^]]*\])", marked)) if x]
    parts = []
    for k, x in enumerate(pieces):
        if x.startswith("["):
            parts.append(Part(x[1:-1], None))
        else:
            end = "$" if k + 1 < len(pieces) else ""
            parts.append(Part(x, regex.compile(f"(?:{regex.escape(x)}){{e<={edits}}}{end}", regex.BESTMATCH)))
    return Notice(text, label, edits, parts, grams_of(text))


class Found(NamedTuple):
    label: str
    notice: str
    start: int
    end: int
    errors: int
    likeness: float


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about the same length: (offset, piece)."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def grams_of(text: str) -> Counter[str]:
    return Counter(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))


def _places(text: str, words: str, start: int, stop: int) -> Iterator[int]:
    """Where words stand in text[start:stop] as whole words."""
    at = text.find(words, start, stop)
    while at >= 0:
        if (at == 0 or text[at - 1] == " ") and text[at + len(words) : at + len(words) + 1] in ("", " "):
            yield at
        at = text.find(words, at + 1, stop)


def _following(text: str, parts: list[Part], at: int, stop: int, edits: int) -> Iterator[tuple[int, int]]:
    """Ends and numbers of edits of the ways in which parts follow exact words that end at a place."""
    if edits < 0:
        return
    if not parts:
        yield at, 0
        return
    fuzzy, more = parts[0], parts[1:]
    if text[at : at + 1] != " ":
        return
    at += 1
    if not more:
        m = fuzzy.pattern.match(text[at : min(stop, at + len(fuzzy.text) + edits)])
        if m and (errors := sum(m.fuzzy_counts)) <= edits:
            yield at + m.end(), errors
        return
    near = at + max(0, len(fuzzy.text) - edits)
    for there in _places(text, more[0].text, near, min(stop, at + len(fuzzy.text) + edits + 1 + len(more[0].text))):
        m = fuzzy.pattern.fullmatch(text[at : there - 1])
        if m and (errors := sum(m.fuzzy_counts)) <= edits:
            for b, rest in _following(text, more[1:], there + len(more[0].text), stop, edits - errors):
                yield b, errors + rest


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        import ahocorasick

        self.phrases = PHRASES if phrases is None else phrases
        self.notices = [notice_of(t, label) for t, label in (NOTICES if notices is None else notices).items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            for at, piece in pieces_of(n.text, n.edits):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def base(self, words: str) -> dict[str, list[int]]:
        """Label -> the words at which its phrase stands, from 0."""
        out: dict[str, list[int]] = {}
        padded = f" {words} "
        for phrase, label in self.phrases.items():
            needle, at = f" {phrase} ", -1
            word, done = 0, 0
            while (at := padded.find(needle, at + 1)) >= 0:
                word += padded.count(" ", done, at)
                done = at
                out.setdefault(label, []).append(word)
        return out

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """(notice, start, end) where a notice with its edits may stand: wherever a piece does, grown by the edits."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (n, of) in self.seeds.iter(text):
            at = last - n + 1
            for k, offset in of:
                notice = self.notices[k]
                a, b = max(0, at - offset - notice.edits), min(len(text), at - offset + len(notice.text) + notice.edits)
                own = spans.setdefault(k, [])
                if own and a <= own[-1][1]:
                    own[-1] = (min(a, own[-1][0]), max(b, own[-1][1]))
                else:
                    own.append((a, b))
        out = []
        for k, own in spans.items():
            own.sort()
            joined = own[:1]
            for a, b in own[1:]:
                if a <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                else:
                    joined.append((a, b))
            out += [(k, a, b) for a, b in joined]
        return out

    def dense(self, n: Notice, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """The stretches of a window in which as many of the notice's runs stand as its edits leave. No find lies outside."""
        need = n.grams.total() - GRAM * n.edits
        if need <= 0:
            return [(start, stop)]
        room = len(n.text) + n.edits - GRAM + 1  # runs that the longest find has
        want, have, shared = n.grams, Counter[str](), 0
        out: list[tuple[int, int]] = []
        for i in range(start, stop - GRAM + 1):
            gram = text[i : i + GRAM]
            if gram in want:
                have[gram] += 1
                shared += have[gram] <= want[gram]
            if i - room >= start:
                gram = text[i - room : i - room + GRAM]
                if gram in want:
                    shared -= have[gram] <= want[gram]
                    have[gram] -= 1
            if shared >= need:
                a = max(start, i - room + 1)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], i + GRAM)
                else:
                    out.append((a, i + GRAM))
        return out

    def matches(self, n: Notice, text: str, start: int, stop: int) -> Iterator[Found]:
        """A find for each place of a notice's first exact words in a stretch, where what stands around has few enough edits."""
        first = next(k for k, p in enumerate(n.parts) if p.pattern is None)
        for at in _places(text, n.parts[first].text, start, stop):
            a, errors = at, 0
            if first:
                if at == 0:
                    continue
                low = max(start, at - 1 - len(n.parts[0].text) - n.edits)
                m = n.parts[0].pattern.search(text[low : at - 1])
                if m is None:
                    continue
                a, errors = low + m.start(), sum(m.fuzzy_counts)
            for b, more in _following(text, n.parts[first + 1 :], at + len(n.parts[first].text), stop, n.edits - errors):
                yield Found(n.label, n.text, a, b, errors + more, 1 - (errors + more) / len(n.text))

    def fuzzy(self, text: str) -> list[Found]:
        """Notices within their edits, by place. Of finds that overlap, the one of fewest errors for its length stays,
        the longer of equals: another version of a license is one edit away."""
        out = set()
        for n, a, b in [(self.notices[k], *some) for k, start, stop in self.windows(text) for some in self.dense(self.notices[k], text, start, stop)]:
            room = len(n.text) + 2 * n.edits
            for start in range(a, b, max(1, STRETCH - room)):
                stop = min(b, start + STRETCH)
                out.update(self.matches(n, text, start, stop))
                if stop == b:
                    break
        kept: list[Found] = []  # by place, apart from each other
        for f in sorted(out, key=lambda f: (-f.likeness, f.start - f.end, f.start, f.notice)):
            k = bisect_left(kept, f.start, key=lambda g: g.start)
            if (k == 0 or kept[k - 1].end <= f.start) and (k == len(kept) or f.end <= kept[k].start):
                kept.insert(k, f)
        return kept


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a row of docs: the base count, the labels, and the fuzzy finds with their spans in the plain text. No shuffle."""
    ship(docs.sparkSession)
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "finds array<struct<label: string, notice: string, start: int, end: int, errors: int>>"
    )
    find = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("errors", pa.int32())]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), find]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "finds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()

        def one(text: str | None) -> tuple:
            words = plain(text)
            base = scanner.base(words)
            places = [p for x in base.values() for p in x]
            finds = scanner.fuzzy(words)
            labels = sorted({*base, *(f.label for f in finds)})
            score = 1.0 if places else max((f.likeness for f in finds), default=0.0)
            return (
                words.count(" ") + 1 if words else 0,
                len(places),
                min(places, default=None),
                max(places, default=None),
                ",".join(sorted(base)),
                ",".join(labels),
                score,
                [dict(zip(("label", "notice", "start", "end", "errors"), f)) for f in finds],
            )

        for batch in sliced(batches):
            if batch.num_rows:
                cols = zip(*map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))

