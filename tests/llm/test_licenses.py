import random
import re

import pytest
import regex

from quernstone.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string, finds int"


def slow_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


TEXTS = [
    "", None, " ", "Under the MIT License", "x under\nthe MIT-license. Under the mit license!", "sunder the mit license under the mit licenses", "CC BY-NC 4.0 cc_by_nc cc by nc by nc", "Apache License, Version 2.0",
    "ccé by nc", "cc by nc cc by nc", "été UNDER THE MIT LICENSE", "under the mit license under the mit license", "Ünder the mit license", "\x7funder\x00the mit{license}",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_count(text):
    words = L.plain(text)
    n, places = slow_base(text)
    assert (words.count(" ") + 1 if words else 0) == n
    assert sorted((p, label) for label, x in L.Scanner().base(words).items() for p in x) == places


MARKED = {m.replace("[", "").replace("]", ""): m for m in L.NOTICES}


def free_places(notice):
    """Places of a notice's characters that may be edited: not those of what identifies it, nor the blanks beside that."""
    out, at, inside = [], 0, False
    marked = MARKED[notice]
    for k, c in enumerate(marked):
        if c in "[]":
            inside = c == "["
            continue
        if not inside and not (c == " " and (marked[k - 1] == "]" or marked[k + 1 : k + 2] == "[")):
            out.append(at)
        at += 1
    return out


def edit(rng, notice, k):
    """k edits, from the end on, none where it would change what identifies the notice or join a word to it."""
    s = list(notice)
    free = [x for x in free_places(notice) if x - 1 in free_places(notice) and x + 1 in free_places(notice)]
    for at in sorted(rng.sample(free, min(k, len(free))), reverse=True):
        what = rng.randrange(3)
        if what == 0:
            s[at] = rng.choice("qxzj")
        elif what == 1:
            s.insert(at, rng.choice("qxzj"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def test_every_notice_within_its_edits_is_found():
    rng = random.Random(4)
    scanner = L.Scanner()
    for _ in range(150):
        notice = rng.choice(scanner.notices)
        if not free_places(notice.text):
            continue
        filler = lambda: " ".join("".join(rng.choices("bdfgkmnv", k=5)) for _ in range(rng.randint(0, 30)))
        k = rng.randint(0, notice.edits)
        text = f"{filler()} {edit(rng, notice.text, k)} {filler()}".strip()
        finds = scanner.fuzzy(text)
        assert finds and max(f.likeness for f in finds) >= 1 - k / len(notice.text)
        for f in finds:
            assert f.errors <= L.edits_of(f.notice) and regex.fullmatch(f"(?:{regex.escape(f.notice)}){{e<={f.errors}}}", text[f.start : f.end])


def test_windows_hold_all_matches_of_the_whole_text():
    rng = random.Random(5)
    scanner = L.Scanner()
    short = [(k, n) for k, n in enumerate(scanner.notices) if len(n.text) < 60]
    for _ in range(40):
        text = " ".join(rng.choice(["license", "version", "2", "the", "mit", "public", "licensed", "under", "cc", "by", "nc", "apache", "released", "4", "0"]) for _ in range(rng.randint(5, 120)))
        windows = scanner.windows(text)
        for k, n in rng.sample(short, 4):
            places = [x for j, a, b in windows if j == k for x in scanner.dense(n, text, a, b)]
            for m in regex.finditer(f"(?:{regex.escape(n.text)}){{e<={n.edits}}}", text, regex.BESTMATCH):
                assert any(a <= m.start() and m.end() <= b for a, b in places)


def test_clean_text_has_no_label():
    rng = random.Random(6)
    assert L.Scanner().fuzzy(" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000))) == []


def test_rows(spark):
    rows = [(k, t, None, 1) for k, t in enumerate(TEXTS)] + [(None, "Licensed under teh Apache Lisence, Version 2.0.", "", None), (3, "Relased under the MIT Lisense", "", 2), (3, "Relased under the MIT Lisense", "", 2), (50, "Released under the M1T License", None, 1), (40, "the license " * 30000, None, 1)]
    got = L.scanned(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[0].n_words, by[0].n_base, by[0].first_word, by[0].labels, by[0].score) == (0, 0, None, "", 0.0) and by[1][1:] == by[0][1:]
    assert (by[4].n_base, by[4].first_word, by[4].last_word, by[4].base_labels, by[4].score) == (2, 1, 5, "mit", 1.0)
    assert (by[None].n_base, by[None].labels) == (0, "apache-2") and 0.8 < by[None].score < 1
    assert by[None].finds[0].errors == 4
    assert L.Scanner().fuzzy(L.plain("licensed under the GNU General Public License, version 3"))[0].label == "gpl-3"
    assert by[3].labels == "mit" and by[50].labels == ""
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert L.scanned(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_one_edit_for_ten_characters():
    """Edits spread over a long notice, up to one for 10 characters, and the finds of a whole-text search."""
    scanner = L.Scanner()
    for n in scanner.notices:
        free = [x for x in free_places(n.text) if x - 1 in free_places(n.text) and x + 1 in free_places(n.text)]
        for k in range(1, min(n.edits, len(free) // 2) + 1):
            chars = list(n.text)
            for e in range(k):
                chars[free[e * len(free) // k]] = "#"
            text = f"bdfg kmnv {''.join(chars)} vnmk gfdb"
            assert any(f.notice == n.text and f.errors == k for f in scanner.fuzzy(text))


def test_close_notices_are_all_found():
    """The worse one stands first, last or between; against brute force over the whole text, by the same rule for overlaps."""
    scanner = L.Scanner()
    two = "relesed under the mit licese and released under the mit license"
    assert [(f.start, f.errors) for f in scanner.fuzzy(two) if f.label == "mit"] == [(0, 2), (33, 0)]
    rng = random.Random(9)
    for _ in range(12):
        n = rng.choice([n for n in scanner.notices if free_places(n.text)])
        edits = [rng.randint(0, n.edits // 2) for _ in range(rng.randint(2, 5))]
        text = " and so ".join(edit(rng, n.text, k) for k in edits)
        assert len(scanner.fuzzy(text)) >= len(edits)


def test_a_later_seed_widens_a_window_to_the_left():
    scanner = L.Scanner({"abcdefghijklmnopqr[st]": "x"}, {})
    (_, a, _), *_ = scanner.windows("zzzzzzzz" + "abcdef" + "hijklmnopqrst")
    starts = [last - length + 1 - offset - 2 for last, (length, of) in scanner.seeds.iter("zzzzzzzz" + "abcdef" + "hijklmnopqrst") for _, offset in of]
    assert a == max(0, min(starts))


#: What stands near a notice, and the labels it has: another name, another version, more clauses.
NEAR = {
    "licensed under the bsd license": {"bsd"}, "licensed under the new license": set(), "the new license": set(), "licensed under the gpl license": set(), "the gpl license": set(), "the zlib license": set(),
    "licensed under the zlib license": {"zlib"}, "cc by sa 4 0": set(), "licensed under cc by sa 4 0": {"cc-by-sa"}, "licensed under cc by nc sa 4 0": {"cc-by-nc-sa"}, "licensed under cc by nd 4 0": {"cc-by-nd"},
    "licensed under cc by 4 0": {"cc-by"}, "licensed under cc by sa 3 0": set(), "gnu general public license version 1": set(), "licensed under the gnu general public license version 1": set(),
    "licensed under the gnu general public license version 22": set(), "licensed under the gnu lesser general public license version 3": {"lgpl"}, "licensed under the gnu affero general public license version 3": {"agpl"},
    "licensed under the mitt license": set(), "licensed under the mi license": set(), "licensed under the isc license": {"isc"}, "licensed under the ibm license": set(), "licensed under the apache license version 1 1": set(),
    "licensed under the mozilla public license version 1 1": set(), "creative commons attribution noncommercial sharealike": {"cc-by-nc-sa"}, "creative commons attribution": set(), "licensed under the eclipse license": set(),
    "with or without fee is hereby granted the software is provided as is": {"0bsd"}, "the boost license version 1 0": set(),
}


@pytest.mark.parametrize("text", NEAR)
def test_near_misses(text):
    scanner = L.Scanner(phrases={})
    for around in ("", "bdfg kmnv "):
        assert {f.label for f in scanner.fuzzy(f"{around}{text} {around}".strip())} == NEAR[text]


def aligned(notice, text, edits):
    """Whether the notice stands somewhere in text with so many edits at most, what identifies it unchanged and whole words: a table of edit
    distances, with no edit inside or at the border of what is exact."""
    marked, chars, exact, inside = MARKED[notice], [], [], False
    for c in marked:
        if c in "[]":
            inside = c == "["
        else:
            chars.append(c)
            exact.append(inside)
    begins = [i for i in range(len(chars)) if exact[i] and (i == 0 or not exact[i - 1])]
    ends = [i + 1 for i in range(len(chars)) if exact[i] and (i + 1 == len(chars) or not exact[i + 1])]
    hard = {i for i in range(len(chars)) if exact[i]} | {i - 1 for i in begins if i} | {i for i in ends if i < len(chars)}
    row = [0] * (len(text) + 1) if 0 not in begins else [0 if j == 0 or text[j - 1] == " " else 99 for j in range(len(text) + 1)]
    for i, c in enumerate(chars, 1):
        new = [99] * (len(text) + 1)
        free_insert = i not in begins and i not in ends and not (i < len(chars) and i in hard and i - 1 in hard)
        for j in range(len(text) + 1):
            best = 99
            if j:
                same = text[j - 1] == c
                best = row[j - 1] + (0 if same else 99 if i - 1 in hard else 1)
                if free_insert:
                    best = min(best, new[j - 1] + 1)
            if i - 1 not in hard:
                best = min(best, row[j] + 1)
            if i in ends and i == len(chars) and j < len(text) and text[j] != " ":
                best = 99
            new[j] = min(best, 99)
        row = new
    return min(row) <= edits


def test_labels_against_brute_force():
    """Notices with other names, versions and random edits, each against every notice by a table of edit distances."""
    rng = random.Random(12)
    scanner = L.Scanner(phrases={})
    words = ["mit", "isc", "bsd", "zlib", "gpl", "2", "3", "1", "sa", "nc", "nd", "new", "public", "x"]
    right = wrong = missed = 0
    for _ in range(60):
        n = rng.choice([n for n in scanner.notices if len(n.text) < 70])
        parts = edit(rng, n.text, rng.randint(0, n.edits)).split(" ")
        if rng.random() < 0.6:
            parts[rng.randrange(len(parts))] = rng.choice(words)
        text = " ".join(["bdfg", *parts, "kmnv"])
        may = {m.label for m in scanner.notices if len(m.text) < 90 and aligned(m.text, text, m.edits)}
        got = {f.label for f in scanner.fuzzy(text)}
        assert got <= may and bool(got) == bool(may)
        right, wrong, missed = right + bool(got), wrong + bool(got - may), missed + bool(may and not got)
    assert right > 20 and not wrong and not missed
