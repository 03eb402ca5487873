import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tabsight.llm.licenses import NOTICES, PHRASES, Scanner, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def base(text):
    words, places, labels = WORD.findall(lower(text or "")), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def within(text, pattern, k):
    """Whether some part of the text is within k edits of the pattern (Sellers)."""
    row = list(range(len(pattern) + 1))
    for c in text:
        last, row = row, [0]
        for j, p in enumerate(pattern, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != c)))
        if row[-1] <= k:
            return True
    return row[-1] <= k


TEXTS = [
    None, "", "a b c", "Under the MIT license, under the mit license", "CC BY-NC 4.0 cc by nc cc by nc",
    "Licensed under the Apache License, Version 2.0.", "Relaesed under teh MIT licence.", "É Under  the\nMIT-License é",
    "This work is licensed under the GNU General Public Licence, version 3", "licensed under cc bynd 4 0",
    "undér the mit license", "x" * 200_000 + " apache license version 2 " + "y " * 100_000,
]


def test_base_places_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "cc by nc", 2)], "doc_id long, text string, score int")
    got = scan_licenses(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = "cc by nc" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert 0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_fuzzy_labels_match_edit_distance(data):
    notice, label = data.draw(st.sampled_from(NOTICES))
    text = list("once upon a time " + notice + " the end")
    for _ in range(data.draw(st.integers(0, 9))):
        i = data.draw(st.integers(0, len(text) - 1))
        text[i : i + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "x", "é", "q "]))
    plain = " ".join(WORD.findall(lower("".join(text))))
    scanner = Scanner()
    got = scanner.scan("".join(text).encode())
    for n in scanner.notices:
        hit = within(f" {plain} ", n.text, n.edits)
        assert bool(n.spans(f" {plain} ".encode())) == hit
    found = {n.label for n in scanner.notices if within(f" {plain} ", n.text, n.edits)}
    assert set(got["labels"]) <= found | set(got["base_labels"])
    assert bool(got["labels"]) == bool(found or got["base_labels"])


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_places_in_one_text():
    """Places and overlaps are counted without walking the text anew for each."""
    import time

    from tabsight.llm.licenses import NOTICES, Scanner

    notice = NOTICES[0][0]
    scanner = Scanner()
    unit = f"x {notice} under the mit license é y "
    one, some = scanner.scan(unit.encode()), scanner.scan((unit * 50).encode())
    size = one["n_words"]
    assert some["n_words"] == 50 * size and some["n_base"] == 50 * one["n_base"] and len(some["spans"]) == 50 * len(one["spans"])
    assert [(s["first"], s["end"]) for s in some["spans"]] == [(k * size + s["first"], k * size + s["end"]) for k in range(50) for s in one["spans"]]
    text = (unit * 6000).encode()
    start = time.time()
    assert scanner.scan(text)["n_base"] == 6000 * one["n_base"]
    assert time.time() - start < 60
