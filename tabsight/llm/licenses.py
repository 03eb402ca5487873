"""License scans: exact phrases, and short notices with a bounded number of edits.

Phrases are found as consecutive words. Notices are found fuzzily: a notice
allowed ``k`` edits is split into ``k + 1`` pieces, and by the pigeonhole
principle any text within ``k`` edits of it holds one piece unchanged. So the
pieces are searched exactly (a byte search each) and only the windows around
their places are given to the ``regex`` library, whose bounded-error matching
verifies the edits and reports the span.

Everything happens within a row: one pass over the documents, no shuffle, no
state between rows; memory is bounded by one Arrow batch. A text is scanned
whole, however long.

Defined results: a null or empty text has no words, no spans and score 0;
places of one phrase may overlap and all count; of overlapping fuzzy spans the
one with the fewest edits stays (ties: the longer notice, then its label);
repeated rows are scanned one by one; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import ascii_words, bound_batches, utf8

# Phrases and labels of the exact search.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Short notices of common licenses: normalised text, label.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


class Notice:
    """A notice, its allowed edits, its exact pieces and its verifying pattern."""

    def __init__(self, text: str, label: str, chars_per_edit: int) -> None:
        self.text, self.label = text, label
        self.edits = max(1, len(text) // chars_per_edit)
        cuts = [len(text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(f"(?e)(?:{regex.escape(text, special_only=True)}){{e<={self.edits}}}")

    def spans(self, plain: bytes) -> list[tuple[int, int, int]]:
        """(first byte, end byte, edits) in the normalised text ``plain``."""
        # an edit shifts a piece by a byte at most if ASCII; one inserted character has up to four bytes
        reach, windows = 4 * self.edits, []
        for offset, piece in self.pieces:
            at = plain.find(piece)
            while at >= 0:
                windows.append((max(0, at - offset - reach), at - offset + len(self.text) + reach))
                at = plain.find(piece, at + 1)
        out, end = [], -1
        merged: list[list[int]] = []
        for a, b in sorted(windows):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            while a > 0 and plain[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(plain) and plain[b] & 0xC0 == 0x80:
                b += 1
            window, char, byte = plain[a:b].decode(), 0, a
            for m in self.pattern.finditer(window):
                first = byte + len(window[char : m.start()].encode())
                byte, char = first + len(m.group().encode()), m.end()
                out.append((first, byte, sum(m.fuzzy_counts)))
        return out


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = 12) -> None:
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = [Notice(t, label, chars_per_edit) for t, label in notices]

    def scan(self, text: bytes) -> dict:
        words = ascii_words(text)
        plain = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)

        def before(at: int) -> int:  # spaces in front of a place
            return int(np.searchsorted(spaces, at))

        places, base = [], set()
        for phrase, label in self.phrases:
            at = plain.find(phrase)
            while at >= 0:
                places.append(before(at))
                base.add(label)
                at = plain.find(phrase, at + 1)
        found = []
        for notice in self.notices:
            found += [(e, -len(notice.text), notice.label, a, b, notice.edits) for a, b, e in notice.spans(plain)]
        taken: list[tuple] = []
        ends: list[tuple[int, int]] = []  # of the spans taken, which do not overlap, in text order
        for hit in sorted(found):
            at = bisect_left(ends, (hit[3] + 1,))  # the first that ends after this one begins
            if at == len(ends) or ends[at][1] >= hit[4]:
                ends.insert(at, (hit[4], hit[3]))
                taken.append(hit)
        score = 1.0 if places else max((1.0 - t[0] / (t[5] + 1) for t in taken), default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": sorted(base),
            "labels": sorted(base | {t[2] for t in taken}),
            "score": score,
            # words: the word in which the span begins, and the one after that in which it ends
            "spans": [
                {"label": t[2], "first": before(t[3] + 1) - 1, "end": before(t[4] - 1), "edits": t[0]}
                for t in sorted(taken, key=lambda t: (t[3], t[2]))
            ],
        }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, score double, spans array<struct<label:string,first:long,end:long,edits:long>>"
)
_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])))]
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases=PHRASES,
    notices=NOTICES,
    chars_per_edit: int = 12,
) -> DataFrame:
    """One row per document: word counts, exact places, labels and fuzzy spans.

    A notice of L characters may differ by L // ``chars_per_edit`` edits.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        for b in batches:
            rows = pa.array([scanner.scan(t or b"") for t in utf8(b.column(1))], _TYPE)
            yield pa.RecordBatch.from_arrays([b.column(0), *rows.flatten()], names=["doc_id", *(f.name for f in _TYPE)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
