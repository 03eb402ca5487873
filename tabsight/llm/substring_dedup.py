"""Substring dedup by level-wise doubling of repeated word windows.

A word is removed if a window of ``window`` consecutive words over it has a
word sequence that also starts in a document with a smaller id.

Level 1 looks at windows of half the length. Of the half windows inside each
full window only the one with the smallest hash is looked at (the anchor; two
equal full windows have equal anchors, so none is lost, and about 2 of every
``window / 2`` places are anchors). An anchor that occurs in one document alone
ends there. Only anchors repeated in several documents are extended to level 2,
the full length, where candidates are decided; longer windows cannot change
what is removed, so the doubling ends there at the latest, and before if no
candidate survives.

Level 2 starts from the *run* of an anchor: the consecutive full windows that
have it, and the span of words they cover together. Runs with the same anchor
and the same span have the same windows, so only one of them (of the smallest
id) matters to others and the rest are removed outright. Only if one anchor has
several different spans, as at the edges of a shared passage or next to an
edit, are the windows of one run per span hashed and compared one by one.

All counting is by aggregates that combine on the map side, and results come
back by joins whose other side has one row per key, which the adaptive skew
join can split: a passage in a third of all documents lands in no single task.
Texts are only re-read, and cross the network compressed. Hashes: 64 bits for
the anchor plus 64 for the span, and 128 for a window.

Defined results: null or empty texts have no words; fewer words than a window
lose nothing; a null id is never smaller nor larger than another, so such rows
lose nothing and take nothing from others; rows that repeat an id are one
document in this respect and each is returned; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.llm.common import SPACE_CLASS, bound_batches, mix, powers, space_words, token_hashes, utf8, write_table

# Odd bases of the polynomial hashes over word hashes, with their inverses.
_BASES = {k: (np.uint64(b), np.uint64(pow(b, -1, 2**64))) for k, b in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))}


class _Hasher:
    """Hashes of word ranges of one text by prefix sums."""

    def __init__(self, words: np.ndarray, kind: int) -> None:
        base, self.inverse = _BASES[kind]
        self.n = len(words) + 1
        self.sums = np.zeros(self.n, dtype=np.uint64)
        np.cumsum(words * powers(base, len(words)), out=self.sums[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * powers(self.inverse, self.n)[first] + (end - first).astype(np.uint64))


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of full windows with the same anchor: anchor hash, span hash, first
    window, number of windows."""
    half = window // 2
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = np.arange(len(words) - half + 1)
    halves = _Hasher(words, 0)(at, at + half)
    place = np.lib.stride_tricks.sliding_window_view(halves, window - half + 1).argmin(axis=1) + at[:n]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    end = np.concatenate((first[1:], [n]))
    return halves[place[first]], _Hasher(words, 1)(first, end + window - 1), first, end - first


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with their texts compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([None if t is None else small.compress(t) for t in utf8(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], names=["doc_id", "text_hash", "packed"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, packed binary")


def _unpack(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [anchors(token_hashes(t or b"", SPACE_CLASS), window) for t in utf8(b.column(2))]
            if parts:
                sizes = [len(p[0]) for p in parts]
                cols = [pa.array(np.concatenate([p[k] for p in parts]).view(np.int64)) for k in (0, 1)]
                ids = [pa.array(np.repeat(b.column(k).to_numpy(), sizes)) for k in (0, 1)]
                place = pa.array(np.concatenate([p[2] * (window + 1) + p[3] for p in parts]))
                yield pa.RecordBatch.from_arrays([*cols, *ids, place], names=["anchor", "span", "doc_id", "text_hash", "place"])

    # a row without id neither removes nor loses anything
    return rows.where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, span long, doc_id long, text_hash long, place long")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """One row per full window of the runs in ``places``: 128-bit hash, document, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text_hash, packed, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = token_hashes(_unpack(packed), SPACE_CLASS)
                place = np.unique(np.array(places, dtype=np.int64))
                start = np.concatenate([np.arange(p // (window + 1), p // (window + 1) + p % (window + 1)) for p in place])
                cols = [pa.array(_Hasher(words, k)(start, start + window).view(np.int64)) for k in (1, 2)]
                ids = [pa.array(np.full(len(start), x)) for x in (doc_id, text_hash)]
                yield pa.RecordBatch.from_arrays([*cols, *ids, pa.array(start * (window + 1) + 1)], names=["w1", "w2", "doc_id", "text_hash", "place"])

    return docs.select("doc_id", "text_hash", "packed", "places").mapInArrow(run, "w1 long, w2 long, doc_id long, text_hash long, place long")


def repeated_places(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, text_hash, place`` of the windows to remove; ``place`` is
    first window * (``window`` + 1) + number of windows."""
    # level 1: anchors in more than one document
    seen = _anchor_rows(rows, window).groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = write_table(seen.where("least < most").select("anchor"), "repeated-anchors")
    found = write_table(_anchor_rows(rows, window).join(repeated, "anchor"), "candidate-runs")
    # level 2: runs; equal spans need only their smallest document
    spans = found.groupBy("anchor", "span").agg(F.min("doc_id").alias("least"))
    several = spans.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor", F.lit(True).alias("open"))
    spans = write_table(spans.join(several, "anchor", "left"), "spans")
    judged = found.join(spans, ["anchor", "span"]).where("doc_id > least OR open")
    judged = write_table(judged.select("doc_id", "text_hash", "place", (F.col("doc_id") > F.col("least")).alias("removed")), "judged-runs")
    out = judged.where("removed").select("doc_id", "text_hash", "place")
    # runs of one anchor with several spans: their windows one by one
    undecided = judged.where("NOT removed").groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("places"))
    undecided = write_table(undecided, "undecided-runs")
    if undecided.isEmpty():
        return out
    texts = _packed(rows.where("doc_id IS NOT NULL")).join(undecided, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    windows = write_table(_window_rows(texts, window), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    more = windows.join(first.select("w1", "w2", "least"), ["w1", "w2"]).where("doc_id > least")
    return out.unionByName(more.select("doc_id", "text_hash", "place"))


def _covered(n: int, places: list[int] | None, window: int) -> np.ndarray:
    """Which of ``n`` words are covered by the windows at ``places``."""
    change = np.zeros(n + 1, dtype=np.int64)
    if places:
        place = np.array(places, dtype=np.int64)
        first, count = place // (window + 1), place % (window + 1)
        np.add.at(change, first, 1)
        np.add.at(change, first + count + window - 1, -1)
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the kept words
    joined by spaces, unless ``with_text`` is false) per row of ``docs``."""
    if window < 2:
        raise InputError("A window has two words at least.")
    rows = _rows(docs, id_col, text_col)
    places = repeated_places(rows, window).groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("places"))
    places = write_table(places, "repeats")
    keys = places.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "places")
    packed = _packed(rows)
    joined = packed.join(keys, (packed["doc_id"] == keys["d"]) & (packed["text_hash"] == keys["h"]), "left").select("doc_id", "packed", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for packed_text, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = space_words(_unpack(packed_text))
                if at:
                    gone = _covered(len(words), at, window)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    removed = int(gone.sum())
                else:
                    kept, removed = b" ".join(words), 0
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            n, removed, sha, kept = zip(*out, strict=True) if out else ((), (), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                cols.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
