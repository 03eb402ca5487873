"""Benchmark decontamination with a generalised suffix automaton.

The items' word sequences are put into one generalised suffix automaton. A
document's words are streamed through it; the automaton's state gives, at each
word, the longest suffix of the document so far that occurs in some item. A
match of at least ``n`` words marks the last ``n`` words as hit (an item of
fewer words is one window of its own length) and the state names the items.

The automaton is built once per Python worker from the items' words. Only
``block_bytes`` of item text go into one automaton: a larger benchmark is
divided by a hash of its texts into as many blocks as needed and the documents
stream through one automaton after another in the same stage. So what is sent
to the executors has a fixed bound per block, and nothing is shuffled.

A quick exact test comes first: a match needs ``n`` consecutive words of the
items' vocabulary, so only such runs reach the automaton.

Defined results: null or empty texts have no words and no hits; items without
words are ignored; items with equal ids and different texts count once; items
with null id mark words but are not listed; extra columns pass through; an
empty benchmark hits nothing; rows are judged one by one, repeated or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import ascii_words, bound_batches, free_name, utf8

#: Words of a text that is not lower-cased yet, for their places in it.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BLOCK_BYTES = 4 << 20


class ItemAutomaton:
    """Generalised suffix automaton over the items' word ids."""

    def __init__(self, items: list[tuple[object, list[bytes]]], n: int) -> None:
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min((min(n, len(ids)) for _, ids in coded), default=n)
        size = len(self.len)
        # the state that holds the suffix of n words of each state's strings
        self.window = [0] * size
        for s in sorted(range(size), key=self.len.__getitem__):
            if self.len[s] >= n:
                up = self.link[s]
                self.window[s] = self.window[up] if self.len[up] >= n else s
        self.window_items: dict[int, set] = {}
        whole: dict[int, dict[int, set]] = {}
        for item, ids in coded:
            s = 0
            for at, c in enumerate(ids, 1):
                s = self.step[s][c]
                if at >= n:
                    self.window_items.setdefault(self.window[s], set()).add(item)
            if len(ids) < n:
                whole.setdefault(s, {}).setdefault(len(ids), set()).add(item)
        # short items that are suffixes of a state's strings: the nearest state up the links that has some
        self.whole = whole
        self.near = [-1] * size
        if whole:
            for s in sorted(range(size), key=self.len.__getitem__):
                self.near[s] = s if s in whole else self.near[self.link[s]] if s else -1

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = len(self.len)
        self.len.append(self.len[p] + 1)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        cur = len(self.len)
        self.len.append(self.len[last] + 1)
        self.step.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return cur

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged hit spans (first word, word after the last), the items, the longest match."""
        if len(words) < self.shortest:
            return [], set(), 0
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                longest = max(longest, self._run(ids[a:b].tolist(), a, spans, items))
        return spans, items, longest

    def _run(self, ids: list[int], base: int, spans: list, items: set) -> int:
        step, link, length, n = self.step, self.link, self.len, self.n
        s = size = longest = 0
        for i, c in enumerate(ids, base + 1):
            to = step[s].get(c)
            while to is None and s:
                s = link[s]
                size = length[s]
                to = step[s].get(c)
            if to is None:
                continue
            s, size = to, size + 1
            longest = max(longest, size)
            start = i
            if size >= n:
                items |= self.window_items[self.window[s]]
                start = i - n
            at = self.near[s]
            while at > 0:
                for size_, ids_ in self.whole[at].items():
                    if size_ <= size:
                        items |= ids_
                        start = min(start, i - size_)
                at = self.near[link[at]]
            if start < i:
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return longest


_built: dict[tuple, ItemAutomaton] = {}


def _automaton(key: tuple, items: list, n: int) -> ItemAutomaton:
    if key not in _built:
        if len(_built) > 8:
            _built.clear()
        _built[key] = ItemAutomaton([(i, ascii_words(t)) for i, t in items], n)
    return _built[key]


_HITS = "spans array<struct<first:long,end:long>>, items array<string>, n_words long, longest long"


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(a + b):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple]]:
    """The distinct items in blocks of about ``block_bytes`` of text, each collected by itself."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        parts.append(sorted(((r[0], r[1].encode()) for r in rows), key=lambda x: (x[0] or "", x[1])))
    return parts


def _hits(items: list[tuple], n: int, at: int, first: bool):
    """A function from a batch to its rows' overlaps: text in column ``at``,
    overlaps with earlier blocks (unless this is the first) in the last column."""
    key = (n, hash(tuple(items)))

    def run(b: pa.RecordBatch) -> list[dict]:
        auto = _automaton(key, items, n)
        before = None if first else b.column(b.num_columns - 1).to_pylist()
        found = []
        for k, text in enumerate(utf8(b.column(at))):
            words = ascii_words(text or b"")
            spans, ids, longest = auto.match(words)
            ids = {x for x in ids if x is not None}
            if before is not None:
                old = before[k]
                spans = _merge(spans, [(x["first"], x["end"]) for x in old["spans"]])
                ids |= set(old["items"])
                longest = max(longest, old["longest"])
            found.append({"spans": [{"first": x, "end": y} for x, y in spans], "items": sorted(ids), "n_words": len(words), "longest": longest})
        return found

    return run


_OVERLAP = pa.struct(
    [("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("n_words", pa.int64()), ("longest", pa.int64())]
)


def _scan(rows: DataFrame, blocks: list[list[tuple]], n: int, at: int) -> DataFrame:
    """``rows`` with a last column of overlaps, by one pass per block in one stage."""
    names = rows.columns
    last = free_name("__overlap", names)
    schema = T.StructType([*rows.schema.fields, T.StructField(last, T.StructType.fromDDL(_HITS))])

    def scan(items: list[tuple], first: bool):
        hits = _hits(items, n, at, first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = [b.column(i) for i in range(len(names))] + [pa.array(hits(b), _OVERLAP)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, last])

        return run

    for k, items in enumerate(blocks):
        rows = rows.mapInArrow(scan(items, k == 0), schema)
    return rows


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns (default: all) of each document with ``spans`` (merged,
    in words), ``items`` (ids as strings, sorted), ``n_words`` and ``longest``
    (longest match in words), in a struct column ``overlap``."""
    bound_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias(free_name("__text", keep)))
    out = _scan(rows, item_blocks(benchmark, item_col, item_text, block_bytes), n, len(keep))
    return out.select(*[F.col(c) for c in keep if c != "overlap"], F.col(out.columns[-1]).alias("overlap"))


def hit_words() -> F.Column:
    """Number of words inside the spans of an ``overlap`` column."""
    return F.aggregate("overlap.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])


def remove_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    min_words: int = 10,
    max_coverage: float = 0.5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the spans of at least ``min_words`` words that occur in
    items, nor those of whole items of fewer than ``n`` words; documents with
    more than ``max_coverage`` of their words hit go."""
    bound_batches(docs.sparkSession)
    columns, blocks = docs.columns, item_blocks(benchmark, item_col, item_text, block_bytes)
    at = columns.index(text_col)
    # the last block's pass cuts the texts too: one Python operator for a benchmark of one block
    found = _scan(docs, blocks[:-1], n, at)
    hits = _hits(blocks[-1], n, at, len(blocks) == 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            for k, hit in enumerate(hits(b)):
                spans = [(x["first"], x["end"]) for x in hit["spans"]]
                keep.append(sum(y - x for x, y in spans) <= max_coverage * hit["n_words"])
                spans = [(x, y) for x, y in spans if y - x >= min_words or y - x < n]
                if spans and keep[-1]:
                    texts[k] = _without(texts[k], spans)
            cols = [b.column(i) for i in range(len(columns))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(cut, docs.schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])
