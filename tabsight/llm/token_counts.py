"""Token counts: a two-tier lookup of pre-token lengths on the map side.

``count_tokens`` gives the number of tokens of every text under a word-level
BPE file of the ``tokenizers`` library. Its pre-tokens never hold white space,
so a text's count is the sum of its pre-tokens' counts:

1. Tier one is a compact hash table of the most frequent pre-tokens and their
   lengths in tokens, sent to every task. The frequent ones are found over the
   whole table without moving pre-tokens: each task keeps a bounded frequency
   summary (Misra-Gries: any pre-token of more than 1/``table_rows`` of a
   task's pre-tokens stays in it), and summaries of ``fan_in`` tasks are merged
   per round until one is left. The table has at most ``table_rows`` entries of
   20 bytes, whatever the input.
2. Tier two encodes the misses of a batch with the library and keeps their
   lengths in a bounded cache of the worker process.

What the table holds decides the speed only, never a count. Texts are split in
numpy by character class. A white-space-free chunk with characters outside the
classes known here (beyond U+00FF) is one unit for the table, the cache and the
library. Keys have 128 bits: the bytes themselves for up to 15 Latin-1
characters, two hashes for other units.

Defined results: a null text is an empty one (0 bytes, 0 tokens); added tokens
inside a text count as one token each, as the library does by default; very
long texts are counted whole in pieces cut at white space; ids of any type, null
ones too, are passed on; repeated rows are counted row by row; other columns
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.errors import InputError
from tabsight.llm.common import bound_batches, mix, powers, write_table

#: The split pattern and normalizers that ``split_text`` follows (fixed values of the tokenizer file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KNOWN = 0x100  # code points below it have an entry in the tables; the last entry is for all others
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_PIECE = 1 << 20  # characters split at once
_CACHE_ROWS = 1 << 18  # lengths in each of the two generations of a worker's cache
_PACKED = 15  # characters whose bytes are the key
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_KNOWN + 1, _OTHER, dtype=np.uint8)
    lower = np.arange(_KNOWN + 1, dtype=np.uint32)
    for c in range(1, _KNOWN):  # U+0000 pads keys, so its chunks are others
        group = unicodedata.category(chr(c))[0]
        kind[c] = _SPACE if chr(c) in _WHITE else _LETTER if group == "L" else _DIGIT if group == "N" else _SIGN
        lower[c] = ord(chr(c).lower())
    return kind, lower


_KIND, _LOWER = _tables()


def split_text(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the text (lower-cased where known), starts and ends of its
    pre-tokens, and whether a pre-token is a whole chunk for the library."""
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    capped = np.minimum(cp, _KNOWN)
    kind = _KIND[capped]
    low = np.where(kind == _OTHER, cp, _LOWER[capped])
    if (kind == _OTHER).any():  # a chunk with one such character is one unit, as it stands
        chunk = np.cumsum(kind == _SPACE)
        flagged = np.zeros(int(chunk[-1]) + 1, dtype=bool)
        flagged[chunk[kind == _OTHER]] = True
        whole = flagged[chunk] & (kind != _SPACE)
        kind[whole], low[whole] = _OTHER, cp[whole]
    start = np.ones(len(kind), dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    ticks = np.flatnonzero((low[:-2] == 39) & (kind[:-2] == _SIGN) & start[:-2] & (kind[1:-1] == _LETTER)) if len(low) > 2 else np.empty(0, int)
    if len(low) > 1 and low[-2] == 39 and kind[-2] == _SIGN and start[-2] and kind[-1] == _LETTER:
        ticks = np.append(ticks, len(low) - 2)
    if len(ticks):  # contractions: 's 't 'm 'd, 're 've 'll
        first = low[ticks + 1]
        after = np.minimum(ticks + 2, len(low) - 1)
        second = np.where((ticks + 2 < len(low)) & (kind[after] == _LETTER), low[after], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        start[ticks[one | two] + 1] = False
        for size, at in ((2, ticks[one]), (3, ticks[two])):
            at = at[at + size < len(low)] + size
            start[at[kind[at] == _LETTER]] = True
    edge = np.flatnonzero(start | (kind == _SPACE))
    end = np.append(edge[1:], len(kind))
    real = kind[edge] != _SPACE
    starts, ends = edge[real], end[real]
    return low, starts, ends, kind[starts] == _OTHER


def unit_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the units, as two arrays of 64 bits."""
    size = ends - starts
    flat = np.zeros(len(low) + 16, dtype=np.uint8)
    flat[: len(low)] = low
    at8 = np.ndarray(len(low) + 8, dtype="<u8", buffer=flat.data, strides=(1,))  # the 8 bytes from every place
    k1 = at8[starts] & _FIRST[np.minimum(size, 8)]
    k2 = at8[np.minimum(starts + 8, len(low))] & _FIRST[np.clip(size - 8, 0, 7)]
    other = np.flatnonzero(whole | (size > _PACKED))
    if len(other):
        hashes = []
        for base, inverse in zip(_BASES, _INVERSES, strict=True):
            sums = np.zeros(len(low) + 1, dtype=np.uint64)
            np.cumsum(mix(low.astype(np.uint64) + base) * powers(base, len(low)), out=sums[1:])
            hashes.append(mix((sums[ends[other]] - sums[starts[other]]) * powers(inverse, len(low))[starts[other]]))
        k1[other], k2[other] = hashes[0], (hashes[1] >> np.uint64(8)) | np.uint64(1 << 56)
    return k1, k2


def _slots(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return mix(k1 ^ mix(k2 + _BASES[0]))


def distinct_units(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct key, and each key's number among them."""
    _, first, inverse = np.unique(_slots(k1, k2), return_index=True, return_inverse=True)
    if np.array_equal(k1[first][inverse], k1) and np.array_equal(k2[first][inverse], k2):
        return first, inverse
    keys = np.stack((k1, k2), axis=1)  # two keys of one slot hash
    _, first, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def unit_texts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The strings of some units."""
    text = low.tobytes().decode("utf-32-le")
    return [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class LengthTable:
    """Lengths of the frequent pre-tokens by 128-bit key, open addressing in numpy."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, lengths: np.ndarray) -> None:
        bits = max(4, int(4 * len(k1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.k1, self.k2 = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.length = np.full(1 << bits, -1, np.int32)  # -1: free
        todo, slot = np.arange(len(k1)), (_slots(k1, k2) >> self.shift).astype(np.int64)
        while len(todo):  # each round, one of the keys that want a free slot takes it
            at = slot[todo]
            free = self.length[at] < 0
            where, who = np.unique(at[free], return_index=True)
            taken = todo[free][who]
            self.k1[where], self.k2[where], self.length[where] = k1[taken], k2[taken], lengths[taken]
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The length of every key, -1 where the table has none."""
        out = np.full(len(k1), -1, np.int32)
        todo, slot = np.arange(len(k1)), (_slots(k1, k2) >> self.shift).astype(np.int64)
        while len(todo):
            have = self.length[slot]
            hit = (self.k1[slot] == k1[todo]) & (self.k2[slot] == k2[todo]) & (have >= 0)
            out[todo[hit]] = have[hit]
            more = ~hit & (have >= 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out


class WordEncoder:
    """The library's tokenizer and the lengths a worker process has seen."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task owns one core
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] != NORMALIZERS or splits[:1] != [PATTERN]:
            raise InputError("The tokenizer file does not split words as this operator does.")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise InputError("Added tokens that strip or need word bounds are not supported.")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that end a pre-token
        suffix = spec["model"]["end_of_word_suffix"]
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(suffix)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each unit, from the cache or the library."""
        if len(self.new) > _CACHE_ROWS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        todo = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    todo.append(w)
        for at in range(0, len(todo), 2048):
            part = todo[at : at + 2048]
            new.update(zip(part, self._encode(part), strict=True))
        return [new[w] for w in words]

    def _encode(self, words: list[str]) -> list[int]:
        """Tokens of each unit by the library: all in one text if each is one
        pre-token (then each has one id that ends a pre-token), else one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
        at = np.flatnonzero(self.ends[ids])
        if len(at) == len(words) and len(ids) == (at[-1] + 1 if len(at) else 0) and not any(map(_MANY.search, words)):
            return np.diff(at, prepend=-1).tolist()
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def plain_parts(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and their number."""
        if self.added is None or "<" not in text and not self.added.search(text):
            return [text], 0
        parts = self.added.split(text)
        return parts, len(parts) - 1


_encoders: dict[str, WordEncoder] = {}
_SPACES = re.compile(f"[{_WHITE}]")
#: Characters of units that are whole chunks: such a unit may hold many pre-tokens, or none.
_MANY = re.compile("[^\x01-\xff]")


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(text: str) -> Iterator[str]:
    """The text cut at white space into pieces of about ``_PIECE`` characters."""
    at = 0
    while len(text) - at > 2 * _PIECE:
        found = _SPACES.search(text, at + _PIECE)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def _blocks(encoder: WordEncoder, texts: list[str | None]) -> Iterator[tuple[str, list[int], list[int], int]]:
    """Joined texts of about ``_PIECE`` characters with each part's row and end.

    A row's added tokens come as (``""``, [row], [], count); a piece that could
    not be cut comes alone, longer than ``2 * _PIECE``.
    """
    joined, rows, ends, size = [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        parts, special = encoder.plain_parts(text)
        if special:
            yield "", [row], [], special
        for part in parts:
            for piece in _pieces(part):
                if len(piece) > 2 * _PIECE:
                    yield piece, [row], [len(piece) + 1], 0
                    continue
                joined.append(piece)
                size += len(piece) + 1
                rows.append(row)
                ends.append(size)
                if size >= _PIECE:
                    yield "\n".join(joined), rows, ends, 0
                    joined, rows, ends, size = [], [], [], 0
    if joined:
        yield "\n".join(joined), rows, ends, 0


def count_texts(texts: list[str | None], encoder: WordEncoder, table: LengthTable) -> np.ndarray:
    """Tokens of every text: the table first, the worker's cache for its misses."""
    out = np.zeros(len(texts), dtype=np.int64)
    for text, rows, ends, special in _blocks(encoder, texts):
        if special:
            out[rows[0]] += special
            continue
        if len(rows) == 1 and len(text) > 2 * _PIECE:  # hardly any white space: one piece for the library
            out[rows[0]] += len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
            continue
        low, starts, stops, whole = split_text(text)
        if not len(starts):
            continue
        k1, k2 = unit_keys(low, starts, stops, whole)
        lengths = table.find(k1, k2)
        missed = np.flatnonzero(lengths < 0)
        if len(missed):
            first, inverse = distinct_units(k1[missed], k2[missed])
            at = missed[first]
            lengths[missed] = np.array(encoder.lengths(unit_texts(low, starts[at], stops[at])), dtype=np.int32)[inverse]
        part = np.searchsorted(np.array(ends), starts, side="right")
        out += np.bincount(np.array(rows)[part], weights=lengths, minlength=len(texts)).astype(np.int64)
    return out


# ------------------------------------------------------- frequent pre-tokens
def _cut(n: np.ndarray, most: int) -> int:
    """Misra-Gries: the (most + 1)-th largest count, taken off every entry."""
    return int(np.partition(n, len(n) - most - 1)[len(n) - most - 1]) if len(n) > most else 0


class Summary:
    """Bounded counts of the units of one task."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.k1, self.k2, self.n = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.long: dict[tuple[int, int], str] = {}  # the units whose bytes are not their key

    def add(self, text: str) -> None:
        low, starts, stops, whole = split_text(text)
        if not len(starts):
            return
        k1, k2 = unit_keys(low, starts, stops, whole)
        first, inverse = distinct_units(k1, k2)
        long = first[k2[first] >> np.uint64(56) > 0]
        for a, b, w in zip(k1[long].tolist(), k2[long].tolist(), unit_texts(low, starts[long], stops[long]), strict=True):
            self.long[a, b] = w
        k1, k2 = np.concatenate((self.k1, k1[first])), np.concatenate((self.k2, k2[first]))
        n = np.concatenate((self.n, np.bincount(inverse)))
        first, inverse = distinct_units(k1, k2)
        self.k1, self.k2, self.n = k1[first], k2[first], np.bincount(inverse, weights=n).astype(np.int64)
        if len(self.n) > 4 * self.most:
            self.prune()

    def prune(self) -> None:
        cut = _cut(self.n, self.most)
        left = self.n > cut
        self.k1, self.k2, self.n = self.k1[left], self.k2[left], self.n[left] - cut
        long = self.k2 >> np.uint64(56) > 0
        self.long = {key: self.long[key] for key in zip(self.k1[long].tolist(), self.k2[long].tolist(), strict=True)}

    def counts(self) -> dict[str, int]:
        self.prune()
        keys = np.stack((self.k1, self.k2), axis=1).astype("<u8").tobytes()
        words = [
            self.long[a, b] if b >> 56 else keys[16 * i : 16 * i + 16].rstrip(b"\0").decode("latin-1")
            for i, (a, b) in enumerate(zip(self.k1.tolist(), self.k2.tolist(), strict=True))
        ]
        return dict(zip(words, self.n.tolist(), strict=True))


def _prune(counts: Counter, most: int) -> Counter:
    cut = _cut(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), most)
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


_SUMMARY = "word string, n long"


def _rows(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def frequent_words(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = 16_384, fan_in: int = 8) -> list[str]:
    """At most ``most`` frequent pre-tokens of all texts, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(most)
        for b in batches:
            for text, rows, _, _ in _blocks(_encoder(tokenizer), b.column(0).to_pylist()):
                if text and (len(rows) > 1 or len(text) <= 2 * _PIECE):
                    summary.add(text)
        yield _rows(summary.counts())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[word] += n
            if len(counts) > 4 * most:
                counts = _prune(counts, most)
        yield _rows(_prune(counts, most))

    table = write_table(docs.select(F.col(text_col).cast("string")).mapInArrow(count, _SUMMARY), "word-counts")
    tasks = None
    while tasks != 1:
        rows = table.count()
        wanted = max(1, -(-rows // (fan_in * most)))
        tasks = wanted if tasks is None else min(wanted, max(1, tasks // 2))  # fewer each round, so the rounds end
        table = write_table(table.coalesce(tasks).mapInArrow(merge, _SUMMARY), "word-counts")
    return [r.word for r in sorted(table.collect(), key=lambda r: (-r.n, r.word))]


def length_arrays(words: list[str], encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and lengths of the table's words."""
    low = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, words)]).astype(np.int64)
    whole = np.array([bool(_MANY.search(w)) for w in words], dtype=bool)
    k1, k2 = unit_keys(low, ends[:-1], ends[1:], whole)
    return k1, k2, np.array(encoder.lengths(words), dtype=np.int32)


_length_tables: dict[str, LengthTable] = {}


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 16_384, fan_in: int = 8
) -> DataFrame:
    """One row per text: the id column, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer`` is the path of a word-level BPE file whose normalizer and
    split pattern are those named above (any other file is an error).
    ``table_rows`` bounds the broadcast table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    arrays = length_arrays(frequent_words(docs, tokenizer, text_col, table_rows, fan_in), WordEncoder(tokenizer))
    sent = spark.sparkContext.broadcast(arrays)
    number = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        if number not in _length_tables:
            _length_tables.clear()
            _length_tables[number] = LengthTable(*sent.value)
        for b in batches:
            texts = b.column(1)
            n = count_texts(texts.to_pylist(), encoder, _length_tables[number])
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n)], names=[id_col, "n_bytes", "n_tokens"])

    out = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, out)
