"""Spelling variants: Bloom-guided neighbourhoods of one edit.

Two words are near if one inserted, deleted or replaced character makes them
equal. Generating every edit of a word and joining all of them would shuffle
hundreds of rows a word; here a Bloom filter of the vocabulary drops almost all
of them on the map side:

1. The vocabulary (word, n) is written once. Each word belongs to a shard by its
   length (64 characters and more share one) and, if a shard has more words than
   ``shard_words``, to a slice of it by hash. A shard's filter has blocks of 512
   bits. Tasks build disjoint ranges of blocks, so no filter is built twice.
2. Filters are broadcast in rounds of at most ``filter_bytes``; a larger
   vocabulary takes more rounds, never a larger broadcast. Words generate their
   edits as hash differences in numpy, without making strings: every deletion,
   and the replacements by a larger character. Each pair of near words comes up
   once that way (an insertion is the other word's deletion).
3. Only edits that the filter knows become strings and are shuffled to an exact
   join with the vocabulary, which removes the false positives.

``variant_forms`` then takes the near word of largest n as a word's form, if it
is ``ratio`` times as frequent. A form is strictly more frequent, so forms make
trees; roots are found by pointer doubling in at most log2(log10(n)) + 1 rounds.

Hot keys: the word counts combine on the map side; every later key is a distinct
word, and the near words of one word are bounded by its length and the alphabet.

Defined results: null and empty texts have no words; an unknown (null) id counts
as an empty one in ``planted_typos``; very long texts and words are read whole
(edits are made in blocks of bounded size); repeated rows count as often as they
stand there; ties go to the smallest word in code-point order; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import bound_batches, mix, powers, write_table

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_BLOCK = 512  # bits
#: Words of this many characters and more share a shard.
_LONG = 64
#: Filter bits per word and bits set per word: in the shards of one length, in the shard of long words
#: (their many edits need a rarer false positive).
_SHORT_BITS, _SHORT_SET = 16, 6
_LONG_BITS, _LONG_SET = 64, 12
#: Edits probed at once.
_PROBES = 1 << 20
#: Words whose edits one task generates.
_TASK_WORDS = 25_000


# -------------------------------------------------------------------- words
def planted_typos(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """``word, n``: the runs of ``[A-Za-z\\u00C0-\\u00FF]`` of all texts, A-Z
    lower-cased, with at least ``least`` characters. A run of which ``every``
    divides the crc32 of ``<id>:<run>`` loses the character at crc32 % length."""
    run = F.col("run")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, capitals, capitals.lower()))
    crc = F.crc32(F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("crc") % F.length("run")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length("run")))
    return (
        docs.select(
            F.col(id_col).cast("string").alias("id"),
            # a run is matched from its start, so shorter ones (which stay shorter) are skipped whole
            F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run"),
        )
        .select("id", lower.alias("run"))
        .select("run", crc.alias("crc"))
        .select(F.when(F.col("crc") % every == 0, cut).otherwise(run).alias("word"))
        .where(F.length("word") >= least)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


# ------------------------------------------------------------------- filter
def _values(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(np.uint64) + _BASE)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length: a row of code points each."""
    return mix((_values(codes) * powers(_BASE, codes.shape[1])).sum(axis=1, dtype=np.uint64))


def shard_of(length: int) -> int:
    return min(length, _LONG)


def shard_bits(shard: int) -> tuple[int, int]:
    return (_LONG_BITS, _LONG_SET) if shard == _LONG else (_SHORT_BITS, _SHORT_SET)


class BlockedBloom:
    """One slice of one shard: blocks of 512 bits, all bits of a word in one block."""

    def __init__(self, words: np.ndarray, n_set: int) -> None:
        self.words, self.n_set = words, n_set  # 8 numbers of 64 bits a block
        self.blocks = np.uint64(len(words) // 8)

    @staticmethod
    def block_of(h: np.ndarray, blocks: np.ndarray | np.uint64) -> np.ndarray:
        """The block of each hash, by its high half."""
        return ((h >> np.uint64(32)) * blocks) >> np.uint64(32)

    @staticmethod
    def build(h: np.ndarray, first: int, n_blocks: int, blocks: int, n_set: int) -> np.ndarray:
        """Blocks ``first`` to ``first + n_blocks - 1`` of a filter from the hashes in them."""
        out = np.zeros(8 * n_blocks, dtype=np.uint64)
        base = (BlockedBloom.block_of(h, np.uint64(blocks)) - np.uint64(first)) * np.uint64(8)
        more = mix(h + _BASE)
        for i in range(n_set):
            if i == 6:
                more = mix(more + np.uint64(1))
            b = (more >> np.uint64(9 * (i % 6))) & np.uint64(_BLOCK - 1)
            np.bitwise_or.at(out, (base + (b >> np.uint64(6))).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        return out

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the slice; a bit is read only for
        those that have all the bits before it."""
        left = np.arange(len(h))
        block = BlockedBloom.block_of(h, self.blocks)
        more = mix(h + _BASE)
        for i in range(self.n_set):
            if i == 6:
                more = mix(more + np.uint64(1))
            b = (more >> np.uint64(9 * (i % 6))) & np.uint64(_BLOCK - 1)
            hit = (self.words[(block * np.uint64(8) + (b >> np.uint64(6))).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
            left, block, more = left[hit], block[hit], more[hit]
        return left


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a shard that a hash belongs to (by its low half, which the block does not use)."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slices)) >> np.uint64(32)


# -------------------------------------------------------------------- edits
def edit_hits(codes: np.ndarray, letters: np.ndarray, probe_same, probe_shorter) -> Iterator[tuple[int, int, int]]:
    """(row, place, letter) of the edits that the probes know; letter -1 is a deletion.

    ``codes`` has a row of code points per word, all of one length. A probe
    takes hashes and returns the places of those it knows; None skips its kind.
    ``letters`` is the sorted alphabet. Replacements are by larger letters only;
    of a run of equal characters the first is deleted.
    """
    n, size = codes.shape
    weight = powers(_BASE, size)
    values = _values(letters)
    part = _values(codes) * weight
    sums = np.zeros((n, size + 1), dtype=np.uint64)
    np.cumsum(part, axis=1, out=sums[:, 1:])
    total = sums[:, -1]
    if probe_shorter is not None:
        for at in range(0, n * size, _PROBES):
            flat = np.arange(at, min(n * size, at + _PROBES))
            row, place = flat // size, flat % size
            first = (place == 0) | (codes[row, place] != codes[row, np.maximum(place, 1) - 1])
            row, place = row[first], place[first]
            h = mix(sums[row, place] + (total[row] - sums[row, place + 1]) * _BASE_INV)
            for k in probe_shorter(h).tolist():
                yield int(row[k]), int(place[k]), -1
    if probe_same is not None:
        step = max(1, _PROBES // max(1, len(letters)))
        for at in range(0, n * size, step):
            flat = np.arange(at, min(n * size, at + step))
            row, place = flat // size, flat % size
            base = total[row] - part[row, place]
            h = mix(base[:, None] + values[None, :] * weight[place][:, None])
            k = np.flatnonzero(letters[None, :] > codes[row, place][:, None])
            k = k[probe_same(h.reshape(-1)[k])]
            for i, j in zip((k // len(letters)).tolist(), (k % len(letters)).tolist(), strict=True):
                yield int(row[i]), int(place[i]), int(letters[j])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length and their code points, in blocks of bounded size."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        step = max(1, _PROBES // max(1, size))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            raw = "".join(words[i] for i in some.tolist()).encode("utf-32-le")
            yield some, np.frombuffer(raw, dtype=np.uint32).reshape(len(some), size)


# --------------------------------------------------------------------- jobs
_SEGMENT = 1 << 8  # blocks built in one group: 16 KB, of some 8,000 words


class _Shards:
    """Number of words, slices and blocks of every shard."""

    def __init__(self, words: dict[int, int], filter_bytes: int) -> None:
        self.slices, self.blocks = {}, {}
        for shard, n in words.items():
            bits = n * shard_bits(shard)[0]
            self.slices[shard] = max(1, -(-bits // (8 * filter_bytes)))
            self.blocks[shard] = max(1, -(-bits // (self.slices[shard] * _BLOCK)))

    def rounds(self, filter_bytes: int) -> list[list[tuple[int, int]]]:
        """(shard, slice) pairs that are broadcast together."""
        out, used = [], 0
        for shard in sorted(self.slices):
            for part in range(self.slices[shard]):
                size = self.blocks[shard] * _BLOCK // 8
                if not out or used + size > filter_bytes:
                    out.append([])
                    used = 0
                out[-1].append((shard, part))
                used += size
        return out


def _build_filters(vocabulary: DataFrame, shards: _Shards) -> DataFrame:
    """``shard, slice, segment, bits``: the block ranges of all filters."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes in _by_length(b.column(0).to_pylist()):
                h, shard = word_hashes(codes), shard_of(codes.shape[1])
                segment = (BlockedBloom.block_of(h, np.uint64(shards.blocks[shard])) // np.uint64(_SEGMENT)).astype(np.int32)
                part = slice_of(h, shards.slices[shard]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"shard": np.full(len(h), shard, np.int32), "slice": part, "segment": segment, "h": h.view(np.int64)}
                )

    def build(rows: pa.Table) -> pa.Table:
        shard, part, segment = (rows.column(c)[0].as_py() for c in ("shard", "slice", "segment"))
        blocks, first = shards.blocks[shard], segment * _SEGMENT
        h = rows.column("h").to_numpy().view(np.uint64)
        words = BlockedBloom.build(h, first, min(_SEGMENT, blocks - first), blocks, shard_bits(shard)[1])
        return pa.table({"shard": pa.array([shard], pa.int32()), "slice": pa.array([part], pa.int32()),
                         "segment": pa.array([segment], pa.int32()), "bits": pa.array([words.tobytes()], pa.binary())})

    placed = vocabulary.select("word").mapInArrow(place, "shard int, slice int, segment int, h long")
    return write_table(
        placed.groupBy("shard", "slice", "segment").applyInArrow(build, "shard int, slice int, segment int, bits binary"), "bloom"
    )


def _filters(table: DataFrame, shards: _Shards, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of one round, at most ``filter_bytes`` in all."""
    out = {(s, p): np.zeros(8 * shards.blocks[s], dtype=np.uint64) for s, p in wanted}
    keys = F.array(*(F.lit(s * 1_000_000 + p) for s, p in wanted))
    for r in table.where(F.array_contains(keys, F.col("shard") * 1_000_000 + F.col("slice"))).toLocalIterator():
        bits = np.frombuffer(r.bits, dtype=np.uint64)
        out[r.shard, r.slice][8 * _SEGMENT * r.segment :][: len(bits)] = bits
    return out


def _hits(vocabulary: DataFrame, letters: np.ndarray, shards: _Shards, table: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """``edit, word, n``: the edits of all words that the round's filters know."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(_filters(table, shards, wanted))

    def probe(shard: int):
        parts = [p for s, p in wanted if s == shard]
        if not parts:
            return None
        filters = {p: BlockedBloom(sent.value[shard, p], shard_bits(shard)[1]) for p in parts}
        if shards.slices[shard] == 1:
            return filters[0].has

        def has(h: np.ndarray) -> np.ndarray:
            own, found = slice_of(h, shards.slices[shard]), []
            for p, bloom in filters.items():
                at = np.flatnonzero(own == p)
                found.append(at[bloom.has(h[at])])
            return np.sort(np.concatenate(found))

        return has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for places, codes in _by_length(words):
                size = codes.shape[1]
                edits, rows, held = [], [], 0
                for row, at, letter in edit_hits(codes, letters, probe(shard_of(size)), probe(shard_of(size - 1)) if size > 1 else None):
                    word = words[places[row]]
                    edits.append(word[:at] + ("" if letter < 0 else chr(letter)) + word[at + 1 :])
                    rows.append(int(places[row]))
                    held += size
                    if held > _PROBES:
                        yield _hit_batch(edits, rows, words, n)
                        edits, rows, held = [], [], 0
                if edits:
                    yield _hit_batch(edits, rows, words, n)

    lengths = sorted({s for s, _ in wanted} | {s + 1 for s, _ in wanted})
    size = F.least(F.length("word"), F.lit(_LONG + 1))
    return vocabulary.where(size.isin(lengths) | ((size > _LONG) & F.lit(_LONG in lengths))).mapInArrow(run, "edit string, word string, n long")


def _hit_batch(edits: list[str], rows: list[int], words: list[str], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"edit": pa.array(edits, pa.string()), "word": pa.array([words[i] for i in rows], pa.string()), "n": pa.array(n[rows])})


def near_words(vocabulary: DataFrame, filter_bytes: int = 64 << 20) -> DataFrame:
    """``word, n, other, other_n``: every pair of near words once.

    ``vocabulary`` has distinct words and their counts (``word``, ``n``) and is
    read several times: pass a written table. The alphabet is taken from it;
    the edits of a word are its length times the alphabet's size.
    """
    spark = vocabulary.sparkSession
    bound_batches(spark)
    vocabulary = vocabulary.select("word", "n")
    stats = vocabulary.where("word <> ''").groupBy(F.least(F.length("word"), F.lit(_LONG)).alias("shard")).agg(F.count("*").alias("n")).collect()
    pairs = None
    if stats:
        shards = _Shards({r.shard: r.n for r in stats}, filter_bytes)
        chars = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
        letters = np.array(sorted(ord(r.c) for r in chars), dtype=np.uint32)
        table = _build_filters(vocabulary.where("word <> ''"), shards)
        # a word's edits are hundreds of probes, so words are dealt by number, not by file size
        vocabulary = vocabulary.repartition(-(-sum(r.n for r in stats) // _TASK_WORDS), "word")
        for wanted in shards.rounds(filter_bytes):
            hits = _hits(vocabulary, letters, shards, table, wanted)
            pairs = hits if pairs is None else pairs.unionByName(hits)
    else:
        pairs = vocabulary.select(F.col("word").alias("edit"), "word", "n").limit(0)
    exact = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    return pairs.join(exact, "edit").select("word", "n", F.col("edit").alias("other"), F.col("edit_n").alias("other_n"))


def variant_forms(vocabulary: DataFrame, ratio: int = 10, filter_bytes: int = 64 << 20) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary
    (``word``, ``n``; a written table, as it is read several times)."""
    pairs = near_words(vocabulary, filter_bytes)
    pairs = write_table(pairs, "near-words")
    no_word, no_n = F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n")
    rows = (
        vocabulary.select("word", "n", no_word, no_n)
        .unionByName(pairs)
        .unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    )
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))))
    near = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    likely = -F.col("best.less") >= ratio * F.col("n")
    forms = write_table(
        near.select(
            "word",
            F.when(likely, F.col("best.word")).alias("form"),
            "n",
            "n_near",
            F.when(likely, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    alone = forms.where("form IS NULL").withColumn("root", F.col("word"))
    linked = forms.where("form IS NOT NULL").withColumn("root", F.col("form"))
    while True:  # pointer doubling: a root moves to its own root
        ups = linked.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = write_table(linked.join(ups, "root", "left"), "word-roots")
        changed = moved.where("up IS NOT NULL").limit(1).count()
        linked = moved.withColumn("root", F.coalesce("up", "root")).drop("up")
        if not changed:
            break
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return alone.select(columns).unionByName(linked.select(columns))
