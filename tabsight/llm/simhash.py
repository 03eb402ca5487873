"""SimHash near-dedup with a Gray-ordered hierarchical index.

``fingerprints`` gives each text the 64-bit SimHash of its word shingles.
``near_groups`` links fingerprints that differ in at most ``max_bits`` bits and
returns each document's group.

Linking works on distinct fingerprints (a group of exact copies is one row):

1. A fingerprint is rotated so that each of ``max_bits + 1`` segments comes
   first once. Two fingerprints within ``max_bits`` bits agree in one whole
   segment, so in that rotation they stand in one subtree of the Gray order:
   that subtree is a group, and groups are dealt to tasks.
2. In a group the fingerprints are sorted by Gray rank. Runs of neighbours are
   factored into nodes (the mask of the bits that all of them share, and the
   shared pattern), nodes into upper nodes. A search adds up the differences on
   the shared bits from the top down and drops a whole node as soon as they
   exceed ``max_bits``; what is left is compared in full.
3. A task hands out a spanning forest of the links it found, never all pairs,
   and the distributed components join the forests.

A group with more than ``group_rows`` fingerprints is divided again by the
segments of its other bits, and what is still too large is searched as pairs of
blocks, so no task holds more than a few blocks. Every case is exact.

Defined results: null or wordless texts have fingerprint zero and link like any
other; fewer words than a shingle give one shingle of them all; repeated rows
keep their rows; a null id never becomes a group's id; extra columns are not
read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import bound_batches, lower_ascii, space_words, utf8, write_table
from tabsight.llm.components import connected_components, local_roots

_DIGESTS_AT_ONCE = 1 << 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text (see ``fingerprints``), unsigned."""
    words = space_words(lower_ascii(text))
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(b" ".join(words), 42), "big")
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, _DIGESTS_AT_ONCE):
        to = min(n, at + _DIGESTS_AT_ONCE)
        cuts = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        raw = np.frombuffer(b"".join([digest(plain[a:b], 42) for a, b in cuts]), dtype=np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp``: A-Z lower-cased, words split at white space, shingles of
    ``shingle`` words with repeats, XXH64 (seed 42); a bit is set if it is in
    over half the hashes. ``fp`` holds the 64 bits as a signed long;
    ``text_hash`` tells rows of one id and different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t or b"", shingle) for t in utf8(b.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _rotated(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in the reflected Gray order (as a signed long)."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def _segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``parts`` nearly equal segments of ``bits`` bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


_RUN = 16  # fingerprints in a lower node, and lower nodes in an upper one


def _nodes(codes: np.ndarray, shared: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes over runs of ``_RUN`` children: start, mask of shared bits, pattern."""
    starts = np.arange(0, len(codes), _RUN)
    same = np.bitwise_and.reduceat(pattern & shared, starts) | np.bitwise_and.reduceat(~pattern & shared, starts)
    return starts, same, pattern[starts] & same


def search_group(codes: np.ndarray, max_bits: int, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i > j) of Gray-sorted distinct ``codes`` within ``max_bits`` bits."""
    n = len(codes)
    full = np.full(n, ~np.uint64(0))
    low_at, low_mask, low_pattern = _nodes(codes, full, codes)
    up_at, up_mask, up_pattern = _nodes(low_at, low_mask, low_pattern)
    found_a, found_b = [], []
    step = max(1, at_once // max(1, len(up_at)))
    for q0 in range(0, n, step):
        q = codes[q0 : q0 + step]
        seen = np.bitwise_count((q[:, None] ^ up_pattern[None, :]) & up_mask[None, :])
        qi, ui = np.nonzero((seen <= max_bits) & (up_at[None, :] * _RUN <= (q0 + np.arange(len(q)))[:, None]))
        for at in range(0, len(qi), max(1, at_once // _RUN // _RUN)):
            pick = slice(at, at + max(1, at_once // _RUN // _RUN))
            qs, us, acc = qi[pick], ui[pick], seen[qi[pick], ui[pick]]
            low = us[:, None] * _RUN + np.arange(_RUN)[None, :]
            there = low < len(low_at)
            low = np.minimum(low, len(low_at) - 1)
            more = np.bitwise_count((q[qs][:, None] ^ low_pattern[low]) & low_mask[low] & ~up_mask[us][:, None])
            total = acc[:, None] + more
            x, y = np.nonzero(there & (total <= max_bits))
            node, who, acc = low[x, y], qs[x], total[x, y]
            leaf = node[:, None] * _RUN + np.arange(_RUN)[None, :]
            there = leaf < (q0 + who)[:, None]
            leaf = np.minimum(leaf, n - 1)
            more = np.bitwise_count((q[who][:, None] ^ codes[leaf]) & ~low_mask[node][:, None])
            x, y = np.nonzero(there & (acc[:, None] + more <= max_bits))
            found_a.append(q0 + who[x])
            found_b.append(leaf[x, y])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, int), np.empty(0, int))


def _forest(keys: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs found within each key's run."""
    n = len(codes)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    a_all, b_all = [], []
    small = np.repeat(sizes <= _RUN, sizes)
    for shift in range(1, min(_RUN, int(sizes.max(initial=0)))):  # short runs: all at once
        near = small[shift:] & (keys[shift:] == keys[:-shift])
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(codes[at + shift] ^ codes[at]) <= max_bits]
        a_all.append(at + shift)
        b_all.append(at)
    for s, size in zip(starts[sizes > _RUN], sizes[sizes > _RUN], strict=True):
        a, b = search_group(codes[s : s + size], max_bits)
        a_all.append(a + s)
        b_all.append(b + s)
    if not a_all:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = local_roots(n, np.concatenate(a_all), np.concatenate(b_all))
    moved = np.flatnonzero(root != np.arange(n))
    return codes[moved].view(np.int64), codes[root[moved]].view(np.int64)


def _search(groups: DataFrame, max_bits: int) -> DataFrame:
    """``a, b`` links from ``key, fp`` rows; rows of one key are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(keys, codes, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        keys, codes = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:  # the last key's run may go on in the next batch
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            codes = np.concatenate((codes, b.column(1).to_numpy().view(np.uint64)))
            if len(keys):
                done = int(np.searchsorted(keys, keys[-1]))
                if done:
                    yield out(keys[:done], codes[:done])
                    keys, codes = keys[done:], codes[done:]
        if len(keys):
            yield out(keys, codes)

    dealt = groups.repartition("key").sortWithinPartitions("key", "rank").select("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def link_fingerprints(fps: DataFrame, max_bits: int = 3, group_rows: int = 8192) -> DataFrame:
    """Links ``a, b`` between distinct ``fp`` values; their components are those
    of all pairs that differ in at most ``max_bits`` bits."""
    turns = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(_rotated(F.col("fp"), first), 64 - width).alias("part"), _rotated(F.col("fp"), first).alias("code"))
            for k, (first, width) in enumerate(_segments(64, max_bits + 1))
        ]
    )
    routed = fps.select("fp", F.explode(turns).alias("t")).select(
        "fp", F.xxhash64("t.k", "t.part").alias("key"), gray_rank(F.col("t.code")).alias("rank"), F.col("t.k").alias("k"), F.col("t.code").alias("code")
    )
    large = write_table(routed.groupBy("key").count().where(F.col("count") > group_rows), "large-groups")
    if large.isEmpty():
        return _search(routed, max_bits)
    found = _search(routed.join(large, "key", "left_anti"), max_bits)
    # the bits after the shared segment are divided by the same principle
    width = {k: w for k, (_, w) in enumerate(_segments(64, max_bits + 1))}
    widest = max(width.values())
    inner = F.array(
        *[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(F.shiftleft(F.col("code"), widest + first), 64 - w).alias("part")) for j, (first, w) in enumerate(_segments(64 - widest, max_bits + 1))]
    )
    again = routed.join(large.select("key"), "key", "left_semi").select("fp", "rank", "key", F.explode(inner).alias("t"))
    again = write_table(again.select("fp", "rank", F.xxhash64("key", "t.j", "t.part").alias("key")), "inner-groups")
    sizes = write_table(again.groupBy("key").count().where(F.col("count") > group_rows), "large-inner-groups")
    found = found.unionByName(_search(again.join(sizes, "key", "left_anti"), max_bits))
    if not sizes.isEmpty():
        blocks = again.join(sizes, "key").withColumn("m", F.ceil(F.col("count") / group_rows)).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m")))
        pairs = blocks.select("fp", "rank", "key", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
        pairs = pairs.select("fp", "rank", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
        found = found.unionByName(_search(pairs, max_bits))
    return found


def _roots(marked: DataFrame, max_bits: int, group_rows: int) -> DataFrame:
    """``fp, root`` for every fingerprint; ``root`` names its component."""
    classes = write_table(marked.select("fp").distinct(), "fingerprint-classes")
    roots = connected_components(link_fingerprints(classes, max_bits, group_rows))
    return write_table(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    group_rows: int = 8192,
) -> DataFrame:
    """``doc_id, fp, component_id`` per document: the smallest id that can be
    reached over links of at most ``max_bits`` differing bits."""
    marked = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _roots(marked, max_bits, group_rows)
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    least = named.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    group_rows: int = 8192,
) -> DataFrame:
    """``docs`` with one row per near-duplicate group: one of the smallest id
    (a row without id only in a group that has none)."""
    marked = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _roots(marked, max_bits, group_rows)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = marked.groupBy("fp").agg(F.min(order).alias("best")).join(named, "fp").groupBy("root").agg(F.min("best").alias("best"))
    rows = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = best.select(F.col("best.doc_id").alias("__id"), F.col("best.text_hash").alias("__hash"))
    kept = kept.join(rows, kept["__id"].eqNullSafe(rows["doc_id"]) & (kept["__hash"] == rows["text_hash"])).select("__id", "__hash", "n")
    kept = write_table(kept, "kept-documents")
    text_hash = F.xxhash64(docs[text_col].cast("string"))

    def of(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs[id_col].cast("long").eqNullSafe(keys["__id"]) & (text_hash == keys["__hash"]), "left_semi")

    out, repeated = of(kept.where("n = 1")), kept.where("n > 1")
    if not repeated.isEmpty():  # rows that repeat both id and text: one of them stays
        out = out.unionByName(of(repeated).dropDuplicates([id_col, text_col]))
    return out
