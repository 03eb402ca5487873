"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Features are the words and word pairs of a text (letters, digits and non-ASCII
characters on one side, runs of other signs on the other; A-Z lower-cased) and
the words that come again within four words, hashed into ``buckets`` places and weighted by their share of the text. The
model is trained by follow-the-regularised-leader (proximal) updates, example by
example, on all labelled rows: shards of about ``shard_rows`` of them take their own
updates for an epoch, then each number of the model becomes the mean over the shards,
weighted by what they learned of it (``shards.py``). With one shard this is plain FTRL.
Texts are turned into sparse rows once, so an epoch sees only bucket numbers and weights. The
model, ``buckets`` numbers, is what is sent to the executors; each text is then
scored whole as a sparse dot product in one pass without a shuffle.

Defined results: an empty or null text has no features and gets the score of
the intercept; labels that are null, or contradict each other for one id, are
not used; repeated rows are scored one by one; extra columns are not read; an
empty or one-sided training set gives the share of ones (0.5 if none) as every score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import TOKEN_CLASS, bound_batches, mix, token_hashes, utf8, write_table
from tabsight.llm.shards import deal, epoch_sum, mean_of, pack, state_batch, unpack


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, max_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label, weight`` of all ids with a label (0, 1) that satisfy ``train`` (on ``doc_id``),
    one row each, or of at most ``max_rows`` of each label, drawn by id hashes; ``weight`` is the number of labelled ids that each one stands for."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").where(train)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    known = write_table(known, "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if max_rows is None:  # the labels grow with the documents: never broadcast; one shuffle serves the join and the grouping
        near = _likely_known(rows.where(train), known)  # texts without a label are hardly shuffled
        return _one_text(near.join(known.withColumn("weight", F.lit(1.0)).hint("merge"), "doc_id"))
    size = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    parts = []
    for y in (0, 1):
        n = size.get(y, 0)
        # about twice the wanted rows by one hash, then the first of them by another
        near = F.pmod(F.xxhash64(F.lit(y), "doc_id"), F.lit(1 << 30)) < int(min(1.0, 2 * max_rows / max(1, n)) * (1 << 30))
        some = known.where(F.col("label") == y).where(near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        parts.append(some.withColumn("weight", F.lit(n / max(1, min(n, max_rows)))))
    picked = parts[0].unionByName(parts[1])
    return _one_text(rows.join(F.broadcast(picked), "doc_id"))  # 2 * max_rows small rows


#: Most bits of the filter of ``_likely_known`` (16 MB); and bits of one of its rows, as ``bitmap_construct_agg`` has them.
_MAX_BITS = 1 << 27
_ROW_BITS = 1 << 15


def _likely_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The ``rows`` whose ``doc_id`` is in ``known`` (without null), and a few others: up to an
    eighth of them, more only where ``known`` has over ``_MAX_BITS / 8`` ids. A bit per id hash is
    broadcast, at most ``_MAX_BITS`` of them; an exact join follows."""
    bits = min(_MAX_BITS, max(_ROW_BITS, 1 << (8 * known.count() - 1).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    block, place = F.shiftright(slot, _ROW_BITS.bit_length() - 1), slot.bitwiseAND(F.lit(_ROW_BITS - 1))
    # dealt by block first: each row of bits is built once
    built = known.select(block.alias("block"), place.alias("place")).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(built), (block == F.col("block")) & is_set, "left_semi")


def _one_text(found: DataFrame) -> DataFrame:
    """One row per id, however often the documents repeat it: that of the smallest text hash."""
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label", "weight")).alias("row"))
    return one.select("doc_id", "row.text", "row.label", "row.weight")


def features(text: bytes, buckets: int) -> np.ndarray:
    """Bucket numbers of the text's words and word pairs, repeats included."""
    words = token_hashes(text, TOKEN_CLASS, lower=True)
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    # a word that comes again one to four words later counts as one feature of that gap, whichever word it is
    echoes = [np.full(np.count_nonzero(words[gap:] == words[:-gap]), mix(np.uint64([gap]))[0]) for gap in range(1, 5)]
    return (np.concatenate((words, pairs, *echoes)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


class FtrlModel:
    """Logistic regression weights kept by FTRL-proximal."""

    def __init__(self, buckets: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)  # the last place is the intercept

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def shares(at: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    places, count = np.unique(at, return_counts=True)
    return places, count * (scale / max(1, len(at)))


def fit_quality(
    rows: DataFrame,
    buckets: int = 1 << 18,
    epochs: int = 6,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    scale: float = 20.0,
    shard_rows: int = 1 << 15,
) -> np.ndarray:
    """Model weights (the last is the intercept) from ``doc_id, text, label`` rows."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shares(features(t or b"", buckets), scale) for t in utf8(b.column(1))]
            places, x = [pack(at.astype(np.int32)) for at, _ in found], [pack(v.astype(np.float32)) for _, v in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(places, pa.binary()), pa.array(x, pa.binary())], names=["doc_id", "label", "places", "x"])

    def epoch(number: int):
        def task(shared):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                start = np.frombuffer(shared.value).reshape(2, -1)
                model = FtrlModel(buckets, alpha, beta, l1, l2)
                model.z, model.n = start.copy()
                for k, b in enumerate(batches):
                    _, labels, places, x = (c.to_pylist() for c in b.columns)
                    for i in np.random.default_rng([number, k]).permutation(len(labels)):
                        model.update(np.append(unpack(places[i], np.int32), buckets), np.append(unpack(x[i], np.float32), 1.0), labels[i])
                yield state_batch(np.stack([model.n - start[1], model.z]).astype(sent))

            return run

        return task

    def weigh(shared):
        def read(state: bytes) -> np.ndarray:
            learned, z = np.frombuffer(state, sent).astype(float).reshape(2, -1)
            squares = np.frombuffer(shared.value).reshape(2, -1)[1] + learned
            return np.concatenate([learned, learned * z, learned * squares])

        return read

    bound_batches(rows.sparkSession)
    rows = write_table(rows.select("doc_id", "text", "label"), "quality-rows")
    size = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # two rows
    n = sum(size.values())
    if len(size) < 2:
        share = size.get(1, 0) / n if n else 0.5
        out = np.zeros(buckets + 1, np.float32)
        out[-1] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return out
    dealt, shards = deal(rows, n, shard_rows)
    sent = np.float32 if shards > 1 else np.float64  # several shards' states are shuffled, in half the bytes
    # the order of arrival must not matter
    dealt = dealt.mapInArrow(sparse, "doc_id long, label int, places binary, x binary").sortWithinPartitions("doc_id", "places").persist()
    state = np.zeros((2, buckets + 1))
    try:
        for number in range(epochs):
            learned, z, squares = epoch_sum(dealt, shards, state, epoch(number), weigh).reshape(3, -1)
            state = np.stack([mean_of(z, learned, state[0]), mean_of(squares, learned, state[1])])
    finally:
        dealt.unpersist()
    model = FtrlModel(buckets, alpha, beta, l1, l2)
    model.z, model.n = state
    return model.weights(slice(None)).astype(np.float32)


def score_text(text: bytes, weights: np.ndarray, scale: float = 20.0) -> float:
    at = features(text, len(weights) - 1)
    z = float(weights[-1]) + (scale * float(weights[at].mean(dtype=np.float64)) if len(at) else 0.0)
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", scale: float = 20.0) -> DataFrame:
    """``doc_id, score`` (the model's probability of label 1) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [score_text(t or b"", weights, scale) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
