"""Word weights for single texts (E6): masks as bit sets, made by built-in functions.

Sample 0 of a text is the text itself; every other sample loses a seeded random
number of its distinct words (1 to all but one): those of the smallest hashes of
(seed, key, sample, word number). What stays is kept as an array of longs with
``BITS`` words each. A text's tokens are found once; the term vectors of its
samples are counted from their numbers. A logistic regression is applied to them in
the task that holds the text, which explains it at once; for any other model the
vectors are made and one transform scores them all. Per text, a task holds the bit
sets of its samples, and the weighted ridge is solved over the samples, so its size
does not grow with the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tabsight.functions.exprs import DEFAULT_SEED
from tabsight.functions.hashing import hash_ints
from tabsight.operators.models import linear_margins, with_proba
from tabsight.operators.text import fold_accents, sparse_vector, tfidf_tokens
from tabsight.session import cut_lineage

#: Words per long of a mask (no sign bit is used).
BITS = 62
#: Width of the kernel over the cosine distance times 100.
KERNEL_WIDTH = 25.0
#: Words whose masks are unpacked at once.
_BLOCK_WORDS = 62 * 64
#: Cells (samples by words, tokens or terms) that numpy works on at once.
_BLOCK_CELLS = 1_000_000


@F.pandas_udf(ArrayType(IntegerType()))
def _word_numbers(tokens: pd.Series, words: pd.Series) -> pd.Series:
    """The number of every token among its text's distinct words; once per text."""
    out = []
    for toks, names in zip(tokens, words, strict=True):
        at = {w: i for i, w in enumerate(names)}
        out.append([at[t] for t in toks])
    return pd.Series(out, dtype=object)


def _packed(flags: Column) -> Column:
    """An array of booleans as longs of ``BITS`` flags, the first flag in the lowest bit."""
    longs = F.sequence(F.lit(0), F.floor((F.size(flags) - 1) / BITS).cast("int"))

    def pack(block: Column) -> Column:
        def add(acc: Column, j: Column) -> Column:
            return acc * 2 + F.coalesce(F.get(flags, block * BITS + j), F.lit(False)).cast("long")

        return F.aggregate(F.sequence(F.lit(BITS - 1), F.lit(0)), F.lit(0).cast("long"), add)

    return F.when(F.size(flags) > 0, F.transform(longs, pack)).otherwise(F.array().cast("array<long>"))


def word_masks(texts: DataFrame, key_col: str, text_col: str, num_samples: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``_k, _s, _d, _bits, _text``: every sample's kept words as bits, and its text."""
    base = texts.select(F.col(key_col).cast("string").alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumn("_tok", F.filter(F.split("_t", r"(?U)\W+"), lambda w: F.length(w) > 0)).drop("_t")
    base = base.withColumn("_words", F.array_distinct("_tok")).withColumn("_num", _word_numbers("_tok", "_words"))
    rows = base.select("_k", "_tok", "_num", F.size("_words").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))).alias("_s"))
    whole = (F.col("_s") == 0) | (F.col("_d") <= 1)
    lost = F.when(whole, 0).otherwise(1 + F.pmod(F.xxhash64(F.lit(seed), "_k", "_s"), F.col("_d") - 1)).cast("int")
    draws = F.transform(
        F.when(F.col("_d") > 0, F.sequence(F.lit(0), F.col("_d") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.lit(seed), F.col("_k"), F.col("_s"), i),
    )
    rows = rows.withColumn("_lost", lost).withColumn("_draws", draws)
    limit = F.coalesce(F.get(F.array_sort("_draws"), F.col("_lost") - 1), F.lit(-(2**63)))
    # the limit is repeated as an array: inside a lambda it would be sorted out per word
    keep = F.zip_with("_draws", F.array_repeat(limit, F.col("_d")), lambda draw, at: (F.col("_lost") == 0) | (draw > at))
    rows = rows.withColumn("_keep", keep)
    kept = F.filter("_tok", lambda t, i: F.get(F.col("_keep"), F.get(F.col("_num"), i)))
    return rows.select("_k", "_s", "_d", _packed(F.col("_keep")).alias("_bits"), F.array_join(kept, " ").alias("_text"))


def unpack(bits: np.ndarray, first: int, last: int) -> np.ndarray:
    """0/1 columns of the words ``first`` (a multiple of ``BITS``) to ``last`` (exclusive), a row per sample."""
    longs = bits[:, first // BITS : -(-last // BITS)]
    flags = (longs[:, :, None] >> np.arange(BITS)) & 1
    return flags.reshape(len(bits), -1)[:, : last - first].astype(float)


def ridge_weights(bits: np.ndarray, d: int, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted ridge of ``y`` on ``d`` mask columns with a free intercept.

    Solved over the samples: Z' (Z Z' + penalty)^-1 r for the centred, weighted
    Z and r, with Z Z' added up over blocks of words.
    """
    root = np.sqrt(w)
    r = root * (y - np.average(y, weights=w))

    def blocks():
        for at in range(0, d, _BLOCK_WORDS):
            x = unpack(bits, at, min(d, at + _BLOCK_WORDS))
            yield root[:, None] * (x - np.average(x, axis=0, weights=w))

    products = sum((z @ z.T for z in blocks()), np.zeros((len(y), len(y))))
    solved = np.linalg.solve(products + penalty * np.eye(len(y)), r)
    return np.concatenate([z.T @ solved for z in blocks()]) if d else np.empty(0)


def _token_parts(texts: DataFrame) -> DataFrame:
    """``_k, _words, _num, _parts``: a text's different words, its words by number, and the TF-IDF tokens of each number, joined by spaces.

    Words are joined by spaces in a sample, and neither folding nor a token
    crosses a space, so a sample's tokens are those of its words.
    """
    words = F.array_distinct("_tok")
    base = texts.select("_k", F.filter(F.split(F.coalesce("_t", F.lit("")), r"(?U)\W+"), lambda w: F.length(w) > 0).alias("_tok"))
    base = base.withColumn("_words", words).withColumn("_num", _word_numbers("_tok", "_words"))
    folded = base.select("_k", "_words", "_num", fold_accents(F.array_join("_words", "\n")).alias("_folded"))
    return folded.select("_k", "_words", "_num", F.transform(F.split("_folded", "\n"), lambda w: F.array_join(tfidf_tokens(w), " ")).alias("_parts"))


class TermTable:
    """The kept terms of a TF-IDF model (≤ max_features rows) as a task looks them up."""

    def __init__(self, tfidf) -> None:
        terms = sorted((r["idx"], r["term"], r["idf"]) for r in tfidf.terms.select("idx", "term", "idf").collect())
        self.single = {t: i for i, t, _ in terms if " " not in t}
        self.pairs = [(*t.split(" "), i) for i, t, _ in terms if " " in t]
        self.idf = np.zeros(terms[-1][0] + 1 if terms else 0)
        self.idf[[i for i, *_ in terms]] = [v for *_, v in terms]

    def of_text(self, parts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
        """A text's tokens as numbers, the word of each, how many differ, the term of each number (-1: none),
        and the kept pairs: ``first * different + second``, ascending, and their terms."""
        number: dict[str, int] = {}
        tokens = [[number.setdefault(t, len(number)) for t in p.split()] for p in parts]
        line = np.array([t for w in words for t in tokens[w]], dtype=np.int64)
        word = np.repeat(words, [len(tokens[w]) for w in words])
        of = np.array([self.single.get(t, -1) for t in number], dtype=np.int64)
        known = sorted((number[a] * len(number) + number[b], i) for a, b, i in self.pairs if a in number and b in number)
        codes, ids = (np.array(v, dtype=np.int64) for v in (zip(*known, strict=True) if known else ((), ())))
        return line, word, len(number), of, codes, ids


def sample_vectors(tfidf, texts: DataFrame, num_samples: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``_k, _s, _d, _bits, features`` of every sample of ``texts`` (``_k`` string, ``_t``), texts without words left out.

    A text is split and folded once. Its samples' terms are counted from its
    token numbers and their masks in the task that holds it; no sample's text is made.
    """
    spark = texts.sparkSession
    # a stated number, which adaptive execution leaves: few bytes here become many samples
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = texts.repartition(parts, "_k")
    masks = word_masks(texts, "_k", "_t", num_samples, seed).select("_k", "_s", "_d", "_bits").where(F.col("_d") > 0)
    vocabulary = TermTable(tfidf)
    idf = vocabulary.idf

    def vectors(masks: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        out = masks.reset_index(drop=True)
        places: list[np.ndarray] = []
        values: list[np.ndarray] = []
        if len(out):
            line, word, number, of, codes, ids = vocabulary.of_text(text["_parts"].iloc[0], np.asarray(text["_num"].iloc[0]))
        for bits in out["_bits"]:
            flags = unpack(np.asarray(bits)[None, :], 0, int(out["_d"].iloc[0]))[0] > 0
            kept = line[flags[word]]
            at = of[kept]
            if len(kept) > 1 and len(codes):
                both = kept[:-1] * number + kept[1:]
                near = np.minimum(np.searchsorted(codes, both), len(codes) - 1)
                at = np.concatenate((at, ids[near[codes[near] == both]]))
            idx, tf = np.unique(at[at >= 0], return_counts=True)
            w = (1.0 + np.log(tf)) * idf[idx]
            places.append(idx.astype(np.int32))
            values.append(w / np.sqrt((w * w).sum()) if len(w) else w)
        out["_idx"], out["_val"] = pd.Series(places, dtype=object), pd.Series(values, dtype=object)
        return out[["_k", "_s", "_d", "_bits", "_idx", "_val"]]

    both = masks.groupBy("_k").cogroup(_token_parts(texts).drop("_words").groupBy("_k"))
    rows = both.applyInPandas(vectors, "_k string, _s int, _d int, _bits array<bigint>, _idx array<int>, _val array<double>")
    return rows.select("_k", "_s", "_d", "_bits", sparse_vector(F.lit(len(idf)), F.col("_idx"), F.col("_val")).alias("features"))


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as longs of ``BITS`` flags, like :func:`_packed`."""
    longs = np.zeros((len(flags), -(-flags.shape[1] // BITS) * BITS), dtype=np.int64)
    longs[:, : flags.shape[1]] = flags
    return longs.reshape(len(flags), -1, BITS) @ (1 << np.arange(BITS))


def sampled(vocabulary: TermTable, weights: np.ndarray, intercepts: np.ndarray, text_hash: int, words: int, parts: list[str],
            numbers: np.ndarray, num_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """The masks of a text's samples as bits, as :func:`word_masks` draws them, and the probability of each class.

    ``text_hash`` is the hash of (seed, key), ``numbers`` are the words of the text in
    its order and ``parts`` the tokens of every word.
    """
    line, word, different, of, codes, ids = vocabulary.of_text(parts, numbers)
    used = np.unique(np.concatenate((of[of >= 0], ids)))  # the terms that the text's samples can have
    of, ids = np.where(of >= 0, np.searchsorted(used, of), -1), np.searchsorted(used, ids)
    weights, idf, k = weights[:, used], vocabulary.idf[used], len(used)
    scale = np.concatenate(([0.0], 1.0 + np.log(np.arange(1, len(line) + 2))))
    bits, probabilities = [], []
    step = max(1, _BLOCK_CELLS // max(words, len(line), k, 1))
    for first in range(0, num_samples, step):
        number = np.arange(first, min(first + step, num_samples))
        hashes = hash_ints(number, np.int64(text_hash))
        lost = np.where(number > 0, 1 + np.mod(hashes, max(words - 1, 1)), 0) if words > 1 else np.zeros(len(number), dtype=np.int64)
        draws = hash_ints(np.arange(words)[None, :], hashes[:, None])
        limit = np.sort(draws, axis=1)[np.arange(len(number)), lost - 1]
        keep = (lost == 0)[:, None] | (draws > limit[:, None])
        bits.append(packed(keep))
        row, at = np.nonzero(keep[:, word])
        kept = line[at]
        term = of[kept]
        place = (row * k + term)[term >= 0]
        if len(kept) > 1 and len(codes):
            both = kept[:-1] * different + kept[1:]
            near = np.minimum(np.searchsorted(codes, both), len(codes) - 1)
            found = (codes[near] == both) & (row[1:] == row[:-1])
            place = np.concatenate((place, row[:-1][found] * k + ids[near[found]]))
        tfidf = scale[np.bincount(place, minlength=len(number) * k).reshape(len(number), k)] * idf
        norm = np.sqrt((tfidf * tfidf).sum(axis=1))
        margins = tfidf @ weights.T / np.where(norm > 0, norm, 1.0)[:, None] + intercepts
        shown = np.exp(margins - margins.max(axis=1, keepdims=True))
        probabilities.append(shown / shown.sum(axis=1, keepdims=True))
    return np.concatenate(bits), np.concatenate(probabilities)


def _top_words(bits: np.ndarray, d: int, y: np.ndarray, num_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the words that weigh most for ``y`` over the samples ``bits``."""
    kept = np.bitwise_count(bits).sum(axis=1)
    far = (1.0 - np.sqrt(kept / d)) * 100.0
    coef = ridge_weights(bits, d, y, np.sqrt(np.exp(-(far**2) / KERNEL_WIDTH**2)))
    top = np.argsort(-np.abs(coef), kind="stable")[:num_features]
    return top, coef[top]


def _explain_in_place(model: LogisticRegressionModel, tfidf, texts: DataFrame, num_samples: int, num_features: int, seed: int) -> DataFrame:
    """``_k, word, weight`` of ``texts`` (``_k``, ``_t``), each explained where it lies."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    weights, intercepts = linear_margins(model)
    vocabulary = TermTable(tfidf)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.to_pylist():
                words = text["_words"]
                if not words:
                    continue
                bits, p = sampled(vocabulary, weights, intercepts, text["_h"], len(words), text["_parts"], np.array(text["_num"]), num_samples)
                top, weight = _top_words(bits, len(words), p[:, int(p[0].argmax())], num_features)
                for column, values in zip(out, ([text["_k"]] * len(top), [words[i] for i in top], weight.tolist()), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["_k", "word", "weight"])

    # a stated number, which adaptive execution leaves: few bytes here become many samples
    dealt = _token_parts(texts.where("_k IS NOT NULL").repartition(parts, "_k"))
    rows = dealt.select("_k", "_words", "_num", "_parts", F.xxhash64(F.lit(seed), "_k").alias("_h"))
    return rows.mapInArrow(explain, "_k string, word string, weight double")


def lime_text(model: Model, tfidf, instances: DataFrame, key_col: str, text_col: str, num_samples: int = 500,
              num_features: int = 10, seed: int = DEFAULT_SEED) -> DataFrame:
    """``key, word, weight`` of the ``num_features`` largest weights per text.

    Weights are for the class predicted on the text itself; a sample counts by
    the root of exp(-(100 * cosine distance)^2 / 25^2). Of equal weights the
    earlier word comes first. Keys are compared as strings and must be distinct;
    null texts and texts without words give no rows.
    """
    texts = instances.select(F.col(key_col).cast("string").alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    texts = cut_lineage(texts, "lime-texts")
    if isinstance(model, LogisticRegressionModel):
        return _explain_in_place(model, tfidf, texts, num_samples, num_features, seed).withColumnRenamed("_k", key_col)
    data = with_proba(model, sample_vectors(tfidf, texts, num_samples, seed)).select("_k", "_s", "_d", "_bits", "proba", "pred")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = int(pdf.loc[pdf["_s"] == 0, "pred"].iloc[0])
        y = np.stack(pdf["proba"].to_numpy())[:, own]
        bits, d = np.stack(pdf["_bits"].to_numpy()), int(pdf["_d"].iloc[0])
        top, weight = _top_words(bits, d, y, num_features)
        return pd.DataFrame({"_k": pdf["_k"].iloc[0], "_i": top, "weight": weight})

    # a group is the bit sets of one text's samples
    weights = data.groupBy("_k").applyInPandas(solve, "_k string, _i int, weight double")
    words = texts.select("_k", F.array_distinct(F.filter(F.split("_t", r"(?U)\W+"), lambda w: F.length(w) > 0)).alias("_words"))
    return weights.join(words, "_k").select(F.col("_k").alias(key_col), F.get("_words", F.col("_i")).alias("word"), "weight")
