"""Language ID: expectation-maximisation over a mixture of languages.

Each language has byte trigram counts, summed over a bounded sample of its
documents (``docs_per_lang`` on average, drawn by id hash). A text is cut into
units of a few words; a unit's likelihood in a language is the product of its
trigrams' smoothed probabilities. Expectation-maximisation estimates the share
of every language in the text from the units' likelihoods. Then sets of one,
two, ... languages (the largest shares first) are fitted anew, and the set with
the best penalised likelihood is the document's language set; its largest
share names the language.

All documents of an Arrow batch are estimated together in numpy. Scoring is one
pass without a shuffle; the model has 65,536 numbers per language and at most
``max_langs`` languages. Counting combines on the map side.

Defined results: a null text or one without a letter is ``und`` with score 0;
``und`` rows have no language set; repeated rows are scored one by one; texts
are read whole, long ones in pieces; extra columns are not read; ties go to the
alphabetically first language; with nothing to learn from all texts are ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.llm.common import bound_batches, utf8

BUCKETS = 1 << 16
#: Lower-cases A-Z; bytes of non-ASCII characters stay; the rest becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


def _trigrams(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around every letter byte and, of each, whether it
    begins a word. ``plain`` begins and ends with a space."""
    raw = np.frombuffer(plain, dtype=np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    letter = raw[1:-1] != 32
    return code[letter], (raw[:-2] == 32)[letter]


def _pieces(text: bytes) -> Iterator[bytes]:
    """The normalised text in pieces that begin and end with a space."""
    plain = b" " + text.translate(_TABLE) + b" "
    at = 0
    while at < len(plain) - 1:
        end = plain.find(b" ", at + _PIECE)
        end = len(plain) - 1 if end < 0 else end
        yield plain[at : end + 1]
        at = end


def has_letter(text: bytes | None) -> bool:
    return text is not None and _LETTER.search(text.decode()) is not None


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages

    def units(self, text: bytes, unit_words: int) -> np.ndarray:
        """Log-likelihoods of the text's units, one column per language."""
        out = []
        for piece in _pieces(text):
            code, first = _trigrams(piece)
            if len(code):
                starts = np.flatnonzero(first)[::unit_words]
                out.append(np.add.reduceat(self.logp[code], starts, axis=0))
        return np.concatenate(out) if out else np.empty((0, len(self.langs)))


def _sample(docs: DataFrame, train: Column, docs_per_lang: int, max_langs: int) -> DataFrame:
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(train)
    counts = known.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise InputError(f"More than {max_langs} languages; raise max_langs.")
    if not counts:
        return known.where("false")
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(int(1_000_000 * min(1.0, docs_per_lang / r[1]))))])
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])


def fit_languages(docs: DataFrame, train: Column, docs_per_lang: int = 1500, max_langs: int = 200, smooth: float = 0.5) -> LanguageModel:
    """A model from ``doc_id, text, lang`` columns of the rows that satisfy
    ``train``; ``docs_per_lang`` bounds the expected sample of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for piece in _pieces(text):
                    own += np.bincount(_trigrams(piece)[0], minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], names=["lang", "bucket", "n"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = _sample(rows, train, docs_per_lang, max_langs).select("text", "lang")
    total = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def pack(rows: pa.Table) -> pa.Table:  # one language's counts as bytes
        dense = np.zeros(BUCKETS, dtype=np.int64)
        dense[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return pa.table({"lang": rows.column("lang")[:1], "counts": pa.array([dense.tobytes()], pa.binary())})

    found = total.groupBy("lang").applyInArrow(pack, "lang string, counts binary").orderBy("lang").collect()
    logp = np.zeros((BUCKETS, len(found)), dtype=np.float32)
    for k, r in enumerate(found):
        seen = np.frombuffer(r["counts"], dtype=np.int64) + smooth
        logp[:, k] = np.log(seen / seen.sum())
    return LanguageModel([r["lang"] for r in found], logp)


def mixture(likelihood: np.ndarray, starts: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) and log-likelihoods by EM.

    ``likelihood``: units x languages, the largest of each unit being 1;
    ``starts``: the first unit of each document; ``allowed``: languages of each document.
    """
    sizes = np.diff(np.append(starts, len(likelihood)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        part = likelihood * np.repeat(share, sizes, axis=0)
        part /= part.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
        share = share * allowed + 1e-12 * allowed
        share /= share.sum(axis=1, keepdims=True)
    total = np.log((likelihood * np.repeat(share, sizes, axis=0)).sum(axis=1) + 1e-300)
    return share, np.add.reduceat(total, starts)


def choose(likelihood: np.ndarray, starts: np.ndarray, steps: int = 10, penalty: float = 1.0) -> np.ndarray:
    """Shares of the language set with the best penalised likelihood; 0 outside
    it. A document's set grows as long as one more language improves that value."""
    docs, langs = len(starts), likelihood.shape[1]
    sizes = np.diff(np.append(starts, len(likelihood)))
    first, _ = mixture(likelihood, starts, np.ones((docs, langs)), steps)
    order = np.argsort(-first, axis=1, kind="stable")
    best, best_value = np.zeros((docs, langs)), np.full(docs, -np.inf)
    doc_of = np.repeat(np.arange(docs), sizes)
    growing = np.arange(docs)
    for k in range(1, langs + 1):
        if not len(growing):
            break
        some = np.isin(doc_of, growing) if len(growing) < docs else slice(None)
        own = sizes[growing]
        allowed = np.zeros((len(growing), langs))
        np.put_along_axis(allowed, order[growing, :k], 1.0, axis=1)
        share, total = mixture(likelihood[some], np.cumsum(own) - own, allowed, steps if k > 1 else 1)
        value = total - penalty * (k - 1) * np.log(own + 1.0)
        better = value > best_value[growing]
        growing, share, value = growing[better], share[better], value[better]
        best[growing], best_value[growing] = share, value
    return best


def predict_languages(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit_words: int = 8,
    penalty: float = 1.0,
) -> DataFrame:
    """``doc_id, lang_pred, score, langs``: the language of the largest share,
    that share, and the chosen set as (lang, share), largest first."""
    entry = pa.struct([("lang", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(1))
            units = [model.units(t, unit_words) if model.langs and has_letter(t) else None for t in texts]
            there = [k for k, u in enumerate(units) if u is not None and len(u)]
            pred, score, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if there:
                stacked = np.concatenate([units[k] for k in there])
                starts = np.cumsum([0, *(len(units[k]) for k in there[:-1])])
                likelihood = np.exp(np.maximum(stacked - stacked.max(axis=1, keepdims=True), -600).astype(float))
                for k, share in zip(there, choose(likelihood, starts, penalty=penalty), strict=True):
                    order = [x for x in np.argsort(-share, kind="stable") if share[x] > 0]
                    pred[k], score[k] = model.langs[order[0]], min(1.0, float(share[order[0]]))
                    sets[k] = [{"lang": model.langs[x], "share": float(share[x])} for x in order]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(entry))], names=["doc_id", "lang_pred", "score", "langs"]
            )

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")
