"""Toxicity: a convolutional text classifier trained in numpy.

Words and their first letters (``PREFIXES``: inflected forms share them) are
hashed (64 bits) and looked up among the hashes that are frequent in the
labelled texts; each has an embedding, all other words share one, and a
word's embedding is the sum over its parts. Filters of
several widths slide over the embeddings, each keeps its maximum over the text
(max pooling), and a logistic layer turns the maxima into a probability. The
weights are learned by Adagrad on all labelled rows: shards of about
``shard_rows`` of them take their own steps for an epoch, then the weights become
the mean over the shards, a word's embedding weighted by what each shard learned
of it (``shards.py``). A quarter of the rows, by id hashes, is set aside to
calibrate one threshold per language, from scores at ``SCORE_DIGITS`` digits. The language is
guessed from the text alone by counting common function words, never read from
a column. The score is the probability bent so that the language's threshold
becomes 0.5.

Scoring is one pass without a shuffle; the model is a few megabytes at most
(``max_words`` rows).

Defined results: null or empty texts consist of padding and get the score of
that; contradicting or null labels are not used; repeated rows are scored one
by one; texts are read whole, long ones in overlapping pieces; extra columns
are not read; without two classes among the labelled rows every score is the
share of ones, or 0 if there are none.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import TOKEN_CLASS, KeyTable, bound_batches, token_hashes, utf8, write_table
from tabsight.llm.shards import deal, epoch_sum, mean_of, pack, state_batch, unpack

# Common function words by language, for the language guess.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was on are as this by from at",
    "fr": "le la les de des du et en un une que qui dans pour est elle sur pas",
    "de": "der die das und ist ein eine nicht mit den dem von zu auf für sich auch im",
    "es": "el la los las de que y en un una por con para del se es al lo",
}
#: Lengths in bytes of the word beginnings that have embeddings too.
PREFIXES = (4, 5, 6)
#: Decimals of the scores that thresholds are chosen from: bounds what the driver holds.
SCORE_DIGITS = 4
#: One of so many rows is set aside for the thresholds.
ASIDE_ONE_IN = 4
_PAD, _UNKNOWN = 0, 1


def word_parts(text: bytes) -> np.ndarray:
    """A row per word: hashes of the word and of its beginnings."""
    return token_hashes(text, TOKEN_CLASS, lower=True, prefixes=PREFIXES)


_PIECE = 1 << 16  # words convolved at once


class LanguageGuess:
    """The language whose function words are the largest share of the text; -1 if none occurs."""

    def __init__(self) -> None:
        self.names = sorted(FUNCTION_WORDS)
        known: dict[int, list[int]] = {}
        for k, name in enumerate(self.names):
            for h in token_hashes(FUNCTION_WORDS[name].encode(), TOKEN_CLASS).tolist():
                known.setdefault(h, []).append(k)
        keys = sorted(known)
        self.places = KeyTable(np.array(keys, dtype=np.uint64))
        self.votes = np.zeros((len(known) + 1, len(self.names)))
        for row, h in enumerate(keys):
            self.votes[row, known[h]] = 1 / len(known[h])

    def __call__(self, words: np.ndarray) -> int:
        votes = self.votes[self.places.find(words)].sum(axis=0)  # the last row is for other words
        return int(votes.argmax()) if votes.any() else -1


_guess = LanguageGuess()


class Cnn:
    """Embeddings, filters by width and the output layer."""

    def __init__(self, keys: np.ndarray, dim: int, filters: int, widths: tuple[int, ...], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.keys, self.widths = keys, widths
        self.embed = rng.normal(0, 0.3, (len(keys) + 2, dim))
        self.embed[_PAD] = 0
        self.filter = [rng.normal(0, (2 / (w * dim)) ** 0.5, (w, dim, filters)) for w in widths]
        self.bias = [np.zeros(filters) for _ in widths]
        self.out = rng.normal(0, 0.3, filters * len(widths))
        self.shift = np.zeros(1)
        self.thresholds = np.full(len(_guess.names) + 1, 0.5)  # the last is for unknown languages
        self.constant = -1.0
        self.places: KeyTable | None = None
        self.fast: tuple | None = None

    def index(self, words: np.ndarray) -> np.ndarray:
        """Embedding rows of the words' parts, padded to the widest filter."""
        found = np.full((max(len(words), max(self.widths)), words.shape[1]), _PAD, dtype=np.int32)
        found[: len(words), 0] = _UNKNOWN
        if self.places is None:
            self.places = KeyTable(self.keys)
        at = self.places.find(words)
        found[: len(words)] = np.where(at >= 0, at + 2, found[: len(words)])
        return found

    def prime(self, count: np.ndarray, size: np.ndarray) -> None:
        """Start the first embedding dimension from each key's share of documents
        by class (log odds, shrunk where it is rare) and let one filter of each
        width read it; what is learned later refines this. ``count`` has a row
        of the keys' documents for each class, ``size`` all documents of each."""
        if not len(self.keys):
            return
        odds = np.log((count + 0.5) / (size[:, None] + 1))
        shrink = count.sum(axis=0) / (count.sum(axis=0) + 5)
        self.embed *= 0.1
        self.embed[2:, 0] = (odds[1] - odds[0]) * shrink
        for f in self.filter:
            f *= 0.3
            f[:, :, 0] = 0
            f[:, 0, 0] = 1 / len(f)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The filters' maxima over the text and where they are."""
        x = self.embed[rows].sum(axis=1)
        tops, places = [], []
        for w, f, b in zip(self.widths, self.filter, self.bias, strict=True):
            n = len(rows) - w + 1
            conv = sum(x[j : j + n] @ f[j] for j in range(w)) + b
            at = conv.argmax(axis=0)
            places.append(at)
            tops.append(conv[at, np.arange(conv.shape[1])])
        return np.concatenate(tops), places

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filter, *self.bias, self.out, self.shift]

    def steps(self, docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, seen: list[np.ndarray], rate: float, weight: float, l2: float = 1e-4) -> None:
        """Adagrad steps over the documents (``index`` rows) in random order;
        ``seen`` are the sums of squared gradients, kept up."""
        params = self.params()
        k, nf = len(self.widths), self.filter[0].shape[2]
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 16):
            grads = [np.zeros_like(p) for p in params[1:]]
            rows_touched, rows_grad = [], []
            for i in order[at : at + 16]:
                rows = docs[i].copy()
                rows[rng.random(len(rows)) < 0.05, 0] = _UNKNOWN
                top, places = self.pooled(rows)
                act = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.shift[0], -35, 35)))
                g = (p - labels[i]) * (weight if labels[i] else 1.0) / 16
                grads[2 * k] += g * act
                grads[2 * k + 1] += g
                back = g * self.out * (top > 0)
                for j, w in enumerate(self.widths):
                    part = back[j * nf : (j + 1) * nf]
                    grads[k + j] += part
                    own = rows[places[j][:, None] + np.arange(w)]  # filter, word, part of the word
                    grads[j] += (part[:, None, None] * self.embed[own].sum(axis=2)).transpose(1, 2, 0)
                    rows_touched.append(own.ravel())
                    back_to = (part * self.filter[j]).transpose(2, 0, 1).reshape(-1, self.embed.shape[1])
                    rows_grad.append(np.repeat(back_to, own.shape[2], axis=0))
            for p, s, g in zip(params[1:], seen[1:], grads, strict=True):
                g = g + l2 * p
                s += g * g
                p -= rate * g / np.sqrt(s)
            rows, inverse = np.unique(np.concatenate(rows_touched), return_inverse=True)
            g = np.zeros((len(rows), self.embed.shape[1]))
            np.add.at(g, inverse, np.concatenate(rows_grad))
            seen[0][rows] += g * g
            self.embed[rows] -= rate * g / np.sqrt(seen[0][rows])
            self.embed[_PAD] = 0

    def new_seen(self) -> list[np.ndarray]:
        return [np.full_like(p, 1e-6) for p in self.params()]

    def state(self, seen: list[np.ndarray]) -> np.ndarray:
        """Weights and sums of squared gradients as one array of two rows."""
        return np.stack([np.concatenate([p.ravel() for p in parts]) for parts in (self.params(), seen)])

    def put_state(self, state: np.ndarray) -> list[np.ndarray]:
        """Take over the weights of ``state``; its sums of squared gradients are returned."""
        seen, at = self.new_seen(), 0
        for p, s in zip(self.params(), seen, strict=True):
            p[...], s[...] = state[:, at : at + p.size].reshape(2, *p.shape)
            at += p.size
        self.fast = None
        return seen

    def probability(self, words: np.ndarray) -> float:
        return self.constant if self.constant >= 0 else self.probability_of(self.index(words))

    def probability_of(self, rows: np.ndarray) -> float:
        """The probability from a text's ``index`` rows."""
        if self.fast is None:
            self.fast = self.embed.astype(np.float32), [f.astype(np.float32) for f in self.filter]
        embed, filters = self.fast
        widest = max(self.widths)
        best = None
        for at in range(0, max(1, len(rows) - widest + 1), _PIECE):
            part = rows[at : at + _PIECE + widest - 1]  # pieces overlap: no window is lost
            x = embed[part[:, 0]]
            for k in range(1, part.shape[1]):
                x += embed[part[:, k]]
            tops = []
            for w, f, b in zip(self.widths, filters, self.bias, strict=True):
                n = len(part) - w + 1
                conv = x[:n] @ f[0]
                for j in range(1, w):
                    conv += x[j : j + n] @ f[j]
                tops.append(conv.max(axis=0) + b)
            top = np.concatenate(tops)
            best = top if best is None else np.maximum(best, top)
        return float(1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ self.out + self.shift[0], -35, 35))))

    def score(self, text: bytes) -> float:
        words = word_parts(text)
        p, t = self.probability(words), self.thresholds[_guess(words[:, 0])]
        return bend(p, t)

    def dumps(self) -> bytes:
        parts = {"keys": self.keys, "widths": np.array(self.widths), "embed": self.embed, "out": self.out, "shift": self.shift, "thresholds": self.thresholds, "constant": np.array([self.constant])}
        parts |= {f"filter{j}": f for j, f in enumerate(self.filter)} | {f"bias{j}": b for j, b in enumerate(self.bias)}
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> "Cnn":
        parts = np.load(io.BytesIO(data))
        widths = tuple(int(w) for w in parts["widths"])
        model = Cnn(parts["keys"], 1, 1, widths)
        model.embed, model.out, model.shift, model.thresholds = parts["embed"], parts["out"], parts["shift"], parts["thresholds"]
        model.filter = [parts[f"filter{j}"] for j in range(len(widths))]
        model.bias = [parts[f"bias{j}"] for j in range(len(widths))]
        model.constant = float(parts["constant"][0])
        return model


def bend(p: float, threshold: float) -> float:
    """The probability moved so that ``threshold`` becomes 0.5, 0 and 1 staying."""
    return 0.5 * p / threshold if p < threshold else 0.5 + 0.5 * (p - threshold) / (1 - threshold)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut, between two scores, with the best weighted F1 (ties: the one nearest 0.5)."""
    cuts = np.unique(p)
    cuts = np.concatenate(((cuts[1:] + cuts[:-1]) / 2, [0.5]))
    cuts = cuts[(cuts > 0.02) & (cuts < 0.98)]
    order = np.argsort(p)
    # sums of the weights from each score upwards
    said, hit = (np.append(np.cumsum((weight * some)[order][::-1])[::-1], 0.0)[np.searchsorted(p[order], cuts)] for some in (np.ones(len(p)), y == 1))
    f1 = 2 * hit / np.maximum(1e-9, said + weight[y == 1].sum())
    best = np.flatnonzero(f1 == f1.max())
    return float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])


def set_thresholds(model: Cnn, p: np.ndarray, y: np.ndarray, weight: np.ndarray, guess: np.ndarray, least_ones: float) -> None:
    """One threshold per guessed language from scores, labels and weights of rows set aside."""
    model.thresholds[:] = best_threshold(p, y, weight)
    for k in range(len(_guess.names)):
        own = guess == k
        if weight[own & (y == 1)].sum() >= least_ones:  # else the threshold over all languages holds
            model.thresholds[k] = best_threshold(p[own], y[own], weight[own])


def train_cnn(
    texts: list[np.ndarray],
    labels: np.ndarray,
    class_weight: np.ndarray,
    aside: np.ndarray | None = None,
    dim: int = 8,
    filters: int = 8,
    widths: tuple[int, ...] = (1, 2, 3),
    epochs: int = 6,
    rate: float = 0.03,
    max_words: int = 1 << 15,
    least_docs: float = 0.003,
    least_ones: int = 20,
) -> Cnn:
    """What :func:`fit_toxicity` learns in one shard, from arrays of
    ``word_parts``, 0/1 labels, weights and which rows are set aside."""
    seen = [np.unique(t[t != 0]) for t in texts]
    keys, count = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.uint64), np.empty(0, int))
    keep = count >= max(3, least_docs * len(texts))
    keys, count = keys[keep], count[keep]
    keys = np.sort(keys[np.lexsort((keys.view(np.int64), -count))[:max_words]])
    model = Cnn(keys, dim, filters, widths)
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        model.constant = ones / max(1, len(labels))
        return model
    aside = np.zeros(len(labels), dtype=bool) if aside is None else aside
    train = np.flatnonzero(~aside)
    by_class = np.zeros((2, len(keys)))
    for i in train:
        by_class[labels[i], np.searchsorted(keys, np.intersect1d(seen[i], keys, assume_unique=True))] += 1
    model.prime(by_class, np.bincount(labels[train], minlength=2))
    docs, state = [model.index(texts[i]) for i in train], model.new_seen()
    for epoch in range(epochs):
        model.steps(docs, labels[train], np.random.default_rng([epoch, 0]), state, rate, one_weight(*np.bincount(labels[train])))
    held = np.flatnonzero(aside) if aside.any() else train
    p = np.array([model.probability(texts[i]) for i in held]).round(SCORE_DIGITS)
    set_thresholds(model, p, labels[held], class_weight[held], np.array([_guess(texts[i][:, 0]) for i in held]), least_ones)
    return model


def one_weight(zeros: int, ones: int) -> float:
    """The weight of a row of label 1 in training."""
    return max(1.0, min(5.0, zeros / ones))


def fit_toxicity(
    rows: DataFrame,
    dim: int = 8,
    filters: int = 8,
    widths: tuple[int, ...] = (1, 2, 3),
    epochs: int = 6,
    rate: float = 0.03,
    max_words: int = 1 << 15,
    least_docs: float = 0.003,
    least_ones: int = 20,
    shard_rows: int = 1 << 14,
) -> Cnn:
    """A calibrated model from ``doc_id, text, label, weight`` rows."""
    bound_batches(rows.sparkSession)
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(ASIDE_ONE_IN)) == 0
    rows = write_table(rows.select("doc_id", "text", "label", "weight", aside.alias("aside")), "toxicity-rows")
    size = {(r[0], r[1]): r[2] for r in rows.groupBy("label", "aside").count().collect()}  # four rows
    n, ones = sum(size.values()), sum(v for (y, _), v in size.items() if y)
    if ones in (0, n):
        model = Cnn(np.empty(0, np.uint64), dim, filters, widths)
        model.constant = ones / max(1, n)
        return model
    if len(size) < 4:  # too few rows to set any aside
        rows = rows.withColumn("aside", F.lit(False))
        size = {(y, False): sum(v for (label, _), v in size.items() if label == y) for y in (0, 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(t[t != 0]) for t in (word_parts(t or b"") for t in utf8(b.column(0)))]
            kind = np.array(b.column(1).to_pylist()) + 2 * np.array(b.column(2).to_pylist(), dtype=int)  # label, and 2 if set aside
            keys, at = np.unique(np.concatenate(found), return_inverse=True)
            seen = np.zeros((len(keys), 4), np.int64)
            np.add.at(seen, (at, np.repeat(kind, [len(f) for f in found])), 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(seen[:, 0]), pa.array(seen[:, 1]), pa.array(seen.sum(axis=1))], names=["key", "zeros", "ones", "n"])

    counts = rows.select("text", "label", "aside").mapInArrow(count, "key long, zeros long, ones long, n long").groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(3, least_docs * n)).orderBy(F.col("n").desc(), "key").limit(max_words).collect()  # at most max_words small rows
    found = np.array([tuple(r) for r in top], np.int64).reshape(-1, 4)
    unsigned = found[:, 0].copy().view(np.uint64)
    order = np.argsort(unsigned)
    model = Cnn(unsigned[order], dim, filters, widths)
    model.prime(found[order, 1:3].T.astype(float), np.array([size[y, False] for y in (0, 1)]))
    weight = one_weight(size[0, False], size[1, False])
    kind = np.uint16 if len(model.embed) <= 1 << 16 else np.int32
    keys, n_parts, n_rows = model.keys, 1 + len(PREFIXES), len(model.embed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn(keys, 1, 1, widths)
        for b in batches:
            words = [word_parts(t or b"") for t in utf8(b.column(1))]
            places, guess = [pack(own.index(w).astype(kind)) for w in words], [_guess(w[:, 0]) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(guess, pa.int32()), pa.array(places, pa.binary())], names=["doc_id", "label", "weight", "aside", "guess", "places"])

    def places_of(column: pa.Array) -> list[np.ndarray]:
        return [unpack(v, kind).reshape(-1, n_parts) for v in column.to_pylist()]

    def spread(learned: np.ndarray, rows_read: float, size: int) -> np.ndarray:
        """Weights of a state: a word's embedding counts by what was learned of it, all else by rows."""
        return np.concatenate([np.repeat(learned, dim), np.full(size - n_rows * dim, float(rows_read))])

    def epoch(number: int):
        def task(shared):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own, rows_read = Cnn(np.empty(n_rows - 2, np.uint64), dim, filters, widths), 0
                start = np.frombuffer(shared.value).reshape(2, -1)
                seen = own.put_state(start)
                for k, b in enumerate(batches):
                    own.steps(places_of(b.column(1)), b.column(0).to_numpy(), np.random.default_rng([number, k]), seen, rate, weight)
                    rows_read += b.num_rows
                state = own.state(seen)
                learned = (state - start)[1, : n_rows * dim].reshape(n_rows, dim).sum(axis=1)
                yield state_batch(np.concatenate([learned, [rows_read], *(spread(learned, rows_read, state.shape[1]) * state)]))

            return run

        return task

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn.loads(learned_model.value)
        for b in batches:
            p = np.array([own.probability_of(x) for x in places_of(b.column(3))]).round(SCORE_DIGITS)
            yield pa.RecordBatch.from_arrays([pa.array(p), *b.columns[:3]], names=["p", "label", "weight", "guess"])

    dealt, shards = deal(rows, n, shard_rows)
    # the order of arrival must not matter
    dealt = dealt.mapInArrow(encode, "doc_id long, label int, weight double, aside boolean, guess int, places binary").sortWithinPartitions("doc_id", "places").persist()
    try:
        state = model.state(model.new_seen())
        for number in range(epochs):
            total = epoch_sum(dealt.where("NOT aside").select("label", "places"), shards, state, epoch(number))
            weights = spread(total[:n_rows], total[n_rows], state.shape[1])
            state = np.stack([mean_of(s, weights, old) for s, old in zip(total[n_rows + 1 :].reshape(2, -1), state, strict=True)])
        model.put_state(state)
        learned_model = rows.sparkSession.sparkContext.broadcast(model.dumps())
        rest = dealt.where("aside") if len(size) == 4 else dealt
        scores = rest.select("label", "weight", "guess", "places").mapInArrow(held, "p double, label int, weight double, guess int")
        got = scores.groupBy("p", "label", "guess").agg(F.sum("weight")).orderBy("p", "label", "guess").collect()  # a few rows per score
    finally:
        dealt.unpersist()
    p, y, guess, share = np.array([tuple(r) for r in got], float).T
    set_thresholds(model, p, y, share, guess, least_ones)
    return model


def score_toxicity(docs: DataFrame, model: Cnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row."""
    data = model.dumps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn.loads(data)
        for b in batches:
            scores = [own.score(t or b"") for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Cnn, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, with all their columns."""
    bound_batches(docs.sparkSession)
    data, at = model.dumps(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn.loads(data)
        for b in batches:
            yield b.filter(pa.array([own.score(t or b"") < cut for t in utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
