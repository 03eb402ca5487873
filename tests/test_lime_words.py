import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabsight.operators import lime_words
from tabsight.operators import text as T


def test_masks_match_their_texts(spark):
    long = " ".join(f"w{i % 150}" for i in range(400))
    texts = spark.createDataFrame([(1, "a b, a c!"), (2, long), (3, "one one"), (4, ""), (5, None)], "id long, text string")
    got = lime_words.word_masks(texts, "id", "text", 40).collect()
    assert len(got) == 5 * 40
    tokens = {"1": ["a", "b", "a", "c"], "2": long.split(), "3": ["one", "one"], "4": [], "5": []}
    lost = set()
    for r in got:
        words = list(dict.fromkeys(tokens[r["_k"]]))
        assert r["_d"] == len(words)
        flags = lime_words.unpack(np.array([r["_bits"]], dtype=np.int64).reshape(1, -1), 0, len(words))[0]
        kept = {w for w, f in zip(words, flags, strict=True) if f}
        assert r["_text"].split() == [t for t in tokens[r["_k"]] if t in kept]
        if r["_s"] == 0 or len(words) <= 1:
            assert len(kept) == len(words)
        else:
            assert 1 <= len(kept) < len(words)
        if r["_k"] == "2":
            lost.add(len(words) - len(kept))
    assert len(lost) > 20  # the number lost is spread from 1 to all but one
    again = lime_words.word_masks(texts.repartition(7), "id", "text", 40).collect()
    assert {(r["_k"], r["_s"], r["_text"]) for r in got} == {(r["_k"], r["_s"], r["_text"]) for r in again}


@pytest.mark.parametrize("n, d", [(60, 5), (40, 130), (30, 4100)])
def test_ridge_equals_the_normal_equations(n, d):
    rnd = np.random.default_rng(d)
    x = rnd.integers(0, 2, (n, d))
    longs = -(-d // lime_words.BITS)
    padded = np.zeros((n, longs * lime_words.BITS), dtype=np.int64)
    padded[:, :d] = x
    bits = (padded.reshape(n, longs, lime_words.BITS) << np.arange(lime_words.BITS)).sum(axis=2)
    assert np.array_equal(lime_words.unpack(bits, 0, d), x)
    y, w = rnd.random(n), rnd.random(n) + 0.1
    xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    want = np.linalg.solve((xc * w[:, None]).T @ xc + np.eye(d), (xc * w[:, None]).T @ yc)
    assert np.allclose(lime_words.ridge_weights(bits, d, y, w), want, atol=1e-9)


def test_signal_words_lead_and_empty_texts_give_nothing(spark):
    good = [f"great film wonderful story {i}" for i in range(20)]
    bad = [f"awful film boring story {i}" for i in range(20)]
    docs = spark.createDataFrame([(i, t, float(i < 20)) for i, t in enumerate(good + bad)], "doc_id long, text string, label double")
    tf = T.fit_tfidf(docs, "doc_id", "text")
    model = LogisticRegression(maxIter=50).fit(tf.vectors(docs, "doc_id", "text").join(docs.select("doc_id", "label"), "doc_id"))
    some = docs.where("doc_id in (0, 25)").select("doc_id", "text").union(spark.createDataFrame([(90, ""), (91, None)], "doc_id long, text string"))
    out = lime_words.lime_text(model, tf, some, "doc_id", "text", num_samples=100, num_features=3)
    rows = out.orderBy("doc_id", F.abs("weight").desc()).collect()
    assert {r["doc_id"] for r in rows} == {"0", "25"} and len(rows) == 6
    assert rows[0]["word"] in {"great", "wonderful"} and rows[3]["word"] in {"awful", "boring"}
    assert lime_words.lime_text(model, tf, some.where("false"), "doc_id", "text", num_samples=20).count() == 0


def test_sample_vectors_are_those_of_the_samples_texts(spark):
    odd = "Ein Straßen-Café, ΟΔΟΣ οδος naïve NAÏVE x1 a b ① ½ ﬁne fine don't don't 3x"
    docs = spark.createDataFrame([("1", odd), ("2", odd + " good film good film"), ("3", "good film, a b c d " * 30), ("4", ""), ("5", None), ("6", "a")], "_k string, _t string")
    tf = T.fit_tfidf(docs, "_k", "_t")
    masks = lime_words.word_masks(docs, "_k", "_t", 12).where("_d > 0").withColumn("_vk", F.concat_ws("|", "_k", "_s"))
    want = {r["_vk"]: r["features"] for r in tf.vectors(masks, "_vk", "_text").collect()}
    got = lime_words.sample_vectors(tf, docs, 12).collect()
    assert len(got) == len(want) == 4 * 12
    for r in got:
        v = want[f"{r['_k']}|{r['_s']}"]
        assert v.size == r["features"].size and np.array_equal(v.indices, r["features"].indices)
        assert np.allclose(v.values, r["features"].values, rtol=1e-12)
    assert any(len(v.indices) > 8 for v in want.values())


@pytest.mark.parametrize("n_classes", [2, 3])
def test_explained_in_place_as_by_vectors(spark, monkeypatch, n_classes):
    """A logistic regression is applied where a text lies: the same samples, words and weights as through the vectors."""
    rnd = np.random.default_rng(3)
    names = [f"Wört{i}" for i in range(40)] + ["good-film", "x", "naïve y"]
    docs = [(i, " ".join(rnd.choice(names, int(rnd.integers(1, 90)))), float(i % n_classes)) for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, label double")
    tf = T.fit_tfidf(docs, "doc_id", "text")
    model = LogisticRegression(maxIter=10, regParam=0.01).fit(tf.vectors(docs, "doc_id", "text").join(docs.select("doc_id", "label"), "doc_id"))
    odd = spark.createDataFrame([(90, ""), (91, None), (92, "one"), (93, "zzz qqq"), (None, "some words")], "doc_id long, text string")
    some = docs.where("doc_id < 6").select("doc_id", "text").union(odd)
    monkeypatch.setattr(lime_words, "_BLOCK_CELLS", 1500)
    run = lambda: {(r["doc_id"], r["word"]): r["weight"] for r in lime_words.lime_text(model, tf, some, "doc_id", "text", 60, 100).collect()}
    place = run()
    monkeypatch.setattr(lime_words, "LogisticRegressionModel", type(None))
    vectors = run()
    assert place.keys() == vectors.keys() and {k for k, _ in place} == {"0", "1", "2", "3", "4", "5", "92", "93"}
    for k, weight in vectors.items():
        assert place[k] == pytest.approx(weight, rel=1e-8, abs=1e-11)
