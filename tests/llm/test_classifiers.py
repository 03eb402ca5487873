import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsight.errors import InputError
from tabsight.llm import queries as llm_queries
from tabsight.llm.common import SPACE_CLASS, TOKEN_CLASS, KeyTable, space_words, token_hashes
from tabsight.llm.language import fit_languages, mixture, predict_languages
from tabsight.llm.quality import FtrlModel, features, fit_quality, fold, labelled_sample, score_quality, score_text, shares
from tabsight.llm.queries import queries
from tabsight.llm.toxicity import Cnn, bend, best_threshold, drop_toxic, fit_toxicity, score_toxicity, train_cnn, word_parts

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "!!! 123"), (5, "é"), (6, "word " * 300_000), (6, "word"), (None, "no id")]


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_token_hashes_follow_the_words():
    text = "Ab, ab\tab\x0bÉab!! ab—x \x85 ab".encode()
    words = space_words(text)
    got = token_hashes(text, SPACE_CLASS)
    assert len(got) == len(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (got[i] == got[j]) == (a == b)
    long = b" ".join(b"w%d" % (i % 1000) for i in range(600_000))
    assert np.array_equal(token_hashes(long, SPACE_CLASS), np.tile(token_hashes(b" ".join(b"w%d" % i for i in range(1000)), SPACE_CLASS), 600))
    parts = token_hashes(b"Badly bad", TOKEN_CLASS, lower=True, prefixes=(3, 5))
    assert parts[0, 1] == parts[1, 0] == parts[1, 1] and parts[0, 2] == parts[0, 0] and parts[1, 2] == 0


def test_key_table():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    table = KeyTable(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    assert (table.find(keys + np.uint64(1)) == -1).all() and (KeyTable(keys[:0]).find(keys) == -1).all()
    assert table.find(np.zeros((2, 2), np.uint64)).tolist() == [[-1, -1]] * 2


def test_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(i, f"t {i}", "x") for i in range(100)] + [(None, "n", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(4, 1), (5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 3) != 1, 10).collect()
    assert len(got) == 20 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.label == r.doc_id % 2 and r.doc_id != 4 for r in got)
    known = [i for i in range(80) if zlib.crc32(str(i).encode()) % 3 != 1 and i != 4]
    for r in got:
        assert r.weight == sum(i % 2 == r.label for i in known) / 10


@pytest.mark.parametrize(("name", "label", "parts", "held", "least"), [("op9_quality", "quality", 3, 1, 0.95), ("op4_toxicity", "toxic", 5, 0, 0.8)])
def test_held_out_quality(spark, name, label, parts, held, least):
    got = {r.doc_id: r for r in queries()[name](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    y, s = [], []
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1
        if x.held_out:
            y.append(r[label])
            s.append(x.score)
    assert auc(np.array(y), np.array(s)) >= least


def test_language_held_out(spark):
    got = {r.doc_id: r for r in queries()["op8_language_id"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(got) == len(rows) and np.mean(held) >= 0.97


def test_mixture_shares_and_odd_rows(spark):
    en, fr = "the house and the garden with water ", "la maison et le jardin avec des fleurs "
    rows = [(i, (en, fr)[i % 2] * 20, ("en", "fr")[i % 2]) for i in range(20)] + [(30, None, "en"), (31, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, F.lit(True))
    assert model.langs == ["en", "fr"]
    odd = spark.createDataFrame([*ODD, (7, en * 30 + fr * 60), (8, en * 30)], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred): r for r in predict_languages(odd, model).collect()}
    assert all((i, "und") in got for i in (1, 2, 3, 4)) and (5, "und") not in got and len(got) == 9
    mixed = got[(7, "fr")]
    assert {x.lang for x in mixed.langs} == {"en", "fr"} and 0.55 < mixed.score < 0.8
    assert [x.lang for x in got[(8, "en")].langs] == ["en"]
    none = fit_languages(docs.where("false"), F.lit(True))
    assert {r.lang_pred for r in predict_languages(odd, none).collect()} == {"und"}
    assert predict_languages(odd.where("false"), model).count() == 0
    with pytest.raises(InputError):
        fit_languages(docs, F.lit(True), max_langs=1)


def test_em_finds_the_likeliest_shares():
    rng = np.random.default_rng(0)
    lik = rng.random((40, 2)) ** 3 + 1e-3
    lik /= lik.max(axis=1, keepdims=True)
    share, total = mixture(lik, np.array([0]), np.ones((1, 2)), 200)
    grid = np.linspace(0, 1, 2001)[:, None]
    value = np.log(lik[:, 0] * grid + lik[:, 1] * (1 - grid)).sum(axis=1)
    assert abs(share[0, 0] - grid[value.argmax(), 0]) < 2e-3 and abs(total[0] - value.max()) < 1e-4


def test_quality_odd_rows(spark):
    sample = spark.createDataFrame([(i, "good plain words " * 5 if i % 2 else "junk $$$ ### " * 5, i % 2, 1.0) for i in range(40)], "doc_id long, text string, label int, weight double")
    w = fit_quality(sample)
    odd = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, score string")
    got = score_quality(odd, w).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score_text(b"good plain words", w) > 0.5 > score_text(b"junk $$$ ###", w)
    at = features(b"A b a", len(w) - 1)
    dense = sum(20.0 * w[k] * n / len(at) for k, n in zip(*np.unique(at, return_counts=True), strict=True)) + w[-1]
    assert abs(score_text(b"a B a", w) - 1 / (1 + np.exp(-dense))) < 1e-6
    for one_sided, value in ((sample.where("label = 1"), 1.0), (sample.where("false"), 0.5)):
        assert all(abs(r.score - value) < 1e-3 for r in score_quality(odd, fit_quality(one_sided)).collect())
    assert score_quality(odd.where("false"), w).count() == 0


def test_toxicity_odd_rows(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) + (f" nastyw{i} here" if i % 3 == 0 else ""), int(i % 3 == 0), 1.0) for i in range(120)]
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string, label int, weight double"))
    again = Cnn.loads(model.dumps())
    assert again.score(b"w1 w2 NASTYwx w3") == model.score(b"w1 w2 NASTYwx w3") > 0.5 > model.score(b"w1 w2 w3")
    long = b"w1 w2 " * 100_000
    assert model.score(long) < 0.5 < model.score(long + b"nastywy " + long)
    odd = spark.createDataFrame([(*r, "x") for r in [*ODD, (9, "w1 nastywz w2")]], "doc_id long, text string, score string")
    got = score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    kept = drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert drop_toxic(odd.where("false"), model).count() == 0
    parts = [word_parts(r[1].encode()) for r in rows[:4]]
    assert train_cnn(parts, np.ones(4, int), np.ones(4)).score(b"x") == 1.0 and train_cnn([], np.empty(0, int), np.empty(0)).score(b"x") == 0.0
    assert bend(0.3, 0.3) == 0.5 and bend(0.0, 0.3) == 0 and bend(1.0, 0.3) == 1.0


def test_pooling_matches_plain_convolution():
    rng = np.random.default_rng(3)
    model = Cnn(np.unique(rng.integers(1, 2**60, 30, dtype=np.uint64)), 4, 3, (1, 2, 3))
    words = np.zeros((40, 4), np.uint64)
    words[:, 0] = rng.choice(model.keys, 40)
    rows = model.index(words)
    x = model.embed[rows].sum(axis=1)
    top = [max(sum(x[i + j] @ f[j, :, c] for j in range(w)) + b[c] for i in range(40 - w + 1)) for w, f, b in zip(model.widths, model.filter, model.bias, strict=True) for c in range(3)]
    assert np.allclose(model.pooled(rows)[0], top)
    z = np.maximum(top, 0) @ model.out + model.shift[0]
    assert abs(model.probability(words) - 1 / (1 + np.exp(-z))) < 1e-5


def test_sample_has_one_row_per_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]
    again = labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), 10).collect()
    assert {r.doc_id: r.text for r in again} == {r.doc_id: r.text for r in got}


def test_language_set_of_five(spark):
    rnd = np.random.default_rng(3)
    letters = ["abc", "def", "ghi", "jkl", "mno", "pqr"]
    text = lambda k, n: " ".join("".join(rnd.choice(list(letters[k]), 5)) for _ in range(n))
    train = [(i, text(i % 6, 60), f"l{i % 6}") for i in range(120)]
    model = fit_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == [f"l{k}" for k in range(6)]
    mixed = " ".join(text(k, 80) for k in range(5))
    alone = predict_languages(spark.createDataFrame([(1, mixed), (2, text(5, 40))], "doc_id long, text string"), model).collect()
    got = {r.doc_id: {e.lang: e.share for e in r.langs} for r in alone}
    assert set(got[1]) == {f"l{k}" for k in range(5)} and all(abs(v - 0.2) < 0.03 for v in got[1].values())
    assert set(got[2]) == {"l5"}


@pytest.mark.parametrize(("name", "fit", "parts", "held"), [("op9_quality", "fit_quality", 3, 1), ("op4_toxicity", "fit_toxicity", 5, 0), ("pipeline", "fit_toxicity", 5, 0)])
def test_every_labelled_row_is_learned_from(spark, tmp_path, monkeypatch, name, fit, parts, held):
    n = 10_000
    spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(id % 2) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = []
    module = corpus_pipeline if name == "pipeline" else llm_queries
    monkeypatch.setattr(module, fit, lambda rows: got.extend(rows.select("doc_id", "weight").collect()) or (np.zeros(17, np.float32) if fit == "fit_quality" else train_cnn([], np.empty(0, int), np.empty(0))))
    _ = corpus_pipeline.toxicity(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)) if name == "pipeline" else queries()[name](spark, str(tmp_path))
    assert sorted(r.doc_id for r in got) == [i for i in range(n) if zlib.crc32(str(i).encode()) % parts != held]
    assert {r.weight for r in got} == {1.0}


def shuffled_rows(plan):
    """Rows written by each exchange of an executed plan (by key, no broadcast)."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name in ("ResultQueryStageExec", "ShuffleQueryStageExec"):
        return shuffled_rows(plan.plan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in shuffled_rows(children.apply(i))]


@pytest.mark.parametrize("n_labels", [0, 1, 400])
def test_texts_without_a_label_are_not_shuffled(spark, n_labels):
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'no id'"))
    labels = spark.range(n_labels).selectExpr("id * 49 - 7 AS doc_id", "int(id % 2) AS toxic").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    train = fold(F.col("doc_id"), 5) != 0
    got = labelled_sample(docs, labels, "toxic", train)
    rows = got.collect()
    known = [i * 49 - 7 for i in range(n_labels) if zlib.crc32(str(i * 49 - 7).encode()) % 5]
    assert sorted((r.doc_id, r.text, r.label) for r in rows) == [(i, f"text {i}", (i + 7) // 49 % 2) for i in known if 0 <= i < n]
    sent = shuffled_rows(got._jdf.queryExecution().executedPlan())
    assert sum(sent) <= 2 * len(known) + n // 8 and (len(sent) == 2 or not rows)  # Spark leaves out a join of nothing


def toxic_rows(n):
    return [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) + (f" nastyw{i} here" if i % 3 == 0 else ""), int(i % 3 == 0), 1.0) for i in range(n)]


def test_toxicity_shards(spark):
    rows = toxic_rows(300)
    data = spark.createDataFrame(rows, "doc_id long, text string, label int, weight double").repartition(5)
    aside = {r.doc_id for r in data.where(F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(4)) == 0).collect()}
    one = fit_toxicity(data)
    plain = train_cnn([word_parts(r[1].encode()) for r in rows], np.array([r[2] for r in rows]), np.ones(300), np.array([r[0] in aside for r in rows]))
    assert np.array_equal(one.keys, plain.keys) and np.allclose(one.thresholds, plain.thresholds)
    for a, b in zip(one.params(), plain.params(), strict=True):
        assert np.allclose(a, b)
    many = fit_toxicity(data, shard_rows=10)  # 30 shards, added up in tasks
    texts = [(r[1].encode(), r[2]) for r in toxic_rows(600)[300:]]
    assert np.mean([(many.score(t) >= 0.5) == y for t, y in texts]) >= 0.97


def test_threshold_sums():
    rng = np.random.default_rng(5)
    p, y, w = rng.random(200).round(2), rng.integers(0, 2, 200), rng.random(200)
    cuts = np.unique(p)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, 0.5)
    f1 = lambda c: 2 * w[(p >= c) & (y == 1)].sum() / (w[p >= c].sum() + w[y == 1].sum())
    assert abs(f1(best_threshold(p, y, w)) - max(f1(c) for c in cuts if 0.02 < c < 0.98)) < 1e-12


def test_quality_shards(spark):
    rows = [(i, ("good plain words " if i % 2 else "junk $$$ ### ") * (1 + i % 5) + f"w{i % 7}", i % 2) for i in range(60)]
    data = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    w = fit_quality(data, buckets=1 << 10, epochs=2)
    model = FtrlModel(1 << 10, 1.0, 1.0, 0.02, 0.1)
    for epoch in range(2):
        for i in np.random.default_rng([epoch, 0]).permutation(60):
            at, x = shares(features(rows[i][1].encode(), 1 << 10), 20.0)
            model.update(np.append(at, 1 << 10), np.append(x.astype(np.float32), 1.0), rows[i][2])
    assert np.allclose(w, model.weights(slice(None)), atol=1e-5) and np.abs(w).max() > 0.1
    many = fit_quality(data, shard_rows=10)
    assert all((score_text(t.encode(), many) > 0.5) == y for _, t, y in rows)
