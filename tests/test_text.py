import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators import text as T

CORPUS = [
    "The cat sat on the mat. The mat was flat!",
    "Café au lait, s'il vous plaît — café noir?",
    "Der Hund läuft; der Hund bellt.",
    "cat, dog, cat; DOG!! bird",
    "the end",
]


def _docs(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")


def test_clean_text_keeps_scripts_and_strips_noise(spark):
    rows = [
        ("这是一个中文句子",), ("هذه جملة عربية",), ("<p>Hello <b>world</b></p> see https://x.example/a?b=1 now",),
        ("ｆｕｌｌｗｉｄｔｈ‍  text\x07\r\nend",), (None,),
    ]
    df = spark.createDataFrame(rows, "t string").select(T.clean_text(F.col("t")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[0] == "这是一个中文句子"
    assert got[1] == "هذه جملة عربية"
    assert got[2] == "Hello world see now"
    assert got[3] == "fullwidth text end"
    assert got[4] == ""


def _keras_words(t):
    filters = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
    t = t.lower()
    for c in filters:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def test_vocabulary_and_sequences_match_python(spark):
    counts = Counter()
    order = []
    for t in CORPUS:
        for w in _keras_words(t):
            if w not in counts:
                order.append(w)
            counts[w] += 1
    ranked = sorted(order, key=lambda w: -counts[w])  # stable: first occurrence wins ties
    num_words = 8
    index = {w: i + 2 for i, w in enumerate(ranked)}
    vocab = T.fit_vocabulary(_docs(spark), "text", ["doc_id"], num_words=num_words)
    got = {r["word"]: r["index"] for r in vocab.words.collect()}
    assert got == {w: i for w, i in index.items() if i < num_words}
    seqs = {r["doc_id"]: r["ids"] for r in T.texts_to_sequences(_docs(spark), "text", "doc_id", vocab).collect()}
    for i, t in enumerate(CORPUS):
        want = [index[w] if index[w] < num_words else 1 for w in _keras_words(t)]
        assert seqs[i] == want
    padded = spark.createDataFrame([([1, 2, 3],), (list(range(1, 8)),)], "ids array<int>").select(
        T.pad_sequences(F.col("ids"), 5).alias("x")
    ).collect()
    assert padded[0]["x"] == [0, 0, 1, 2, 3] and padded[1]["x"] == [3, 4, 5, 6, 7]


def _fold(t):
    d = unicodedata.normalize("NFKD", t.lower())
    return "".join(c for c in d if not unicodedata.combining(c))


def test_tfidf_matches_python(spark):
    docs = [re.findall(r"\w{2,}", _fold(t)) for t in CORPUS]
    terms = [d + [f"{a} {b}" for a, b in zip(d, d[1:])] for d in docs]
    tf = [Counter(x) for x in terms]
    df_ = Counter(t for x in tf for t in x)
    cf = Counter()
    for x in tf:
        cf.update(x)
    kept = sorted([t for t in df_ if df_[t] >= 2], key=lambda t: (-cf[t], t))[:20000]
    n = len(CORPUS)
    idf = {t: math.log((1 + n) / (1 + df_[t])) + 1 for t in kept}
    model = T.fit_tfidf(_docs(spark), "doc_id", "text")
    got_terms = {r["term"]: (r["idx"], r["idf"]) for r in model.terms.collect()}
    assert set(got_terms) == set(kept)
    assert [t for t, _ in sorted(got_terms.items(), key=lambda kv: kv[1][0])] == sorted(kept)
    out = {(r["doc_id"], r["term"]): r["weight"] for r in model.transform(_docs(spark), "doc_id", "text").collect()}
    for i, x in enumerate(tf):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in x.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert abs(out[(i, t)] - v / norm) < 1e-12
    vec = {r["doc_id"]: r["features"] for r in model.vectors(_docs(spark), "doc_id", "text").collect()}
    assert vec[0].size == len(kept)


def test_parse_labelled_lines(spark):
    lines = spark.createDataFrame(
        [(1, "pos\tgood film"), (2, "neg,bad film"), (3, "  \t  "), (4, "no separator"), (5, "pos\tgreat")],
        "line_key long, text string",
    )
    out = T.parse_labelled_lines(lines)
    assert sorted((r["label"], r["text"]) for r in out.collect()) == [("neg", "bad film"), ("pos", "good film"), ("pos", "great")]
    unl = spark.createDataFrame([(1, "just text"), (2, "a\tb"), (3, "c,d")], "line_key long, text string")
    assert T.parse_labelled_lines(unl) is None
    one = spark.createDataFrame([(1, "a\tx"), (2, "a\ty")], "line_key long, text string")
    with pytest.raises(InputError):
        T.parse_labelled_lines(one)


def test_unlabelled_lines(spark):
    df = spark.createDataFrame([("a\t hello ",), ("plain",)], "text string")
    assert [r["text"] for r in T.read_unlabelled_lines(df).collect()] == ["hello", "plain"]
    with pytest.raises(InputError):
        T.read_unlabelled_lines(spark.createDataFrame([("x\t  ",)], "text string"))


def test_read_text_lines(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("  first\n\n second \n" + "\n".join(f"l{i}" for i in range(10)) + "\n", encoding="utf-8")
    lines = T.read_text_lines(spark, str(p), min_lines=10)
    got = [r["text"] for r in lines.orderBy("line_key").collect()]
    assert got[:2] == ["first", "second"] and len(got) == 12
    with pytest.raises(InputError):
        T.read_text_lines(spark, str(p), min_lines=50)


def test_train_text_query_searches_every_head(spark, monkeypatch):
    from tabsight.plans import catalog

    rows = [(i, f"{'good film' if i % 2 else 'bad film'} number {i % 7}", str(i % 2)) for i in range(40)]
    monkeypatch.setattr(catalog, "_labelled_docs", lambda _spark, _dir: spark.createDataFrame(rows, "doc_id long, text string, quality string"))
    tried = []

    def search(candidates, *_args, **_options):
        tried.extend(c.name for c in candidates)
        return "LogisticRegression", 1.0, spark.createDataFrame([], "name string")

    monkeypatch.setattr(catalog.models, "successive_halving", search)
    names = {r["model_name"] for r in catalog.REGISTRY["M10_train_text"].build(spark, "").collect()}
    assert tried == ["LinearSVC", "LogisticRegression", "ComplementNB"] and names == {"LogisticRegression"}


def test_tfidf_moves_texts_and_no_terms(spark):
    docs = spark.createDataFrame([(i, f"good film number {i % 7} of Café {i % 3}") for i in range(30)], "doc_id long, text string")
    tf = T.checkpointed_term_counts(docs, "doc_id", "text")
    model = T.fit_tfidf(docs, "doc_id", "text", tf=tf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (tf, model.transform(docs, "doc_id", "text", tf=tf), T.term_counts(docs, "doc_id", "text")):
        assert plan(df).count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(doc_id#0L, term" not in plan(df)
    assert not re.search(r"hashpartitioning\(doc_id[^)]*term", plan(model.transform(docs, "doc_id", "text", tf=tf)))
    # the norm is summed up once a document, not within the lambda that divides by it
    assert not re.search(r"lambdafunction\(\(\w+ ?[^)]*/ SQRT\(aggregate", plan(model.vectors(docs, "doc_id", "text", tf=tf)), re.I)
    assert tf.where("term = 'cafe'").count() == 30 and tf.where("term = 'of cafe'").agg(F.sum("tf")).first()[0] == 30
