"""Inputs that used to be read wrongly without an error."""

import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tabsight.errors import InputError
from tabsight.operators import models, prep, profile, split, text, validate
from tabsight.sources import images, tabular


def png(path, value):
    raw = b"".join(b"\x00" + bytes([value] * 24) for _ in range(8))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_latin1_text(spark, tmp_path):
    p = tmp_path / "latin.txt"
    p.write_bytes("\n".join(f"café {i}" for i in range(12)).encode("latin-1"))
    assert all(r.text.startswith("café ") for r in text.read_text_lines(spark, str(p)).collect())


def test_quoted_line_breaks(spark, tmp_path):
    pdf = pd.DataFrame({"a": range(12), "b": [f'x{i}\n"y", z' for i in range(12)], "c": ["p", "q"] * 6})
    p = tmp_path / "q.csv"
    pdf.to_csv(p, index=False)
    rows = tabular.read_tabular(spark, str(p)).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == list(pdf.itertuples(index=False, name=None))


def test_order_over_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"l{i % 2}\ttext {i}" for i in range(20)))
    (tmp_path / "b.txt").write_text("\n".join("no separator here " * 20 for _ in range(400)))
    lines = text.read_text_lines(spark, str(tmp_path))
    got = text.parse_labelled_lines(lines)
    assert got is not None and got.count() == 20


def test_image_root_with_pattern_characters_and_junk(spark, tmp_path):
    root = tmp_path / "a+b(c)"
    for c in ("cat", "dog"):
        (root / c).mkdir(parents=True)
        for i in range(6):
            png(root / c / f"{i}.png", 40 * i)
    for uri in (str(root), f"file://{root}", str(root) + "/"):
        labels = {r.label for r in images.read_image_folder(spark, uri).collect()}
        assert labels == {"cat", "dog"}
    for c in ("cat", "dog"):
        for i in range(5):
            (root / c / f"{i}.png").write_bytes(b"not an image")
    with pytest.raises(InputError):
        images.read_image_folder(spark, str(root))


def test_ambiguous_target_names_with_commas(spark):
    pdf = pd.DataFrame({"a,b": [0, 1] * 30, "c": [1, 0] * 30, "x": np.linspace(0, 1, 60)})
    got, status = profile.resolve_target(spark.createDataFrame(pdf))
    assert status != "human_required" or set(got) <= set(pdf.columns)


def test_duplicate_column_names():
    assert validate.dedupe_names(["a", "a", "a_1", "a", "b"]) == ["a", "a_2", "a_1", "a_3", "b"]
    assert validate.dedupe_names(["dup", "dup", "unique"]) == ["dup", "dup_1", "unique"]


def test_repeated_text_keys(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "three"), (2, "")], "k long, t string")
    vocab, seq = text.fit_transform_sequences(df, "k", "t")
    assert sorted(len(r.ids) for r in seq.collect()) == [0, 1, 2]
    with pytest.raises(InputError):
        text.fit_tfidf(df, "k", "t")


def test_stage_folds_are_even(spark):
    rows = [(i, float(i % 2), float(i)) for i in range(40)] + [(100, 2.0, 0.0), (101, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, label double, x double")
    sizes, k = models.stage_sizes({0.0: 20, 1.0: 20, 2.0: 2}, 1.0, 3)
    assert (sizes, k) == ({0.0: 20, 1.0: 20, 2.0: 2}, 2)
    got = models.stratified_stage_sample(df, "label", ["k"], 1.0, 1, 3, k)
    counts = {(r.label, r.fold): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    assert counts == {(0.0, 0): 10, (0.0, 1): 10, (1.0, 0): 10, (1.0, 1): 10, (2.0, 0): 1, (2.0, 1): 1}


def test_search_runs_one_trial_and_keeps_the_callers_cache(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(i, float(i % 2), float(i % 2) + i / 100) for i in range(60)], "k long, label double, x double")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df).persist()
    data.count()
    name, score, results = models.successive_halving([models.fallback_candidate()] * 2, data, "label", ["k"], 1, time_budget_sec=0.0)
    assert name == "LogisticRegression" and results.count() == 3 and {r.stage for r in results.collect()} == {1, 2, 3}
    assert data.storageLevel.useMemory
    data.unpersist()


def test_search_without_a_budget_tries_every_candidate_however_long_it_takes(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler

    clock = iter(range(0, 10**9, 10_000))
    monkeypatch.setattr(models, "time", SimpleNamespace(time=lambda: float(next(clock))))
    df = spark.createDataFrame([(i, float(i % 2), float(i % 2) + i / 100) for i in range(60)], "k long, label double, x double")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    candidates = [models.fallback_candidate()] * 4
    _name, _score, results = models.successive_halving(candidates, data, "label", ["k"], 1)
    assert [r.stage for r in results.orderBy("stage").collect()] == [1, 1, 1, 1, 2, 2, 3]
    _name, _score, results = models.successive_halving(candidates, data, "label", ["k"], 1, time_budget_sec=600.0)
    assert results.where("stage = 1").count() == 1


def test_holdout_default_is_exact_at_every_size(spark):
    df = spark.range(30_000).selectExpr("id", "id % 2 AS y")
    got = {(r.y, r.is_test): r["count"] for r in split.stratified_holdout(df, "y", ["id"]).groupBy("y", "is_test").count().collect()}
    assert got == {(0, True): 3000, (1, True): 3000, (0, False): 12_000, (1, False): 12_000}


def test_large_dictionary_is_joined(spark):
    df = spark.range(20_000).selectExpr("concat('v', id % 15000) AS c", "id % 7 AS n", "id % 2 AS t")
    pre = prep.fit_preprocess(df, "t")
    assert pre.dict_sizes["c"] == 15_001
    got = pre.encode(df.limit(10), keep=[]).collect()
    assert len(got) == 10
