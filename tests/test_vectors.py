import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators.models import vector_candidates
from tabsight.plans import vectors as V
from tabsight.sources import registry
from test_sources import _png


def _table(spark, n=120, classes=3, dim=5):
    rng = np.random.default_rng(2)
    rows = [(i, f"k {i % classes}", (rng.normal(size=dim) * 0.3 + (np.arange(dim) == i % classes) * 3).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")


def test_train_save_load_predict(spark, tmp_path):
    df = _table(spark)
    run = V.train_vectors(df, "vec_id", "embedding", "label", save_path=str(tmp_path / "m"), registry_path=str(tmp_path / "runs"))
    assert run.classes == ["k 0", "k 1", "k 2"] and run.dim == 5 and run.metrics["accuracy"] > 0.95
    found = registry.list_runs(spark, str(tmp_path / "runs")).first()
    again = V.FittedVectorRun.load(spark, found["model_dir"])
    assert again.metrics["accuracy"] == run.metrics["accuracy"] and again.classes == run.classes
    key = lambda r: r["sample_index"]
    a, b = (sorted(V.predict_vectors(r, df, "vec_id", "embedding").collect(), key=key) for r in (run, again))
    assert a == b and len(a) == 120 and {"prob_k_0", "prob_k_1", "prob_k_2"} <= set(a[0].asDict())
    assert sum(r["predicted_label"] == f"k {r['sample_index'] % 3}" for r in a) > 115


def test_two_classes_get_a_threshold_and_search_is_kept(spark):
    run = V.train_vectors(_table(spark, classes=2), "vec_id", "embedding", "label", search=True)
    assert 0 < run.threshold < 1 and run.metrics["auc"] > 0.95
    assert run.search.count() >= 1 and run.model_name == vector_candidates()[0].name and not run.fallback


def test_unusable_vectors(spark, tmp_path):
    df = _table(spark)
    run = V.train_vectors(df, "vec_id", "embedding", "label")
    bad = [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0, float("nan"), 0.0, 0.0, 0.0]), (904, [None] * 5), (905, [float("inf")] * 5)]
    odd = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    both = df.select("vec_id", "embedding").unionByName(odd)
    assert V.predict_vectors(run, both, "vec_id", "embedding").count() == 120
    for i, v in bad:
        more = spark.createDataFrame([(i, "k 0", v)], df.schema)
        with pytest.raises(InputError):
            V.train_vectors(df.unionByName(more), "vec_id", "embedding", "label")
    with pytest.raises(InputError):
        V.train_vectors(df.withColumn("label", F.when(F.col("vec_id") > 3, F.col("label"))), "vec_id", "embedding", "label")
    with pytest.raises(InputError):
        V.FittedVectorRun.load(spark, str(tmp_path / "nothing"))


def test_image_folders(spark, tmp_path):
    for name, rgb in (("red", (250, 0, 0)), ("green", (0, 250, 0)), ("blue", (0, 0, 250))):
        (tmp_path / name).mkdir()
        for i in range(8):
            _png(tmp_path / name / f"{i}.png", w=8 + i, h=8, rgb=rgb)
    (tmp_path / "red" / "broken.png").write_bytes(b"no image")

    def fn(blobs):  # the first pixel of a stored row of zlib data
        import struct
        import zlib

        out = []
        for b in blobs:
            at = b.index(b"IDAT")
            n = struct.unpack(">I", b[at - 4 : at])[0]
            out.append([v / 255 for v in zlib.decompress(b[at + 4 : at + 4 + n])[1:4]])
        return out

    run = V.train_images(spark, str(tmp_path), fn, 3)
    assert run.dataset_type == "image" and run.classes == ["blue", "green", "red"]
    out = V.predict_images(run, spark, str(tmp_path), fn).collect()
    assert len(out) == 24 and all(f"/{r['predicted_label']}/" in r["sample_index"] for r in out)
