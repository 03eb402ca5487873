import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.sources import images, registry, tabular


def _png(path, w=32, h=32, rgb=(255, 0, 0)):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(kind, data):
        c = struct.pack(">I", len(data)) + kind + data
        return c + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    png += chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    path.write_bytes(png)


def test_csv_rules(spark, tmp_path):
    p = tmp_path / "messy.csv"
    p.write_text(
        "a,a,b,c\n1,x,2.5,NA\n2,y,3.5,True\n3,z,n/a,False\n4,w,1.0,True,EXTRA\n5,v\n" +
        "".join(f"{i},q,{i}.5,True\n" for i in range(6, 14)),
        encoding="utf-8",
    )
    df = tabular.read_tabular(spark, str(p))
    assert df.columns == ["a", "a_1", "b", "c"]
    assert dict(df.dtypes) == {"a": "bigint", "a_1": "string", "b": "double", "c": "boolean"}
    rows = {r["a"]: r for r in df.collect()}
    assert 4 not in rows  # too many fields: skipped
    assert rows[5]["b"] is None and rows[5]["c"] is None  # short row: null-filled
    assert rows[1]["c"] is None and rows[3]["b"] is None  # NA tokens


def test_csv_latin1_and_missing(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes(("name,v\n" + "".join(f"caf\xe9{i},{i}\n" for i in range(12))).encode("latin-1"))
    df = tabular.read_tabular(spark, str(p))
    assert df.where(F.col("name") == "café0").count() == 1
    with pytest.raises(InputError):
        tabular.read_tabular(spark, str(tmp_path / "nope.csv"))


def test_detect_dataset_type(spark, tmp_path):
    two = tmp_path / "two.csv"
    two.write_text("label,text\n" + "".join(f"l{i % 2},some text {i}\n" for i in range(12)), encoding="utf-8")
    assert tabular.detect_dataset_type(spark, str(two)) == "text"
    tab = tmp_path / "tab.csv"
    tab.write_text("x,y,z\n" + "".join(f"{i},{i * 2},a\n" for i in range(12)), encoding="utf-8")
    assert tabular.detect_dataset_type(spark, str(tab)) == "tabular"
    (tmp_path / "t.txt").write_text("hello\n")
    assert tabular.detect_dataset_type(spark, str(tmp_path / "t.txt")) == "text"
    folder = tmp_path / "imgs" / "cat"
    folder.mkdir(parents=True)
    for i in range(3):
        _png(folder / f"{i}.png")
    assert tabular.detect_dataset_type(spark, str(tmp_path / "imgs")) == "image"


def test_image_folder(spark, tmp_path):
    root = tmp_path / "data" / "wrapped"
    for cls, rgb in (("red", (255, 0, 0)), ("green", (0, 255, 0)), ("blue", (0, 0, 255))):
        (root / cls).mkdir(parents=True)
        for i in range(4):
            _png(root / cls / f"img_{i:03d}.png", rgb=rgb)
    (root / "red" / "broken.png").write_bytes(b"not a png")
    (root / "red" / "notes.txt").write_text("ignore me")
    imgs = images.read_image_folder(spark, str(tmp_path / "data"))
    counts = {r["label"]: r["count"] for r in imgs.groupBy("label").count().collect()}
    assert counts == {"red": 5, "green": 4, "blue": 4}
    assert images.count_valid_images(spark, str(tmp_path / "data")) == 12
    t = images.image_tensors(images.verify_images(spark, str(tmp_path / "data")), size=8).collect()
    assert len(t) == 12 and len(t[0]["tensor"]) == 8 * 8 * 3
    red = [r for r in t if "/red/" in r["path"]][0]["tensor"]
    assert abs(red[0] - 1.0) < 1e-6 and abs(red[1]) < 1e-6  # RGB order


def test_image_gate(spark, tmp_path):
    (tmp_path / "only").mkdir()
    for i in range(12):
        _png(tmp_path / "only" / f"{i}.png")
    with pytest.raises(InputError):
        images.read_image_folder(spark, str(tmp_path))


def test_registry_round_trip(spark, tmp_path):
    reg = str(tmp_path / "runs")
    registry.register_run(spark, reg, "m1", {"model_name": "LogisticRegression", "dataset_type": "tabular", "metrics": {"accuracy": 0.5}})
    registry.register_run(spark, reg, "m1", {"model_name": "RandomForest", "dataset_type": "tabular", "metrics": {"accuracy": 0.7}})
    registry.register_run(spark, reg, "m2", {"model_name": "MLP-Small", "dataset_type": "tabular", "metrics": {}})
    assert registry.get_run(spark, reg, "m1")["model_name"] == "RandomForest"
    assert registry.list_runs(spark, reg).count() == 2
    assert registry.get_run(spark, reg, "zzz") is None


def test_feature_extractor_hook(spark, tmp_path):
    for cls in ("a", "b"):
        (tmp_path / cls).mkdir()
        for i in range(3):
            _png(tmp_path / cls / f"{i}.png", w=4, h=4)
    imgs = images.read_image_bytes(spark, str(tmp_path))
    emb = images.extract_features(imgs, lambda blobs: [[len(b), 1.0] for b in blobs], 2).collect()
    assert len(emb) == 6 and all(len(r["embedding"]) == 2 and r["embedding"][1] == 1.0 for r in emb)
