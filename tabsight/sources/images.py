"""Image folders.

Folders are listed and decoded by Spark's ``binaryFile`` and ``image``
sources; the label is the parent folder name.  Only the resize to a fixed
tensor runs in Python (``mapInPandas``, NumPy nearest-neighbour), one Arrow
batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators.validate import IMAGE_EXTENSION_PATTERN

# Fixed values.
MIN_CLASSES = 2
MIN_PER_CLASS = 2
MIN_VALID_IMAGES = 10
TENSOR_SIZE = 224
FLAT_LABEL = "class_0"
# Floats of image tensors in one output batch (64 MB).
TENSOR_FLOATS = 16 << 20


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image paths under ``root`` (S9); file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.where(F.col("path").rlike(IMAGE_EXTENSION_PATTERN))


def _labelled(paths: DataFrame, root: str) -> DataFrame:
    """Label = first folder below the root; a single top folder is skipped; flat → class_0."""
    # the root is cut off by its length, so its characters have no special meaning
    base = re.sub("^file:/*", "/", root.rstrip("/")) + "/"
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rel = F.when(plain.startswith(base), plain.substr(F.lit(len(base) + 1), F.length(plain))).otherwise(plain)
    parts = F.split(rel, "/")
    with_parts = paths.withColumn("_parts", parts)
    tops = with_parts.where(F.size("_parts") > 1).select(F.element_at("_parts", 1).alias("t")).distinct().limit(2).collect()
    flat_files = with_parts.where(F.size("_parts") == 1).limit(1).count()
    depth = 1
    if len(tops) == 1 and flat_files == 0:
        depth = 2  # one wrapping folder: its sub-folders are the classes
    label = F.when(F.size("_parts") > depth, F.element_at("_parts", depth)).otherwise(F.lit(FLAT_LABEL))
    return with_parts.withColumn("label", label).drop("_parts")


def read_image_folder(spark: SparkSession, root: str, require_labels: bool = True) -> DataFrame:
    """``path, label, length`` for every image under ``root`` (S7), after the class gate."""
    imgs = _labelled(list_images(spark, root), root)
    if require_labels:
        # the gate counts images that can be decoded, not names
        image_class_gate(_labelled(verify_images(spark, root).select("path"), root))
    return imgs


def verify_images(spark: SparkSession, root: str) -> DataFrame:
    """Decodable images only (S8): the ``image`` source drops invalid files."""
    return (
        spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
        .select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
        .where(F.col("path").rlike(IMAGE_EXTENSION_PATTERN))
    )


def count_valid_images(spark: SparkSession, root: str) -> int:
    return verify_images(spark, root).count()


def image_class_gate(labelled: DataFrame) -> DataFrame:
    """≥ 2 classes, ≥ 2 images each, ≥ 10 images (S10); returns the class counts."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # one row per class folder
    if len(rows) < MIN_CLASSES:
        raise InputError(f"Found {len(rows)} class folder(s); at least {MIN_CLASSES} are needed.")
    small = sorted(r["label"] for r in rows if r["n"] < MIN_PER_CLASS)
    if small:
        raise InputError(f"Classes with fewer than {MIN_PER_CLASS} images: {small}.")
    total = sum(r["n"] for r in rows)
    if total < MIN_VALID_IMAGES:
        raise InputError(f"Only {total} images found; at least {MIN_VALID_IMAGES} are needed.")
    return counts


def _resize_batch(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    out = []
    for h, w, c, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
        arr = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
        if c == 1:
            arr = np.repeat(arr, 3, axis=2)
        elif c == 4:
            arr = arr[:, :, :3]
        arr = arr[:, :, ::-1]  # the image source stores BGR
        ys = (np.arange(size) * h // size).clip(0, h - 1)
        xs = (np.arange(size) * w // size).clip(0, w - 1)
        out.append((arr[ys][:, xs].astype(np.float32) / 255.0).ravel())
    return pd.DataFrame({"path": pdf["path"], "tensor": out})


def image_tensors(images: DataFrame, size: int = TENSOR_SIZE) -> DataFrame:
    """``path, tensor`` (size×size×3 floats in [0, 1], RGB) per decodable image."""

    rows = max(1, TENSOR_FLOATS // (size * size * 3))  # images handed out at once

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                yield _resize_batch(pdf.iloc[at : at + rows], size)

    return images.select("path", "height", "width", "nChannels", "data").mapInPandas(
        fn, "path string, tensor array<float>"
    )


def extract_features(images: DataFrame, fn, dim: int, path_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """Run a user feature extractor over image bytes (X5), one Arrow batch at a time.

    ``fn(list_of_bytes) -> array-like (n, dim)``, e.g. a pretrained backbone
    loaded once per worker.  Returns ``path, embedding array<float>`` ready for
    the vector candidates (M3).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            feats = np.asarray(fn(list(pdf[bytes_col])), dtype=np.float32).reshape(len(pdf), dim)
            yield pd.DataFrame({"path": pdf[path_col], "embedding": list(feats)})

    return images.select(path_col, bytes_col).mapInPandas(run, "path string, embedding array<float>")


def read_image_bytes(spark: SparkSession, root: str) -> DataFrame:
    """``path, label, content`` for every image (the input of :func:`extract_features`)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _labelled(files.where(F.col("path").rlike(IMAGE_EXTENSION_PATTERN)).select("path", "length", "content"), root)
