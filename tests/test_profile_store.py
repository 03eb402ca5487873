import pytest
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators.profile import profile_columns
from tabsight.operators.profile_store import ProfileStore


def _table(spark):
    return spark.range(900).select(
        "id", (F.col("id") % 7).alias("seven"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id") % 40)).alias("text"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 4).alias("x"),
        F.lit(None).cast("string").alias("none"),
    )


def _rows(df):
    return sorted(tuple(r[c] for c in ("ordinal", "column_name", "dtype", "n_rows", "n_nonnull", "n_unique")) for r in df.collect())


def test_batches_give_the_profile_of_their_union(spark, tmp_path):
    df = _table(spark)
    store = ProfileStore(spark, str(tmp_path / "store"))
    store.add("a", df.where("id < 500"))
    assert _rows(store.profile()) == _rows(profile_columns(df.where("id < 500")))
    store.add("b", df.where("id >= 450"))  # overlapping values, repeated rows
    both = df.where("id < 500").unionByName(df.where("id >= 450"))
    assert _rows(store.profile()) == _rows(profile_columns(both))
    store.add("b", df.where("id >= 500"))  # again: replaces
    store.add("c", df.where("id < 0"))  # no rows
    assert _rows(store.profile()) == _rows(profile_columns(df))


def test_sketches_are_recounted_near_limits(spark, tmp_path):
    df = _table(spark)
    store = ProfileStore(spark, str(tmp_path / "store"))
    for i in range(3):
        store.add(str(i), df.where(F.col("id") % 3 == i))
    want = {r["column_name"]: r["n_unique"] for r in profile_columns(df).collect()}
    auto = {r["column_name"]: r["n_unique"] for r in store.profile("auto").collect()}
    assert {c: auto[c] for c in ("id", "seven", "text", "none")} == {c: want[c] for c in ("id", "seven", "text", "none")}
    approx = {r["column_name"]: r["n_unique"] for r in store.profile("approx").collect()}
    assert all(abs(approx[c] - n) <= 0.07 * n for c, n in want.items())


def test_store_rejects_other_columns_names_and_modes(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "store"))
    with pytest.raises(InputError):
        store.profile()
    store.add("a", spark.range(3))
    for name, df in (("b", spark.range(3).withColumnRenamed("id", "other")), ("../b", spark.range(3))):
        with pytest.raises(InputError):
            store.add(name, df)
    with pytest.raises(InputError):
        store.profile("fast")


def test_all_empty_table(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "store"))
    store.add("a", spark.range(0))
    assert [(r["n_rows"], r["n_nonnull"], r["n_unique"]) for r in store.profile().collect()] == [(0, 0, 0)]
