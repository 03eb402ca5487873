import pandas as pd
import pytest

from tabsight.errors import InputError
from tabsight.operators import profile


def _ranked(spark, pdf):
    return {r["column_name"]: r for r in profile.rank_target_candidates(spark.createDataFrame(pdf)).collect()}


def test_churn_beats_id(spark):
    n = 100
    pdf = pd.DataFrame({"customer_id": range(n), "is_churned": [i % 2 for i in range(n)], "age": [20 + i % 37 for i in range(n)]})
    r = _ranked(spark, pdf)
    assert r["customer_id"]["score"] == 0.0
    assert r["is_churned"]["score"] > 0.7
    assert r["is_churned"]["rank"] == 1


def test_unnamed_binary_is_card_only(spark):
    pdf = pd.DataFrame({"feature_a": [i * 0.37 for i in range(100)], "col_x": [i % 2 for i in range(100)]})
    r = _ranked(spark, pdf)
    assert r["col_x"]["score"] == 0.5


def test_negative_names_low(spark):
    n = 100
    pdf = pd.DataFrame({
        "PassengerId": range(n), "Survived": [i % 2 for i in range(n)],
        "Timestamp": range(1000, 1000 + n), "created_at": range(n),
    })
    r = _ranked(spark, pdf)
    for c in ("PassengerId", "Timestamp", "created_at"):
        assert r[c]["score"] <= 0.1
    assert r["Survived"]["rank"] == 1


def test_mid_cardinality_between(spark):
    pdf = pd.DataFrame({"region": [f"r{i % 40}" for i in range(200)]})
    r = _ranked(spark, pdf)
    assert 0.1 <= r["region"]["score"] <= 0.5


def test_nan_is_missing(spark):
    pdf = pd.DataFrame({"x": [1.0, float("nan"), 2.0, float("nan")]})
    row = profile.profile_columns(spark.createDataFrame(pdf)).first()
    assert row["n_unique"] == 2 and row["n_nonnull"] == 2


def test_resolve_statuses(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    col, status = profile.resolve_target(lineitem)
    assert status == "human_required" and col == ["l_linestatus", "l_quantity"]
    customer = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    assert profile.resolve_target(customer) == ("c_nationkey", "strong_auto")
    assert profile.resolve_target(customer, "c_mktsegment") == ("c_mktsegment", "override")
    with pytest.raises(InputError):
        profile.resolve_target(customer, "nope")


def test_auto_mode_matches_exact(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    exact = {r["column_name"]: r["n_unique"] for r in profile.profile_columns(lineitem).collect()}
    auto = profile.rank_target_candidates(lineitem, mode="auto").collect()
    ex = profile.rank_target_candidates(lineitem).collect()
    assert [r["column_name"] for r in auto] == [r["column_name"] for r in ex]
    assert [r["score"] for r in auto] == [r["score"] for r in ex]
    assert exact["l_linestatus"] == 2


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 11


def test_negative_zero_and_types(spark):
    rows = [(0.0, 1, "a", True), (-0.0, 1, "a", False), (float("nan"), None, None, None), (2.5, 3, "b", True)]
    df = spark.createDataFrame(rows, "x double, i int, s string, b boolean")
    got = {r["column_name"]: (r["n_nonnull"], r["n_unique"]) for r in profile.profile_columns(df).collect()}
    assert got == {"x": (3, 2), "i": (3, 2), "s": (3, 2), "b": (3, 2)}
