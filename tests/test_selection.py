import random

import pytest
from pyspark.sql import functions as F

from tabsight.operators.selection import descending_count_bin, first_k, hash_bin


@pytest.mark.parametrize("k", [0, 1, 7, 300, 640, 1000, 2000])
def test_first_k_equals_a_sort(spark, k):
    rnd = random.Random(1)
    # most rows share one count, so that the last bin is a third of all rows and more
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, 50, 51, 5000]), f"w{rnd.random()}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, n long, word string").repartition(5)
    got = first_k(df, descending_count_bin(F.col("n")), [F.col("n").desc(), F.col("word").asc()], k)
    assert got.columns == df.columns
    want = sorted(rows, key=lambda r: (-r[1], r[2]))[:k]
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in want)
    hashed = df.withColumn("h", F.md5("word"))
    by_hash = sorted(hashed.collect(), key=lambda r: (r.h, r.id))[:k]
    assert sorted(r.id for r in first_k(hashed, hash_bin(F.col("h")), ["h", "id"], k).collect()) == sorted(r.id for r in by_hash)


def test_no_sort_with_limit_in_the_plan(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7 + 1).alias("n"))
    got = first_k(df, descending_count_bin(F.col("n")), [F.col("n").desc(), F.col("id").asc()], 100)
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert sorted(r.id for r in got.collect()) == [i for i in range(5000) if i % 7 == 6][:100]


def test_bins_never_fall_along_the_order(spark):
    counts = [1, 2, 3, 4, 5, 1000, 1001, 2**31, 2**40, 2**62]
    df = spark.createDataFrame([(c,) for c in counts], "n long")
    bins = [r[0] for r in df.orderBy("n").select(descending_count_bin(F.col("n"))).collect()]
    assert bins == sorted(bins, reverse=True)
