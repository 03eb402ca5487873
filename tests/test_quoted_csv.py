import csv
import random

import pytest

from tabsight.errors import InputError
from tabsight.sources.quoted_csv import line_ends_inside, read_records
from tabsight.sources.tabular import read_csv


def test_states_of_lines():
    for line, after_out, after_in in [
        ("a,b", False, True), ('"a,b', True, False), ('"a""b', True, False), ('"a""b",c', False, False), ('5" pipe,x', False, False),
        ('x"', False, False), ('",y,"', False, True), ('""', False, True), ("", False, True), ('a,""",', True, False), ('"",""', False, True),
    ]:
        assert (line_ends_inside(line, False), line_ends_inside(line, True)) == (after_out, after_in), line


@pytest.fixture
def small_blocks(spark):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
    spark.conf.set("spark.sql.files.openCostInBytes", keep[1])


def test_records_equal_the_csv_module(spark, tmp_path, small_blocks):
    rnd = random.Random(1)
    want, folder = [], tmp_path / "many.csv"
    folder.mkdir()
    for f in range(3):
        with open(folder / f"p{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n")
            w.writerow(["id", 'te`xt"', "n"])
            for i in range(60):
                text = "".join(rnd.choice(["a", "é", '"', ",", "\n", "\n\n", "x y", ";", "\r\n"]) for _ in range(rnd.choice([0, 1, 3, 8, 80 if f else 400])))
                want.append((f"{f}-{i}", text, i))
                w.writerow([f"{f}-{i}", text, str(i)])
    records = read_records(spark, str(folder))
    assert records.count() == 183 and records.where("header").count() == 3
    df = read_csv(spark, str(folder))
    assert df.columns == ["id", 'te`xt"', "n"] and df.dtypes[2][1] == "bigint"
    assert spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions() > 60
    got = sorted(map(tuple, df.collect()))
    assert got == sorted((a, b or None, n) for a, b, n in want)  # empty texts are null


def test_stray_quotes_and_open_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('size,note\n5" pipe,plain\n"6""",",x\ny"\n7,"z"\n')
    got = sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv")).collect()))
    assert got == sorted([('5" pipe', "plain"), ('6"', ",x\ny"), ("7", "z")])
    (tmp_path / "b.csv").write_text('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(InputError, match="inside a quoted field"):
        read_csv(spark, str(tmp_path / "b.csv"))
