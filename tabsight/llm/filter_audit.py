"""Filter interaction audit: a Gray-code walk over the subsets of filters.

``audit_filters`` says what each of a few filters removes at every step of
every order of applying them, per part of a table. Documents are reduced to
counts per (part, failure mask), at most 2**k cells a part. For a part, the
subsets of filters are walked in Gray order: each step toggles one filter, adds
or takes one from the active-failure counter of every cell that fails it, and
moves cells whose counter leaves or reaches zero out of or into the running
survivors. The survivors of all 2**k subsets are kept; what a filter removes
after others is the difference of two of them.

``document_flags`` computes the five filters of the query with built-in
functions. Duplicates need no window and no join on the text: rows are counted
per (text hash, id, cell), the least id of each text comes from one aggregate
(both combine on the map side, so a text that a third of all rows share is one
row per task), and the counted rows are joined with these least ids on (hash,
id), where no key is hot.

Defined results: a null text is an empty one; a null part is the empty string;
a row without id is never a duplicate nor makes one (ids decide which copy is
first), and has no labels; repeated rows are counted each, and rows that share
the least id of a text are all first; a document with several label rows is
good, or toxic, if one of them says so; an empty table gives no rows; only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import write_table

#: Letters of the filters; bit i of a mask is filter i.
FILTERS = "ABCDE"
_SPACES = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"


# ---------------------------------------------------------------- the walk
def gray_walk(n_filters: int, masks: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: row S sums the ``amounts`` (one row
    per cell) of the cells that fail no filter of S."""
    cells = amounts.shape[0]
    failures = np.zeros(cells, dtype=np.int64)
    running = amounts.sum(axis=0)
    states = np.zeros((1 << n_filters, amounts.shape[1]), dtype=np.int64)
    states[0] = running
    subset = 0
    for step in range(1, 1 << n_filters):
        toggled = (step & -step).bit_length() - 1
        subset ^= 1 << toggled
        fails = (masks >> toggled) & 1 == 1
        if subset >> toggled & 1:
            running = running - amounts[fails & (failures == 0)].sum(axis=0)
            failures[fails] += 1
        else:
            failures[fails] -= 1
            running = running + amounts[fails & (failures == 0)].sum(axis=0)
        states[subset] = running
    return states


def order_steps(filters: str, states: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of every order and step, as differences of states
    with the columns (documents, good, toxic)."""
    k, every = len(filters), (1 << len(filters)) - 1
    bit = {f: 1 << i for i, f in enumerate(filters)}
    fails = {f: int(states[0, 0] - states[bit[f], 0]) for f in filters}
    unique = {f: int(states[every ^ bit[f], 0] - states[every, 0]) for f in filters}
    shapley = dict.fromkeys(filters, 0)
    for f in filters:
        for subset in range(every + 1):
            if not subset & bit[f]:
                size = subset.bit_count()
                shapley[f] += factorial(size) * factorial(k - 1 - size) * int(states[subset, 0] - states[subset | bit[f], 0])
    rows = []
    for order in permutations(filters):
        subset = 0
        for step, f in enumerate(order, 1):
            lost = states[subset] - states[subset | bit[f]]
            subset |= bit[f]
            removed, good, toxic = (int(x) for x in lost)
            rows.append(("".join(order), step, int(states[subset, 0]), removed, fails[f] - removed, unique[f], good, toxic, shapley[f]))
    return rows


_STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step per part, from ``cells`` with the columns ``part``,
    ``mask`` (bit i: fails ``filters[i]``), ``n``, ``n_good`` and ``n_toxic``.

    Cells of one part and mask are summed first, so that a group holds at most
    2**k rows.
    """

    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        amounts = cells[["n", "n_good", "n_toxic"]].to_numpy(dtype=np.int64)
        rows = order_steps(filters, gray_walk(len(filters), cells["mask"].to_numpy(dtype=np.int64), amounts))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _STEPS.split(", ")[1:]])
        out.insert(0, "part", cells["part"].iloc[0])
        return out

    summed = cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")))
    return summed.groupBy("part").applyInPandas(walk, _STEPS)


# ----------------------------------------------------------- the five filters
def document_flags(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Counts per part and failure mask: ``part, mask, n, n_good, n_toxic``.

    A: under 100 words; B: distinct words under 80 % of the words; C: A-Z over
    10 % of the characters; D: one of ``#$%&*|``; E: the text of a smaller id.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    trimmed = F.btrim("text", F.lit(_SPACES))
    words = source.select("*", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT)).alias("words"))
    n_words = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    rows = words.select(
        "id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("hash"),
        (
            F.when(n_words < 100, 1).otherwise(0)
            + F.when(100 * F.size(F.array_distinct("words")).cast("long") < 80 * n_words.cast("long"), 2).otherwise(0)
            + F.when(100 * capitals > 10 * F.length("text").cast("long"), 4).otherwise(0)
            + F.when(F.col("text").rlike("[#$%&*|]"), 8).otherwise(0)
        ).alias("mask"),
    )
    counted = write_table(rows.groupBy("id", "hash", "part", "mask").agg(F.count("*").alias("n")), "filter-rows")
    none = F.lit(False)
    unnamed = counted.where("id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    first = counted.where("id IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    named = (
        counted.where("id IS NOT NULL")
        .join(first, ["hash", "id"], "left")
        .join(known, "id", "left")
        .select("part", (F.col("mask") + F.when(F.col("first").isNull(), 16).otherwise(0)).alias("mask"), "n", "good", "toxic")
    )
    return (
        named.unionByName(unnamed)
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
        )
    )
