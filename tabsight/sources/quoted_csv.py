"""CSV records with line breaks inside quoted fields, read by many tasks.

Whether a line begins inside a quoted field depends on all lines before it, but
only through one of two states. Every file block is read twice:

1. For both states it may begin in, a block tells the state it ends in and the
   record that is open then: one row per block. A fold over each file's blocks
   gives every block its real first state and the open record it goes on with.
2. Lines that are records of their own pass on as they are; only the lines of
   records with line breaks are shuffled, by record, and joined in order.

Lines without a quote never change the state, so Python looks at lines with
quotes only. The driver holds one row per block that begins inside a field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.session import cut_lineage

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
_COMPLETE = re.compile(f"{_FIELD}(?:,{_FIELD})*+")
_CLOSING = re.compile(r'(?:[^"]++|"")*+"[^,]*+')


def line_ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line. A quote opens a field only
    at its beginning; a doubled quote is a character of the field."""
    if inside:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        if closing.end() == len(line):
            return False
        line = line[closing.end() + 1 :]
    return _COMPLETE.fullmatch(line) is None


def _lines(spark: SparkSession, path: str, decode) -> DataFrame:
    """Every line with its file and block, in file order within a partition."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace(decode(F.col("value")), "\r$", "")
    raw = decode(F.col("value"))
    return text.select(value.alias("value"), raw.alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """Parts of the batches that lie in one block, and whether the block begins there."""
    last = None
    for b in batches:
        files, blocks = b.column("file"), b.column("block").to_numpy()
        codes = files.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if hi > lo:
                key = (files[lo].as_py(), int(blocks[lo]))
                yield key, key != last, b.slice(lo, hi - lo)
                last = key


def _walk(values: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """For each line whether it begins inside a field, and the state after the last."""
    begins = np.empty(len(values), dtype=bool)
    at = 0
    for i in np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist():
        begins[at : i + 1] = inside
        at, inside = i + 1, line_ends_inside(values[i].as_py(), inside)
    begins[at:] = inside
    return begins, inside


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and first state: the state at its end and its number of record starts."""
    out: dict[tuple[str, int], list] = {}
    for key, _, part in _runs(batches):
        state = out.setdefault(key, [False, 0, True, 0])
        for k in (0, 2):
            begins, state[k] = _walk(part.column("value"), state[k])
            state[k + 1] += int((~begins).sum())
    names = ["file", "block", "end0", "starts0", "end1", "starts1"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, *v), strict=True)) for k, v in out.items()],
                                     schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("end0", pa.bool_()), ("starts0", pa.int64()), ("end1", pa.bool_()), ("starts1", pa.int64())]))


def _first_states(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one file that begin inside a field, with the open record
    (the block and place it started at); a last row tells if the file ends inside."""
    rows, inside, record = [], False, (0, 0)
    for b in blocks.sort_values("block").itertuples():
        if inside:
            rows.append((b.file, b.block, record[0], record[1], False))
        starts = b.starts1 if inside else b.starts0
        inside = b.end1 if inside else b.end0
        if starts:
            record = (b.block, starts)
    if inside:
        rows.append((blocks["file"].iloc[0], -1, record[0], record[1], True))
    return pd.DataFrame(rows, columns=["file", "block", "of_block", "of_record", "open_end"])


def read_records(spark: SparkSession, path: str, decode=lambda value: value) -> DataFrame:
    """``value, header``: one row per CSV record, and whether it is the first of
    its file. A file that ends inside a quoted field is an error."""
    lines = _lines(spark, path, decode)
    ends = lines.select("value", "file", "block").mapInArrow(_block_ends, "file string, block long, end0 boolean, starts0 long, end1 boolean, starts1 long")
    inside = ends.groupBy("file").applyInPandas(_first_states, "file string, block long, of_block long, of_record long, open_end boolean").collect()
    broken = [r["file"] for r in inside if r["open_end"]]
    if broken:
        raise InputError(f"CSV '{broken[0]}' ends inside a quoted field.")
    open_records = {(r["file"], r["block"]): (r["of_block"], r["of_record"]) for r in inside}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, record, place = False, (0, 0), 0
        for key, first, part in _runs(batches):
            if first:
                record = open_records.get(key, (key[1], 0))
                state, place = key in open_records, 0
            values = part.column("value")
            begins, after = _walk(values, state)
            ends_inside = np.append(begins[1:], after)
            started = (~begins).cumsum()
            own = started > 0  # the record started in this part of the block
            base = record[1] if record[0] == key[1] else 0
            of_block = np.where(own, key[1], record[0])
            of_record = np.where(own, base + started, record[1])
            alone = ~begins & ~ends_inside
            text = pc.if_else(pa.array(alone), values, part.column("raw"))
            yield pa.RecordBatch.from_pydict({
                "value": text, "file": part.column("file"), "block": part.column("block"), "place": pa.array(np.arange(place, place + len(values))),
                "of_block": pa.array(of_block), "of_record": pa.array(of_record), "alone": pa.array(alone),
            })
            state, place = after, place + len(values)
            if own.any():
                record = (key[1], base + int(started[-1]))

    numbered = lines.mapInArrow(number, "value string, file string, block long, place long, of_block long, of_record long, alone boolean")
    numbered = cut_lineage(numbered, "csv-lines")
    first = (F.col("of_block") == 0) & (F.col("of_record") == 1)
    alone = numbered.where("alone").select("value", first.alias("header"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"])
    joined = numbered.where("NOT alone").groupBy("file", "of_block", "of_record").agg(parts.alias("parts"))
    whole = F.regexp_replace(F.array_join("parts", "\n"), "\r$", "")
    return alone.unionByName(joined.select(whole.alias("value"), first.alias("header")))


def parse_records(records: DataFrame, schema: str, options: dict[str, str]) -> DataFrame:
    """The fields of every record but headers and blank lines."""
    rows = records.where(~F.col("header") & (F.col("value") != ""))
    return rows.select(F.from_csv("value", schema, options).alias("r")).select("r.*")


def quoted_breaks(value: Column) -> Column:
    """Whether a line may begin or end a field with a line break: an odd number of quotes."""
    return (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
