"""The corpus pipeline: stages that turn ``documents`` into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; the last returns packed token sequences' pieces.

1. ``toxicity``: documents that the classifier scores 0.5 or more go. It learns
   from ``labels`` of the training fold, by the texts of this stage's input.
2. ``line_dedup``: lines on more than a tenth of a source's distinct documents,
   and on two at least, go; sources of every size are judged.
3. ``simhash_dedup``: one document of each near-duplicate group stays.
4. ``decontamination``: spans shared with ``benchmark`` items go, and documents
   of which more than half the words are hit.
5. ``packing``: the rest is tokenised and packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.common import write_table
from tabsight.llm.decontaminate import remove_overlaps
from tabsight.llm.line_dedup import drop_site_lines
from tabsight.llm.packing import pack_documents
from tabsight.llm.quality import fold, labelled_sample
from tabsight.llm.simhash import drop_near_copies
from tabsight.llm.toxicity import drop_toxic, fit_toxicity
from tabsight.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0)
    return drop_toxic(docs, fit_toxicity(sample))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_site_lines(docs, F.col("source"), F.col("text"), ratio=0.1)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_overlaps(docs, read_table(spark, sf_dir, "benchmark"), n=10, min_words=10, max_coverage=0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity and SimHash linking have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
