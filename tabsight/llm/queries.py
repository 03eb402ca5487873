"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tabsight.llm.common import write_table
from tabsight.llm.decontaminate import find_overlaps, hit_words
from tabsight.llm.embedding_dedup import near_vectors
from tabsight.llm.filter_audit import audit_filters, document_flags
from tabsight.llm.language import fit_languages, predict_languages
from tabsight.llm.licenses import scan_licenses
from tabsight.llm.line_dedup import BLOCK_TAGS, drop_site_lines, host_of, page_lines
from tabsight.llm.packing import pack_documents
from tabsight.llm.quality import fit_quality, fold, labelled_sample, score_quality
from tabsight.llm.simhash import near_groups
from tabsight.llm.spelling import planted_typos, variant_forms
from tabsight.llm.substring_dedup import remove_repeats
from tabsight.llm.token_counts import count_tokens
from tabsight.llm.toxicity import fit_toxicity, score_toxicity
from tabsight.sources.tables import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 5) != 0)
    scores = score_toxicity(docs, fit_toxicity(sample))
    return scores.select("doc_id", _held_out(5, 0), "score", _predicted())


def _held_out(parts: int, fold_no: int) -> Column:
    """Whether the id is in the held-out fold; false for a null id, which no label has."""
    return F.coalesce(fold(F.col("doc_id"), parts) == fold_no, F.lit(False)).alias("held_out")


def _predicted() -> Column:
    return (F.col("score") >= 0.5).cast("int").alias("predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text"))
    pages = write_table(pages, "page-text")  # the tags are taken out once
    kept = drop_site_lines(pages, F.col("host"), F.col("text"), out="kept")
    return kept.select(
        "page_id",
        "host",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.size(F.split("kept", "\n", -1)).cast("long").alias("n_kept"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id, html,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>', chr(10), 'g'),
           '(?s)<[^>]*>', '', 'g'),
           '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'),
           '^\n|\n$', '', 'g') AS text
  FROM pages),
u AS (SELECT DISTINCT host, text FROM p WHERE host IS NOT NULL AND text IS NOT NULL),
t AS (SELECT host, count(*) AS n_pages FROM u GROUP BY host),
l AS (SELECT DISTINCT host, text, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM u),
b AS (SELECT l.host, line FROM l JOIN t ON l.host = t.host WHERE line <> ''
      GROUP BY l.host, line, n_pages HAVING count(*) >= 2 AND count(*) / n_pages > 0.1),
x AS (SELECT page_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM p),
k AS (SELECT x.page_id, string_agg(x.line, chr(10) ORDER BY x.at) AS kept, count(*) AS n
      FROM x LEFT JOIN b ON b.host = x.host AND b.line = trim(x.line, ' ') WHERE b.line IS NULL GROUP BY x.page_id)
SELECT p.page_id, p.host, len(string_split(p.text, chr(10)))::BIGINT AS n_lines,
       coalesce(k.n, 1)::BIGINT AS n_kept, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM p LEFT JOIN k USING (page_id)
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("overlap.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        (F.size("overlap.spans") > 0).alias("contaminated"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_languages(docs, fold(F.col("doc_id"), 4) != 2, docs_per_lang=1500))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "langs")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), 3) != 1)
    scores = score_quality(docs, fit_quality(sample))
    return scores.select("doc_id", _held_out(3, 1), "score", _predicted())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), window=50, with_text=False)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(document_flags(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = planted_typos(read_table(spark, sf_dir, "documents"), least=7, every=31)
    return variant_forms(write_table(words.where("n >= 2"), "vocabulary"), ratio=10)


_WORDS = (
    "coalesce(regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(x="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS least FROM x GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f ON f.win = x.win WHERE doc_id > least),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u
      LEFT JOIN c ON c.doc_id = u.doc_id AND c.p = u.p WHERE c.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
#: The five filters per document, every order as a product of letters, and each step counted by its own sums over masks.
OP12_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
g AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
      FROM f LEFT JOIN g ON g.doc_id = f.doc_id GROUP BY part, mask),
l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM l a, l b, l c, l d, l e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before
      FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n_good ELSE 0 END) AS good_lost,
             sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op7_decontamination": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op12_filter_audit": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
