"""Text: line files, cleaning, vocabulary, sequences and TF-IDF.

Everything is JVM-side regex and array work except two Unicode
normalisations that Spark has no built-in for (NFKC in cleaning, NFKD
accent folding in TF-IDF); those run as Arrow-batched pandas UDFs.
Vocabularies are bounded by ``num_words`` / ``max_features`` and are the
only pieces that are broadcast.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabsight.errors import InputError
from tabsight.operators.selection import descending_count_bin, first_k
from tabsight.session import cut_lineage
from tabsight.sources.tabular import decoded, detect_encoding

# Fixed values.
NUM_WORDS = 10_000
MAX_LEN = 120
OOV_INDEX = 1
KERAS_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
TFIDF_MAX_FEATURES = 20_000
TFIDF_MIN_DF = 2
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = r"(?U)https?://\S+"
CONTROL_PATTERN = r"[\p{C}&&[^\t\n]]"
SPACE_PATTERN = r"(?U)\s+"
TRIM_PATTERN = r"(?U)^\s+|\s+$"


# ---- line files (S4-S6) ------------------------------------------------------------

def read_text_lines(spark: SparkSession, path: str, min_lines: int = 10) -> DataFrame:
    """Non-blank, stripped lines of text files in file order.

    Returns ``file, line_key, text``; ``line_key`` (file, block start, row id)
    orders lines without numbering them on one task.  Files that are not valid
    UTF-8 are read as ISO-8859-1.
    """
    encoding = detect_encoding(spark, path)
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_row"),
        F.regexp_replace(decoded(F.col("value"), encoding), TRIM_PATTERN, "").alias("text"),
    )
    lines = raw.where(F.length("text") > 0).select(
        "file", F.struct("file", "_blk", "_row").alias("line_key"), "text"
    )
    have = lines.limit(max(min_lines, 1)).count()
    if have == 0:
        raise InputError(f"'{path}' has no line with text.")
    if have < min_lines:
        raise InputError(f"'{path}' has {have} line(s) with text; {min_lines} are needed.")
    return lines


def parse_labelled_lines(lines: DataFrame, text_col: str = "text", order_col: str = "line_key") -> DataFrame | None:
    """``label<TAB>text`` or ``label,text`` lines → ``label, text`` rows.

    Returns None when the input is unlabelled: a line without separator comes
    before any valid labelled line.  Fewer than 2 valid rows or labels raise.
    """
    line = F.col(text_col)
    tab = F.instr(line, "\t")
    comma = F.instr(line, ",")
    pos = F.when(tab > 0, tab).when(comma > 0, comma).otherwise(F.lit(0))
    label = F.regexp_replace(line.substr(F.lit(1), F.greatest(F.col("_pos") - 1, F.lit(0))), TRIM_PATTERN, "")
    body = F.regexp_replace(line.substr(F.col("_pos") + 1, F.length(line) + 1), TRIM_PATTERN, "")
    parsed = lines.withColumn("_pos", pos).select(
        F.col(order_col).alias("_ord"),
        F.col("_pos"),
        label.alias("label"),
        body.alias("body"),
    )
    parsed = parsed.withColumn(
        "kind",
        F.when(F.col("_pos") == 0, F.lit("none"))
        .when((F.length("label") > 0) & (F.length("body") > 0), F.lit("valid"))
        .otherwise(F.lit("invalid")),
    )
    stats = parsed.agg(
        F.min(F.when(F.col("kind") == "none", F.col("_ord"))).alias("first_none"),
        F.min(F.when(F.col("kind") == "valid", F.col("_ord"))).alias("first_valid"),
        F.count(F.when(F.col("kind") == "valid", 1)).alias("n_valid"),
        F.count_distinct(F.when(F.col("kind") == "valid", F.col("label"))).alias("n_labels"),
    ).first()
    if stats["first_none"] is not None and (stats["first_valid"] is None or stats["first_none"] < stats["first_valid"]):
        return None
    if stats["n_valid"] == 0:
        raise InputError("No line has the form label, separator (tab or comma), text.")
    if stats["n_valid"] < 2:
        raise InputError("Only one labelled line; training needs two or more.")
    if stats["n_labels"] < 2:
        raise InputError("All labelled lines carry the same label; classification needs two or more.")
    return parsed.where(F.col("kind") == "valid").select(
        F.col("_ord").alias(order_col), "label", F.col("body").alias("text")
    )


def unlabelled_text(line: Column) -> Column:
    """Prediction input: the part after the first TAB, else the whole line, stripped."""
    tab = F.instr(line, "\t")
    return F.when(tab > 0, line.substr(tab + 1, F.length(line) + 1)).otherwise(line)


def read_unlabelled_lines(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Apply :func:`unlabelled_text`; an all-blank input raises."""
    out = lines.withColumn(text_col, F.regexp_replace(unlabelled_text(F.col(text_col)), TRIM_PATTERN, ""))
    if out.where(F.length(text_col) > 0).isEmpty():
        raise InputError("All lines are blank.")
    return out


# ---- cleaning (F7) -------------------------------------------------------------------

@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC normalisation (no Spark built-in)."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_text(text: Column, normalize: bool = True) -> Column:
    """NFKC, drop tags and URLs, drop control characters except TAB/LF,
    collapse whitespace, trim; null → "" (F7)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    if normalize:
        t = nfkc(t)
    t = F.regexp_replace(t, TAG_PATTERN, " ")
    t = F.regexp_replace(t, URL_PATTERN, " ")
    t = F.regexp_replace(t, CONTROL_PATTERN, "")
    t = F.regexp_replace(t, SPACE_PATTERN, " ")
    # every whitespace run is now one space, so trimming spaces is the full strip
    return F.trim(t)


def require_some_text(df: DataFrame, col_name: str) -> None:
    if df.where(F.length(col_name) > 0).isEmpty():
        raise InputError("Cleaning left no text in any row.")


# ---- vocabulary and sequences (F8-F10) ------------------------------------------------------

def keras_words(text: Column) -> Column:
    """Lower-case, punctuation → space, split on space, drop empty tokens."""
    filters = "[" + "".join("\\" + c if c in "\\[]^-" else c for c in KERAS_FILTERS) + "]"
    t = F.regexp_replace(F.lower(text), filters, " ")
    return F.array_remove(F.split(t, " "), "")


@dataclass
class Vocabulary:
    """``word, count, index`` for the ``num_words - 2`` most frequent words."""

    words: DataFrame
    num_words: int


POS_BITS = 24
#: Characters of text that one task turns into words or terms.
TASK_CHARS = 16_000_000


def text_partitions(df: DataFrame, text_col: str) -> int:
    """Tasks for the texts: the session's number, more where a task would get over ``TASK_CHARS`` characters.

    A text becomes several times its size in words and terms, so the number of
    tasks that suits the texts' bytes leaves each with more than it can hold.
    """
    chars = df.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB, where the session names no size of its own:
    10,000 long texts at once take hundreds of MB in every Python worker."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")


def _first_occurrence_key(df: DataFrame, text_col: str, order_cols: list[str]) -> Column:
    """Orderable key of (document order, position).

    One non-negative integral order column and documents shorter than 2^24
    characters (checked by one small aggregate over the documents, not the
    words) pack into a long; anything else uses a struct.
    """
    from pyspark.sql.types import IntegralType

    if len(order_cols) == 1 and isinstance(df.schema[order_cols[0]].dataType, IntegralType):
        o = F.col(order_cols[0])
        row = df.agg(F.min(o).alias("lo"), F.max(o).alias("hi"), F.max(F.length(text_col)).alias("len")).first()
        if row["lo"] is None or (row["lo"] >= 0 and row["hi"] < (1 << (63 - POS_BITS)) and (row["len"] or 0) < (1 << POS_BITS)):
            return o.cast("long") * F.lit(1 << POS_BITS) + F.col("pos")
    return F.struct(F.struct(*[F.col(c) for c in order_cols]), F.col("pos"))


def fit_vocabulary(df: DataFrame, text_col: str, order_cols: list[str], num_words: int = NUM_WORDS) -> Vocabulary:
    """Rank words by count, ties by first occurrence (document order, then position) (F8).

    Index = rank + 1 (1-based rank; index 1 is the OOV token).  Only indexes
    below ``num_words`` are ever emitted, so only those words are kept.
    """
    first = _first_occurrence_key(df, text_col, order_cols)
    tokens = df.select(*[F.col(c) for c in order_cols], F.posexplode(keras_words(F.col(text_col))).alias("pos", "word"))
    # a long key keeps the aggregate hash-based; a struct min would fall back to sorting
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("count"), F.min(first).alias("first"))
    counts = cut_lineage(counts, "word-counts")
    top = first_k(counts, descending_count_bin(F.col("count")), [F.col("count").desc(), F.col("first").asc()], max(num_words - 2, 0))
    w = Window.orderBy(F.col("count").desc(), F.col("first").asc())  # ≤ num_words rows
    words = top.select("word", "count", (F.row_number().over(w) + 1).alias("index"))
    return Vocabulary(words, num_words)


def texts_to_sequences(df: DataFrame, text_col: str, key_col: str, vocab: Vocabulary, out_col: str = "ids") -> DataFrame:
    """Word ids per document, OOV = 1.

    Tokens are exploded with their position, looked up in the broadcast
    vocabulary (≤ num_words rows), and gathered back per document; the
    partial aggregate already assembles each document on the map side.
    """
    # partition by document first: gathering ids back per document is then local
    # (a row id keeps texts that repeat a key apart)
    docs = df.select(F.col(key_col), F.monotonically_increasing_id().alias("_rid"), F.col(text_col))
    docs = docs.repartition(text_partitions(df, text_col), F.col(key_col))
    tok = docs.select(F.col(key_col), "_rid", F.posexplode_outer(keras_words(F.col(text_col))).alias("pos", "word"))
    lut = F.broadcast(vocab.words.select(F.col("word").alias("_w"), F.col("index").alias("_id")))
    ids = tok.join(lut, tok["word"] == lut["_w"], "left").select(
        key_col, "_rid", "pos", F.when(F.col("word").isNull(), F.lit(None)).otherwise(F.coalesce("_id", F.lit(OOV_INDEX))).alias("id")
    )
    seq = ids.groupBy(key_col, "_rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("_p")
    )
    return seq.select(key_col, F.transform("_p", lambda x: x["id"]).cast("array<int>").alias(out_col))


def pad_sequences(ids: Column, max_len: int = MAX_LEN) -> Column:
    """Keep the last ``max_len`` ids, left-pad with 0."""
    n = F.size(ids)
    kept = F.when(n > max_len, F.slice(ids, -max_len, max_len)).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(kept), F.lit(0))), kept)


# ---- TF-IDF (F11) -------------------------------------------------------------------

_COMBINING: dict | None = None


def _combining_table() -> dict:
    """``str.translate`` table deleting every combining code point (built once per worker)."""
    global _COMBINING
    if _COMBINING is None:
        _COMBINING = {cp: None for cp in range(0x110000) if unicodedata.combining(chr(cp))}
    return _COMBINING


@F.pandas_udf(StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Lower-case then NFKD and drop combining marks (no Spark built-in)."""
    table = _combining_table()

    def one(t):
        if t is None:
            return None
        low = t.lower()
        if low.isascii():
            return low
        return unicodedata.normalize("NFKD", low).translate(table)

    return s.map(one)


def tfidf_tokens(folded: Column) -> Column:
    """``[\\p{L}\\p{N}_]{2,}`` tokens of already folded text."""
    return F.regexp_extract_all(folded, F.lit(TOKEN_PATTERN), 0)


def with_bigrams(toks: Column) -> Column:
    """Tokens followed by the bigrams of consecutive tokens (``toks`` must be a column reference)."""
    m = F.greatest(F.size(toks) - 1, F.lit(1))
    # two equal-length slices: token i with token i+1, no padding to filter out
    pairs = F.zip_with(F.slice(toks, 1, m), F.slice(toks, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))
    bigrams = F.when(F.size(toks) >= 2, pairs).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


@dataclass
class TfidfModel:
    """``term, idx, df, idf`` for the kept terms; idx is alphabetical."""

    terms: DataFrame
    n_docs: int

    def transform(self, df: DataFrame, key_col: str, text_col: str, tf: DataFrame | None = None) -> DataFrame:
        """Long-form ``key, term, idx, tf, weight`` with L2-normalised weights.

        ``tf`` may pass precomputed :func:`term_counts` of ``df``.
        """
        docs = self._gathered(df, key_col, text_col, tf).select(key_col, "_norm", F.explode("_terms").alias("e"))
        return docs.select(key_col, "e.term", "e.idx", "e.tf", (F.col("e.w") / F.col("_norm")).alias("weight"))

    def _gathered(self, df: DataFrame, key_col: str, text_col: str, tf: DataFrame | None) -> DataFrame:
        """Per document its kept terms with tf and tf-idf, by index, and the norm of the latter.

        Counts are partitioned by document, so gathering them moves no rows.
        """
        tf = tf if tf is not None else term_counts(df, key_col, text_col)
        lut = F.broadcast(self.terms.select("term", "idx", "idf"))  # ≤ max_features rows
        w = tf.join(lut, "term", "left").withColumn("w", (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf"))
        terms = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "term", "tf", "w"))))
        docs = w.groupBy(key_col).agg(terms.alias("_terms"))
        norm = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda total, e: total + e["w"] * e["w"]))
        return docs.select(key_col, "_terms", norm.alias("_norm"))

    def vectors(self, df: DataFrame, key_col: str, text_col: str, tf: DataFrame | None = None) -> DataFrame:
        """``key, features`` as ML SparseVectors (documents without kept terms get an empty vector).

        ``tf`` may pass precomputed :func:`term_counts` of ``df``.
        """
        size = self._size()
        docs = self._gathered(df, key_col, text_col, tf)
        idx = F.transform("_terms", lambda e: e["idx"].cast("int"))
        vals = F.transform("_terms", lambda e: e["w"])
        # the norm is repeated as an array: inside a lambda it would be summed up anew for every value
        scaled = F.zip_with(vals, F.array_repeat(F.col("_norm"), F.size("_terms")), lambda v, n: v / n)
        return docs.select(key_col, sparse_vector(F.lit(size), idx, scaled).alias("features"))

    def _size(self) -> int:
        return int(self.terms.agg(F.count(F.lit(1))).first()[0])


def sparse_vector(size: Column, idx: Column, vals: Column) -> Column:
    """ML SparseVector from index/value arrays.

    Spark SQL has no constructor for the ML vector type; its JSON reader makes
    one from the type's fields (type 0 is sparse), without leaving the JVM.
    """
    from pyspark.ml.linalg import VectorUDT

    fields = F.struct(F.lit(0).cast("byte").alias("type"), size.cast("int").alias("size"), idx.alias("indices"), vals.alias("values"))
    read = F.from_json(F.to_json(F.struct(fields.alias("v"))), StructType([StructField("v", VectorUDT())]))
    return read["v"]


def term_counts(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``key, term, tf`` for every document; one without terms has a row with a null term."""
    _bound_batches(df.sparkSession)
    return _counted(_folded(df, key_col, text_col), key_col, text_partitions(df, text_col))


def _folded(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(key_col), fold_accents(F.col(text_col)).alias("_folded"))


def _counted(folded: DataFrame, key_col: str, parts: int) -> DataFrame:
    # Documents are hash-partitioned by key first: every later step is then
    # partition-local (neither the counts nor what is gathered from them shuffles
    # the exploded terms, which outnumber the raw text).  Nothing but built-in
    # functions may follow: Spark forgets the partitioning of what passed through
    # Python or a checkpoint.  The bigram lambda only reads the token column.
    docs = folded.repartition(parts, F.col(key_col))
    toks = docs.select(F.col(key_col), tfidf_tokens(F.col("_folded")).alias("_toks"))
    terms = toks.select(F.col(key_col), F.explode_outer(with_bigrams(F.col("_toks"))).alias("term"))
    return terms.groupBy(key_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(
    df: DataFrame,
    key_col: str,
    text_col: str,
    max_features: int = TFIDF_MAX_FEATURES,
    min_df: int = TFIDF_MIN_DF,
    tf: DataFrame | None = None,
) -> TfidfModel:
    """Vocabulary and smoothed idf like the reference's TF-IDF settings.

    Terms with df ≥ min_df, then the ``max_features`` most frequent over the
    corpus (ties alphabetical), indexed alphabetically; idf = ln((1+n)/(1+df)) + 1.
    """
    tf = tf if tf is not None else term_counts(df, key_col, text_col)
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key_col).alias("keys")).first()
    if rows["n"] != rows["keys"]:
        raise InputError(f"'{key_col}' must name every text once; {rows['n']} texts have {rows['keys']} keys.")
    n_docs = int(rows["n"])
    stats = tf.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    stats = cut_lineage(stats.where(F.col("df") >= min_df), "term-stats")
    kept = first_k(stats, descending_count_bin(F.col("cf")), [F.col("cf").desc(), F.col("term").asc()], max_features)
    w = Window.orderBy("term")  # ≤ max_features rows
    terms = kept.select(
        "term",
        (F.row_number().over(w) - 1).alias("idx"),
        "df",
        (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
    )
    return TfidfModel(terms, n_docs)


def fit_transform_tfidf(df: DataFrame, key_col: str, text_col: str, **kw) -> tuple[TfidfModel, DataFrame]:
    """Fit and transform the same documents, folded ONCE.

    The folded texts are written to the shared checkpoint folder (lineage cut,
    survives executor loss); the fit and the transform count their terms.
    """
    tf = checkpointed_term_counts(df, key_col, text_col)
    model = fit_tfidf(df, key_col, text_col, tf=tf, **kw)
    return model, model.transform(df, key_col, text_col, tf=tf)


def checkpointed_term_counts(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """:func:`term_counts` of texts that are folded once and written to the shared checkpoint folder (lineage cut).

    The texts are written, not their counts, which take several times their room.
    """
    _bound_batches(df.sparkSession)
    folded = cut_lineage(_folded(df, key_col, text_col), "folded-texts")
    return _counted(folded, key_col, text_partitions(folded, "_folded"))


def fit_transform_sequences(
    df: DataFrame, key_col: str, text_col: str, order_cols: list[str] | None = None,
    num_words: int = NUM_WORDS, max_len: int | None = None,
) -> tuple[Vocabulary, DataFrame]:
    """Clean once, fit the vocabulary and turn the same texts into id sequences.

    The cleaned text is checkpointed to the shared checkpoint folder so the
    Unicode normalisation runs once for both passes; ``max_len`` pads.
    """
    from tabsight.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    _bound_batches(df.sparkSession)
    cleaned = df.select(F.col(key_col), clean_text(F.col(text_col)).alias(text_col)).checkpoint(eager=True)
    vocab = fit_vocabulary(cleaned, text_col, order_cols or [key_col], num_words)
    seq = texts_to_sequences(cleaned, text_col, key_col, vocab)
    if max_len is not None:
        seq = seq.withColumn("ids", pad_sequences(F.col("ids"), max_len))
    return vocab, seq
