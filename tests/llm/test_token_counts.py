import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsight.errors import InputError
from tabsight.llm import token_counts as tc
from tabsight.llm.queries import TOKENIZER, WORD_TOKENIZER, queries
from tabsight.llm.token_counts import LengthTable, Summary, WordEncoder, count_texts, count_tokens, frequent_words, length_arrays, split_text

SF = "/root/testdata/sf0.001"


def library(texts):
    tok = Tokenizer.from_file(WORD_TOKENIZER)
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_equal_the_library_on_odd_texts():
    rnd = random.Random(3)
    parts = [*"abstmdrevl '''''  \n\t 12.,;!?-_ÉéßÀ×÷½²ªº´µ\x85\xa0€…’“　日本ΑΣσίİŸſ́é😀\x1c\x00<|>", "<|endoftext|>", "'re", "'ll", "don't", " the "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(6000)]
    texts += ["", None, "'", "'s", "a'", "'r", "'re", " ", "<|startoftext|><|endoftext|>", "x" * 40, "é" * 15, "é" * 16]
    encoder = WordEncoder(WORD_TOKENIZER)
    for words in ([], ["the", "a", "'s", "it", "1", "日本", "x" * 40, "é" * 16]):
        table = LengthTable(*length_arrays(words, encoder))
        assert count_texts(texts, encoder, table).tolist() == library(texts)


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("ab 'c1.é") for _ in range(30_000))
    whole = "ab1é'" * 4000
    want = library([text, whole, "x " + whole])
    monkeypatch.setattr(tc, "_PIECE", 1000)
    encoder = WordEncoder(WORD_TOKENIZER)
    assert count_texts([text, whole, "x " + whole], encoder, LengthTable(*length_arrays(["a"], encoder))).tolist() == want


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tc, "_CACHE_ROWS", 10)
    encoder = WordEncoder(WORD_TOKENIZER)
    rnd = random.Random(5)
    for _ in range(20):
        words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 3))) for _ in range(30)]
        words = list(dict.fromkeys(words))
        assert encoder.lengths(words) == library(words)
    assert len(encoder.new) <= 10 + 30


def test_length_table():
    words = [f"w{i}" for i in range(3000)] + ["日" * i for i in range(1, 40)]
    k1, k2, n = length_arrays(words, WordEncoder(WORD_TOKENIZER))
    table = LengthTable(k1, k2, n)
    assert np.array_equal(table.find(k1, k2), n) and (table.find(k1, k2 + np.uint64(1 << 57)) == -1).all()
    assert (LengthTable(*length_arrays([], WordEncoder(WORD_TOKENIZER))).find(k1, k2) == -1).all()


def test_split_gives_the_pretokens():
    low, starts, ends, whole = split_text("It'S 12 don't ''s x日y!")
    text = low.tobytes().decode("utf-32-le")
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == ["it", "'s", "1", "2", "don", "'t", "''", "s", "x日y!"]
    assert whole.tolist() == [False] * 8 + [True]


def test_summary_keeps_the_frequent():
    rnd = random.Random(6)
    words = ["common"] * 3000 + ["日本"] * 2000 + ["averylongwordofmanycharacters"] * 1500 + ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(5000)]
    rnd.shuffle(words)
    summary = Summary(most=9)
    for at in range(0, len(words), 97):
        summary.add(" ".join(words[at : at + 97]))
    got = summary.counts()
    assert {"common", "日本", "averylongwordofmanycharacters"} <= set(got) and len(got) <= 9 and all(got[w] <= n for w, n in (("common", 3000), ("日本", 2000)))


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op11_token_counts"](spark, SF).collect()}
    want = dict(zip(texts, library(texts.values()), strict=True))
    assert {d: r.n_tokens for d, r in got.items()} == want
    assert all(r.n_bytes == len(texts[d].encode()) and r.over_limit == (want[d] > 2048) for d, r in got.items())


def test_table_size_changes_no_count(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 6), (None, "it's 2 <|endoftext|>", 7), (3, "w " * 300_000, 8)], "doc_id long, text string, n_tokens long").repartition(4)
    for rows in (1, 16_384):
        got = count_tokens(docs, WORD_TOKENIZER, table_rows=rows, fan_in=2).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == [(0, 20, 4), (1, 0, 0), (2, 0, 0), (2, 3, 2), (3, 600_000, 300_000)]
    named = count_tokens(docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("n_bytes")), WORD_TOKENIZER, "key", "n_bytes")
    assert named.columns == ["key", "n_bytes", "n_tokens"] and named.count() == 5
    assert count_tokens(docs.limit(0), WORD_TOKENIZER).collect() == []
    assert frequent_words(docs, WORD_TOKENIZER, most=1) == ["w"]


def test_other_tokenizers_are_refused():
    with pytest.raises(InputError):
        WordEncoder(TOKENIZER)
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_TOKENIZER
