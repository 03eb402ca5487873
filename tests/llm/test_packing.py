import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsight.llm.packing import Encoder, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "Hello  world\n\n x", "tab\t\tnew \n line", "ñandú ûber 漢字 🙂", "<|endoftext|> and <|endoftext|>",
    "x" * 5000, "it's we'll I'D 12345 !!??", "  lead", "trail  ", " nbsp em", "a\x00b\x1cc",
]


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_gives_the_file_ids():
    tok, enc = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in ODD:
        assert enc(text).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("partitions", "windows", "merge"), [(1, 2, 50_000), (7, 3, 5), (4, 64, 50_000)])
def test_round_trip(spark, partitions, windows, merge):
    rng = np.random.default_rng(1)
    texts = [*ODD, None, None, *(" ".join(["word"] * int(n)) for n in rng.integers(1, 300, 60)), "long text " * 900]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(partitions)
    got = pack_documents(df, PATH, max_tokens=128, open_windows=windows, slack=8, merge_pieces=merge).collect()
    tok = Tokenizer.from_file(PATH)
    pieces, sequences = {}, {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = sorted(str((d, ids_of(tok, t))) for d, t, _ in rows)
    have = []
    for (d, total), parts in pieces.items():
        flat = sum((ids for _, ids in sorted(parts, key=lambda x: x[0])), [])
        assert len(flat) % total == 0
        if len(flat) == total:
            have.append(str((d, flat)))
            assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(len(i) for _, i in sorted(parts))])[:-1])
    assert set(have) <= set(want) and len(have) >= len(want) - 2
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
        short += at < 128 - 8
    assert short <= 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(df, PATH).count() == 0
