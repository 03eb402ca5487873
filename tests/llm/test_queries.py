"""The registered queries over a whole small table, against brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

from tabsight.llm.licenses import PHRASES
from tabsight.llm.queries import TOKENIZER, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def test_op1(spark):
    texts, tok = docs(spark), Tokenizer.from_file(TOKENIZER)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries()["op1_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, t in texts.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    used = []
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
        used.append(sum(n for _, n in parts))
    assert max(used) <= 2048 and sum(used) >= 0.985 * 2048 * (len(used) - 1)


def test_op2(spark):
    got = {r.doc_id: r for r in queries()["op2_license_scan"](spark, SF).collect()}
    texts = docs(spark)
    assert set(got) == set(texts)
    for d, t in texts.items():
        w, places, labels = WORD.findall(lower(t)), [], set()
        for phrase, label in PHRASES:
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_op3(spark):
    texts = docs(spark)
    fp = {}
    for d, t in texts.items():
        w = lower(t).encode().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        bits = np.zeros(64, int)
        for s in shingles:
            bits += np.array([xxhash.xxh64_intdigest(s, 42) >> b & 1 for b in range(64)])
        fp[d] = sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))
    root = {d: d for d in fp}
    for a in sorted(fp):
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: (x if r == y else r) for d, r in root.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op3_simhash"](spark, SF).collect()}
    assert got == {d: (f"{fp[d]:016x}", root[d]) for d in fp}
