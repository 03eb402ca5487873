import random
import re
import zlib
from collections import Counter

import numpy as np

from tabsight.llm import spelling
from tabsight.llm.queries import queries
from tabsight.llm.spelling import BlockedBloom, edit_hits, near_words, planted_typos, variant_forms, word_hashes

SF = "/root/testdata/sf0.001"


def typos(rows, least=7, every=31):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def neighbours(words):
    """Near words through shared wildcard patterns: replaced at a place, or with one character less."""
    near = {w: set() for w in words}
    patterns = {}
    for w in words:
        for i in range(len(w)):
            patterns.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in patterns.values():
        for w in group:
            near[w] |= group - {w}
    return near


def forms(counts, ratio=10):
    near = neighbours(counts)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(queries()["op13_spelling_variants"](spark, SF))
    want = forms({w: n for w, n in typos(rows).items() if n >= 2})
    assert got == want and any(r[0] for r in want.values())


def random_vocabulary(seed, letters, sizes, n):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))) for _ in range(n)}
    return {w: rnd.choice([1, 2, 3, 20, 25, 200, 2500, 30_000]) for w in words}


def test_forms_and_roots_of_dense_vocabularies(spark):
    for seed, letters, sizes in ((1, "ab", [1, 2, 3, 4, 5]), (2, "abcé×", [3, 4]), (3, "ab", [62, 63, 64, 65, 66])):
        counts = random_vocabulary(seed, letters, sizes, 300)
        if seed == 3:  # long words and all their deletions and some replacements
            for w in list(counts)[:40]:
                counts[w[1:]], counts[w[:5] + "b" + w[6:]], counts[w + "a"] = 5, 7, 500
        table = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert rows_of(variant_forms(table)) == forms(counts)


def test_rounds_and_slices_change_nothing(spark, monkeypatch):
    counts = random_vocabulary(4, "abcd", [5, 6], 2000)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {frozenset((w, o)) for w, others in neighbours(counts).items() for o in others}
    for size in (64, 1 << 10):  # 64 bytes: many slices of one block and as many rounds
        monkeypatch.setattr(spelling, "_SEGMENT", 2)
        some = {w: counts[w] for w in sorted(counts)[: 150 if size == 64 else None]}
        got = near_words(spark.createDataFrame(list(some.items()), "word string, n long"), filter_bytes=size).collect()
        pairs = [frozenset((r.word, r.other)) for r in got]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {p for p in want if p <= set(some)}
    assert table.count() == len(counts)


def test_edits_come_once_and_reach_every_neighbour():
    letters = np.array([ord(c) for c in "abc"], dtype=np.uint32)
    codes = np.array([[ord(c) for c in w] for w in ("aab", "cba")], dtype=np.uint32)
    every = lambda h: np.arange(len(h))
    got = [(r, p, x) for r, p, x in edit_hits(codes, letters, every, every)]
    text = [("aab", "cba")[r][:p] + (chr(x) if x >= 0 else "") + ("aab", "cba")[r][p + 1 :] for r, p, x in got]
    assert sorted(text) == sorted(["ab", "aa", "bab", "cab", "abb", "acb", "aac", "ba", "ca", "cb", "cca", "cbb", "cbc"])
    # the hash of an edit is the hash of its word
    seen = []
    list(edit_hits(codes, letters, lambda h: seen.append(h) or np.arange(0), lambda h: seen.append(h) or np.arange(0)))
    words = {h for w in text for h in word_hashes(np.array([[ord(c) for c in w]], dtype=np.uint32)).tolist()}
    assert {h for part in seen for h in part.tolist()} == words


def test_bloom_has_its_words_and_few_others():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    blocks = 20_000 * 16 // 512
    order = np.argsort(BlockedBloom.block_of(h, np.uint64(blocks)))
    half = int(np.searchsorted(BlockedBloom.block_of(h[order], np.uint64(blocks)), 300))
    words = np.concatenate((BlockedBloom.build(h[order][:half], 0, 300, blocks, 6), BlockedBloom.build(h[order][half:], 300, blocks - 300, blocks, 6)))
    bloom = BlockedBloom(words, 6)
    assert np.array_equal(bloom.has(h), np.arange(len(h)))
    other = rnd.integers(0, 2**63, 200_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert len(bloom.has(other)) < 0.006 * len(other)


def test_odd_rows(spark):
    huge = "a" * 100_000
    rows = [(1, None), (2, ""), (None, "Wonderful wonderful WONDERFUL"), (3, "ÀÉabcdef àéabcdef ×÷×÷×÷×"), (3, "short wonderfull"), (4, f"{huge} {huge}"), (4, "wonderfull-wonderful_x9wonderful")]
    rows += [(i, "wonderful wunderful") for i in range(100, 140)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, run string, crc int")
    counts = typos(rows)
    words = planted_typos(docs)
    assert {r.word: r.n for r in words.collect()} == counts
    kept = words.where("n >= 2").cache()
    assert rows_of(variant_forms(kept)) == forms({w: n for w, n in counts.items() if n >= 2})
    assert variant_forms(words.limit(0)).collect() == [] and planted_typos(docs.limit(0)).collect() == []
