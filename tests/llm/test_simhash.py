import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tabsight.llm.components import connected_components
from tabsight.llm.simhash import drop_near_copies, link_fingerprints, near_groups, search_group, simhash


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def slow_simhash(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


TEXTS = ["", None, " \t\n", "one", "One  two", "a b c", "É b\x0bc d\x85 e f", "rep rep rep rep", *(f"common words here and word {i} of the text " * 12 for i in range(20)), "w " * 50_000, "end"]


def test_fingerprint_matches_definition(spark):
    for t in TEXTS:
        assert simhash((t or "").encode()) == slow_simhash(t or "")
    # the same hash as the engine's own
    got = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components(spark):
    r = random.Random(5)
    for n, m in ((30, 20), (200, 190), (3, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(1000, 1060)] if m == 20 else [])
        df = spark.createDataFrame(links, "a long, b long")
        got = {x.node: x.root for x in connected_components(df).collect()}
        real = [(a, b) for a, b in links if a != b]
        assert got == roots_of({x for e in real for x in e}, real)


def test_group_search_is_exact():
    rng = np.random.default_rng(2)
    for n in (1, 17, 300, 900):
        base = rng.integers(0, 2**63, 12, dtype=np.uint64)
        codes = np.unique(np.array([base[rng.integers(12)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) for _ in range(n)]))
        rng.shuffle(codes)
        a, b = search_group(codes, 3, at_once=2048)
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
        x, y = np.nonzero(np.tril(near, -1))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))


def test_links_match_brute_force_with_divided_groups(spark):
    rng = np.random.default_rng(4)
    codes = [0, 1, 2**63, 2**64 - 1]
    for _ in range(12):
        c = int(rng.integers(0, 2**63))
        for _ in range(25):
            c ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5)))
            codes.append(c)
    codes = sorted(set(codes))
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    links = [(a, b) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= 3]
    want = roots_of(codes, links)
    for rows in (8192, 3):
        found = [(r.a % 2**64, r.b % 2**64) for r in link_fingerprints(df, 3, rows).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in found) and roots_of(codes, found) == want


def test_query_and_pipeline_form(spark):
    rows = [(i + 5, t, "x", 0) for i, t in enumerate(TEXTS)] + [(5, "", "x", 0), (None, "end", "x", 0), (None, "alone here", "x", 0), (None, "alone there too", "x", 0), (400, TEXTS[9], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long").repartition(5)
    fp = [slow_simhash(t or "") for _, t, *_ in rows]
    links = [(a, b) for i, a in enumerate(fp) for b in fp[:i] if (a ^ b).bit_count() <= 3]
    root = roots_of(set(fp), links)
    first = {}
    for (d, *_), f in zip(rows, fp, strict=True):
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    got = sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in near_groups(df).collect())
    assert got == sorted(str((d, f, first.get(root[f]))) for (d, *_), f in zip(rows, fp, strict=True))
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in [*first.values(), None, None])
    assert near_groups(df.where(F.lit(False))).count() == 0 and drop_near_copies(df.where("false")).count() == 0
