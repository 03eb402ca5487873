import math
import tracemalloc

import numpy as np
import pandas as pd

from tabsight.llm import embedding_dedup
from tabsight.llm.components import local_roots
from tabsight.llm.embedding_dedup import _build, _find, audit_recall, audit_shares, exact_links, find_links, near_vectors, vector_classes
from tabsight.llm.queries import queries
from tabsight.llm.vector_graph import entry_points, hit_components, medoid, range_search, robust_prune, with_reverse

SF = "/root/testdata/sf0.01"


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def brute(rows, t=0.98):
    """n_links and component of every usable row (ids are distinct)."""
    ok = {}
    for v, e, label in rows:
        if v is not None and label is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e):
            x = np.array(e) / np.abs(e).max()
            ok[v] = (label, x / np.linalg.norm(x))
    links = {v: {u for u in ok if u != v and ok[u][0] == ok[v][0] and len(ok[u][1]) == len(ok[v][1]) and ok[u][1] @ ok[v][1] >= t} for v in ok}
    comp = {}
    for v in sorted(ok):
        if v not in comp:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = v
                    todo += links[x]
    return {v: (len(links[v]), comp[v]) for v in ok}


def table():
    rng = np.random.default_rng(7)
    rows, v = [], 0
    for label in range(3):
        base = unit(rng, 150, 16)
        for x in base:
            for _ in range(rng.choice([1, 1, 1, 2, 6])):
                y = x + rng.normal(size=16) * rng.choice([0.0, 0.01, 0.04])
                rows.append((v, [float(c) for c in y * rng.choice([1.0, 5.0])], label))
                v += 1
    same = [float(c) for c in unit(rng, 1, 16)[0]]
    rows += [(v + i, same, 1) for i in range(60)]
    rows += [(9000, None, 1), (9001, same, None), (9002, [0.0] * 16, 1), (9003, [float("nan")] + same[1:], 1), (9004, same[:8], 1), (9005, [None, *same[1:]], 1), (9006, [], 1), (9007, [float("inf")] * 16, 1), (9008, [1e300] * 16, 2), (9009, [1e-300] * 16, 2)]
    return rows


def test_matches_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(5)
    want = brute(rows)
    for options in ({}, {"shard_rows": 40, "shard_limit": 50}):
        got = {r.vec_id: r for r in near_vectors(df, **options).collect()}
        assert len(got) == len(rows)
        exact = sum(n for n, _ in want.values())
        found = sum(min(got[v].n_links, n) for v, (n, _) in want.items())
        assert found >= 0.95 * exact and all(got[v].n_links <= n for v, (n, _) in want.items())
        assert np.mean([got[v].component_id == c for v, (_, c) in want.items()]) >= 0.97
        for v, r in got.items():
            assert r.kept == (v == r.component_id) and (v in want or (r.n_links, r.component_id) == (0, v))
        if not options:
            assert found == exact and all(got[v].component_id == c for v, (_, c) in want.items())


def test_repeated_rows_and_empty(spark):
    e, f = [1.0, 0.0], [0.99, 0.01]
    rows = [(1, e, 0), (1, e, 0), (2, f, 0), (None, e, 0), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in near_vectors(df).collect())
    assert got == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (3, 0, 3, True)]))
    assert near_vectors(df.where("false")).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(3)
    base = unit(rng, 1500, 24)
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 24)) * 0.02])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    lists = robust_prune(x, 64, 24, 1.2)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1]
    assert (lists[:, 0] == near).mean() > 0.99  # the nearest is always taken
    own = with_reverse(lists, 24)
    table = np.full((len(x), max(map(len, own))), -1)
    for i, o in enumerate(own):
        table[i, : len(o)] = o
    a, b = range_search(x, table, x, medoid(x), 0.04, 48)
    exact = np.argwhere(2 - 2 * (x @ x.T) <= 0.04)
    have = set(zip(a.tolist(), b.tolist(), strict=True))
    assert np.mean([tuple(p) in have for p in exact.tolist()]) > 0.95


def test_audit_and_query(spark):
    df = spark.createDataFrame(table(), "vec_id long, embedding array<double>, label int")
    _, classes = vector_classes(df, "vec_id", "embedding", "label")
    found = find_links(classes, 0.98)
    assert audit_recall(classes, found, 0.98) >= 0.9 and audit_recall(classes, found.where("false"), 0.98) < 0.5
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    got = {r.vec_id: r for r in queries()["op6_embedding_dedup"](spark, SF).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_shards_of_near_copies_alone():
    rng = np.random.default_rng(11)
    for groups, size in ((10, 100), (5, 200), (2, 2000), (60, 90)):
        x = np.repeat(unit(rng, groups, 32), size, axis=0) + rng.normal(size=(groups * size, 32)) * 0.004
        x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        own = with_reverse(robust_prune(x, 64, 24, 1.2), 24)
        table = np.full((len(x), max(map(len, own))), -1)
        for i, o in enumerate(own):
            table[i, : len(o)] = o
        starts = entry_points(table, medoid(x))
        a, b = range_search(x, table, x, starts, 0.04, 48)
        exact = (np.maximum(2 - 2 * (x @ x.T), 0) <= 0.04).sum(axis=1)
        have = np.bincount(a, minlength=len(x))
        assert (have <= exact + 1).all() and (have / exact).min() > 0.95
        assert len(np.unique(a * np.int64(len(x)) + b)) == len(a)


def test_exact_search_answers(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = np.concatenate((np.repeat(unit(rng, 4, 16), 40, axis=0) + rng.normal(size=(160, 16)) * 0.004, unit(rng, 200, 16)))
    rows = [(i, [float(c) for c in v], int(i % 7 == 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    monkeypatch.setattr(embedding_dedup, "range_hits", None)  # only the exact search can answer
    for options in ({}, {"shard_rows": 20, "shard_limit": 15}):  # many cells, each in many parts
        got = near_vectors(df, tries=0, **options).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_low_recall_and_rare_links_are_searched_exactly(spark, monkeypatch):
    rng = np.random.default_rng(19)
    x = unit(rng, 900, 16)
    x[77] = x[500] + 0.001
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    _, classes = vector_classes(df, "vec_id", "embedding", "label")
    found = find_links(classes, 0.98)
    assert audit_shares(classes, found.where("false"), 0.98, queries=4, most=4) is None  # no link drawn: not measured
    assert audit_shares(classes, found.where("false"), 0.98, queries=4) == (0.0, 0.0)  # drawn on until the one pair is seen
    assert audit_shares(classes, found, 0.98, queries=4) == (1.0, 1.0)
    for shares in ((0.2, 0.9), None):
        monkeypatch.setattr(embedding_dedup, "audit_shares", lambda *a, s=shares: s)
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, tries=1).collect()}
        assert got[77] == got[500] == (1, 77) and sum(n for n, _ in got.values()) == 2


def test_a_group_of_near_copies_needs_bounded_memory():
    rng = np.random.default_rng(23)
    n = 4000
    x = np.repeat(unit(rng, 1, 64), n, axis=0) + rng.normal(size=(n, 64)) * 0.004
    pdf = pd.DataFrame({"node": np.arange(n), "size": 1, "vector": list(x), "shards": [["s"]] * n, "shard": "s", "indexed": True, "query": True})
    lists = _build(64, 24, 1.2)(pdf[["node", "vector"]])
    pdf = pdf.merge(lists, on="node")
    tracemalloc.start()
    got = _find(0.98, 48, False)(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit_x = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit_x @ unit_x.T >= 0.98).sum(axis=1) - 1
    assert (got["links"].to_numpy() <= want).all() and got["links"].sum() > 0.95 * want.sum()
    assert (got["other"] == 0).all() and peak < 300e6  # every pair gathered in double precision would be 16 GB


def test_components_of_a_table():
    rng = np.random.default_rng(29)
    for n_a, n_h, same in ((40, 40, True), (30, 50, False), (5, 0, False)):
        hit = rng.random((n_a, n_h)) < 0.02
        asked, held = np.arange(n_a), np.arange(n_h) if same else n_a + np.arange(n_h)
        if same:
            hit |= hit.T
        n = n_a if same else n_a + n_h
        a, b = np.nonzero(hit)
        assert np.array_equal(hit_components(hit, asked, held, n), local_roots(n, asked[a], held[b]))


def test_recall_per_class(spark):
    rng = np.random.default_rng(17)
    x = np.concatenate([np.repeat(unit(rng, 1, 16), 60, axis=0), np.repeat(unit(rng, 20, 16), 2, axis=0)])
    df = spark.createDataFrame([(i, [float(c) for c in y], 0) for i, y in enumerate(x + rng.normal(size=x.shape) * 0.004)], "vec_id long, embedding array<double>, label int")
    _, classes = vector_classes(df, "vec_id", "embedding", "label")
    found = exact_links(classes, 0.98)
    assert audit_shares(classes, found, 0.98) == (1.0, 1.0)
    link, per_class = audit_shares(classes, found.where("node < 60"), 0.98)  # the 20 pairs are missed
    assert link > 0.95 and abs(per_class - 0.6) < 0.01
