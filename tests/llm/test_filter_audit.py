from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tabsight.llm.filter_audit import audit_filters, document_flags, gray_walk
from tabsight.llm.queries import SQL, queries

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out = [""]
    for c in text:
        if c in WHITE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute_force(docs, labels):
    """Every order applied one filter after the other to lists of documents."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    parts = defaultdict(list)
    for d, t, p in docs:
        t = t or ""
        w = words_of(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and d > least[t],
        }
        parts[p or ""].append((d, fails))
    out = {}
    for p, rows in parts.items():
        removed_by, unique = Counter(), Counter()
        for _, fails in rows:
            failed = [f for f in "ABCDE" if fails[f]]
            if len(failed) == 1:
                unique[failed[0]] += 1
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[p, "".join(order), step] = [len(left), len(lost), sum(r[1][f] for r in gone), f, sum(r[0] in good for r in lost), sum(r[0] in toxic for r in lost)]
                gone = gone + lost
                removed_by[f] += len(lost)
        for key, row in out.items():
            if key[0] == p:
                f = row[3]
                row[3] = unique[f]
                row.append(removed_by[f])
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_walk_equals_direct_sums():
    rnd = np.random.default_rng(1)
    for k in (1, 3, 5):
        masks, amounts = np.arange(1 << k), rnd.integers(0, 50, (1 << k, 3))
        states = gray_walk(k, masks, amounts)
        for subset in range(1 << k):
            assert np.array_equal(states[subset], amounts[masks & subset == 0].sum(axis=0))


def test_query_against_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    got = rows_of(queries()["op12_filter_audit"](spark, SF))
    assert got == brute_force(docs, labels) and len(got) == 600 * len({d[2] for d in docs})
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute(SQL["op12_filter_audit"])
    names = [c[0] for c in con.description]
    sql = [dict(zip(names, r, strict=True)) for r in con.fetchall()]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in sql} == got


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150))
    rows = [
        (1, None, "en"), (2, "", "en"), (2, "", "en"), (0, "", None), (None, "", "en"), (None, "", ""), (5, long, "en"), (4, long, "de"),
        (4, long, "en"), (9, "  \x0b" + long + "\t", "en"), (10, long.upper(), "en"), (11, "a b " * 100, None), (12, "a#" + long, "fr"),
        (13, long + "\x85x\xa0y", "en"), (14, "x " * 50_000, "en"),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (4, 1, None), (None, 1, 1), (12, None, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, mask int, n int, hash int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clean = [(d, q, x) for d, q, x in labels if d is not None]
    want = brute_force(rows, clean)
    got = rows_of(audit_filters(document_flags(docs, marks)))
    assert got == want
    assert audit_filters(document_flags(docs.limit(0), marks)).collect() == []
    assert rows_of(audit_filters(document_flags(docs, marks.limit(0)))).keys() == want.keys()


@pytest.mark.parametrize("filters", ["A", "XYZ"])
def test_other_numbers_of_filters(spark, filters):
    cells = spark.createDataFrame([("p", m, 10 + m, m, 1) for m in range(1 << len(filters))] + [("p", 0, 5, 1, 1)], "part string, mask int, n long, n_good long, n_toxic long")
    got = audit_filters(cells, filters).collect()
    total = sum(10 + m for m in range(1 << len(filters))) + 5
    assert len(got) == len(list(permutations(filters))) * len(filters)
    assert all(r.kept == 15 for r in got if r.step == len(filters))
    for order in {r.filter_order for r in got}:
        assert sum(r.removed for r in got if r.filter_order == order) == total - 15
