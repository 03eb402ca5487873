import random
import re

from pyspark.sql import functions as F

from tabsight.llm.decontaminate import ItemAutomaton, find_overlaps, hit_words, remove_overlaps

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(doc, items, n):
    hit, ids = set(), set()
    w = words(doc)
    for item, text in items:
        x = words(text)
        k = min(n, len(x))
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(item)
    return len(w), len(hit), ids


def test_automaton_matches_brute_force():
    r = random.Random(3)
    for _ in range(400):
        n, letters = r.randint(1, 5), "abc"[: r.randint(1, 3)]
        items = [(i, " ".join(r.choices(letters, k=r.randint(0, 9)))) for i in range(r.randint(0, 5))]
        doc = " ".join(r.choices(letters + "d", k=r.randint(0, 25)))
        auto = ItemAutomaton([(i, t.encode().split()) for i, t in items], n)
        spans, ids, longest = auto.match(doc.encode().split())
        want = brute(doc, items, n)
        assert (sum(b - a for a, b in spans), ids) == (want[1], want[2]), (n, items, doc)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


DOCS = [
    (1, "Start one TWO three, four five six seven eight nine ten eleven stop", "x"),
    (2, None, "x"), (3, "", "x"), (4, "one two three", "x"), (5, "a short item", "x"),
    (5, "a short item", "x"), (None, "one two three four five six seven eight nine ten", None),
    (7, "filler " * 30_000 + "one two three four five six seven eight nine ten " + "pad " * 30_000, "y"),
]
ITEMS = [(10, "One two three four five six seven eight nine ten eleven twelve"), (9, "short  item"), (9, "other words of nine"), (8, None), (7, "!!"), (None, "stop")]


def test_query_rows(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, overlap string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1 << 20, 30):
        got = find_overlaps(df, bench, keep=["doc_id"], block_bytes=block).withColumn("hit", hit_words()).collect()
        have = sorted(str((r.doc_id, r.overlap.n_words, r.hit, r.overlap["items"])) for r in got)
        want = []
        for d, t, _ in DOCS:
            n, h, ids = brute(t, ITEMS, 10)
            want.append(str((d, n, h, sorted(str(i) for i in ids if i is not None))))
        assert have == sorted(want)


def test_remove(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = {r.doc_id: r.text for r in remove_overlaps(df, bench, max_coverage=0.9).collect()}
    assert got[1] == "Start  stop" and got[2] is None and got[4] == "one two three" and None not in got
    assert got[7] == "filler " * 30_000 + " " + "pad " * 30_000
    many = spark.createDataFrame(ITEMS[:1] * 2 + [(50 + i, f"unrelated item number {i} " * 4) for i in range(12)], "item_id long, text string")
    assert {r.doc_id: r.text for r in remove_overlaps(df, many, max_coverage=0.9, block_bytes=100).collect()} == got
    none = remove_overlaps(df, bench.where(F.lit(False)))
    assert none.columns == df.columns and none.count() == len(DOCS)
    assert remove_overlaps(df.where(F.lit(False)), bench).count() == 0


def test_short_items_go_and_names_may_clash(spark):
    from tabsight.llm.decontaminate import find_overlaps, remove_overlaps

    filler = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"{filler} one two three four five six end", "a", 5), (2, filler, "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __overlap string, __text int")
    items = spark.createDataFrame([(1, "One two three four five six")], "item_id long, text string")
    got = {r.doc_id: r for r in remove_overlaps(docs, items).collect()}
    assert got[1].text == f"{filler}  end" and got[2].text == filler and (got[1]["__overlap"], got[1]["__text"]) == ("a", 5)
    found = find_overlaps(docs, items)
    assert found.columns == [*docs.columns, "overlap"]
    assert {r.doc_id: [(s.first, s.end) for s in r.overlap.spans] for r in found.collect()} == {1: [(50, 56)], 2: []}
