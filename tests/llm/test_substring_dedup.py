import hashlib
import random

from tabsight.llm.substring_dedup import remove_repeats


def brute(rows, window):
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append(str((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())))
    return sorted(out)


def rows_of(seed, window):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 3)
    passage = [word() for _ in range(window * 3)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(r.randint(0, window * 4))]
        kind = r.randint(0, 4)
        if kind == 0:
            text[5:5] = passage
        elif kind == 1:
            at = r.randint(0, window)
            text += passage[at : at + window + r.randint(0, 9)]
        elif kind == 2 and rows:
            text = r.choice(rows)[1].split(" ")
            text[r.randrange(len(text))] = "edit"
        rows.append((r.choice([d, -d]), r.choice([" ", "  ", "\n"]).join(text) if kind != 2 else " ".join(text), 0))
    same = "tie " * (window * 3)
    return rows + [(100, same, 0), (101, same, 0), (101, same, 1), (101, "other " + same, 1), (None, same, 0), (None, None, 0), (102, None, 0), (103, "", 0), (104, "short one", 0), (105, "\x85 x", 0)]


def test_matches_brute_force(spark):
    for seed, window in ((1, 8), (2, 9), (3, 50), (4, 2)):
        rows = rows_of(seed, window)
        df = spark.createDataFrame(rows, "doc_id long, text string, place long").repartition(4)
        got = sorted(str(tuple(r)) for r in remove_repeats(df, window=window).collect())
        assert got == brute(rows, window), (seed, window)


def test_long_and_empty(spark):
    long = " ".join(str(i) for i in range(200_000))
    rows = [(1, long), (2, long[: len(long) // 2]), (3, "x " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(df, with_text=False).collect()}
    n = len((long[: len(long) // 2]).split())
    assert got[1] == (200_000, 0) and got[3] == (100_000, 0) and got[2][0] == n and got[2][1] in (n, n - 1)
    assert remove_repeats(df.where("false")).count() == 0
