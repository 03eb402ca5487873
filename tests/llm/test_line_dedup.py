from collections import Counter

from pyspark.sql import functions as F

from tabsight.llm.line_dedup import drop_site_lines, host_of, page_lines


def test_matches_brute_force(spark):
    rows = [("a", f"menu\nbody {i}\n\n{'often' if i % 3 == 0 else 'own ' + str(i)}\nmenu") for i in range(40)]
    rows += [("b", f"menu\ntext {i}") for i in range(5)] + [("a", None), (None, "menu\nx"), ("a", ""), ("a", rows[0][1])]
    rows += [("a", "copied line")] * 30
    df = spark.createDataFrame([(h, t, 1, 2) for h, t in rows], "host string, text string, lines int, n int")
    got = drop_site_lines(df, F.col("host"), F.col("text"), ratio=0.2, min_pages=20, min_count=5)
    assert got.columns == df.columns
    pages = {(h, t) for h, t in rows if h and t is not None}
    total = Counter(h for h, _ in pages)
    share = Counter((h, x.strip(" ")) for h, t in pages for x in set(t.split("\n")) if x.strip(" "))
    bad = {k for k, n in share.items() if total[k[0]] >= 20 and n >= 5 and n / total[k[0]] > 0.2}
    assert bad == {("a", "menu"), ("a", "often")}
    want = [(h, t if h is None or t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for h, t in rows]
    assert sorted(map(str, ((r.host, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert drop_site_lines(df.where("false"), F.col("host"), F.col("text")).count() == 0


def test_share_decides_on_hosts_of_every_size(spark):
    rows = [(f"h{n}", f"{'menu' if i < max(2, n // 8) else 'own'}\nbody {n} {i}\nown {n} {i}") for n in (1, 2, 3, 8, 19, 24, 75, 133) for i in range(n)]
    df = spark.createDataFrame(rows, "host string, text string")
    got = drop_site_lines(df, F.col("host"), F.col("text")).collect()
    total = Counter(h for h, _ in rows)
    share = Counter((h, x) for h, t in rows for x in set(t.split("\n")))
    bad = {k for k, n in share.items() if n >= 2 and n / total[k[0]] > 0.1}
    assert {h for h, x in bad if x == "menu"} == set(total) - {"h1"}
    want = [(h, "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for h, t in rows]
    assert sorted((r.host, r.text) for r in got) == sorted(want)


def test_page_text(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><p class=x>One <b>bold</b><br/>two</p><!-- no --><pre>in  line</pre></body></html>"
    r = spark.createDataFrame([(html, "HTTPS://User.Example.ORG:80/x"), (None, "nothing")], "h string, u string").select(page_lines(F.col("h")), host_of(F.col("u"))).collect()
    assert r[0][0] == "T\nOne bold\ntwo\nin  line" and r[0][1] == "user.example.org" and r[1][0] is None and r[1][1] is None


def test_names_of_the_operator_as_user_columns(spark):
    rows = [("h", f"menu\nown {i}", 7, "u", 8, 9) for i in range(4)]
    df = spark.createDataFrame(rows, "host string, text string, __drop int, __host string, __site int, __text int")
    got = drop_site_lines(df, F.col("host"), F.col("text"))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [("h", f"own {i}", 7, "u", 8, 9) for i in range(4)]


def test_query_drops_lines(spark, duck):
    from tabsight.llm.queries import SQL, queries

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: (r.n_lines, r.n_kept, r.kept_sha256) for r in queries()["op5_line_dedup"](spark, sf).collect()}
    want = {r[0]: r[2:] for r in duck.execute(SQL["op5_line_dedup"]).fetchall()}
    assert got == want and sum(a - b for a, b, _ in got.values()) > 100
