import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabsight.llm.simhash import simhash
from tabsight.llm.toxicity import fit_toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, prose(30)) for k in range(8)]
    rows, labels = [], []
    for i in range(400):
        source, text = ("hot", "cold", None)[i % 3], "\n".join(prose(40) for _ in range(4))
        if source == "hot" and i % 2:
            text = "subscribe to our letter\n" + text
        toxic = i % 5 == 1
        if toxic:
            text += " vilew" + vocab[i] + " then " + prose(5)
        if i % 7 == 3:
            text += "\n" + items[i % 8][1]
        if i % 40 == 9:
            text = items[i % 8][1]
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i * 2][1], "en", "cold", 0) for i in range(40)]
    rows += [(2000 + i, rows[i * 2][1] + " more", "en", "cold", 0) for i in range(40)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "hot", 0), (None, prose(60), "en", "hot", 0), (0, *rows[0][1:])]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def key(r):
    return str((r.doc_id, r.text, r.lang, r.source, r.n_chars))


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = tables(spark, folder)
    seen = {"documents": spark.read.parquet(f"{folder}/documents.parquet")}
    docs = seen["documents"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{folder}/out-{name}")
        seen[name] = docs = spark.read.parquet(f"{folder}/out-{name}")
    rows = {k: v.collect() for k, v in seen.items()}

    # toxicity: rows are unchanged; those that go are those of the same model's scores
    sample = corpus_pipeline.labelled_sample(seen["documents"], spark.read.parquet(f"{folder}/labels.parquet"), "toxic", corpus_pipeline.fold(F.col("doc_id"), 5) != 0, 1500)
    model = fit_toxicity(sample)
    want = [key(r) for r in rows["documents"] if model.score((r.text or "").encode()) < 0.5]
    assert sorted(map(key, rows["toxicity"])) == sorted(want)
    bad = [r for r in rows["documents"] if "vilew" in (r.text or "")]
    gone = {key(r) for r in rows["documents"]} - set(want)
    assert np.mean([key(r) in gone for r in bad]) > 0.9 and len(gone - {key(r) for r in bad}) <= 0.02 * len(want)

    # line dedup
    pages = {(r.source, r.text) for r in rows["toxicity"] if r.source is not None and r.text is not None}
    total = Counter(s for s, _ in pages)
    share = Counter((s, x.strip(" ")) for s, t in pages for x in {y.strip(" ") for y in t.split("\n")} if x)
    drop = {k for k, n in share.items() if n >= 2 and n / total[k[0]] > 0.1}
    assert ("hot", "subscribe to our letter") in drop
    cut = lambda s, t: t if s is None or t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop)
    assert sorted(map(key, rows["line_dedup"])) == sorted(str((r.doc_id, cut(r.source, r.text), r.lang, r.source, r.n_chars)) for r in rows["toxicity"])

    # near copies: one row per component, of the smallest id
    fps = [simhash((r.text or "").encode()) for r in rows["line_dedup"]]
    names = sorted(set(fps))
    root = {f: f for f in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                x, y = root[a], root[b]
                root = {f: (y if g == x else g) for f, g in root.items()}
    groups = defaultdict(list)
    for r, f in zip(rows["line_dedup"], fps, strict=True):
        groups[root[f]].append(r)
    kept = rows["simhash_dedup"]
    assert len(kept) == len(groups) < len(rows["line_dedup"])
    least = [min((x.doc_id for x in g if x.doc_id is not None), default=None) for g in groups.values()]
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, least))

    # decontamination: no ten words of an item are left, documents that are mostly items are gone
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(21)}
    after = {r.doc_id: r for r in rows["decontamination"]}
    for r in kept:
        w = words(r.text)
        hit = {i + j for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows for j in range(10)}
        if 2 * len(hit) > len(w):
            assert r.doc_id not in after
        else:
            assert words(after[r.doc_id].text) == [x for i, x in enumerate(w) if i not in hit]
            assert hit or after[r.doc_id].text == r.text
    assert len(after) < len(kept)

    # packing: the ids of every document, in order
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in rows["packing"]:
        pieces[r.doc_id].append((r.start, r.ids))
    assert set(pieces) == set(after)
    for d, parts in pieces.items():
        assert sum((list(i) for _, i in sorted(parts)), []) == [*tok.encode(after[d].text or "", add_special_tokens=False).ids, 1]

    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.start, r.ids_crc32) for r in rows["packing"])


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
