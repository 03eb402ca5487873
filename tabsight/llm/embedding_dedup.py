"""Embedding near-dedup on a robust-pruned flat graph over overlapping shards.

Vectors are compared within their label. Vectors that are the same in every
component are one *class* and stand in the graph once, with their number.

1. Centres: a bounded sample (``sample_rows`` vectors) is clustered by label on
   the driver; a label gets centres in proportion to its classes, about
   ``shard_rows`` classes each, ``max_centres`` in all.
2. Shards: every class goes to its ``overlap`` nearest centres of its label. A
   shard larger than ``shard_limit`` is divided by hash into parts; then each
   part holds its own rows and is searched for those of every part in turn.
3. Graph: each shard's rows get neighbour lists by robust pruning, with reverse
   links. A class's lists from all its shards are united.
4. Search: in each shard every class is a query. A greedy beam search from the
   shard's medoid, and from one row of every part of the graph that the medoid
   does not reach, is followed by expanding all rows in range. Every pair found
   is verified in double precision (cosine >= ``threshold``).
5. A pair counts in the first shard that both classes share; a shard hands out
   one count per class and a spanning forest of its links, so nothing grows
   with the square of a group. Components are joined by distributed rounds.
6. ``audit_shares`` compares the links of a bounded sample of vectors with
   brute force over all rows, per link and per class; where either is below
   ``least_recall`` the search is repeated with twice the beam and one more
   centre per class. After ``tries`` searches, or where no class drawn has a
   link to measure by, ``exact_links`` compares all rows in reach of each other
   across shards, pruned by the distances of centres.

Defined results: null, zero or non-finite vectors, null components, null labels
and null ids link with nothing (their component is their own id); vectors of
different lengths are never compared; rows that repeat id, label and vector
count as one vector; rows that repeat an id alone are one node; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import write_table
from tabsight.llm.components import connected_components
from tabsight.llm.vector_graph import entry_points, exact_hits, hit_components, medoid, range_hits, robust_prune, verify_hits, with_reverse

log = logging.getLogger(__name__)


def _unit(vectors: list | pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    # divided by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their class key, and one row per class."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        v.alias("vector"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    rows = rows.select("vec_id", "label", "vector", "usable", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), F.size("vector").alias("dim"))
    key = ["label", "dim", "h1", "h2"]
    once = rows.where("usable").dropDuplicates([*key, "vec_id"])
    classes = once.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    return rows, write_table(classes, "vector-classes")


def fit_centres(classes: DataFrame, shard_rows: int, max_centres: int, sample_rows: int, rounds: int = 5) -> dict[tuple[str, int], np.ndarray]:
    """Centres by (label, length of vector), from a bounded sample."""
    sizes = {(r[0], r[1]): r[2] for r in classes.groupBy("label", "dim").count().orderBy(F.desc("count")).limit(max_centres).collect()}
    total = sum(sizes.values())
    rows = classes.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select("label", "dim", "vector").collect()
    by: dict[tuple[str, int], list] = {}
    for r in rows:
        by.setdefault((r[0], r[1]), []).append(r[2])
    centres = {}
    for key in sorted(by):
        x = _unit(by[key])
        want = min(-(-sizes.get(key, 1) // shard_rows), max(1, max_centres * sizes.get(key, 1) // max(1, total)), len(x))
        c = x[:: max(1, len(x) // want)][:want].copy()
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1)
            c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
        centres[key] = c.astype(np.float32)
    return centres


def assign_shards(classes: DataFrame, centres: dict[tuple[str, int], np.ndarray], overlap: int, with_angle: bool = False) -> DataFrame:
    """``node, size, vector, shard, shards``: a row per class and shard; labels
    without centres (none in the sample) are a shard each. ``with_angle`` adds
    the angle to the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards: list[list[str]] = [[] for _ in range(b.num_rows)]
            keys = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(keys):
                by.setdefault(key, []).append(i)
            vectors = b.column(4).to_pylist()
            angles = np.zeros(b.num_rows)
            for (label, dim), rows in by.items():
                c = centres.get((label, dim))
                if c is None or len(c) == 1 and not with_angle:
                    names = np.zeros((len(rows), 1), dtype=np.int64)
                else:
                    unit = c / np.maximum(np.linalg.norm(c.astype(np.float64), axis=1, keepdims=True), 1e-300)
                    near = _unit([vectors[i] for i in rows]) @ unit.T
                    names = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                    angles[rows] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                for i, own in zip(rows, names.tolist(), strict=True):
                    shards[i] = sorted(f"{dim}:{k}:{label}" for k in own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(shards, pa.list_(pa.string())), pa.array(angles)], names=["node", "size", "vector", "shards", "angle"])

    rows = classes.select("node", "size", "label", "dim", "vector").mapInArrow(run, "node long, size long, vector array<double>, shards array<string>, angle double")
    rows = rows.select("*", F.explode("shards").alias("shard"))
    return rows if with_angle else rows.drop("angle")


def divide_shards(rows: DataFrame, shard_limit: int) -> DataFrame:
    """Adds ``part, chunk, indexed, query``: a shard over the limit is dealt by
    hash to P parts, and every part meets the rows of every chunk (part number
    of the queries) in a group of its own, so a group has two parts at most."""
    parts = rows.groupBy("shard").count().select("shard", F.ceil(F.col("count") / shard_limit).cast("long").alias("parts"))
    rows = rows.join(write_table(parts, "shard-parts"), "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))

    def place(part, chunk, indexed, query):
        return F.struct(part.alias("part"), chunk.alias("chunk"), indexed.alias("indexed"), query.alias("query"))

    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    held = F.transform(others, lambda x: place(F.col("own"), x, F.lit(True), x == F.col("own")))
    asked = F.transform(F.filter(others, lambda x: x != F.col("own")), lambda x: place(x, F.col("own"), F.lit(False), F.lit(True)))
    return rows.withColumn("at", F.explode(F.concat(held, asked))).select("node", "size", "vector", "shards", "shard", "at.*")


def _build(candidates: int, degree: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node = pdf["node"].to_numpy()
        lists = with_reverse(robust_prune(_unit(pdf["vector"]).astype(np.float32), candidates, degree, alpha), degree)
        return pd.DataFrame({"node": node, "neighbours": [node[x].tolist() for x in lists]})

    return run


def _find(threshold: float, beam: int, exact: bool):
    """Links and forest of one group. The pairs are a table of bits' worth of
    (queries x rows) booleans, at most ``shard_limit`` squared; every other
    array is made for a block of it, so a group of near copies costs no more
    memory than any other rows. ``exact`` compares all rows and counts links on
    both sides, as a pair of rows then meets in one group only."""
    radius2 = 2 - 2 * threshold + 1e-5  # single precision finds, double precision decides

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        # rows that repeat a node (one id, several vectors) stay apart here and share their node outside
        node, size = pdf["node"].to_numpy(), pdf["size"].to_numpy()
        held, asked = np.flatnonzero(pdf["indexed"].to_numpy()), np.flatnonzero(pdf["query"].to_numpy())
        if not len(held) or not len(asked):
            return pd.DataFrame({"node": node, "links": 0, "other": node})
        x = _unit(pdf["vector"])
        x32 = x.astype(np.float32)
        if exact:
            blocks = exact_hits(x32[held], x32[asked], radius2)
        else:
            place = {n: i for i, n in enumerate(node[held].tolist())}
            lists = [sorted({place[n] for n in near if n in place}) for near in (pdf["neighbours"][i] for i in held)]
            table = np.full((len(held), max(1, max(map(len, lists)))), -1, dtype=np.int64)
            for i, own in enumerate(lists):
                table[i, : len(own)] = own
            blocks = range_hits(x32[held], table, x32[asked], entry_points(table, medoid(x32[held])), radius2, beam)
        hit = np.zeros((len(asked), len(held)), dtype=bool)
        for at, block in blocks:
            hit[at : at + len(block)] = block
        same = np.array_equal(asked, held)
        if same:  # a pair found from one side holds for the other
            hit |= hit.T.copy()
            np.fill_diagonal(hit, False)
        verify_hits(hit, x[asked], x[held], threshold)
        links = np.zeros(len(node), dtype=np.int64)
        known = pdf["shards"].tolist()
        numbers = {name: i for i, name in enumerate(sorted({s for own in known for s in own}))}
        shards = np.full((len(node), max(map(len, known))), -1, dtype=np.int64)
        for i, own in enumerate(known):
            shards[i, : len(own)] = [numbers[s] for s in own]
        here = numbers[pdf["shard"].iloc[0]]
        # shards before this one: a pair that shares one of them counts there
        earlier = np.where(shards < here, shards, -1)
        per = max(1, (1 << 20) // len(held))
        for at in range(0, len(asked), per):
            i, j = np.nonzero(hit[at : at + per])
            a, b = asked[at + i], held[j]
            counted = np.ones(len(a), dtype=bool)
            for s in range(shards.shape[1]):
                for t in range(shards.shape[1]):
                    counted &= (earlier[a, s] < 0) | (earlier[a, s] != earlier[b, t])
            a, b = a[counted], b[counted]
            links += np.bincount(a, weights=size[b], minlength=len(node)).astype(np.int64)
            if exact and not same:
                links += np.bincount(b, weights=size[a], minlength=len(node)).astype(np.int64)
        return pd.DataFrame({"node": node, "links": links, "other": node[hit_components(hit, asked, held, len(node))]})

    return run


def exact_links(
    classes: DataFrame, threshold: float, shard_rows: int = 1000, shard_limit: int = 6000, max_centres: int = 4096, sample_rows: int = 16384, **_
) -> DataFrame:
    """The rows of ``find_links`` by comparing everything that can be in range.

    Every class stands in the cell of its nearest centre, divided by hash into
    parts of ``shard_limit`` rows at most. Two cells are compared if the angle
    of their centres less both cells' widest angles is within the threshold's
    angle; a pair of parts is one group, so any two rows meet at most once."""
    centres = fit_centres(classes, shard_rows, max_centres, sample_rows)
    cells = assign_shards(classes, centres, 1, with_angle=True)
    cells = write_table(cells.select("node", "size", "vector", "shard", "angle"), "cells")
    # a row per cell; labels outside the sample are a cell each, which meets itself only
    sizes = cells.groupBy("shard").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
    known = {f"{dim}:{k}:{label}": (label, dim, k) for (label, dim), c in centres.items() for k in range(len(c))}  # max_centres names
    listed = spark_frame(classes, [(name,) for name in known], "shard string")
    reach = {r.shard: r.reach for r in sizes.join(listed, "shard").collect()}
    limit = float(np.arccos(threshold)) + 1e-6
    pairs = []
    for (label, dim), c in centres.items():
        names = [f"{dim}:{k}:{label}" for k in range(len(c))]
        have = [k for k, name in enumerate(names) if name in reach]
        wide = np.array([reach[names[k]] for k in have])
        unit = c[have].astype(np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        near = np.arccos(np.clip(unit @ unit.T, -1, 1)) - wide[:, None] - wide[None, :] <= limit
        pairs += [(names[have[i]], names[have[j]]) for i, j in zip(*np.nonzero(near), strict=True) if i != j]
    meets = spark_frame(classes, pairs, "shard string, other string")
    parts = write_table(sizes.select("shard", F.ceil(F.col("n") / shard_limit).cast("long").alias("parts")), "cell-parts")
    others = meets.join(parts.select(F.col("shard").alias("other"), F.col("parts").alias("other_parts")), "other").unionByName(
        parts.select(F.col("shard").alias("other"), "shard", F.col("parts").alias("other_parts"))
    )
    # (cell, part) meets (other cell, part); the pair's lesser side is the queries
    own = F.concat_ws("/", F.lpad(F.col("part").cast("string"), 12, "0"), "shard")
    their = F.concat_ws("/", F.lpad(F.col("q").cast("string"), 12, "0"), "other")
    placed = (
        cells.join(parts, "shard")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        .join(others, "shard")
        .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_parts") - 1)))
        .select("node", "size", "vector", own.alias("own"), their.alias("their"))
        .select(
            "node", "size", "vector", F.concat_ws("|", F.least("own", "their"), F.greatest("own", "their")).alias("shard"),
            (F.col("own") >= F.col("their")).alias("indexed"), (F.col("own") <= F.col("their")).alias("query"),
        )
    )
    placed = placed.withColumn("shards", F.array("shard"))
    return write_table(placed.groupBy("shard").applyInPandas(_find(threshold, 0, True), "node long, links long, other long"), "exact-links")


def spark_frame(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def find_links(
    classes: DataFrame,
    threshold: float,
    shard_rows: int = 1000,
    shard_limit: int = 6000,
    max_centres: int = 4096,
    sample_rows: int = 16384,
    overlap: int = 2,
    candidates: int = 64,
    degree: int = 24,
    alpha: float = 1.2,
    beam: int = 48,
) -> DataFrame:
    """``node, links, other``: rows whose ``links`` add up to each node's links
    to other classes, and whose (node, other) pairs connect its component."""
    rows = write_table(divide_shards(assign_shards(classes, fit_centres(classes, shard_rows, max_centres, sample_rows), overlap), shard_limit), "shards")
    lists = rows.where("indexed AND part = chunk").groupBy("shard", "part").applyInPandas(_build(candidates, degree, alpha), "node long, neighbours array<long>")
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    graph = write_table(graph, "graph")
    return write_table(
        rows.join(graph, "node").groupBy("shard", "part", "chunk").applyInPandas(_find(threshold, beam, False), "node long, links long, other long"), "found-links"
    )


def audit_recall(classes: DataFrame, found: DataFrame, threshold: float, queries: int = 256) -> float | None:
    """The lower of the two shares of ``audit_shares``."""
    shares = audit_shares(classes, found, threshold, queries)
    return None if shares is None else min(shares)


def audit_shares(classes: DataFrame, found: DataFrame, threshold: float, queries: int = 256, most: int = 4096) -> tuple[float, float] | None:
    """The share of the links of some classes that ``found`` has, by brute force
    of those classes against all rows: over all links, and as the mean over the
    classes with links, where a large group weighs no more a class.

    ``queries`` classes are drawn by hash, and four times as many as long as
    fewer than 8 of them have links, up to ``most``. None: no class drawn has a
    link, so nothing is measured (an exact search must answer)."""
    while True:
        rows, shares, linked = _audit(classes, found, threshold, queries)
        if rows < queries and linked:  # all classes were drawn
            return shares
        if linked >= 8:
            return shares
        if rows < queries or queries >= most:
            return shares if linked else None
        queries = min(most, 4 * queries)


def _audit(classes: DataFrame, found: DataFrame, threshold: float, queries: int) -> tuple[int, tuple[float, float], int]:
    sample = classes.orderBy(F.xxhash64("h1", "node"), "node").limit(queries).select("node", "label", "dim", "vector").collect()
    if not sample:
        return 0, (1.0, 1.0), 1  # an empty table has no link to miss
    by: dict[tuple[str, int], list] = {}
    for r in sample:
        by.setdefault((r["label"], r["dim"]), []).append((r["node"], r["vector"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = {k: (np.array([n for n, _ in v]), _unit([x for _, x in v])) for k, v in by.items()}
        total: dict[int, int] = {}
        for b in batches:
            pdf = b.to_pandas()
            for key, part in pdf.groupby(["label", "dim"]):
                if key in units:
                    nodes, x = units[key]
                    near = (_unit(part["vector"]) @ x.T >= threshold) & (part["node"].to_numpy()[:, None] != nodes[None, :])
                    for n, links in zip(nodes.tolist(), (near * part["size"].to_numpy()[:, None]).sum(axis=0).tolist(), strict=True):
                        total[n] = total.get(n, 0) + int(links)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "links"])

    exact = classes.select("node", "size", "label", "dim", "vector").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("exact"))
    have = found.groupBy("node").agg(F.sum("links").alias("have"))
    have_of = F.least("exact", F.coalesce("have", F.lit(0)))
    row = exact.where("exact > 0").join(have, "node", "left").agg(F.sum("exact"), F.sum(have_of), F.avg(have_of / F.col("exact")), F.count("*")).first()
    return len(sample), ((1.0, 1.0) if not row[0] else (row[1] / row[0], row[2])), row[3]


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    least_recall: float = 0.95,
    tries: int = 3,
    **options,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row; ``options`` go to ``find_links``."""
    rows, classes = vector_classes(vectors, id_col, vector_col, label_col)
    settings = {"overlap": 2, "beam": 48} | options
    for k in range(tries):
        found = find_links(classes, threshold, **settings)
        shares = audit_shares(classes, found, threshold)
        if shares is None:
            log.warning("near_vectors: no class drawn for the audit has a link; recall not measured, searched exactly")
            found = exact_links(classes, threshold, **settings)
            break
        if min(shares) >= least_recall:
            break
        log.warning("near_vectors, search %d: recall %.3f per link and %.3f per class, under %s", k + 1, *shares, least_recall)
        settings |= {"overlap": settings["overlap"] + 1, "beam": settings["beam"] * 2}
    else:
        found = exact_links(classes, threshold, **settings)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "node").join(roots, "node", "left").select(
        "label", "dim", "h1", "h2", (F.col("links") + F.col("size") - 1).alias("n"), F.coalesce("root", "node").alias("component")
    )
    key = ["label", "dim", "h1", "h2"]
    out = rows.select("vec_id", "usable", *key).join(named, key, "left")
    linked = F.col("usable") & F.col("component").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.when(linked, F.col("n")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
