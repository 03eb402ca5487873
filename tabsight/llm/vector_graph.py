"""A flat proximity graph in numpy: robust pruning and range search.

Vectors are rows of unit length; distances are Euclidean (for unit vectors
``d * d = 2 - 2 cos``). Used by ``embedding_dedup`` inside tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ROWS = 1024  # rows compared with all others at once


def nearest(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``count`` nearest other rows and their squared distances, ascending."""
    n = len(x)
    count = min(count, n - 1)
    ids, dist = np.empty((n, count), dtype=np.int64), np.empty((n, count), dtype=x.dtype)
    for at in range(0, n, _ROWS):
        block = np.maximum(2 - 2 * (x[at : at + _ROWS] @ x.T), 0)
        block[np.arange(len(block)), at + np.arange(len(block))] = np.inf
        pick = np.argpartition(block, count - 1, axis=1)[:, :count] if count else np.empty((len(block), 0), np.int64)
        own = np.take_along_axis(block, pick, axis=1)
        order = np.argsort(own, axis=1, kind="stable")
        ids[at : at + _ROWS], dist[at : at + _ROWS] = np.take_along_axis(pick, order, axis=1), np.take_along_axis(own, order, axis=1)
    return ids, dist


def robust_prune(x: np.ndarray, candidates: int, degree: int, alpha: float) -> np.ndarray:
    """Neighbour lists (-1 where there are fewer than ``degree``): each row takes
    its nearest candidate, drops candidates that are ``alpha`` times nearer to
    the one taken than to the row, and goes on."""
    n = len(x)
    out = np.full((n, degree), -1, dtype=np.int64)
    ids, dist = nearest(x, candidates)
    if not ids.shape[1]:
        return out
    for at in range(0, n, _ROWS):
        own, d = ids[at : at + _ROWS], dist[at : at + _ROWS]
        y = x[own]
        between = np.maximum(2 - 2 * np.einsum("ncd,nkd->nck", y, y), 0)
        left = np.ones(own.shape, dtype=bool)
        rows = np.arange(len(own))
        for k in range(degree):
            first = left.argmax(axis=1)
            some = left[rows, first]
            out[at + rows[some], k] = own[rows[some], first[some]]
            left &= (alpha * alpha) * between[rows, first] > d
            left[rows, first] = False
            if not left.any():
                break
    return out


def with_reverse(lists: np.ndarray, most: int) -> list[np.ndarray]:
    """Each row's neighbours and the rows that name it, ``most`` of the latter."""
    n = len(lists)
    a, k = np.nonzero(lists >= 0)
    b = lists[a, k]
    order = np.argsort(b, kind="stable")
    starts = np.searchsorted(b[order], np.arange(n + 1))
    return [np.unique(np.concatenate((lists[i][lists[i] >= 0], a[order[starts[i] : starts[i + 1]][:most]]))) for i in range(n)]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def entry_points(lists: np.ndarray, first: int) -> np.ndarray:
    """``first`` and further rows, so that every row can be reached from one of
    them along ``lists`` (padded with -1)."""
    reached = np.zeros(len(lists) + 1, dtype=bool)  # the last place stands for padding
    reached[-1] = True
    starts = []
    at = first
    while True:
        starts.append(at)
        reached[at] = True
        new = np.array([at])
        while len(new):
            nb = np.unique(lists[new])
            new = nb[~reached[nb]]
            reached[new] = True
        at = int(reached.argmin())
        if reached[at]:
            return np.array(starts, dtype=np.int64)


#: Cells of the (query, row) tables and components gathered at once.
_CELLS, _GATHER = 1 << 20, 1 << 22


def range_hits(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, start: int | np.ndarray, radius2: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first query, table of queries x rows) of the rows within squared
    distance ``radius2``, found by greedy beam search from the nearest of the
    ``start`` rows, then by expanding every row in range until no new one
    appears. ``lists`` is padded with -1. A block has at most ``_CELLS`` cells,
    so memory does not grow with the number of pairs in range."""
    start = np.atleast_1d(start)
    per = max(1, min(_ROWS, _CELLS // max(1, len(x))))
    for at in range(0, len(queries), per):
        yield at, _search_block(x, lists, queries[at : at + per], start, radius2, beam)


def exact_hits(x: np.ndarray, queries: np.ndarray, radius2: float) -> Iterator[tuple[int, np.ndarray]]:
    """The same blocks by comparing all."""
    per = max(1, min(_ROWS, _CELLS // max(1, len(x))))
    for at in range(0, len(queries), per):
        yield at, 2 - 2 * (queries[at : at + per] @ x.T) <= radius2


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, start: int | np.ndarray, radius2: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The (query, row) pairs of ``range_hits``."""
    blocks = [(at, np.nonzero(hit)) for at, hit in range_hits(x, lists, queries, start, radius2, beam)]
    none = np.empty(0, np.int64)
    return (np.concatenate([a + at for at, (a, _) in blocks]), np.concatenate([b for _, (_, b) in blocks])) if blocks else (none, none)


def verify_hits(hit: np.ndarray, queries: np.ndarray, rows: np.ndarray, threshold: float) -> None:
    """Take out the hits whose cosine, in double precision, is below ``threshold``.

    Blocks with few hits gather their pairs, full ones multiply matrices; both
    hold a bounded number of components."""
    size = queries.shape[1]
    per = max(1, min(_ROWS, _CELLS // max(1, len(rows))))
    step = max(1, _GATHER // max(1, size))
    for at in range(0, len(queries), per):
        block = hit[at : at + per]
        a, b = np.nonzero(block)
        if len(a) > block.size // 16:
            block &= queries[at : at + per] @ rows.T >= threshold
            continue
        for k in range(0, len(a), step):
            i, j = a[k : k + step], b[k : k + step]
            block[i, j] = np.einsum("nd,nd->n", queries[at + i], rows[j]) >= threshold


def hit_components(hit: np.ndarray, asked: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """For rows 0..n-1 of which ``hit`` links ``asked`` and ``held`` ones: the
    smallest row of each one's component. Every table row is read once or twice."""
    root = np.arange(n)
    by_held = hit.T if hit.shape[0] * hit.shape[1] == 0 else np.ascontiguousarray(hit.T)
    new_a, new_h = hit.any(axis=1), by_held.any(axis=1)  # linked and not reached yet
    while new_a.any():
        side_a = [np.array([int(new_a.argmax())])]
        new_a[side_a[0]] = False
        side_h: list[np.ndarray] = []
        grow_a = side_a[0]
        while len(grow_a):
            grow_h = np.flatnonzero(hit[grow_a].any(axis=0) & new_h)
            new_h[grow_h] = False
            side_h.append(grow_h)
            grow_a = np.flatnonzero(by_held[grow_h].any(axis=0) & new_a) if len(grow_h) else grow_h
            new_a[grow_a] = False
            side_a.append(grow_a)
        members = np.concatenate((asked[np.concatenate(side_a)], held[np.concatenate(side_h)]))
        root[members] = members.min()
    return root


def _near_pairs(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, radius2: float) -> np.ndarray:
    """Whether each pair (query i, row j) is within the radius, a bounded number at once."""
    out = np.empty(len(i), dtype=bool)
    step = max(1, _GATHER // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        k = slice(at, at + step)
        out[k] = np.maximum(2 - 2 * np.einsum("qd,qd->q", q[i[k]], x[j[k]]), 0) <= radius2
    return out


def _search_block(x: np.ndarray, lists: np.ndarray, q: np.ndarray, start: np.ndarray, radius2: float, beam: int) -> np.ndarray:
    m = len(q)
    rows = np.arange(m)
    seen = np.zeros((m, len(x) + 1), dtype=bool)  # the last column stands for padding
    seen[:, -1] = True
    hit = np.zeros((m, len(x) + 1), dtype=bool)
    ids = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=x.dtype)
    done = np.ones((m, beam), dtype=bool)
    d = np.maximum(2 - 2 * (q @ x[start].T), 0)
    k = min(beam, len(start))
    pick = np.argpartition(d, k - 1, axis=1)[:, :k]
    ids[:, :k], dist[:, :k], done[:, :k] = start[pick], np.take_along_axis(d, pick, axis=1), False
    i, j = np.nonzero(d <= radius2)
    hit[i, start[j]] = True
    seen[rows[:, None], ids[:, :k]] = seen[i, start[j]] = True
    active = rows
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        k = open_.argmin(axis=1)
        go = ~done[active, k]
        active, k = active[go], k[go]
        if not len(active):
            break
        done[active, k] = True
        nb = lists[ids[active, k]]
        fresh = ~seen[active[:, None], nb]
        seen[active[:, None], nb] = True
        d = np.maximum(2 - 2 * np.einsum("qd,qkd->qk", q[active], x[nb]), 0)
        d[~fresh] = np.inf
        i, j = np.nonzero(d <= radius2)
        hit[active[i], nb[i, j]] = True
        all_d = np.concatenate((dist[active], d), axis=1)
        all_id = np.concatenate((ids[active], nb), axis=1)
        all_done = np.concatenate((done[active], ~fresh), axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[active], ids[active] = np.take_along_axis(all_d, best, axis=1), np.take_along_axis(all_id, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1) | np.isinf(dist[active])
    new_q, new_x = np.nonzero(hit)
    step = max(1, _CELLS // max(1, lists.shape[1]))
    while len(new_q):  # rows in range lead to more rows in range
        more = np.zeros_like(seen)
        for at in range(0, len(new_q), step):  # a bounded part of the frontier at once
            more[new_q[at : at + step, None], lists[new_x[at : at + step]]] = True
        more &= ~seen
        seen |= more
        i, j = np.nonzero(more)
        near = _near_pairs(x, q, i, j, radius2)
        new_q, new_x = i[near], j[near]
        hit[new_q, new_x] = True
    return hit[:, :-1]
