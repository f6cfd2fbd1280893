"""Numpy kernels for one cloud that fits a task. Each agrees with the distributed form in operators.cluster."""

from __future__ import annotations

import time

import numpy as np


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable by the edges (a, b), for nodes 0..n-1."""
    low = np.arange(n)
    while len(a):
        p, q = low[a], low[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        # hook the larger root under the smaller one, then let every node point at its root
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
    return low


#: Cells of cell_side in which points within tol of each other can lie apart, along each axis.
REACH = 2
#: Cells beyond are counted as this one, within which doubles are exact.
FARTHEST = 1 << 50
#: The own column of cells and one of each pair of opposite ones within REACH.
HALF_COLUMNS = tuple((dx, dy) for dx in range(REACH + 1) for dy in range(-REACH, REACH + 1) if (dx, dy) >= (0, 0))


def cell_side(tol: float) -> float:
    """Side of cells whose points are all within tol of each other."""
    return tol / 3**0.5 * (1 - 1e-6)


def squeezed(cells: np.ndarray, reach: int) -> np.ndarray:
    """Cell numbers from 0 along each axis, in which empty stretches of more than reach cells are shortened to reach, so that products of them stay small."""
    out = np.empty(cells.shape, np.int64)
    for k in range(cells.shape[1]):
        u, at = np.unique(cells[:, k], return_inverse=True)
        out[:, k] = np.concatenate([[0], np.cumsum(np.minimum(np.diff(u), reach + 1).astype(np.int64))])[at] if len(u) else 0
    return out


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): for each row the numbers first, first + 1, ..., count of them."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(count) - count), count)


def _meet(a: np.ndarray, b: np.ndarray, limit: float, chunk: int) -> bool:
    """Whether a point of a and one of b have a squared distance of at most limit; both are thinned to what is near the other's box."""
    for _ in range(2):
        gap = np.maximum(np.maximum(b.min(axis=0) - a, a - b.max(axis=0)), 0)
        gap *= gap
        a = a[gap[:, 0] + gap[:, 1] + gap[:, 2] <= limit]
        if not len(a):
            return False
        a, b = b, a
    rows = max(1, chunk // len(b))
    for at in range(0, len(a), rows):
        d = a[at : at + rows, None, :] - b[None]
        d *= d
        if (d[..., 0] + d[..., 1] + d[..., 2] <= limit).any():
            return True
    return False


def cell_components(xyz: np.ndarray, tol: float, cells: np.ndarray, group: np.ndarray | None = None, chunk: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, cell): for each point the first point (row number) of its component of the radius graph (<= tol) and of its cell. group: points of different groups are never linked.

    cells: numbers of cells of cell_side, from 0. All points of a cell are linked, so cells are the nodes. Boxes around their points tell most pairs of near cells to be linked or apart; of the others, those that are not linked by then are compared point by point, so memory grows with points, not with pairs. Coordinates so large that a cell's box is wider than tol have a node for each point.
    """
    n, limit = len(xyz), tol * tol
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = cells.max(axis=0) + 2 * REACH + 1
    code = ((cells[:, 0] + REACH) * span[1] + cells[:, 1] + REACH) * span[2] + cells[:, 2] + REACH
    if group is not None:
        code += group * (span[0] * span[1] * span[2])
    order = np.argsort(code, kind="stable")
    code, p = code[order], xyz[order]
    new = np.concatenate([[True], code[1:] != code[:-1]])
    start = np.flatnonzero(new)
    side = np.maximum.reduceat(p, start) - np.minimum.reduceat(p, start)
    side *= side
    wide = side[:, 0] + side[:, 1] + side[:, 2] > limit
    if wide.any():
        new |= wide[np.cumsum(new) - 1]
        start = np.flatnonzero(new)
    node, code, size = np.cumsum(new) - 1, code[start], np.diff(np.append(start, n))
    low, high, m = np.minimum.reduceat(p, start), np.maximum.reduceat(p, start), len(start)
    root, here, doubtful = np.arange(m), np.arange(m), []
    for dx, dy in HALF_COLUMNS:
        target = code + (dx * span[1] + dy) * span[2]
        left = here + 1 if (dx, dy) == (0, 0) else np.searchsorted(code, target - REACH, "left")
        count = np.searchsorted(code, target + REACH, "right") - left
        total = np.cumsum(count)
        at = 0
        while at < m:  # bounded numbers of pairs of cells at a time
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
            a, b = spread(left[at:to], count[at:to])
            a += at
            near, far = np.zeros(len(a)), np.zeros(len(a))
            for k in range(3):
                up, down = low[b, k] - high[a, k], low[a, k] - high[b, k]
                d = np.maximum(np.maximum(up, down), 0)
                near += d * d
                d = np.maximum(high[b, k] - low[a, k], high[a, k] - low[b, k])
                far += d * d
            sure = far <= limit
            x, y = root[a[sure]], root[b[sure]]
            root = components(m, x, y)[root]
            open_ = ~sure & (near <= limit)
            doubtful.append(np.stack([a[open_], b[open_]]))
            at = to
    a, b = np.concatenate(doubtful, axis=1)
    work = size[a] * size[b]
    o = np.argsort(work, kind="stable")
    a, b, work = a[o], b[o], work[o]
    while True:
        open_ = root[a] != root[b]
        a, b, work = a[open_], b[open_], work[open_]
        if not len(a):
            break
        to = int(np.searchsorted(np.cumsum(work), chunk, "right"))
        if to:
            row, at = spread(np.zeros(to, np.int64), work[:to])
            i, j = start[a[row]] + at // size[b[row]], start[b[row]] + at % size[b[row]]
            d = p[i] - p[j]
            d *= d
            hit = np.zeros(to, bool)
            hit[row[d[:, 0] + d[:, 1] + d[:, 2] <= limit]] = True
        else:
            to = 1
            hit = np.array([_meet(p[start[a[0]] : start[a[0]] + size[a[0]]], p[start[b[0]] : start[b[0]] + size[b[0]]], limit, chunk)])
        root = components(m, root[a[:to][hit]], root[b[:to][hit]])[root]
        a, b, work = a[to:], b[to:], work[to:]
    first = order[start]
    least = np.full(m, n)
    np.minimum.at(least, root, first)
    cluster, cell = np.empty(n, np.int64), np.empty(n, np.int64)
    cluster[order], cell[order] = least[root][node], first[node]
    return cluster, cell


def grid(xyz: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, numbers along each axis, sorted cell codes, order of the points) of a grid with cells of the size tol."""
    c = np.floor(xyz / tol).astype(np.int64)
    shifted = c - c.min(axis=0) + 1
    span = shifted.max(axis=0) + 2
    code = (shifted[:, 0] * span[1] + shifted[:, 1]) * span[2] + shifted[:, 2]
    order = np.argsort(code, kind="stable")
    return c, span, code[order], order


def half_pairs(xyz: np.ndarray, tol: float, strict: bool = False, chunk: int = 4_000_000, built: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2, cells) of each unordered pair of different points within tol, once; cells are the points' grid cells. built: grid(xyz, tol), if it is there.

    Points are sorted by cell; cells along z are neighbours in that order, so five ranges cover half of the 27 cells.
    """
    n = len(xyz)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0), np.zeros((0, 3), np.int64)
    c, span, code, order = built or grid(xyz, tol)
    x, y, z = (np.ascontiguousarray(xyz[order, k]) for k in range(3))
    here, limit = np.arange(n), tol * tol
    out: list[tuple[np.ndarray, ...]] = []
    for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        target = code + (dx * span[1] + dy) * span[2]
        lo = here + 1 if (dx, dy) == (0, 0) else np.searchsorted(code, target - 1, "left")
        count = np.searchsorted(code, target + 1, "right") - lo
        total = np.cumsum(count)
        at = 0
        while at < n:  # bounded numbers of pairs at a time
            m = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
            k = count[at:m]
            i = np.repeat(here[at:m], k)
            j = np.arange(len(i)) + np.repeat(lo[at:m] - (np.cumsum(k) - k), k)
            d = x[i] - x[j]
            d2 = d * d
            d = y[i] - y[j]
            d2 += d * d
            d = z[i] - z[j]
            d2 += d * d
            ok = np.flatnonzero(d2 < limit if strict else d2 <= limit)
            out.append((order[i[ok]], order[j[ok]], d2[ok]))
            at = m
    a, b, d2 = (np.concatenate(v) for v in zip(*out, strict=True))
    return a, b, d2, c


def directed_pairs(xyz: np.ndarray, tol: float, strict: bool = False, built: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2, k) within tol, i = j included; k numbers j's cell as seen from i's, from (-1, -1, -1) up."""
    a, b, d2, c = half_pairs(xyz, tol, strict, built=built)
    own = np.arange(len(xyz))
    i, j = np.concatenate([a, b, own]), np.concatenate([b, a, own])
    step = c[j] - c[i] + 1
    return i, j, np.concatenate([d2, d2, np.zeros(len(own))]), (step[:, 0] * 3 + step[:, 1]) * 3 + step[:, 2]


def capped(i, j, d2, k, max_n: int, cap: str):
    """At most max_n neighbours of each i, as in operators.neighbors; sorted by i."""
    if max_n:
        n = np.bincount(i)
        full = n[i] > max_n
        # only crowded points need their neighbours ranked
        a, b, d, c = i[full], j[full], d2[full], k[full]
        o = np.lexsort((b, c, a)) if cap == "scan_order" else np.lexsort((b, d, b != a, a))
        a, b = a[o], b[o]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.concatenate([start, [len(a)]])))
        i, j = np.concatenate([i[~full], a[rank < max_n]]), np.concatenate([j[~full], b[rank < max_n]])
    o = np.argsort(i, kind="stable")
    return i[o], j[o]


def _places_near(p: np.ndarray, kept: np.ndarray, radius: float, of: np.ndarray, limit: float, strict: bool, chunk: int):
    """(those of ``of``, i, j, d2): the places ``of`` with all places of p within radius, themselves included, in parts that hold all pairs of their i and about chunk points, kept of each place."""
    c = squeezed(np.floor(p / (radius * (1 + 1e-6) + 4 * np.spacing(np.abs(p).max()))), 1) + 1  # a little larger, for rounding
    span = c.max(axis=0) + 2
    code = (c[:, 0] * span[1] + c[:, 1]) * span[2] + c[:, 2]
    order = np.argsort(code, kind="stable")
    own, code, s = code[of], code[order], p[order]
    of = of[o := np.argsort(own, kind="stable")]
    target = own[o][:, None] + np.array([(dx * span[1] + dy) * span[2] for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left = np.searchsorted(code, target - 1, "left")
    count = np.searchsorted(code, target + 1, "right") - left
    points = np.concatenate([[0], np.cumsum(kept[order])])
    total = np.cumsum((points[left + count] - points[left]).sum(axis=1))
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, "right")))
        row, j = spread(left[at:to].ravel(), count[at:to].ravel())
        i = of[at + row // 9]
        d = p[i] - s[j]
        d *= d
        d2 = d[:, 0] + d[:, 1] + d[:, 2]
        ok = np.flatnonzero(d2 < limit if strict else d2 <= limit)
        yield of[at:to], i[ok], order[j[ok]], d2[ok]
        at = to


def nearest_capped(xyz: np.ndarray, tol: float, max_n: int, strict: bool = False, chunk: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), sorted by i: each point with itself and its nearest others within tol by (d2, j), max_n in all; the same as capped over directed_pairs, without all pairs.

    Points at the same place share a search, in which the first max_n points of each place are candidates, as later ones can't be among the nearest. Radii grow from tol / 8 on: whoever has max_n candidates within one is done.
    """
    n = len(xyz)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0]))
    p = xyz[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]).any(axis=1)])
    start = np.flatnonzero(new)
    place, p, kept = np.cumsum(new) - 1, p[start], np.minimum(np.diff(np.append(start, n)), max_n)
    found, left = [], np.arange(len(p))
    for radius in (tol / 8, tol / 3, tol):
        undone = [left[:0]]
        for of, a, b, d2 in _places_near(p, kept, radius, left, radius * radius, strict and radius == tol, chunk):
            row, at = spread(start[b], kept[b])
            a, j, d2 = a[row], order[at], d2[row]
            if radius < tol:
                full = np.zeros(len(p), bool)
                full[of] = np.bincount(a, minlength=len(p))[of] >= max_n
                undone.append(of[~full[of]])
                a, j, d2 = a[full[a]], j[full[a]], d2[full[a]]
            o = np.lexsort((j, d2, a))
            a, j = a[o], j[o]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            ok = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < max_n
            found.append(np.stack([a[ok], j[ok]]))
        left = np.concatenate(undone)
        if not len(left):
            break
    a, j = np.concatenate(found, axis=1)
    o = np.argsort(a, kind="stable")
    j, count = j[o], np.bincount(a, minlength=len(p))
    # a place's list for each of its points, without the point itself
    row, at = spread((np.cumsum(count) - count)[place], count[place])
    i, j, count = order[row], j[at], count[place]
    same = i == j
    passed = np.cumsum(same) - same
    begin = (np.cumsum(count) - count)[row]
    ok = ~same & (np.arange(len(i)) - begin - (passed - passed[begin]) < max_n - 1)
    i, j = np.concatenate([np.arange(n), i[ok]]), np.concatenate([np.arange(n), j[ok]])
    o = np.argsort(i, kind="stable")
    return i[o], j[o]


def seeded_labels(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, seeds): points are taken in order; one that no earlier seed covers becomes a seed and covers its neighbours; clusters are the components of the seeds' stars, named by their smallest point. i must be sorted."""
    start = np.searchsorted(i, np.arange(n + 1))
    covered = np.zeros(n, dtype=bool)
    seeds = []
    begin, end = start[:-1].tolist(), start[1:].tolist()
    for p in range(n):
        if not covered[p]:
            seeds.append(p)
            covered[p] = True
            covered[j[begin[p] : end[p]]] = True
    s = np.array(seeds, dtype=np.int64)
    mark = np.zeros(n, dtype=bool)
    mark[s] = True
    use = mark[i]
    return components(n, i[use], j[use]), s


def cluster_cloud(xyz: np.ndarray, tol: float, method: str, max_n: int = 0, strict: bool = False) -> np.ndarray:
    """Cluster of each point, as its smallest point number. Coordinates must be finite."""
    if method == "euclidean":
        return cell_components(xyz, tol, squeezed(np.floor(xyz / cell_side(tol)), REACH))[0]
    if max_n and method != "seeded_scan_order":
        i, j = nearest_capped(xyz, tol, max_n, strict)
    else:
        i, j, d2, k = directed_pairs(xyz, tol, strict)
        i, j = capped(i, j, d2, k, max_n, "scan_order")
    if method == "capped_graph":
        return components(len(xyz), i, j)
    return seeded_labels(len(xyz), i, j)[0]


def staged_cloud(xyz: np.ndarray, tol: float, max_n: int = 0, min_size: int = 1) -> tuple[np.ndarray, dict[str, float]]:
    """(cluster of each point, -1 below min_size; milliseconds) of a seeded clustering in stages: build (the grid), search (capped neighbours), merge (the walk and its components), final (sizes)."""
    marks = [time.perf_counter()]
    built = grid(xyz, tol) if len(xyz) else None
    marks.append(time.perf_counter())
    i, j = capped(*directed_pairs(xyz, tol, built=built), max_n, "nearest")
    marks.append(time.perf_counter())
    found, _ = seeded_labels(len(xyz), i, j)
    marks.append(time.perf_counter())
    sizes = np.bincount(found, minlength=len(xyz))
    found = np.where(sizes[found] >= min_size, found, -1)
    marks.append(time.perf_counter())
    return found, {n: (b - a) * 1000 for n, a, b in zip(("build_ms", "search_ms", "merge_ms", "final_ms"), marks, marks[1:], strict=False)}


def knn(xyz: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(indices, squared distances) of the k nearest points, itself included, by (distance, index).

    Rough distances of the centred cloud only choose the candidates: all points up to the k-th rough distance and the rounding error of either side.
    """
    n, k = len(xyz), min(k, len(xyz))
    index, dist = np.empty((n, k), np.int64), np.empty((n, k))
    if not k:
        return index, dist
    mid = xyz - xyz.mean(axis=0)
    sq = (mid * mid).sum(axis=1)
    error = 64 * np.finfo(np.float64).eps * float(sq.max())
    for a in range(0, n, rows):
        part = mid[a : a + rows]
        rough = sq[None] - 2 * part @ mid.T
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + error
        i, j = np.nonzero(rough <= limit[:, None])
        d = ((xyz[a + i] - xyz[j]) ** 2).sum(axis=1)
        o = np.lexsort((j, d, i))
        first = np.searchsorted(i, np.arange(len(part)))
        o = o[first[:, None] + np.arange(k)]
        index[a : a + rows], dist[a : a + rows] = j[o], d[o]
    return index, dist


def region_growing(xyz: np.ndarray, k: int, smooth_deg: float, curvature_limit: float, normal_k: int = 50) -> np.ndarray:
    """Region of each point: from the point of least curvature on, neighbours whose normals differ by less than smooth_deg join; those of a curvature below the limit go on growing."""
    n = len(xyz)
    region = np.full(n, -1, np.int64)
    if not n:
        return region
    near, _ = knn(xyz, normal_k)
    nb = xyz[near]
    d = nb - nb.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", d, d))
    normals, total = vectors[:, :, 0], values.sum(axis=1)
    curvature = np.where(total > 0, values[:, 0] / np.where(total > 0, total, 1), 0.0)
    near = near[:, :k] if k <= near.shape[1] else knn(xyz, k)[0]
    limit, count = np.cos(np.radians(smooth_deg)), 0
    for s in np.lexsort((np.arange(n), curvature)).tolist():
        if region[s] >= 0:
            continue
        region[s] = count
        queue = [s]
        while queue:
            p = queue.pop(0)
            for q in near[p].tolist():
                if region[q] < 0 and abs(float(normals[p] @ normals[q])) >= limit:
                    region[q] = count
                    if curvature[q] < curvature_limit:
                        queue.append(q)
        count += 1
    first = np.full(count, n)
    np.minimum.at(first, region, np.arange(n))
    return first[region]


def cloth(xyz: np.ndarray, resolution: float = 1.0, rigidness: int = 3, iterations: int = 500, step: float = 0.65, threshold: float = 0.5, slope_smooth: bool = False, gravity: float = 0.2) -> np.ndarray:
    """Ground mask by a cloth that falls on the inverted cloud (Zhang et al. 2016). Heights are z."""
    if not len(xyz):
        return np.zeros(0, bool)
    z = -xyz[:, 2]
    low = xyz[:, :2].min(axis=0) - 2 * resolution
    size = np.floor((xyz[:, :2].max(axis=0) + 2 * resolution - low) / resolution).astype(int) + 1
    at = np.round((xyz[:, :2] - low) / resolution).astype(int).clip(0, size - 1)
    floor = np.full(size, -np.inf)
    np.maximum.at(floor, (at[:, 0], at[:, 1]), z)
    while np.isinf(floor).any():  # empty cells take the mean of their filled neighbours
        pad = np.pad(floor, 1, constant_values=-np.inf)
        nb = np.stack([pad[1 + a : 1 + a + size[0], 1 + b : 1 + b + size[1]] for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
        ok = np.isfinite(nb)
        fill = np.isinf(floor) & ok.any(axis=0)
        floor[fill] = np.where(ok, nb, 0).sum(axis=0)[fill] / ok.sum(axis=0)[fill]
    h = np.full(size, z.max() + 0.05)
    old, free = h.copy(), np.ones(size, bool)
    pull = 1 - 0.5**rigidness
    for _ in range(iterations):
        new = np.where(free, h + (h - old) * 0.99 - gravity * step * step, h)
        old, h = h, new
        for axis in (0, 1):
            a, b = (np.s_[:-1], np.s_[1:]) if axis == 0 else (np.s_[:, :-1], np.s_[:, 1:])
            gap = h[b] - h[a]
            both, left, right = free[a] & free[b], free[a] & ~free[b], ~free[a] & free[b]
            move_a, move_b = np.zeros_like(h), np.zeros_like(h)
            move_a[a] = np.where(both, gap * pull / 2, np.where(left, gap * pull, 0)) / 2
            move_b[b] = np.where(both, -gap * pull / 2, np.where(right, -gap * pull, 0)) / 2
            h = h + move_a + move_b
        landed = h <= floor
        h = np.where(landed, floor, h)
        free &= ~landed
        if np.abs(h - old).max() < 0.005:
            break
    while slope_smooth:  # on gentle slopes the cloth follows the floor beside cells where it lies
        lies = np.pad(~free, 1)
        ground = np.pad(floor, 1)
        next_to = np.zeros(size, bool)
        for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            window = np.s_[1 + a : 1 + a + size[0], 1 + b : 1 + b + size[1]]
            next_to |= lies[window] & (np.abs(ground[window] - floor) < 0.3)
        sink = free & next_to & (h - floor < 0.3)
        if not sink.any():
            break
        h[sink] = floor[sink]
        free &= ~sink
    f = (xyz[:, :2] - low) / resolution
    i = np.floor(f).astype(int).clip(0, size - 2)
    u, v = (f - i).T
    height = h[i[:, 0], i[:, 1]] * (1 - u) * (1 - v) + h[i[:, 0] + 1, i[:, 1]] * u * (1 - v) + h[i[:, 0], i[:, 1] + 1] * (1 - u) * v + h[i[:, 0] + 1, i[:, 1] + 1] * u * v
    return np.abs(height - z) < threshold
