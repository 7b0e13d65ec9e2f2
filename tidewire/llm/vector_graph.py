"""A robust-pruned directed graph over vectors, in numpy: building, and beam search for the largest inner product.

Inner products become Euclidean distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, which is 0
for queries. Vectors are first divided by M in double precision, so magnitudes of any size keep their resolution. Points are inserted in batches that double: greedy beam searches over the graph so far propose neighbours,
relaxed distance pruning keeps those that no kept neighbour is closer to by the factor alpha, reverse edges are added, and
overfull nodes are pruned again. All searches of a batch advance in lock step.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class GraphSettings:
    degree: int = 48
    beam: int = 96
    alpha: float = 1.2
    expand: int = 4
    batch: int = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe for components of any finite size; there are no zero rows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lift(x: np.ndarray) -> np.ndarray:
    """float32 rows, all of length 1, with the coordinate that makes nearest mean largest inner product."""
    x = x / np.abs(x).max()
    n = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x / np.sqrt(n.max()), np.sqrt(np.maximum(1 - n / n.max(), 0))[:, None]], 1).astype(np.float32)


def search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, s: GraphSettings) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query at the end, nearest first: ids (-1: none) and squared distances without |q|^2."""
    norms = np.einsum("ij,ij->i", points, points)
    b, none = len(queries), len(points)
    ids = np.full((b, s.beam), none)
    dist = np.full((b, s.beam), np.inf, np.float32)
    done = np.ones((b, s.beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = norms[start] - 2 * (queries @ points[start])
    seen = np.zeros((b, none + 1), bool)
    seen[:, start] = seen[:, none] = True
    live = np.arange(b)
    rows = np.arange(b)[:, None]
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argsort(open_, 1, kind="stable")[:, : s.expand]
        chosen = np.where(np.isinf(np.take_along_axis(open_, pick, 1)), none, np.take_along_axis(ids[live], pick, 1))
        done[live[:, None], pick] = True
        near = edges[chosen].reshape(len(live), -1)
        fresh = ~seen[live[:, None], near]
        near = np.where(fresh, near, none)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = none
        seen[live[:, None], near] = True
        d = np.full(near.shape, np.inf, np.float32)
        at, col = np.nonzero(near < none)
        to = near[at, col]
        d[at, col] = norms[to] - 2 * np.einsum("ij,ij->i", points[to], queries[live[at]])
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argpartition(all_d, s.beam - 1, 1)[:, : s.beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near == none], 1), keep, 1)
        live = live[~done[live].all(1)]
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    return np.where(ids == none, -1, ids), dist


def prune(points: np.ndarray, nodes: np.ndarray, near: np.ndarray, s: GraphSettings) -> np.ndarray:
    """Of each node's proposed neighbours (rows of ids, -1: none), at most `degree`: the nearest first, then only those
    that are closer to the node than alpha times to any kept one."""
    n = len(points)
    near = np.where((near == nodes[:, None]) | (near < 0), n, near)
    near.sort(1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = n
    padded = np.concatenate([points, np.zeros((1, points.shape[1]), np.float32)])
    x = padded[near]
    own = points[nodes]
    d = np.square(x - own[:, None]).sum(2)
    d[near == n] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, : 2 * s.beam]
    near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    x = np.take_along_axis(x, order[:, :, None], 1)
    sq = np.einsum("bij,bij->bi", x, x)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    alive = ~np.isinf(d)
    out = np.full((len(nodes), s.degree), n)
    rows = np.arange(len(nodes))
    for k in range(s.degree):
        first = np.argmax(alive, 1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, k] = near[rows, first][has]
        alive[rows, first] = False
        alive &= ~has[:, None] | (s.alpha**2 * between[rows, first] > d)
    return out


def build(points: np.ndarray, s: GraphSettings = GraphSettings()) -> tuple[np.ndarray, int]:
    """The out-edges of each point (n + 1 rows; the number of points stands for none) and the start point."""
    n = len(points)
    edges = np.full((n + 1, s.degree), n)
    start = int(np.square(points - points.mean(0)).sum(1).argmin())
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, step = 1, 1
    while at < n:
        new = order[at : at + min(step, s.batch)]
        beam, _ = search(points, edges, start, points[new], s)
        # Points of one batch do not see each other in the graph yet; a few of its nearest own points are proposed too.
        mates = new[np.argsort(np.square(points[new]).sum(1)[None, :] - 2 * (points[new] @ points[new].T), 1)[:, : s.degree // 2]]
        edges[new] = prune(points, new, np.concatenate([beam, mates], 1), s)
        src, dst = np.repeat(new, s.degree), edges[new].ravel()
        src, dst = src[dst < n], dst[dst < n]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(targets), int(count.max()) if len(count) else 1), n)
        col = np.arange(len(dst)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(targets)), count), col] = src
        for i in range(0, len(targets), s.batch):
            t = targets[i : i + s.batch]
            near = np.concatenate([edges[t], wide[i : i + s.batch, : int(count[i : i + s.batch].max())]], 1)
            near = np.where(near == n, -1, near)
            few = (near >= 0).sum(1) <= s.degree
            near.sort(1)
            near = near[:, ::-1]
            edges[t[few]] = np.where(near[few, : s.degree] < 0, n, near[few, : s.degree])
            if (~few).any():
                edges[t[~few]] = prune(points, t[~few], near[~few].copy(), s)
        at += len(new)
        step *= 2
    return edges, start


def nearest(x: np.ndarray, points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, k: int, s: GraphSettings) -> tuple[np.ndarray, np.ndarray]:
    """Of each query, the k rows of x found with the largest inner products, largest first: places (-1: none) and products
    in double precision. `points` are the rows lifted.

    A beam search with twice the beam follows as long as it changes the k rows found, up to all rows, so the beam fits
    the data. Equal products go to the smaller place.
    """
    q = np.concatenate([unit(queries), np.zeros((len(queries), 1))], 1).astype(np.float32)
    best = np.full((len(q), k), -1)
    score = np.full((len(q), k), -np.inf)
    live, beam = np.arange(len(q)), max(s.beam, k)
    while len(live):
        found, _ = search(points, edges, start, q[live], replace(s, beam=beam, expand=max(s.expand, beam // 16)))
        new, far = np.full((len(live), k), -1), np.full((len(live), k), -np.inf)
        for i, near in enumerate(found):
            near = np.sort(near[near >= 0])
            with np.errstate(over="ignore", invalid="ignore"):
                product = np.einsum("ij,j->i", x[near], queries[live[i]])
            product = np.where(np.isnan(product), -np.inf, product)
            top = np.argsort(-product, kind="stable")[:k]
            new[i, : len(top)], far[i, : len(top)] = near[top], product[top]
        changed = (new != best[live]).any(1)
        best[live], score[live] = new, far
        if beam >= len(x):
            break
        live, beam = live[changed], 2 * beam
    return best, score
