"""Slow, plain definitions the distributed results are checked against."""

from __future__ import annotations

import numpy as np


def distances(points: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(points)))
    for k in range(points.shape[1]):
        step = points[:, k][:, None] - points[:, k][None, :]
        total += step * step
    return np.sqrt(total)


def core_distances(points: np.ndarray, min_samples: int) -> np.ndarray:
    return np.sort(distances(points), axis=1)[:, min_samples]


def _tree_edges(points: np.ndarray, min_samples: int) -> list[tuple[float, int, int]]:
    gaps = distances(points)
    core = np.sort(gaps, axis=1)[:, min_samples]
    reach = np.maximum(gaps, np.maximum(core[:, None], core[None, :]))
    n = len(points)
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    label = list(range(n))
    tree = []
    for w, i, j in edges:
        a, b = label[i], label[j]
        if a != b:
            tree.append((w, i, j))
            label = [b if x == a else x for x in label]
    return tree


def _side(start: int, edges: list[tuple[float, int, int]]) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for _, i, j in edges:
            for here, there in ((i, j), (j, i)):
                if here == x and there not in seen:
                    seen.add(there)
                    todo.append(there)
    return seen


def density_clusters(points: np.ndarray, min_cluster_size: int, min_samples: int,
                     epsilon: float) -> list[frozenset[int]]:
    """The clusters as sets of row numbers, by cutting the tree from the top."""
    nodes: list[dict] = []

    def cut(members: set[int], birth: float, parent: int | None) -> int:
        me = len(nodes)
        nodes.append({"members": members, "birth": birth, "parent": parent, "children": [],
                      "stability": 0.0})
        edges = [e for e in tree if e[1] in members and e[2] in members]
        start = 1.0 / birth if birth else 0.0
        inside = set(members)
        while edges:
            # edges of one length go together
            w = edges[-1][0]
            while edges and edges[-1][0] == w:
                edges.pop()
            density = 1.0 / w if w > 0 else np.inf
            parts, left = [], set(inside)
            while left:
                part = _side(next(iter(left)), edges)
                left -= part
                parts.append(part)
            big = [p for p in parts if len(p) >= min_cluster_size]
            if len(big) == 1:
                if len(big[0]) < len(inside):
                    nodes[me]["stability"] += (density - start) * (len(inside) - len(big[0]))
                inside = big[0]
                edges = [e for e in edges if e[1] in inside and e[2] in inside]
                continue
            nodes[me]["stability"] += (density - start) * len(inside)
            for part in big:
                nodes[me]["children"].append(cut(part, w, me))
            return me
        if len(inside) >= min_cluster_size:
            nodes[me]["stability"] = np.inf  # copies that never part
        return me

    tree = _tree_edges(points, min_samples)
    cut(set(range(len(points))), 0.0, None)

    def best(k: int) -> tuple[float, list[int]]:
        below = [best(c) for c in nodes[k]["children"]]
        total = sum(b[0] for b in below)
        if below and (total > nodes[k]["stability"] or k == 0):
            return total, [s for b in below for s in b[1]]
        return nodes[k]["stability"], [k]

    chosen = [k for k in best(0)[1] if k != 0]
    widened = set()
    for k in chosen:
        if nodes[k]["birth"] < epsilon:
            while nodes[k]["parent"] != 0:
                k = nodes[k]["parent"]
                if nodes[k]["birth"] > epsilon:
                    break
        widened.add(k)
    return [frozenset(nodes[k]["members"]) for k in widened]
