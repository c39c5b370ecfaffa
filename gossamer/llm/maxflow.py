"""Minimum cuts of small graphs, exactly, in plain Python.

``min_cut`` labels vertices so that the sum of unary costs and of cut edges is least. Most vertices of a page graph are decided by
their own cost alone, so exact reduction comes first: a vertex whose cost outweighs all its open edges has that label in some
minimum cut, and its edges turn into costs of its neighbours. Only what stays open goes through max-flow (shortest augmenting paths).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

EPS = 1e-9


def min_cut(unary: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """A label for each vertex. unary[i] > 0 is the cost of False, -unary[i] > 0 the cost of True; an edge costs w if its ends differ.

    Ties go to False. Edges to itself and weights of 0 or less don't count. No vertex gives an empty list.
    """
    n = len(unary)
    cost = list(unary)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    open_w = [0.0] * n
    for i, j, w in edges:
        if i != j and w > 0:
            near[i].append((j, w))
            near[j].append((i, w))
            open_w[i] += w
            open_w[j] += w
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(cost[i]) >= open_w[i] - EPS]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        mine = label[i] = cost[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                open_w[j] -= w
                cost[j] += w if mine else -w
                if abs(cost[j]) >= open_w[j] - EPS:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source_side = _source_side(rest, cost, near, label)
        for i in rest:
            label[i] = i in source_side
    return [bool(x) for x in label]


def _source_side(rest: list[int], cost: list[float], near: list[list[tuple[int, float]]], label: list[bool | None]) -> set[int]:
    """Vertices that the source still reaches once the flow among the open vertices is greatest."""
    s, t = -1, -2
    left: dict[int, dict[int, float]] = {v: {} for v in (s, t, *rest)}
    for i in rest:
        for j, w in near[i]:
            if label[j] is None:
                left[i][j] = left[i].get(j, 0.0) + w
        a, b = (s, i) if cost[i] > 0 else (i, t)
        left[a][b] = abs(cost[i])
        left[b].setdefault(a, 0.0)
    while True:
        came = {s: s}
        line = deque([s])
        while line and t not in came:
            v = line.popleft()
            for u, c in left[v].items():
                if c > EPS and u not in came:
                    came[u] = v
                    line.append(u)
        if t not in came:
            return {v for v in came if v >= 0}
        path, v = [], t
        while v != s:
            path.append((came[v], v))
            v = came[v]
        f = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= f
            left[b][a] = left[b].get(a, 0.0) + f
