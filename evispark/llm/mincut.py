"""Exact minimum cut for two labels on small sparse graphs."""

from __future__ import annotations

from collections import deque


def label(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least energy; ``True`` costs ``max(0, -unary)``, ``False`` ``max(0, unary)``, a cut edge its weight.

    ``unary`` is a node's terminal capacity: to the source where positive, to the sink where negative. A node whose
    terminal outweighs all its edges can't be cut from it, so it is contracted into the terminal, and its edges into its
    neighbours' terminals, until none is left; the rest is solved by augmenting paths. Ties go to ``False``.
    """
    n = len(unary)
    u = list(unary)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    out: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if out[i] is not None:
            continue
        total = sum(around[i].values())
        if u[i] > total or u[i] <= -total:
            out[i] = u[i] > total
            for j, w in around[i].items():
                u[j] += w if out[i] else -w
                del around[j][i]
                todo.append(j)
            around[i] = {}
    rest = [i for i in range(n) if out[i] is None]
    if rest:
        side = _max_flow(rest, u, around)
        for i in rest:
            out[i] = i in side
    return out


def _max_flow(nodes: list[int], u: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of the least cut nearest to the source."""
    s, t = -1, -2
    residual: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    residual[s], residual[t] = {}, {}
    for i in nodes:
        if u[i] > 0:
            residual[s][i], residual[i][s] = u[i], 0.0
        elif u[i] < 0:
            residual[i][t], residual[t][i] = -u[i], 0.0
    while True:
        parent = {s: s}
        queue = deque([s])
        while queue and t not in parent:
            i = queue.popleft()
            for j, c in residual[i].items():
                if c > 1e-12 and j not in parent:
                    parent[j] = i
                    queue.append(j)
        if t not in parent:
            return {i for i in parent if i >= 0}
        flow, j = float("inf"), t
        while j != s:
            flow = min(flow, residual[parent[j]][j])
            j = parent[j]
        j = t
        while j != s:
            residual[parent[j]][j] -= flow
            residual[j][parent[j]] = residual[j].get(parent[j], 0.0) + flow
            j = parent[j]
