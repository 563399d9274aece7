"""Simple cycles of a directed graph, shortest first; no Spark here."""

from __future__ import annotations

from collections.abc import Iterator


def cores(edges: dict[int, list[int]]) -> list[set[int]]:
    """Strongly connected components of two nodes or more (Tarjan, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    out = []
    for root in edges:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(edges[root]))]
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(edges.get(to, ()))))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    found = set()
                    while node not in found:
                        found.add(stack.pop())
                    on -= found
                    if len(found) > 1:
                        out.append(found)
    return out


def _back(into: dict[int, list[int]], start: int, most: int) -> dict[int, int]:
    """Steps to `start`, up to `most`, from the nodes above it."""
    far, edge = {start: 0}, [start]
    for step in range(1, most + 1):
        edge = [x for node in edge for x in into[node] if x > start and x not in far and not far.update({x: step})]
        if not edge:
            break
    return far


def _paths(edges: dict[int, list[int]], far: dict[int, int], start: int, length: int) -> Iterator[list[int]]:
    """Cycles of `length` through `start` over nodes above it, in the order of their nodes."""
    path, tried = [start], [iter(edges[start])]
    while tried:
        for to in tried[-1]:
            if to == start and len(path) == length:
                yield list(path)
            elif to > start and to not in path and far.get(to, length) <= length - len(path):
                path.append(to)
                tried.append(iter(edges[to]))
                break
        else:
            tried.pop()
            path.pop()


def shortest_cycles(pairs: list[tuple[int, int]], most: int) -> list[list[int]]:
    """The first `most` simple cycles by length, then by nodes from the least one. Nodes are numbers in the order that counts."""
    edges: dict[int, list[int]] = {}
    for a, b in sorted(set(pairs)):
        if a != b:
            edges.setdefault(a, []).append(b)
    inside = [(c, {a: [b for b in edges[a] if b in c] for a in c}) for c in cores(edges)]
    starts = sorted((a, k) for k, (c, _) in enumerate(inside) for a in c)
    into = []
    for _, own in inside:
        back: dict[int, list[int]] = {a: [] for a in own}
        for a, to in own.items():
            for b in to:
                back[b].append(a)
        into.append(back)
    out: list[list[int]] = []
    length, longest = 2, max((len(c) for c, _ in inside), default=0)
    #: starts that no cycle goes through, seen from above them, are not tried again
    while length <= longest and len(out) < most and starts:
        again = []
        for start, k in starts:
            own = inside[k][1]
            far = _back(into[k], start, length - 1)
            closes = [far[b] for b in own[start] if b in far and b > start]
            if len(far) > 1 and any(any(x > start and x not in far for x in into[k][node]) for node in far if far[node] == length - 1) or closes:
                again.append((start, k))
            if closes and min(closes) < length:
                for path in _paths(own, far, start, length):
                    out.append(path)
                    if len(out) == most:
                        return out
        starts = again
        length += 1
    return out
