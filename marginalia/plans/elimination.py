"""Orders in which to sum variables out of a product of tables.

Catalyst orders joins but never moves an aggregate below them, so the order is
chosen here, from scopes and sizes alone, and the DataFrames are built in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from typing import Protocol


class Planner(Protocol):
    """Gives an order of all variables of the scopes but the kept ones."""

    def __call__(self, scopes: Iterable[Iterable[str]], sizes: Mapping[str, int], keep: Iterable[str] = ()) -> list[str]: ...


def neighbours(scopes: Iterable[Iterable[str]]) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for s in map(set, scopes):
        for v in s:
            found.setdefault(v, set()).update(s - {v})
    return found


def fill(graph: Mapping[str, set[str]], v: str, weight=lambda a, b: 1.0) -> float:
    near = sorted(graph[v])
    return sum(weight(a, b) for i, a in enumerate(near) for b in near[i + 1 :] if b not in graph[a])


#: What to minimise: a tuple per variable, from the graph and the logarithms of the variables' sizes.
OBJECTIVES = {
    "min_degree": lambda g, v, s: (len(g[v]),),
    "min_fill": lambda g, v, s: (fill(g, v),),
    "min_degree_then_fill": lambda g, v, s: (len(g[v]), fill(g, v)),
    "min_fill_then_degree": lambda g, v, s: (fill(g, v), len(g[v])),
    "min_weighted_degree": lambda g, v, s: (sum(s[n] for n in g[v]),),
    "min_weighted_fill": lambda g, v, s: (fill(g, v, lambda a, b: s[a] + s[b]),),
    "min_traditional_weighted_fill": lambda g, v, s: (fill(g, v, lambda a, b: s[a] * s[b]),),
}


def order(scopes: Iterable[Iterable[str]], sizes: Mapping[str, int], objective: str = "min_fill_then_degree", keep: Iterable[str] = ()) -> tuple[list[str], float]:
    """An elimination order of all variables not kept, and log2 of its largest table. Ties go by name."""
    graph = neighbours(scopes)
    logs = {v: math.log2(max(1, sizes[v])) for v in graph}
    left, found, largest = set(graph) - set(keep), [], 0.0
    while left:
        v = min(left, key=lambda x: (*OBJECTIVES[objective](graph, x, logs), x))
        near = graph.pop(v)
        largest = max(largest, logs[v] + sum(logs[n] for n in near))
        for n in near:
            graph[n] |= near - {n}
            graph[n].discard(v)
        found.append(v)
        left.discard(v)
    return found, largest


def _remove(graph: dict[str, set[str]], v: str) -> None:
    near = graph.pop(v)
    for n in near:
        graph[n] |= near - {n}
        graph[n].discard(v)


def _almost_simplicial(graph: Mapping[str, set[str]], v: str) -> bool:
    """Whether all neighbours but one are connected with each other."""
    open_pairs = [(a, b) for a in graph[v] for b in graph[v] if a < b and b not in graph[a]]
    return not open_pairs or bool(set.intersection(*map(set, open_pairs)))


def twig_prefix(scopes: Iterable[Iterable[str]], keep: Iterable[str] = ()) -> list[str]:
    """Variables with at most one neighbour, again and again: an order may always begin with them."""
    graph, found, kept = neighbours(scopes), [], set(keep)
    while twigs := sorted(v for v in graph if len(graph[v]) <= 1 and v not in kept):
        _remove(graph, twigs[0])
        found.append(twigs[0])
    return found


def optimal_prefix(scopes: Iterable[Iterable[str]], keep: Iterable[str] = ()) -> list[str]:
    """Variables that some best order, by width, may begin with.

    They are simplicial (all neighbours are connected), or almost so with no
    more neighbours than the width known to be needed, which is the largest
    number of neighbours of a simplicial variable met so far.
    """
    graph, found, least, kept = neighbours(scopes), [], 0, set(keep)
    while True:
        free = sorted(v for v in graph if v not in kept)
        simplicial = next((v for v in free if fill(graph, v) == 0), None)
        v = simplicial or next((x for x in free if len(graph[x]) <= least and _almost_simplicial(graph, x)), None)
        if v is None:
            return found
        if simplicial:
            least = max(least, len(graph[v]))
        _remove(graph, v)
        found.append(v)


#: Planners by name: an order from scopes, sizes and the variables kept.
PLANNERS: dict[str, Planner] = {name: lambda scopes, sizes, keep=(), o=name: order(scopes, sizes, o, keep)[0] for name in OBJECTIVES}


def planned(scopes: Iterable[Iterable[str]], sizes: Mapping[str, int], planner: str | Planner = "best", prefix: str | None = None, keep: Iterable[str] = ()) -> list[str]:
    """An order by a planner or its name, ``best`` for the best of all, after a ``twig`` or ``optimal`` prefix.

    A planner that leaves a variable out, or gives one twice, is an error.
    """
    scopes = [tuple(s) for s in scopes]
    first = {"twig": twig_prefix, "optimal": optimal_prefix, None: lambda *_: []}[prefix](scopes, keep)
    graph = neighbours(scopes)
    for v in first:
        _remove(graph, v)
    rest = [(v, n) for v, near in graph.items() for n in near] + [(v,) for v in graph]
    chosen = planner if callable(planner) else best_order if planner == "best" else PLANNERS[planner]
    found = list(chosen(rest, sizes, keep))
    if sorted(found) != sorted(v for v in graph if v not in set(keep)):
        raise ValueError(f"not an order of all variables to sum out: {found}")
    return first + found


def maximal_tree(scopes: Iterable[Iterable[str]], sizes: Mapping[str, int]) -> tuple[list[frozenset], list[int | None]]:
    """The maximal clusters of the best order, joined into a tree by the largest separators, and the parent of each.

    The root of each tree is its smallest cluster, and a parent comes before
    its children.
    """
    every = join_tree(scopes, sizes)[0]
    clusters = sorted({c for c in every if not any(c < d for d in every)}, key=lambda c: (sum(math.log2(max(1, sizes[v])) for v in c), sorted(c)))
    found: list[frozenset] = []
    parents: list[int | None] = []
    left = list(clusters)
    while left:
        best = max(((len(c & f), -k, -left.index(c)) for c in left for k, f in enumerate(found)), default=(0, 0, 0))
        c = left[-best[2]] if best[0] else left[0]
        found.append(c)
        parents.append(-best[1] if best[0] else None)
        left.remove(c)
    return found, parents


def best_order(scopes: Iterable[Iterable[str]], sizes: Mapping[str, int], keep: Iterable[str] = ()) -> list[str]:
    """The order with the smallest largest table among all objectives."""
    scopes = [tuple(s) for s in scopes]
    return min((order(scopes, sizes, o, keep) for o in OBJECTIVES), key=lambda x: x[1])[0]


def join_tree(scopes: Iterable[Iterable[str]], sizes: Mapping[str, int]) -> tuple[list[frozenset], list[int | None]]:
    """Clusters of an elimination and the parent of each; a parent comes after its children."""
    scopes = [tuple(s) for s in scopes]
    graph = neighbours(scopes)
    sequence = best_order(scopes, sizes)
    place = {v: k for k, v in enumerate(sequence)}
    clusters, parents = [], []
    for v in sequence:
        near = graph.pop(v)
        for n in near:
            graph[n] |= near - {n}
            graph[n].discard(v)
        clusters.append(frozenset(near | {v}))
        parents.append(min((place[n] for n in near), default=None))
    return clusters, parents
