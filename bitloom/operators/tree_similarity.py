"""Similarity of two dependency trees: greedy edge mapping and exact edit distance, in Arrow batches."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.trees import HEAVY_LABELS


@dataclass(frozen=True)
class Edge:
    """One edge: from source to target node, raw label."""

    source: int
    target: int
    label: str

    @property
    def main(self) -> str:
        return self.label.split(":")[0].lower()


class Tree:
    """A rooted tree: part of speech of each node, edges in row order."""

    def __init__(self, upos: dict[int, str | None], edges: list[Edge]):
        self.upos = upos
        rank: dict[int, int] = {}
        for e in edges:
            rank.setdefault(e.source, len(rank))
            rank.setdefault(e.target, len(rank))
        self.edges = sorted(edges, key=lambda e: rank[e.source])
        self.parent = {e.target: e for e in edges}
        self.children: dict[int, list[Edge]] = {}
        for e in edges:
            self.children.setdefault(e.source, []).append(e)
        tops = [n for n in upos if n not in self.parent]
        self.root = tops[0] if tops else None

    @classmethod
    def of_tokens(cls, tokens: list[dict], with_root: bool = False) -> Tree:
        """Tree over tokens; heads outside are roots. with_root adds the artificial node 0."""
        upos = {t["id"]: t["upos"] for t in tokens}
        if with_root:
            upos = {0: None} | upos
        edges = [Edge(t["head"], t["id"], t["deprel"] or "") for t in tokens if t["head"] in upos]
        return cls(upos, edges)

    def route(self, node: int) -> list[str]:
        """Main labels from the root to a node."""
        out: list[str] = []
        seen = set()
        while node in self.parent and node not in seen:
            seen.add(node)
            out.append(self.parent[node].main)
            node = self.parent[node].source
        return out[::-1]

    def labels_below(self, node: int) -> Counter[str]:
        return Counter(e.main for e in self.children.get(node, ()))


def sequence_distance(a: list[str], b: list[str]) -> int:
    """Edits between two label sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _best(edges: list[Edge], score) -> list[Edge]:  # noqa: ANN001
    scores = [score(e) for e in edges]
    top = max(scores)
    return [e for e, s in zip(edges, scores, strict=True) if s == top]


def map_edges(one: Tree, two: Tree) -> list[tuple[Edge, Edge]]:
    """Edges of ``one`` with their counterparts in ``two``, one to one.

    Heavy labels go first. Counterparts have the same main label; ties go to equal parts of speech at both ends, then
    to the closest route from the root, then to the most common labels below the target (if still tied: below the
    source, of all that were tied before), then to the first.
    """
    heavy_first = lambda t: sorted(t.edges, key=lambda e: e.label not in HEAVY_LABELS)
    left, mapping = heavy_first(two), []
    for e in heavy_first(one):
        found = [c for c in left if c.main == e.main]
        if len(found) > 1:
            found = _best(found, lambda c: (one.upos[e.source] == two.upos[c.source]) + (one.upos[e.target] == two.upos[c.target]))  # noqa: B023
        if len(found) > 1:
            here = one.route(e.source)
            found = _best(found, lambda c: -sequence_distance(here, two.route(c.source)))  # noqa: B023
        if len(found) > 1:
            below = one.labels_below(e.target)
            by_target = _best(found, lambda c: (below & two.labels_below(c.target)).total())  # noqa: B023
            if len(by_target) > 1:
                around = one.labels_below(e.source)
                by_target = _best(found, lambda c: (around & two.labels_below(c.source)).total())  # noqa: B023
            found = by_target
        if found:
            mapping.append((e, found[0]))
            left.remove(found[0])
    return mapping


def edge_jaccard(one: Tree, two: Tree) -> float:
    """Mapped edges among all edges of both trees; 1 if neither has any."""
    mapped, total = len(map_edges(one, two)), len(one.edges) + len(two.edges)
    return mapped / (total - mapped) if total else 1.0


#: Search steps of the edit distance, and of the second search for the pairs that the first one did not finish.
BUDGETS = (2_000, 200_000)


def edit_distance(one: Tree, two: Tree, max_expansions: int = BUDGETS[1]) -> tuple[float, bool]:
    """Edit distance of two trees with their roots matched to each other, and whether the search was cut short.

    Changing the part of speech of a node or the main label of an edge costs 2; adding or deleting a node or edge 1,
    but 0 for punctuation (part of speech PUNCT; raw label punct). A best-first search over assignments of the nodes
    of ``one``, with a bound from the parts of speech and the edge labels that are left. A search that needs more than
    max_expansions steps is cut short and gives the cheapest assignment seen, so the distance is then an upper limit;
    the result never depends on the clock.
    """
    node = lambda p: 0 if p == "PUNCT" else 1
    edge = lambda e: 0 if e.label == "punct" else 1
    first = [one.root, *(n for n in one.upos if n != one.root)]
    second = [two.root, *(n for n in two.upos if n != two.root)]
    edges1 = {(e.source, e.target): e for e in one.edges}
    edges2 = {(e.source, e.target): e for e in two.edges}
    touching: dict[int, list[Edge]] = {n: [] for n in second}
    for e in two.edges:
        touching[e.source].append(e)
        touching[e.target].append(e)

    def edge_cost(a: Edge | None, b: Edge | None) -> int:
        if a is None or b is None:
            return edge(a or b) if (a or b) else 0
        return 0 if a.main == b.main else 2

    def added(done: Sequence[tuple[int, int | None]], n: int, to: int | None) -> int:
        """Cost of the edges between a newly assigned node and those assigned before."""
        cost = 0
        for m, other in done:
            for x, y in ((m, n), (n, m)):
                a = edges1.get((x, y))
                b = edges2.get((other, to) if x == m else (to, other)) if other is not None and to is not None else None
                cost += edge_cost(a, b)
        return cost

    def finish(done: Sequence[tuple[int, int | None]]) -> int:
        """Nodes of ``two`` that nothing was assigned to, and their edges."""
        free = set(second) - {t for _, t in done}
        return sum(node(two.upos[n]) for n in free) + sum(edge(e) for e in two.edges if e.source in free or e.target in free)

    # what is left is counted by part of speech and by main label; a kind with a free member costs nothing in the bound
    kinds = {("n", p): node(p) for p in (*one.upos.values(), *two.upos.values())}
    for e in (*one.edges, *two.edges):
        kinds["e", e.main] = min(kinds.get(("e", e.main), 1), edge(e))
    place = {k: i for i, k in enumerate(kinds)}
    price = list(kinds.values())
    left_one = []
    for k in range(len(first) + 1):
        rest = set(first[k:])
        counts = Counter(place["n", one.upos[n]] for n in rest) + Counter(place["e", e.main] for e in one.edges if e.source in rest or e.target in rest)
        left_one.append([counts[i] for i in range(len(price))])

    def bound(k: int, left_two: tuple[int, ...]) -> int:
        return sum(abs(x - y) * c for x, y, c in zip(left_one[k], left_two, price, strict=True))

    def without(left_two: tuple[int, ...], used: set[int | None], to: int | None) -> tuple[int, ...]:
        if to is None:
            return left_two
        out = list(left_two)
        out[place["n", two.upos[to]]] -= 1
        for e in touching[to]:
            if (e.target if e.source == to else e.source) in used:
                out[place["e", e.main]] -= 1
        return tuple(out)

    start = ((first[0], second[0]),)
    base = 0 if one.upos[first[0]] == two.upos[second[0]] else 2
    whole = Counter(place["n", p] for p in two.upos.values()) + Counter(place["e", e.main] for e in two.edges)
    rest = without(tuple(whole[i] for i in range(len(price))), set(), second[0])
    # something complete to begin with: all other nodes of one deleted
    best, full = base, list(start)
    for n in first[1:]:
        best += node(one.upos[n]) + added(full, n, None)
        full.append((n, None))
    best += finish(full)
    if len(first) == 1:
        return float(best), False
    tick, steps = count(), 0
    heap = [(base + bound(1, rest), -1, next(tick), base, start, rest)]
    while heap:
        estimate, _, _, cost, done, rest = heapq.heappop(heap)
        if estimate >= best:
            break
        steps += 1
        if steps > max_expansions:
            return float(best), True
        n, used, last = first[len(done)], {t for _, t in done}, len(done) + 1 == len(first)
        for to in [*(x for x in second if x not in used), None]:
            step = (0 if one.upos[n] == two.upos[to] else 2) if to is not None else node(one.upos[n])
            c = cost + step + added(done, n, to)
            if last:
                best = min(best, c + finish((*done, (n, to))))
                continue
            after = without(rest, used, to)
            guess = c + bound(len(done) + 1, after)
            if guess < best:
                heapq.heappush(heap, (guess, -len(done) - 1, next(tick), c, (*done, (n, to)), after))
    return float(best), False


def ged_similarity(one: Tree, two: Tree, budgets: Sequence[int] = BUDGETS) -> tuple[float, bool]:
    """1 for equal trees, 0 for nothing in common (the distance against deleting one tree and adding the other), and
    whether every search was cut short: the similarity is then a lower limit.

    Roots of different parts of speech count 1.
    """
    extra = 0
    if one.upos[one.root] != two.upos[two.root]:
        one = Tree({**one.upos, one.root: two.upos[two.root]}, one.edges)
        extra = 1
    most = 2 * len(one.upos) - 1 + 2 * len(two.upos) - 1
    for steps in budgets:
        distance, cut = edit_distance(one, two, steps)
        if not cut:
            break
    return (most - distance - extra) / most, cut


def pair_similarity(kind: str, a: list[dict] | None, b: list[dict] | None) -> tuple[float | None, bool]:
    """Similarity of two subtrees given as tokens (null if one is missing or empty), and whether it is a lower limit only."""
    if a is None or b is None or not len(a) or not len(b):
        return None, False
    one, two = Tree.of_tokens(list(a)), Tree.of_tokens(list(b))
    if kind == "edge_mapper":
        return edge_jaccard(one, two), False
    if kind == "ged":
        return ged_similarity(one, two)
    raise ValueError(f"unknown similarity {kind!r}")


def similarity(kind: str, a: Column, b: Column) -> Column:
    """``struct<similarity, cut_short>`` of pair_similarity (``edge_mapper`` or ``ged``) over two arrays of tokens, in Arrow batches."""

    @F.pandas_udf("similarity double, cut_short boolean")
    def of(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [pair_similarity(kind, p, q) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame({"similarity": pd.Series([s for s, _ in found], dtype="float64"), "cut_short": [c for _, c in found]})

    return of(a, b)


def jaccard_from_sizes(common: Column, src_nodes: Column, tgt_nodes: Column) -> Column:
    """Jaccard value from the mapped edges and the numbers of nodes; 1 if there is no edge at all."""
    edges = src_nodes - 1 + tgt_nodes - 1 - common
    return F.when((src_nodes <= 1) & (tgt_nodes <= 1), F.lit(1.0)).otherwise(F.try_divide(common.cast("double"), edges.cast("double")))
