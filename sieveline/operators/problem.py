"""One task's nodes with dependencies: the walks and the exact search that a task of Spark runs on one group.

Of a closed set the objective is a sum over its nodes, as a chosen node brings its dependencies with it: value and the bonus
for each dependency. Sums are kept as whole numbers of 1e-12, so that neither order nor machine changes a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from fractions import Fraction

import numpy as np
import pandas as pd

#: Fixed value: two objectives that differ by less are equal.
TOLERANCE = 1e-12
#: Explored nodes after which the exact search gives its best set, and how many sets it compares one by one before it searches.
EXPLORED, FEW = 2000, 500
UNIT = 10**12
LINES = ("start_line", "end_line")
OPTIMAL, HEURISTIC, STOPPED, INFEASIBLE = "optimal", "heuristic", "feasible_timeout", "infeasible"


def max_closure(weight: list[int], deps: list[list[int]], nodes: Iterable[int]) -> set[int]:
    """Of the closed subsets of nodes one of the greatest weight, by a minimum cut: what the source still reaches. deps stay inside nodes."""
    nodes = list(nodes)
    source, sink = len(weight), len(weight) + 1
    graph: dict[int, dict[int, int]] = {i: {} for i in (*nodes, source, sink)}
    whole = 1 + sum(weight[i] for i in nodes if weight[i] > 0)
    for i in nodes:
        a, b, room = (source, i, weight[i]) if weight[i] > 0 else (i, sink, -weight[i])
        if room:
            graph[a][b], graph[b][a] = room, graph[b].get(a, 0)
        for d in deps[i]:
            graph[i][d] = whole
            graph[d].setdefault(i, 0)
    while True:
        level, queue = {source: 0}, [source]
        for i in queue:
            for j, room in graph[i].items():
                if room > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        left = {i: list(graph[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(graph[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    graph[a][b] -= flow
                    graph[b][a] += flow
                path = path[: 1 + next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if not graph[a][b])]
            elif left[i]:
                j = left[i][-1]
                if graph[i][j] > 0 and level.get(j) == level[i] + 1:
                    path.append(j)
                else:
                    left[i].pop()
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


class Problem:
    """rows (a frame, or lists by column): node_id, cost, value, relevance, uri, deps and, if there are any, mandatory and allowed (a task's own), start_line, end_line."""

    def __init__(self, rows: pd.DataFrame | dict[str, list], allowance: int, dependency_weight: float = 0.1):
        lists = rows if isinstance(rows, dict) else {c: rows[c].tolist() for c in rows.columns}
        order = sorted(range(len(lists["node_id"])), key=lists["node_id"].__getitem__)
        rows = {c: [x[k] for k in order] for c, x in lists.items()}
        number = lambda name, none: [none if x is None or x != x else x for x in rows[name]]
        self.ids, relevance = rows["node_id"], number("relevance", float("nan"))
        self.cost, self.value = dict(zip(self.ids, map(int, rows["cost"]), strict=True)), dict(zip(self.ids, number("value", float("nan")), strict=True))
        lines = [number(c, 0) for c in LINES if c in rows]
        self.key = {i: (-r, c, u, *place, i) for i, r, c, u, *place in zip(self.ids, relevance, rows["cost"], rows["uri"], *lines, strict=True)}
        #: The order of what is chosen: value before relevance and the rest.
        self.place = {i: (-round(v, 9), *self.key[i]) for i, v in self.value.items()}
        self.deps = {i: [d for d in ds if d in self.cost] for i, ds in zip(self.ids, rows["deps"], strict=True)}
        self.allowance, self.weight = allowance, dependency_weight
        of = lambda name, default: {i for i, x in zip(self.ids, rows[name], strict=True) if x} if name in rows else default
        self.mandatory, self.allowed = of("mandatory", set()), of("allowed", set(self.ids))
        place = {i: k for k, i in enumerate(self.ids)}
        self._deps = [sorted({place[d] for d in self.deps[i]}) for i in self.ids]
        self._users: list[list[int]] = [[] for _ in self.ids]
        for k, ds in enumerate(self._deps):
            for d in ds:
                self._users[d].append(k)
        self._cost = [self.cost[i] for i in self.ids]
        self._gain = [round(self.value[i] * UNIT) + len(ds) * round(dependency_weight * UNIT) for i, ds in zip(self.ids, self._deps, strict=True)]
        self.status, self.gap, self.explored = HEURISTIC, None, 0

    def _reach(self, start: Iterable[int], links: list[list[int]], without=frozenset(), most: int | None = None) -> set[int] | None:
        """What links lead to from start, past no node of ``without``; nothing if it costs more than ``most``."""
        found = {k for k in start if k not in without}
        stack, cost = list(found), sum(self._cost[k] for k in found)
        while stack:
            for d in links[stack.pop()]:
                if d not in found and d not in without:
                    found.add(d)
                    stack.append(d)
                    cost += self._cost[d]
            if most is not None and cost > most:
                return None
        return found

    def _named(self, chosen: Iterable[int]) -> frozenset:
        return frozenset(self.ids[k] for k in chosen)

    def closure(self, node) -> frozenset:
        return self._named(self._reach([self.ids.index(node)], self._deps))

    def total(self, chosen) -> int:
        return sum(self.cost[i] for i in chosen)

    def objective(self, chosen) -> float:
        return sum(self.value[i] for i in chosen) + self.weight * sum(d in chosen for i in chosen for d in set(self.deps[i]))

    def required(self) -> set[int] | None:
        """The closure of the mandatory nodes; nothing if it isn't allowed or doesn't fit, with the status infeasible."""
        found = self._reach((k for k, i in enumerate(self.ids) if i in self.mandatory), self._deps, most=self.allowance)
        if found is None or not self._named(found) <= self.allowed:
            self.status = INFEASIBLE
            return None
        return found

    def _open(self, chosen: set[int]) -> dict[int, set[int]]:
        """For each node that can still be taken, its cluster: its closure without what is chosen."""
        barred = self._reach((k for k, i in enumerate(self.ids) if i not in self.allowed), self._users)
        room = self.allowance - sum(self._cost[k] for k in chosen)
        clusters = ((k, self._reach([k], self._deps, chosen, room)) for k in range(len(self.ids)) if k not in chosen and k not in barred)
        return {k: c for k, c in clusters if c is not None}

    def walk(self, order: Callable) -> frozenset:
        """In the given order of nodes each with its cluster, if that fits."""
        chosen = self.required()
        if chosen is None:
            return frozenset()
        barred = self._reach((k for k, i in enumerate(self.ids) if i not in self.allowed), self._users)
        left = self.allowance - sum(self._cost[k] for k in chosen)
        for k in sorted(range(len(self.ids)), key=lambda k: order(self.ids[k])):
            if k in chosen or k in barred:
                continue
            cluster = self._reach([k], self._deps, chosen, left)
            if cluster is not None:
                chosen |= cluster
                left -= sum(self._cost[c] for c in cluster)
        return self._named(chosen)

    def density(self) -> frozenset:
        """In each round the node whose cluster has the best gain for each token is taken with it; one that is best and doesn't fit is dropped,
        and the rounds end when the best gains nothing.

        Gains and costs of clusters are summed once. A choice changes those that reach a node of it, and only those are
        subtracted from and queued anew; older entries of the queue are passed over."""
        chosen = self.required()
        if chosen is None:
            return frozenset()
        left = self.allowance - sum(self._cost[k] for k in chosen)
        gain, cost, entries, version = {}, {}, [], {}
        for k, cluster in self._open(chosen).items():  # clusters aren't kept
            gain[k], cost[k], version[k] = sum(self._gain[c] for c in cluster), sum(self._cost[c] for c in cluster), 0
            entries.append((self._rank(k, gain[k], cost[k]), k, 0))
        heapq.heapify(entries)
        while entries:
            _, k, at = heapq.heappop(entries)
            if k in chosen or version.get(k) != at:
                continue
            if gain[k] <= TOLERANCE * UNIT:
                break
            if cost[k] > left:
                del version[k]
                continue
            cluster = self._reach([k], self._deps, chosen)
            left -= cost[k]
            touched = set()
            for c in cluster:
                for u in self._reach([c], self._users, chosen):
                    if u in version and u not in cluster:
                        gain[u] -= self._gain[c]
                        cost[u] -= self._cost[c]
                        touched.add(u)
            chosen |= cluster
            for u in touched:
                version[u] += 1
                heapq.heappush(entries, (self._rank(u, gain[u], cost[u]), u, version[u]))
        return self._named(chosen)

    def _rank(self, k: int, gain: int, cost: int) -> tuple:
        return (-round(gain / UNIT / max(1, cost), 12), -round(gain / UNIT, 12), self.key[self.ids[k]])

    def better(self, a: frozenset, b: frozenset) -> bool:
        x, y = self.objective(a), self.objective(b)
        if abs(x - y) > TOLERANCE:
            return x > y
        return (self.total(a), [self.place[i] for i in self.ordered(a)]) < (self.total(b), [self.place[i] for i in self.ordered(b)])

    def _compared(self, taken: set[int], most: int) -> frozenset | None:
        """The best set (by ``better``), if no more than ``most`` come into question: what fits of the unions of closures, but for those of
        nodes that gain nothing for their tokens, which a best set holds only where another node needs them."""
        if min(self._cost, default=0) < 0:
            return None
        room = self.allowance - sum(self._cost[k] for k in taken)
        found = {0: (0, 0)}
        for k, cluster in self._open(taken).items():
            if self._gain[k] < 0 or (self._gain[k] == 0 and self._cost[k] > 0):
                continue
            bits = [(1 << c, self._gain[c], self._cost[c]) for c in cluster]
            whole = sum(b for b, _, _ in bits)
            for old, (gain, cost) in list(found.items()):
                if (new := old | whole) in found:
                    continue
                for b, g, c in bits:
                    if not old & b:
                        gain, cost = gain + g, cost + c
                if cost <= room:
                    found[new] = gain, cost
            if len(found) > most:
                return None
        best = min((-gain, cost) for gain, cost in found.values())
        sets = [self._named(taken | {k for k in range(len(self.ids)) if s >> k & 1}) for s, (gain, cost) in found.items() if (-gain, cost) == best]
        return sets[0] if len(sets) == 1 else min(sets, key=lambda c: [self.place[i] for i in self.ordered(c)])

    def exact(self, explored: int = EXPLORED) -> frozenset:
        """The best closed set that fits, of equal ones one of least cost. Sets status and gap: with more than ``explored`` nodes of the search
        the best set so far, and how much better another could be.

        Best first over closed sets: a node is taken with its closure or left out with all that need it. The bound prices tokens:
        for each price a closure of greatest weight less its price is told by a minimum cut, and the price of the least bound is where the
        lines of a set over the allowance and of one within it meet (all in fractions, so nothing is rounded)."""
        taken = self.required()
        if taken is None:
            return frozenset()
        if (few := self._compared(taken, min(explored, FEW))) is not None:
            self.status, self.gap, self.explored = OPTIMAL, 0.0, 0
            return few
        factor = 1 + sum(self._cost)  # first the objective, then tokens saved
        worth = [g * factor - c for g, c in zip(self._gain, self._cost, strict=True)]
        total = lambda s, of: sum(of[k] for k in s)
        place = {i: k for k, i in enumerate(self.ids)}
        start = {place[i] for i in self.density()}
        best, best_worth = start, total(start, worth)
        self.status, self.explored = OPTIMAL, 0
        fit = self._open(taken)
        reach = {k: self._reach([k], self._deps, taken) for k in fit}

        def bounded(inside: set[int], free: set[int]) -> tuple[int, set[int]]:
            """The bound of what inside and free nodes can be worth, and the nodes that it is undecided about."""
            nonlocal best, best_worth
            room, own = self.allowance - total(inside, self._cost), total(inside, worth)
            deps = [[d for d in self._deps[k] if d in free] if k in free else [] for k in range(len(self.ids))]

            def tried(s: set[int]) -> tuple[int, int, set[int]]:
                nonlocal best, best_worth
                w, c = total(s, worth), total(s, self._cost)
                if c <= room and own + w > best_worth:
                    best, best_worth = inside | s, own + w
                return w, c, s

            low = tried(set())
            high = tried(max_closure(worth, deps, free))
            if high[1] <= room:
                return own + high[0], set()
            while True:
                price = Fraction(high[0] - low[0], high[1] - low[1])
                middle = tried(max_closure([w * price.denominator - price.numerator * c for w, c in zip(worth, self._cost, strict=True)], deps, free))
                if middle[0] - price * middle[1] <= low[0] - price * low[1]:
                    return own + int((low[0] + price * (room - low[1])) // 1), high[2] - low[2] or free
                low, high = (middle, high) if middle[1] <= room else (low, middle)

        def opened(inside: set[int], free: set[int]) -> tuple | None:
            room = self.allowance - total(inside, self._cost)
            dear = {k for k in free if sum(self._cost[d] for d in reach[k] - inside) > room}
            free = free - self._reach(dear, self._users) if dear else free
            bound, open_nodes = bounded(inside, free)
            return (-bound, self.explored, inside, free, open_nodes) if open_nodes and bound > best_worth else None

        waiting = [n for n in [opened(taken, set(fit))] if n]
        while waiting:
            if -waiting[0][0] <= best_worth:
                break
            if self.explored >= explored:
                self.status = STOPPED
                break
            bound, _, inside, free, open_nodes = heapq.heappop(waiting)
            node = min(open_nodes, key=lambda k: self._rank(k, sum(self._gain[d] for d in reach[k] - inside), sum(self._cost[d] for d in reach[k] - inside)))
            for child in ((inside | reach[node], free - reach[node]), (inside, free - self._reach([node], self._users))):
                self.explored += 1
                if found := opened(*child):
                    heapq.heappush(waiting, found)
        self.gap = max(0, (-waiting[0][0] - best_worth) / factor / UNIT) if self.status == STOPPED else 0.0
        return self._named(best)

    def brute(self) -> frozenset:
        """Every subset of at most a few nodes, each a number whose bits name its nodes; equal ones are told apart by ``better``."""
        taken = self.required()
        if taken is None:
            return frozenset()
        if (few := self._compared(taken, FEW)) is not None:
            self.status, self.gap = OPTIMAL, 0.0
            return few
        place = {i: k for k, i in enumerate(self.ids)}
        bits = lambda nodes: sum(1 << place[i] for i in nodes)
        subsets = np.arange(1 << len(self.ids), dtype=np.int64)
        must, barred = bits(self.mandatory), bits(set(self.ids) - self.allowed)
        fine = (subsets & must == must) & (subsets & barred == 0)
        gain, cost = np.zeros_like(subsets), np.zeros_like(subsets)
        for k, deps in enumerate(self._deps):
            inside, need = subsets >> k & 1, sum(1 << d for d in deps)
            fine &= (inside == 0) | (subsets & need == need)
            gain += inside * self._gain[k]
            cost += inside * self._cost[k]
        left = np.flatnonzero(fine & (cost <= self.allowance))
        if not len(left):
            self.status = INFEASIBLE
            return frozenset()
        self.status, self.gap = OPTIMAL, 0.0
        left = left[gain[left] == gain[left].max()]
        left = left[cost[left] == cost[left].min()]
        sets = [self._named(k for k in range(len(self.ids)) if s >> k & 1) for s in left.tolist()]
        return min(sets, key=lambda c: [self.place[i] for i in self.ordered(c)])

    def ordered(self, chosen: frozenset) -> list:
        """Repeatedly the first by value and key among nodes whose dependencies are out; with a cycle, plainly so."""
        waits = {i: {d for d in self.deps[i] if d in chosen and d != i} for i in chosen}
        users: dict = {}
        for i, ds in waits.items():
            for d in ds:
                users.setdefault(d, []).append(i)
        ready, out = [(self.place[i], i) for i, ds in waits.items() if not ds], []
        heapq.heapify(ready)
        while ready:
            out.append(heapq.heappop(ready)[1])
            for u in users.get(out[-1], ()):
                waits[u].discard(out[-1])
                if not waits[u]:
                    heapq.heappush(ready, (self.place[u], u))
        return out if len(out) == len(chosen) else sorted(chosen, key=self.place.get)
