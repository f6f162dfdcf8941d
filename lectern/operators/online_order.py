"""A topological order kept while edges come in one by one: which of them would close a cycle.

Nodes stand in a list, each with a label that grows along it. An edge that goes forward needs nothing. One that goes back is
searched from both of its ends at once: ahead from its end, the node that stands first next, and back from its beginning,
the node that stands last next, an edge each in turn, until the two searches pass each other. If they meet, the edge would
close a cycle and is refused. If not, the nodes met that stand on the wrong side of the place where they passed move there.
So an edge costs about what the smaller of the two searches sees, and nodes beyond both ends are never looked at.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

GAP = 1 << 40


class OnlineOrder:
    """The order over n nodes, at first by their number."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.ahead: list[list[int]] = [[] for _ in range(n)]
        self.behind: list[list[int]] = [[] for _ in range(n)]
        self.label = [(k + 1) * GAP for k in range(n)] + [0, (n + 1) * GAP]
        self.after = [*range(1, n), n + 1, 0 if n else n + 1, n]  # n stands before all nodes, n + 1 after them
        self.before = [n, *range(n - 1), n, n - 1] if n else [n, n]

    def add(self, src: int, dst: int) -> bool:
        """Take the edge in, or refuse it."""
        if src == dst:
            return False
        if self.label[src] > self.label[dst] and not self._turned(src, dst):
            return False
        self.ahead[src].append(dst)
        self.behind[dst].append(src)
        return True

    def _turned(self, src: int, dst: int) -> bool:
        """Move nodes so that src stands before dst; False if dst leads to src."""
        label, ahead, behind = self.label, self.ahead, self.behind
        fore, back = {dst: 0}, {src: 0}  # nodes met, and how many of their edges have been followed
        first, last = [(label[dst], dst)] if ahead[dst] else [], [(-label[src], src)] if behind[src] else []
        while first and last and first[0][0] < -last[0][0]:
            u, z = first[0][1], last[0][1]
            x, y = ahead[u][fore[u]], behind[z][back[z]]
            fore[u] += 1
            back[z] += 1
            if fore[u] == len(ahead[u]):
                heappop(first)
            if back[z] == len(behind[z]):
                heappop(last)
            if x in back or y in fore or x == y:
                return False
            if x not in fore:
                fore[x] = 0
                if ahead[x]:
                    heappush(first, (label[x], x))
            if y not in back:
                back[y] = 0
                if behind[y]:
                    heappush(last, (-label[y], y))
        t = first[0][1] if first and first[0][0] < label[src] else src
        early = sorted((x for x in fore if label[x] < label[t]), key=label.__getitem__)
        late = sorted((y for y in back if label[y] > label[t]), key=label.__getitem__)
        for node in early + late:
            self.after[self.before[node]], self.before[self.after[node]] = self.after[node], self.before[node]
        if t == src:
            self._insert(early, t)
        else:
            self._insert(late + early, self.before[t])
        return True

    def _insert(self, nodes: list[int], place: int) -> None:
        """Put nodes, in a row, after the one at place."""
        if not nodes:
            return
        low, then = self.label[place], self.after[place]
        step = (self.label[then] - low) // (len(nodes) + 1)
        for k, node in enumerate(nodes, 1):
            self.after[place], self.before[node] = node, place
            self.label[node] = low + k * step
            place = node
        self.after[place], self.before[then] = then, place
        if not step:  # no room between two labels: all anew
            node, k = self.n, 0
            while node != self.n + 1:
                self.label[node] = k * GAP
                node, k = self.after[node], k + 1
            self.label[node] = k * GAP


def layered(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """A number for each node, for a first order: nodes without an edge to them first, layer by layer; those on cycles,
    which that doesn't reach, last."""
    order = np.argsort(src, kind="stable")
    ends, begin = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    open_ = np.bincount(dst, minlength=n)
    todo = np.flatnonzero(open_ == 0).tolist()
    for node in todo:
        for to in ends[begin[node] : begin[node + 1]].tolist():
            open_[to] -= 1
            if not open_[to]:
                todo.append(to)
    number = np.full(n, -1)
    number[todo] = np.arange(len(todo))
    number[number < 0] = np.arange(len(todo), n)
    return number


def refused(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Of edges in the order in which they come, those that would close a cycle with the ones taken in before."""
    nodes, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    number = layered(a, b, len(nodes))
    order = OnlineOrder(len(nodes))
    return np.fromiter((not order.add(x, y) for x, y in zip(number[a].tolist(), number[b].tolist(), strict=True)), bool, len(a))
