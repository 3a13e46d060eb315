"""Signature trees over shingle sets, and the dual traversal that finds links between the sets.

A set's bitmap has a column for each of some hundred buckets of its tokens, with as many bits set as
it has tokens there (kept as counts: the AND of two such bitmaps has the sum of the smaller counts as
its bits, their OR the larger counts). A node ORs the bitmaps below it and keeps the range of set
sizes. Two sets below nodes X and Y share at most |X AND Y| tokens, so a pair of nodes is pruned
when that stays under the overlap its smallest sets need. Pairs of nodes whose sets are all in one
group already are skipped, as one more link between them can't change a component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 8


class Groups:
    """Union-find over numbers that are met as they come; the root is the smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, i: int) -> int:
        up = self.up
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def bitmap(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint32)


def buckets_for(sizes: list[int]) -> int:
    return 1 << min(12, max(8, sorted(sizes)[len(sizes) // 2].bit_length()))


class Tree:
    """Levels of nodes over members (any numbers, for `Groups`); level 0 are the members in the given order."""

    def __init__(self, members: list[int], maps: np.ndarray, sizes: np.ndarray):
        self.members = members
        self.levels = [(maps, sizes, sizes)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        self.one: list[list[int | None]] = [list(members)] + [[None] * len(level[1]) for level in self.levels[1:]]

    def under(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))

    def group(self, level: int, node: int, groups: Groups) -> int | None:
        """The group that all members below a node are in, or None. Groups only grow, so one once seen is kept."""
        if (known := self.one[level][node]) is not None:
            return groups.find(known)
        found = None
        for child in self.under(level, node):
            g = self.group(level - 1, child, groups)
            if g is None or found not in (None, g):
                return None
            found = g
        self.one[level][node] = found
        return found


def needed(low_a: np.ndarray, low_b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two sets of these sizes with 100 * overlap >= percent * union."""
    return (percent * (low_a + low_b) + 99 + percent) // (100 + percent)


def traverse(left: Tree, right: Tree, groups: Groups, percent: int, check: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Join the groups of all pairs (one below each tree; one tree twice: within it) that no bound rules out
    and ``check`` affirms, unless they are in one group by then; the pairs that were joined."""
    found: list[tuple[int, int]] = []
    itself = left is right
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        own = left.group(la, a, groups)
        if own is not None and own == right.group(lb, b, groups):
            continue
        if la == 0 and lb == 0:
            if check(left.members[a], right.members[b]):
                groups.join(left.members[a], right.members[b])
                found.append((left.members[a], right.members[b]))
            continue
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        na = np.array(left.under(la, a) if down_a else [a])
        nb = np.array(right.under(lb, b) if down_b else [b])
        la, lb = la - down_a, lb - down_b
        maps_a, low_a, high_a = (x[na] for x in left.levels[la])
        maps_b, low_b, high_b = (x[nb] for x in right.levels[lb])
        most = np.minimum(maps_a[:, None], maps_b[None]).sum(axis=2, dtype=np.int64)
        apart = (100 * high_a[:, None] < percent * low_b[None]) | (100 * high_b[None] < percent * low_a[:, None])
        hits = np.argwhere((most >= needed(low_a[:, None], low_b[None], percent)) & ~apart)
        pairs = [(int(na[x]), int(nb[y])) for x, y in hits]
        if itself and la == lb:
            pairs = [(p, q) for p, q in pairs if p < q or p == q and la > 0]
            pairs.sort(key=lambda pq: pq[0] == pq[1])  # nodes with themselves last, so that they are popped first
        stack += [(la, p, lb, q) for p, q in pairs]
    return found


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a or b|, for sorted distinct sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_tree(sets: list[np.ndarray], which: list[int], buckets: int) -> Tree:
    """A tree over the positions ``which``, ordered so that similar sets tend to be neighbours: by smallest token."""
    order = sorted(which, key=lambda i: (int(sets[i][0]), len(sets[i]), i))
    return Tree(order, np.stack([bitmap(sets[i], buckets) for i in order]), np.array([len(sets[i]) for i in order], np.int64))
