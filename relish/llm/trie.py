"""Similar sets found in a prefix tree.

The sets of a task are written as sequences in one order of their elements,
most frequent first, so that similar sets share long beginnings, and stored in
a compressed tree.  A search walks down with the number of elements shared so
far, counted once for all sets below a node, and leaves out a subtree when the
elements that remain on either side cannot make up the overlap that its
shortest set needs, or when its lengths are out of range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Node:
    __slots__ = ("row", "start", "end", "children", "leaf", "low", "high", "live", "parent")

    def __init__(self, row: int, start: int, end: int, parent: "Node | None"):
        self.row, self.start, self.end, self.parent = row, start, end, parent
        self.children: list[Node] = []
        self.leaf, self.low, self.high, self.live = -1, 1 << 60, 0, 0


class Tree:
    """A prefix tree over distinct, non-empty sets (arrays of 64-bit elements, each once)."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        self.elements, at, count = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(self.elements), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(self.elements))
        self.rank = rank
        ends = np.cumsum([len(s) for s in sets])
        self.sets = [np.sort(part) for part in np.split(rank[at], ends[:-1])]
        self.mark = np.zeros(len(self.elements), bool)
        self.root = Node(0, 0, 0, None)
        self.leaves: list[Node | None] = [None] * len(sets)
        for row in range(len(sets)):
            self._insert(row)
        self._measure()

    def _insert(self, row: int) -> None:
        own, node, depth = self.sets[row], self.root, 0
        while True:
            if depth == len(own):
                node.leaf, self.leaves[row] = row, node
                return
            child = next((c for c in node.children if self.sets[c.row][c.start] == own[depth]), None)
            if child is None:
                child = Node(row, depth, len(own), node)
                node.children.append(child)
                child.leaf, self.leaves[row] = row, child
                return
            length = min(child.end, len(own)) - depth
            same = self.sets[child.row][depth:depth + length] == own[depth:depth + length]
            shared = depth + (length if same.all() else int(np.argmin(same)))
            if shared < child.end:  # split the child where the two part
                upper = Node(child.row, child.start, shared, node)
                node.children[node.children.index(child)] = upper
                child.start, child.parent = shared, upper
                upper.children.append(child)
                child = upper
            node, depth = child, shared

    def _measure(self) -> None:
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children
        for node in reversed(order):
            if node.leaf >= 0:
                node.low, node.high, node.live = node.end, max(node.high, node.end), node.live + 1
            if node.parent is not None:
                node.parent.low, node.parent.high = min(node.parent.low, node.low), max(node.parent.high, node.high)
                node.parent.live += node.live

    def remove(self, row: int) -> None:
        node = self.leaves[row]
        node.leaf = -1
        while node is not None:
            node.live -= 1
            node = node.parent

    def place(self, elements: np.ndarray) -> tuple[np.ndarray, int]:
        """A set's elements as this tree's sorted ranks, without those it does not hold; and how many there are in all."""
        at = np.searchsorted(self.elements, elements)
        at[at == len(self.elements)] = 0
        return np.sort(self.rank[at[self.elements[at] == elements]]), len(elements)

    def similar(self, own: np.ndarray, size: int, percent: int) -> Iterator[int]:
        """Live sets whose Jaccard similarity with a placed set is at least ``percent`` / 100."""
        self.mark[own] = True
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if not node.live or node.high * 100 < percent * size or node.low * percent > 100 * size:
                continue
            if node.end > node.start:
                part = self.sets[node.row][node.start:node.end]
                shared += int(np.count_nonzero(self.mark[part]))
                rest = len(own) - int(np.searchsorted(own, part[-1], "right"))
                if (100 + percent) * (shared + min(rest, node.high - node.end)) < percent * (size + max(node.low, -(-percent * size // 100))):
                    continue
            if node.leaf >= 0 and (100 + percent) * shared >= percent * (size + node.end):
                yield node.leaf
            stack += [(c, shared) for c in node.children]
        self.mark[own] = False


def groups(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its group: sets linked by similarity, directly or through others.

    A set found is taken out of the tree, so a large group of similar sets
    takes one search, not one per pair.
    """
    tree, root = Tree(sets), [-1] * len(sets)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        tree.remove(first)
        waiting = [first]
        while waiting and tree.root.live:
            row = waiting.pop()
            for other in list(tree.similar(tree.sets[row], len(tree.sets[row]), percent)):
                root[other] = first
                tree.remove(other)
                waiting.append(other)
    return root
