"""Longest common extensions of a sequence of integers by a suffix tree.

The tree is built by Ukkonen's algorithm and walked once. The walk gives the order of the
suffixes and the string depths met on its Euler tour; a table of minima over that tour
answers the depth of a lowest common ancestor, so the longest common prefix of any two
suffixes, in constant time and for whole arrays of pairs at once.
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """Suffix tree of ``symbols`` (integers from 0 on) and an end mark below all of them."""

    def __init__(self, symbols: list[int]):
        self.text = [*symbols, -1]
        self._build()
        self._walk()

    def _build(self) -> None:
        """Ukkonen's online construction. A node is a number; leaves share one open end.

        ``children`` has a dictionary for an inner node and the place of its suffix for a leaf.
        """
        text = self.text
        n = len(text)
        start, end, link = [0], [0], [0]  # of the edge into each node; end n for leaves
        children: list[dict[int, int] | int] = [{}]
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            pending += 1
            last = 0  # the inner node made last in this phase, which still needs its link
            while pending:
                if not length:
                    edge = i
                first = text[edge]
                child = children[node].get(first)
                if child is None:
                    children[node][first] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    children.append(i - pending + 1)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = start[child]
                    size = (end[child] if end[child] < n else i + 1) - at
                    if length >= size:  # walk down
                        node, edge, length = child, edge + size, length - size
                        continue
                    if text[at + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start.append(at)
                    end.append(at + length)
                    link.append(0)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    children.append({text[at + length]: child, symbol: split + 1})
                    children.append(i - pending + 1)
                    children[node][first] = split
                    start[child] = at + length
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if not node:
                    if length:
                        length -= 1
                        edge = i - pending + 1
                else:
                    node = link[node]
        self.start, self.end, self.children = start, end, children

    def _walk(self) -> None:
        """Suffixes in order, and the depth at which the tour turns between neighbours."""
        start, end, children = self.start, self.end, self.children
        n = len(self.text)
        order, between, turn = [], [], 0
        stack = [(0, 0, -1)]
        push = stack.append
        while stack:
            node, depth, back = stack.pop()
            if back >= 0:  # the tour has come back to the parent, at that depth
                turn = back
            below = children[node]
            if type(below) is int:
                between.append(turn)
                order.append(below)
                continue
            if node:
                depth += end[node] - start[node]
            left = sorted(below)
            first = children[below[left[0]]]
            if type(first) is int:  # leaves in front need no place on the stack
                between.append(turn)
                order.append(first)
                turn, at = depth, 1
                while at < len(left) and type(leaf := children[below[left[at]]]) is int:
                    between.append(depth)
                    order.append(leaf)
                    at += 1
                for key in reversed(left[at:]):
                    push((below[key], depth, depth))
            else:
                for key in reversed(left[1:]):
                    push((below[key], depth, depth))
                push((below[left[0]], depth, -1))
        self.order, self.between = np.array(order, np.int64), np.array(between[1:], np.int32)
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.start = self.end = self.children = None  # the tour is all that later calls need
        table = [self.between]
        while (span := 1 << (len(table) - 1)) * 2 <= len(self.between):
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        self.minima = table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common prefixes of the suffixes at ``i`` and at ``j``, all different."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)  # minima over [low, high)
        out = np.zeros(len(low), np.int64)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            here = level == k
            row = self.minima[k]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << int(k))])
        return out
