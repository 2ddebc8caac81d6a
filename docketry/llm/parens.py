"""Balanced parentheses of an ordered tree, with a range min-max tree over blocks of excess.

A node is an open parenthesis; what stands between it and its close are its descendants.
All searches take many nodes at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parens:
    def __init__(self, opens: np.ndarray):
        """`opens`: true for an open parenthesis; balanced."""
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype("int32")
        padded = np.concatenate([self.excess, np.repeat(self.excess[-1:], -len(opens) % BLOCK)]).reshape(-1, BLOCK)
        self.least, self.most = [padded.min(axis=1)], [padded.max(axis=1)]
        while len(self.least[-1]) > 1:
            for levels, fold in ((self.least, np.minimum), (self.most, np.maximum)):
                below = levels[-1]
                below = np.concatenate([below, below[-1:]]) if len(below) % 2 else below
                levels.append(fold(below[::2], below[1::2]))
        #: Opens before each place, and leaves, which are pairs "()", likewise.
        self.rank = np.concatenate([[0], np.cumsum(opens)])
        pairs = opens[:-1] & ~opens[1:]
        self.leaf_rank = np.concatenate([[0], np.cumsum(pairs), np.zeros(1, "int64")])
        self.leaf_rank[-1] = self.leaf_rank[-2]

    @classmethod
    def of_depths(cls, depths: np.ndarray) -> Parens:
        """From the depths of all nodes in preorder, the root's first."""
        closes = np.concatenate([depths[:-1] - depths[1:] + 1, depths[-1:] - depths[0] + 1])
        at = np.arange(len(depths)) + np.concatenate([[0], np.cumsum(closes[:-1])])
        opens = np.zeros(2 * len(depths), bool)
        opens[at] = True
        return cls(opens)

    def select(self) -> np.ndarray:
        """Where each node's parenthesis opens, in preorder."""
        return np.flatnonzero(self.opens)

    def _within(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place of a block, behind `after`, that has the target excess; -1 if none."""
        out = np.full(len(block), -1, "int64")
        left = np.arange(len(block))
        for k in range(BLOCK):
            at = block[left] * BLOCK + k
            inside = at < len(self.excess)
            there = inside & (at > after[left]) & (self.excess[np.minimum(at, len(self.excess) - 1)] == target[left])
            out[left[there]] = at[there]
            left = left[~there]
            if not len(left):
                break
        return out

    def _has(self, level: int, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        node_in = np.minimum(node, len(self.least[level]) - 1)
        return (node < len(self.least[level])) & (self.least[level][node_in] <= target) & (target <= self.most[level][node_in])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closes of the opens at these places."""
        target = self.excess[at] - 1
        out = self._within(at // BLOCK, at, target)
        # Up to the first level where the block to the right holds the target, and down again.
        left = np.flatnonzero(out < 0)
        node = at[left] // BLOCK
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(len(self.least)):
            found = (node % 2 == 0) & self._has(level, node + 1, target[left])
            met.append((left[found], node[found] + 1))
            left, node = left[~found], node[~found] // 2
        rows, nodes = np.zeros(0, "int64"), np.zeros(0, "int64")
        for level in range(len(self.least) - 1, -1, -1):
            rows, nodes = np.concatenate([rows, met[level][0]]), np.concatenate([nodes, met[level][1]])
            if level:
                nodes = 2 * nodes
                nodes += ~self._has(level - 1, nodes, target[rows])
        out[rows] = self._within(nodes, np.full(len(rows), -1), target[rows])
        return out


def parents(depths: np.ndarray) -> np.ndarray:
    """The parent of each node in preorder: the last one before it that is a level higher; root: -1."""
    n = len(depths)
    places = np.sort(depths * n + np.arange(n))
    found = places[np.maximum(np.searchsorted(places, (depths - 1) * n + np.arange(n)) - 1, 0)] % n
    return np.where(depths > depths[0], found, -1)


def range_min(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minima of values[start:end] for ranges that are not empty, by a table of powers of two."""
    table = [values]
    while 2 ** len(table) <= len(values):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((ends - starts).astype("float64"))[1] - 1
    out = np.empty(len(starts), values.dtype)
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(table[k][starts[here]], table[k][ends[here] - 2**k])
    return out
