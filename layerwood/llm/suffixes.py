"""Order of strings and their common prefixes by deep-shallow sorting.

Shallow: multikey quicksort, here one 8-byte key at a time for all groups that
are still equal, down to a small depth.  Deep: what is equal to that depth is
put into a blind trie, which holds branching places only: a string goes down by
these places alone, is compared once with the leaf it arrives at, and branches
off where the two part.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a sort key; four of them make 8 bytes.
PER_KEY = 4


def symbols(strings: list[bytes], width: int) -> np.ndarray:
    """One row per string; bytes count from 1, so that an end comes first."""
    out = np.zeros((len(strings), -(-width // PER_KEY) * PER_KEY), np.uint16)
    for row, s in zip(out, strings):
        row[:len(s)] = np.frombuffer(s, np.uint8)
        row[:len(s)] += 1
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


class BlindTrie:
    """Strings by their branching places; equal strings share a leaf."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [[first]]  # a leaf: [ids]; a branch: [depth, {symbol: child}]

    @staticmethod
    def symbol(s: bytes, depth: int) -> int:
        return s[depth] + 1 if depth < len(s) else 0

    def insert(self, at: int) -> None:
        s, node = self.strings[at], self.root
        while len(node) == 2:
            children = node[1]
            node = children.get(self.symbol(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[0][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[0].append(at)
            return
        parent, node = None, self.root
        while len(node) == 2 and node[0] < depth:
            parent, node = node, node[1][self.symbol(s, node[0])]
        if len(node) == 2 and node[0] == depth:
            node[1][self.symbol(s, depth)] = [[at]]
            return
        branch = [depth, {self.symbol(other, depth): node, self.symbol(s, depth): [[at]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self.symbol(s, parent[0])] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """Ids in order, and the common prefix of each with the one before it (0 for the first)."""
        ids, shared, todo, depth = [], [], [(self.root, 0)], 0
        while todo:
            node, depth = todo.pop()
            if len(node) == 1:
                ids += node[0]
                shared += [depth] + [len(self.strings[node[0][0]])] * (len(node[0]) - 1)
            else:
                children = sorted(node[1].items(), reverse=True)
                todo += [(child, node[0]) for _, child in children[:-1]] + [(children[-1][1], depth)]
        return ids, shared


def deep_shallow(group: np.ndarray, strings: list[bytes], width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order within groups, and each string's common prefix with the one before it (-1 at the start of a group)."""
    n = len(strings)
    keys = symbols(strings, width).astype(">u2").view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    shared = np.full(n, -1)
    start = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if n else np.zeros(0, bool)
    depth = 0
    while depth < min(keys.shape[1], -(-shallow // PER_KEY)):
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        open_ = np.flatnonzero(size[run] > 1)
        if not len(open_):
            break
        key = keys[order[open_], depth]
        by = np.lexsort((key, run[open_]))
        order[open_] = order[open_][by]
        key = key[by]
        apart = np.flatnonzero((key[1:] != key[:-1]) & ~start[open_][1:]) + 1
        x = key[apart] ^ key[apart - 1]
        equal = sum((x >> np.uint64(64 - 16 * (i + 1)) == 0).astype(int) for i in range(PER_KEY))
        shared[open_[apart]] = depth * PER_KEY + equal
        start[open_[apart]] = True
        depth += 1
    cuts = np.flatnonzero(start)
    ends = np.append(cuts[1:], n)
    for low, high in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1]):
        members = order[low:high].tolist()
        trie = BlindTrie(strings, members[0])
        for m in members[1:]:
            trie.insert(m)
        ids, prefix = trie.ordered()
        order[low:high] = ids
        shared[low + 1:high] = prefix[1:]
    return order, shared
