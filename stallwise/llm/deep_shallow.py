"""Deep-shallow sorting of byte strings of one length, and their common prefixes.

The shallow part is a multikey quicksort whose characters are 8-byte words: a group is split in
three by a pivot word, and the middle goes on at the next word. Groups that are still together at
the shallow depth, or are small, are ordered by a blind trie: strings are inserted by branching
bytes alone and compared once, with the leaf they end at.
"""

from __future__ import annotations

import numpy as np

SHALLOW_BYTES = 32
SMALL_GROUP = 24


class BlindTrie:
    """Strings as leaves below nodes [branching byte, children by that byte's value].

    A leaf is a list of the numbers of equal strings, a node a tuple.
    """

    def __init__(self, strings: list[bytes], values: list[int]):
        self._strings, self._values = strings, values
        self._size = len(strings[0]) if strings else 0
        self._root: tuple | list = []

    def insert(self, number: int) -> None:
        if not self._root:
            self._root = [number]
            return
        string = self._strings[number]
        node = self._root
        while type(node) is tuple:
            at, children = node
            child = children.get(string[at])
            node = next(iter(children.values())) if child is None else child
        apart = self._values[number] ^ self._values[node[0]]
        if not apart:
            node.append(number)
            return
        common = self._size - (apart.bit_length() + 7) // 8
        other = self._strings[node[0]][common]
        above, node = None, self._root
        while type(node) is tuple and node[0] < common:
            above, node = node, node[1][string[node[0]]]
        if type(node) is tuple and node[0] == common:
            node[1][string[common]] = [number]
            return
        split = (common, {other: node, string[common]: [number]})
        if above is None:
            self._root = split
        else:
            above[1][string[above[0]]] = split

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self._root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                children = node[1]
                stack.extend(children[key] for key in sorted(children, reverse=True))
            else:
                out.extend(node)
        return out


def _by_trie(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    strings = [row.tobytes() for row in rows[group]]
    trie = BlindTrie(strings, [int.from_bytes(s, "big") for s in strings])
    for number in range(len(strings)):
        trie.insert(number)
    return group[trie.ordered()]


def sorted_order(rows: np.ndarray, shallow: int = SHALLOW_BYTES) -> np.ndarray:
    """Order of the rows of a matrix of bytes, each row a string; equal rows in input order.

    ``shallow`` is the depth, in bytes, of the multikey quicksort: a multiple of 8."""
    count, size = rows.shape
    depth = min(shallow, size - size % 8)
    words = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64) if depth else np.zeros((count, 0), np.uint64)
    out: list[np.ndarray] = []
    stack = [(np.arange(count), 0)]
    while stack:
        group, at = stack.pop()
        if len(group) <= 1:
            out.append(group)
        elif len(group) <= SMALL_GROUP or at == words.shape[1]:
            out.append(_by_trie(rows, group))
        else:
            key = words[group, at]
            pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
            less, more = key < pivot, key > pivot
            stack.append((group[more], at))
            stack.append((group[~(less | more)], at + 1))
            stack.append((group[less], at))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row, in order, with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for begin in range(1, len(order), 1 << 14):  # bounds the matrix of differences
        at = np.arange(begin, min(begin + (1 << 14), len(order)))
        differs = rows[order[at]] != rows[order[at - 1]]
        out[at] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out
