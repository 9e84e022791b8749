"""Deep-shallow sorting of strings, many groups at a time.

Shallow: a multikey quicksort, eight bytes being one character, splits all groups
at once about a pivot of each until they agree to a fixed depth. Deep: what is still equal there shares a long prefix,
and a blind trie (which keeps only the places where strings differ) orders each
such group, comparing every string once with one leaf.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


class _Node:
    __slots__ = ("bit", "zero", "one")

    def __init__(self, bit: int, zero, one):
        self.bit, self.zero, self.one = bit, zero, one


def blind_trie(strings: list[bytes], depth: int) -> tuple[list[int], list[int]]:
    """Order of the strings by their first ``depth`` bytes, and each one's common prefix with the one before.

    Shorter strings count as followed by zero bytes; the common prefix is cut to
    the length of the shorter one by the caller.
    """
    padded = [s[:depth].ljust(depth, b"\0") for s in strings]
    number = [int.from_bytes(s, "big") for s in padded]
    total = 8 * depth
    root: object = [0]
    for i in range(1, len(strings)):
        own = padded[i]
        node = root
        while node.__class__ is _Node:
            node = node.one if own[node.bit >> 3] >> (7 - (node.bit & 7)) & 1 else node.zero
        apart = number[i] ^ number[node[0]]
        if not apart:
            node.append(i)
            continue
        bit = total - apart.bit_length()
        up, node = None, root
        while node.__class__ is _Node and node.bit < bit:
            up, node = node, node.one if own[node.bit >> 3] >> (7 - (node.bit & 7)) & 1 else node.zero
        new = _Node(bit, node, [i]) if own[bit >> 3] >> (7 - (bit & 7)) & 1 else _Node(bit, [i], node)
        if up is None:
            root = new
        elif up.one is node:
            up.one = new
        else:
            up.zero = new
    order: list[int] = []
    common: list[int] = []
    stack: list = [(root, 0)]
    while stack:
        node, bit = stack.pop()
        if node.__class__ is _Node:
            stack.append((node.one, node.bit))
            stack.append((node.zero, bit))
        else:
            common += [bit >> 3] + [depth] * (len(node) - 1)
            order += node
    return order, common


def multikey(order: np.ndarray, begins: np.ndarray, words: np.ndarray) -> None:
    """Multikey quicksort of rows of words, in place: all groups (begun where ``begins``) take a step together.

    A step splits each group about the median of three of its words at the group's
    depth; the middle part goes on one word deeper. What is left in one group
    afterwards has equal rows.
    """
    n, depth = words.shape
    level = np.zeros(n, np.int64)
    while True:
        at = np.flatnonzero((~begins | np.append(~begins[1:], False)) & (level < depth))
        if not len(at):
            return
        first = np.flatnonzero(begins[at])
        size = np.diff(np.append(first, len(at)))
        key = words[order[at], level[at]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        part = 3 * np.repeat(np.arange(len(first)), size) + (key > pivot) + (key >= pivot)
        sort = np.argsort(part, kind="stable")
        order[at], part = order[at][sort], part[sort]
        begins[at[np.flatnonzero(part[1:] != part[:-1]) + 1]] = True
        level[at[part % 3 == 1]] += 1


def deep_shallow(groups: np.ndarray, strings: list[bytes], depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings within groups: (order, common).

    common[i] is the length of the common prefix of the i-th string in order and
    the one before it, at most ``depth`` and -1 where a group begins.
    """
    n = len(strings)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shallow = min(shallow, -(-depth // 8) * 8)
    head = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), np.uint8).reshape(n, shallow)
    size = np.minimum(np.fromiter(map(len, strings), np.int64, n), depth)
    order = np.argsort(groups, kind="stable")
    begins = np.r_[True, groups[order[1:]] != groups[order[:-1]]]
    common = np.where(begins, -1, depth)
    joined = np.flatnonzero(~begins)
    multikey(order, begins, head.view(">u8").astype(np.uint64))
    apart = joined[begins[joined]]
    common[apart] = (head[order[apart]] != head[order[apart - 1]]).argmax(axis=1)
    first = np.flatnonzero(begins)
    last = np.r_[first[1:], n]
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
        own = order[a:b]
        inner, lcp = blind_trie([strings[i] for i in own], depth)
        order[a:b] = own[inner]
        common[a + 1 : b] = lcp[1:]
    common[joined] = np.minimum(common[joined], np.minimum(size[order[joined]], size[order[joined - 1]]))
    return order, common
