"""Deep-shallow sorting of byte strings.

Multikey quicksort orders strings by their first SHALLOW bytes, eight at a time. Groups that agree on all of these go
into a blind trie: it branches on single bytes, descends without comparing, and compares each new string once.
"""

from __future__ import annotations

SHALLOW, STEP = 32, 8


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Branch:
    __slots__ = ("depth", "next", "any")

    def __init__(self, depth: int, any_leaf: list[int]):
        self.depth, self.next, self.any = depth, {}, any_leaf


def blind_sort(strings: list[bytes], which: list[int]) -> list[int]:
    """Orders the places `which` by their strings; a string that ends comes before those that go on."""
    root: _Branch | list[int] = [which[0]]
    for w in which[1:]:
        s = strings[w]
        node = root
        while isinstance(node, _Branch):  # blind: only the branching bytes are looked at
            c = s[node.depth] if node.depth < len(s) else -1
            node = node.next.get(c, node.any)
        other = strings[node[0]]
        d = common(s, other)
        if d == len(s) == len(other):
            node.append(w)
            continue
        parent, at, node = None, -1, root
        while isinstance(node, _Branch) and node.depth < d:
            parent, at = node, s[node.depth]
            node = node.next[at]
        leaf = [w]
        mine = s[d] if d < len(s) else -1
        if isinstance(node, _Branch) and node.depth == d:
            node.next[mine] = leaf
            continue
        split = _Branch(d, node.any if isinstance(node, _Branch) else node)
        split.next[other[d] if d < len(other) else -1] = node
        split.next[mine] = leaf
        if parent is None:
            root = split
        else:
            parent.next[at] = split
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Branch):
            stack.extend(node.next[c] for c in sorted(node.next, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of the strings: places from the smallest to the largest."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        which, depth = stack.pop()
        if len(which) <= 1:
            out.extend(which)
            continue
        if depth >= SHALLOW:
            out.extend(blind_sort(strings, which))
            continue
        pivot = strings[which[len(which) // 2]][depth : depth + STEP]
        less, same, more = [], [], []
        for w in which:
            key = strings[w][depth : depth + STEP]
            (same if key == pivot else less if key < pivot else more).append(w)
        if len(pivot) < STEP:  # these strings end here and are equal
            done = (same, SHALLOW)
        else:
            done = (same, depth + STEP)
        stack.extend(x for x in ((more, depth), done, (less, depth)) if x[0])
    return out


def neighbours(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order, and the common prefix of each string with the one before it (0 for the first)."""
    order = deep_shallow(strings)
    return order, [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]
