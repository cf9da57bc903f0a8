"""Compressed radix tries over whole texts: a terminal holds what is known of one text."""

from __future__ import annotations

from collections.abc import Iterator


def common_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, found by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """An edge's label, the nodes below by their first byte, and the text's record if a text ends here."""

    __slots__ = ("label", "below", "record")

    def __init__(self, label: bytes, record=None):
        self.label, self.below, self.record = label, {}, record


class Trie:
    """Texts as bytes. ``held`` counts the bytes of its distinct texts."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def node(self, text: bytes) -> Node:
        """The node at which ``text`` ends; inserted (with no record yet) if it is new."""
        at, rest = self.root, text
        while rest:
            child = at.below.get(rest[0])
            if child is None:
                self.held += len(text)
                child = at.below[rest[0]] = Node(rest)
                return child
            if rest.startswith(child.label):
                at, rest = child, rest[len(child.label):]
                continue
            k = common_length(child.label, rest)
            upper = at.below[rest[0]] = Node(child.label[:k])
            child.label = child.label[k:]
            upper.below[child.label[0]] = child
            at, rest = upper, rest[k:]
            if not rest:
                self.held += len(text)
        return at

    def walk(self) -> Iterator[tuple[bytes, object, bytes]]:
        """(text, record, key) in ascending byte order; ``key`` is the shortest prefix that tells it from all before it."""
        stack = [(self.root, b"", b"")]
        while stack:
            node, path, key = stack.pop()
            text = path + node.label
            if node.record is not None:
                yield text, node.record, key
            # below a text, and behind a sibling, one more byte tells the texts apart
            order = sorted(node.below, reverse=True)
            for first in order:
                only = first == order[-1] and node.record is None
                stack.append((node.below[first], text, key if only else text + bytes([first])))


def weighted_cuts(keys: list[tuple[bytes, int]], parts: int, phase: float = 1.0) -> list[tuple[bytes, int]]:
    """At most ``parts`` keys, in order, each with an equal share of the weights of all (key, weight) pairs.

    The first stands where ``phase`` of a share is reached: cuts of many lists with phases of their own do not fall
    on the same places.
    """
    total = sum(w for _, w in keys)
    share, out, at = total / parts if parts else 0, [], 0.0
    for key, weight in sorted(keys):
        at += weight
        while share and len(out) < parts and at >= share * (len(out) + phase) * (1 - 1e-9):
            out.append((key, max(1, round(share))))
    return out


def phase_of(name: str) -> float:
    """A phase in (0, 1] from a hexadecimal name."""
    return 1 - int(name[:8], 16) / (1 << 32)
