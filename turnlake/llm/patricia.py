"""A compressed radix (Patricia) trie over byte strings, with spill by subtree.

Each edge holds a run of bytes, so a text that shares no prefix with another costs one node. A terminal
node keeps the smallest rank inserted there and the number of insertions.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

#: Bytes that a node costs besides its label.
NODE_BYTES = 400


class Node:
    __slots__ = ("label", "children", "rank", "count", "tag")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.rank = None
        self.count = 0
        self.tag = None


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class SpillingTrie:
    """Texts in, (tag, smallest rank, count) out. Beyond limit_bytes, the largest subtree below the first
    branch goes to a file of this task's temporary folder, and what belongs to it later follows; files
    are worked through one after another in the end, each as a trie of its own."""

    def __init__(self, limit_bytes: int, folder: str | None = None, depth: int = 0):
        self.limit, self.depth = limit_bytes, depth
        self.own = folder is None
        self.folder = folder or tempfile.mkdtemp(prefix="trie-")
        self.root, self.bytes, self.files = Node(b""), 0, {}
        self.lengths: list[int] = []  # of the spilled prefixes
        self.spills = 0

    def insert(self, key: bytes, rank: tuple, count: int, tag) -> None:
        for n in self.lengths:
            file = self.files.get(key[:n])
            if file is not None:
                pickle.dump((key, rank, count, tag), file)
                return
        self._place(key, rank, count, tag)
        if self.bytes > self.limit:
            self._spill()

    def _place(self, key: bytes, rank: tuple, count: int, tag) -> None:
        node, at = self.root, self.depth
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += NODE_BYTES + len(child.label)
                node = child
                break
            n = len(child.label) if key.startswith(child.label, at) else shared_length(child.label, key, at)
            if n < len(child.label):
                upper = Node(child.label[:n])
                node.children[key[at]] = upper
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                self.bytes += NODE_BYTES
                child = upper
            node, at = child, at + n
        node.rank = rank if node.count == 0 else min(node.rank, rank)
        node.count += count
        node.tag = tag

    def _spill(self) -> None:
        prefix, node = bytearray(), self.root
        while len(node.children) == 1 and not node.count:
            node = next(iter(node.children.values()))
            prefix += node.label
        if not node.children:
            return  # a single text: nothing to part
        sizes = {b: self._size(c) for b, c in node.children.items()}
        largest = max(sizes, key=sizes.get)
        child = node.children.pop(largest)
        file = open(os.path.join(self.folder, f"{self.depth}-{len(prefix)}-{largest}-{self.spills}-{id(self)}"), "w+b")
        self.spills += 1
        head = self._head + bytes(prefix) + bytes([largest])
        # The texts' first depth bytes aren't in this trie; any text below has them. One text at a time is put together.
        for x, path in self._walk(child, bytes(prefix)):
            if x.count:
                pickle.dump((self._head + path, x.rank, x.count, x.tag), file)
        self.files[head] = file
        self.lengths = sorted(set(map(len, self.files)), reverse=True)  # a longer one was there first
        self.bytes -= sizes[largest]

    @property
    def _head(self) -> bytes:
        return getattr(self, "head", b"")

    @staticmethod
    def _size(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += NODE_BYTES + len(node.label)
            stack += node.children.values()
        return total

    @staticmethod
    def _walk(node: Node, before: bytes) -> Iterator[tuple[Node, bytes]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            path = before + node.label
            yield node, path
            stack += [(c, path) for c in node.children.values()]

    def owners(self) -> Iterator[tuple]:
        """(tag, rank, count) of every text; empties the trie."""
        try:
            stack = [self.root]
            while stack:
                node = stack.pop()
                if node.count:
                    yield node.tag, node.rank, node.count
                stack += node.children.values()
            self.root = Node(b"")
            for head, file in self.files.items():
                file.seek(0)
                inner = SpillingTrie(self.limit, self.folder, len(head))
                inner.head = head
                while True:
                    try:
                        inner.insert(*pickle.load(file))
                    except EOFError:
                        break
                file.close()
                os.remove(file.name)
                yield from inner.owners()
        finally:
            if self.own:
                shutil.rmtree(self.folder, ignore_errors=True)
