"""A Patricia (compressed radix) trie over byte strings, whose terminal nodes own the smallest identifier seen.

When what is held outgrows a budget, the subtree with the most bytes is spilled: its strings go to a file in Spark's spill folders, and so
do later strings under its prefix. Each file is read back into a trie of its own, one after another, so memory stays within the
budget (or one string) however many distinct strings come. A file belongs to the task that writes it and has no name; if the executor is
lost, the task and its files are made anew elsewhere.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

#: Bytes that a node takes beside its label.
NODE = 400
#: (identifier or None, tie): None is larger than any identifier.
Owner = tuple[int | None, int]


def _key(owner: Owner) -> tuple:
    return owner[0] is None, owner[0] or 0, owner[1]


class _Node:
    __slots__ = ("label", "kids", "owner", "rows", "count")

    def __init__(self, label: bytes, owner: Owner | None = None, rows: int = 0, count: int = 0):
        self.label, self.owner, self.rows, self.count = label, owner, rows, count
        self.kids: dict[int, _Node] = {}

    def own(self, owner: Owner, rows: int, count: int) -> None:
        if self.owner is None or _key(owner) < _key(self.owner):
            self.owner, self.rows = owner, rows
        elif owner == self.owner:
            self.rows += rows
        self.count += count


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix: doubling steps, then halving, each a comparison of whole slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _folder() -> str | None:
    """One of the folders that Spark itself spills to, where the worker knows them."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return folders[os.getpid() % len(folders)] if folders else None


class PatriciaTrie:
    def __init__(self, budget: int = 128 << 20):
        self.budget, self.held = budget, 0
        self.root = _Node(b"")
        self.spilled: dict[bytes, object] = {}

    def insert(self, key: bytes, owner: Owner, rows: int = 1, count: int = 1) -> None:
        """owner: an identifier, and what tells rows with one identifier apart; rows: how many have just this owner; count: how many in all."""
        for prefix, file in self.spilled.items():
            if key.startswith(prefix):
                pickle.dump((key, owner, rows, count), file)
                return
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], owner, rows, count)
                self.held += len(key) - at + NODE
                if self.held > self.budget:
                    self._spill()
                return
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            same = _common(kid.label, key[at : at + len(kid.label)])
            upper = _Node(kid.label[:same])
            kid.label = kid.label[same:]
            upper.kids[kid.label[0]] = kid
            node.kids[key[at]] = upper
            self.held += NODE
            node, at = upper, at + same
        node.own(owner, rows, count)

    def _walk(self, top: _Node, prefix: bytes) -> Iterator[tuple[bytes, Owner, int, int]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            if node.count:
                yield path, node.owner, node.rows, node.count
            stack.extend((kid, path + kid.label) for kid in node.kids.values())

    def _bytes(self, top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE
            stack.extend(node.kids.values())
        return total

    def _spill(self) -> None:
        """Moves the heaviest subtree of at most half of what is held to a file. Its prefix is longer than what all strings share, so files get smaller subjects."""
        node, path = self.root, b""
        while True:
            heavy = max((kid for kid in node.kids.values() if kid.kids), key=self._bytes, default=None)
            if heavy is None:  # only single strings here: nothing that a subtree would save
                self.budget *= 2
                return
            size = self._bytes(heavy)
            if 2 * size <= self.held:
                break
            node, path = heavy, path + heavy.label
        prefix = path + heavy.label
        file = tempfile.TemporaryFile(dir=_folder())
        for item in self._walk(heavy, prefix):
            pickle.dump(item, file)
        self.held -= size
        del node.kids[heavy.label[0]]
        self.spilled[prefix] = file

    def items(self) -> Iterator[tuple[bytes, Owner, int, int]]:
        """(string, smallest owner, rows with just this owner, rows in all) of each distinct string."""
        yield from self._walk(self.root, b"")
        for file in self.spilled.values():
            file.seek(0)
            trie = PatriciaTrie(self.budget)
            with file:
                while True:
                    try:
                        trie.insert(*pickle.load(file))
                    except EOFError:
                        break
            yield from trie.items()
