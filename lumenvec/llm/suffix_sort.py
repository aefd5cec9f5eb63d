"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries for what is still tied there."""

from __future__ import annotations

import numpy as np

WORD = 8


def multikey_quicksort(words: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (big-endian words of a string) by group and their first ``depth`` words; and tie numbers in that order.

    Ternary partitioning as in multikey quicksort, on all open segments at once: each round takes a pivot (median of three) of every
    segment at its own depth, parts it into less, equal and greater, and moves the equal part one word on.
    """
    perm = np.argsort(groups, kind="stable")
    seg = np.cumsum(np.r_[True, np.diff(groups[perm]) != 0]) - 1 if len(perm) else np.zeros(0, np.int64)
    level = np.zeros(seg[-1] + 1 if len(seg) else 0, np.int64)
    while len(perm):
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[first, len(seg)])
        open_ = (size > 1) & (level < depth)
        if not open_.any():
            break
        lv = np.minimum(level, depth - 1)
        key = lambda at: words[perm[at], lv]
        three = np.sort(np.stack([key(first), key(first + size // 2), key(first + size - 1)]), 0)
        live = np.flatnonzero(open_[seg])
        s = seg[live]
        k, pivot = words[perm[live], level[s]], three[1][s]
        side = (k > pivot).astype(np.int64) - (k < pivot) + 1
        order = np.argsort(s * 3 + side, kind="stable")
        perm[live] = perm[live][order]
        part = seg * 3 + 1
        part[live] = (s * 3 + side)[order]
        new = np.r_[True, part[1:] != part[:-1]]
        at = np.flatnonzero(new)
        level = level[seg[at]] + (open_[seg[at]] & (part[at] % 3 == 1))
        seg = np.cumsum(new) - 1
    return perm, seg


class BlindTrie:
    """A trie of equally long byte strings that stores, per node, only the depth of its branch and one byte per child."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.texts: list[bytes] = []
        self.numbers: list[int] = []

    def add(self, text: bytes) -> None:
        """Descend by branch bytes alone, compare once with the leaf that is reached, and branch off at the first difference."""
        me = len(self.texts)
        self.texts.append(text)
        number = int.from_bytes(text, "big")
        self.numbers.append(number)
        node = self.root
        if node is None:
            self.root = [len(text), [me]]
            return
        width = len(text)
        while node[0] < width:
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        apart = number ^ self.numbers[node[1][0]]
        if not apart:
            node[1].append(me)
            return
        common = (8 * width - apart.bit_length()) // 8
        leaf = [width, [me]]
        node, above = self.root, None
        while node[0] < common:
            above, node = node, node[1][text[node[0]]]
        if node[0] == common:
            node[1][text[common]] = leaf
            return
        below = node
        while below[0] < width:
            below = next(iter(below[1].values()))
        fork = [common, {self.texts[below[1][0]][common]: node, text[common]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[1], list):
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: np.ndarray, groups: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix by group and content, and each row's common prefix with the row before it (0 across groups)."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // WORD) * WORD), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    shallow = min(shallow, words.shape[1])
    perm, ties = multikey_quicksort(words, groups, shallow)
    first = np.flatnonzero(np.r_[True, ties[1:] != ties[:-1]]) if n else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), np.r_[first[1:], n].tolist() if n else [], strict=True):
        if hi - lo > 1:
            rows = perm[lo:hi]
            trie = BlindTrie()
            for row in padded[rows, shallow * WORD :]:
                trie.add(row.tobytes())
            perm[lo:hi] = rows[trie.order()]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = strings[perm[1:]] != strings[perm[:-1]]
        some = differ.any(1)
        lcp[1:] = np.where(some, differ.argmax(1), width)
        lcp[1:][groups[perm[1:]] != groups[perm[:-1]]] = 0
    return perm, lcp
