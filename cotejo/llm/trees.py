"""Ordered trees, and their alignment by simple tree matching.

Two trees match from their roots down: nodes of one kind are paired if their parents are, in
the order of siblings, so that as many nodes as possible are paired.  The best pairing of two
nodes' children is found by dynamic programming over the best pairings below each pair; a
pair whose texts are equal counts double, so what is constant keeps its place beside what
was put in.  Equal subtrees at either end of two child lists are paired at once, which is
always among the best.
"""

from __future__ import annotations

import sys
import zlib
from math import isqrt

import numpy as np

MASK = (1 << 64) - 1
#: Fixed odd multipliers; any would do, but results must not change between tasks.
STEP, TURN = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Pairs of siblings from which lists are compared row by row in arrays, or by their equal subtrees alone where a matching is so limited.
WIDE = 10_000
#: Pairs of nodes, and weights, that are remembered while long lists are compared; what is forgotten is worked out again.
KNOWN, HELD = 100_000, 1 << 24


class Tree:
    """Nodes in the order of the page, each behind its parent: kind, hash of its text, and whether it may be a constant."""

    def __init__(self, parents: list[int], kinds: list[int], texts: list[int], free: list[bool]):
        n = len(parents)
        self.parents, self.kinds, self.texts, self.free = parents, kinds, texts, free
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[parents[i]].append(i)
        #: The hash and the size of each node's subtree.
        self.same, self.size, self.depth = [0] * n, [1] * n, 1
        depth = [1] * n
        for i in range(n - 1, -1, -1):
            h = kinds[i] * STEP + texts[i]
            for k in self.kids[i]:
                h = ((h ^ (h >> 29)) * TURN + self.same[k]) & MASK
                self.size[i] += self.size[k]
                depth[i] = max(depth[i], depth[k] + 1)
            self.same[i] = h & MASK
        self.depth = depth[0] if n else 0

    def packed(self) -> bytes:
        columns = (np.array(self.parents, np.int32), np.array(self.kinds, np.int64), np.array(self.texts, np.int64), np.array(self.free, bool))
        return zlib.compress(b"".join(c.tobytes() for c in columns), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        data = zlib.decompress(data)
        n = len(data) // 21
        read = lambda kind, at: np.frombuffer(data, kind, n, at * n).tolist()
        return cls(read(np.int32, 0), read(np.int64, 4), read(np.int64, 12), read(bool, 20))


class Matching:
    """One tree matched with another; if it is limited, lists of more than WIDE pairs by their equal subtrees alone."""

    def __init__(self, a: Tree, b: Tree, limited: bool = True):
        self.a, self.b, self.limited = a, b, limited
        self.alike: tuple[list[int], list[int]] | None = None
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weight(self, i: int, j: int) -> int:
        """Of the best matching of the subtrees below two nodes of one kind."""
        a, b = self.a, self.b
        if a.same[i] == b.same[j]:
            return 2 * a.size[i]
        if not a.kids[i] or not b.kids[j]:
            return 1 + (a.texts[i] == b.texts[j])
        if (i, j) not in self.known:
            total, pairs = self.paired(a.kids[i], b.kids[j])
            self.known[i, j] = total + 1 + (a.texts[i] == b.texts[j]), pairs
        return self.known[i, j][0]

    def paired(self, xs: list[int], ys: list[int]) -> tuple[int, list[tuple[int, int]]]:
        """The weight and the pairs of the best pairing of two lists of siblings."""
        a, b = self.a, self.b
        out, total, first, m, n = [], 0, 0, len(xs), len(ys)
        while first < min(m, n) and a.same[xs[first]] == b.same[ys[first]]:
            total += 2 * a.size[xs[first]]
            out.append((xs[first], ys[first]))
            first += 1
        while min(m, n) > first and a.same[xs[m - 1]] == b.same[ys[n - 1]]:
            m, n = m - 1, n - 1
            total += 2 * a.size[xs[m]]
            out.append((xs[m], ys[n]))
        xs, ys = xs[first:m], ys[first:n]
        if len(xs) * len(ys) > WIDE and not self.limited:
            most, pairs = self.in_rows(xs, ys)
            return total + most, out + pairs
        if len(xs) * len(ys) > WIDE:
            pairs = self.in_step(xs, ys)
            return total + sum(2 * a.size[i] for i, _ in pairs), out + pairs
        best = [[0] * (len(ys) + 1)]
        others = [(j, b.kinds[j], not b.kids[j], b.same[j], b.texts[j]) for j in ys]
        for i in xs:
            above, row, before, left = best[-1], [0], 0, 0
            kind, leaf, same, text, double = a.kinds[i], not a.kids[i], a.same[i], a.texts[i], 2 * a.size[i]
            for (j, kind_, leaf_, same_, text_), over in zip(others, above[1:]):
                most = over if over > left else left
                if kind == kind_:
                    own = before + (double if same == same_ else 1 + (text == text_) if leaf or leaf_ else self.weight(i, j))
                    most = own if own > most else most
                row.append(most)
                before, left = over, most
            best.append(row)
        p, q = len(xs), len(ys)
        while p and q:
            here = best[p][q]
            if here == best[p - 1][q]:
                p -= 1
            elif here == best[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                out.append((xs[p], ys[q]))
        return total + best[-1][-1], out

    def classes(self) -> tuple[list[int], list[int]]:
        """A number for each node of both trees; nodes of one number weigh the same: they differ only in texts that the other tree has nowhere."""
        if self.alike is None:
            shared, numbers, out = set(self.a.texts) & set(self.b.texts), {}, []
            for tree in (self.a, self.b):
                own = [0] * len(tree.kinds)
                for i in range(len(own) - 1, -1, -1):
                    shape = tree.kinds[i], tree.texts[i] if tree.texts[i] in shared else None, tuple(own[k] for k in tree.kids[i])
                    own[i] = numbers.setdefault(shape, len(numbers))
                out.append(own)
            self.alike = out[0], out[1]
        return self.alike

    def in_rows(self, xs: list[int], ys: list[int]) -> tuple[int, list[tuple[int, int]]]:
        """What ``paired`` finds, for long lists: a row at a time, of which every sqrt(n)-th is kept; nodes that weigh the same are compared once."""
        a, b = self.a, self.b
        of_a, of_b = self.classes()
        kinds, texts, leaf = np.array([b.kinds[j] for j in ys]), np.array([b.texts[j] for j in ys]), np.array([not b.kids[j] for j in ys])
        same, (_, first, number) = np.array([b.same[j] for j in ys], np.uint64), np.unique([of_b[j] for j in ys], return_index=True, return_inverse=True)
        held: dict[int, np.ndarray] = {}

        def weights(i: int) -> np.ndarray:
            if of_a[i] in held:
                return held[of_a[i]]
            kind = kinds == a.kinds[i]
            equal = kind & (same == np.uint64(a.same[i]))
            row = np.where(equal, 2 * a.size[i], np.where(kind, 1 + (texts == a.texts[i]), 0))
            inner = kind & ~equal & ~leaf
            if a.kids[i] and inner.any():
                own = np.zeros(len(first), np.int64)
                for c in np.unique(number[inner]):
                    own[c] = self.weight(i, ys[first[c]])
                    if len(self.known) > KNOWN:
                        self.known.clear()
                row[inner] = own[number[inner]]
                if (len(held) + 1) * len(ys) <= HELD:
                    held[of_a[i]] = row
            return row

        def following(above: np.ndarray, i: int) -> np.ndarray:
            row = np.zeros_like(above)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights(i)), out=row[1:])
            return row

        step, p, q, out = isqrt(len(xs)) + 1, len(xs), len(ys), []
        kept, row = [], np.zeros(len(ys) + 1, np.int64)
        for k, i in enumerate(xs):
            if k % step == 0:
                kept.append(row)
            row = following(row, i)
        most = int(row[-1])
        while p and q:
            start = (p - 1) // step * step
            best = [kept[start // step]]
            for i in xs[start:p]:
                best.append(following(best[-1], i))
            while p > start and q:
                here = best[p - start][q]
                if here == best[p - start - 1][q]:
                    p -= 1
                elif here == best[p - start][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    out.append((xs[p], ys[q]))
        return most, out

    def in_step(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Pairs of equal subtrees in order, each with the next one there is."""
        places: dict[int, list[int]] = {}
        for k in range(len(ys) - 1, -1, -1):
            places.setdefault(self.b.same[ys[k]], []).append(k)
        out, last = [], -1
        for i in xs:
            of = places.get(self.a.same[i], [])
            while of and of[-1] <= last:
                of.pop()
            if of:
                last = of.pop()
                out.append((i, ys[last]))
        return out

    def pairs(self) -> list[int]:
        """For each node of the first tree the node of the second one that it is paired with, or -1."""
        a, b = self.a, self.b
        out = [-1] * len(a.kinds)
        if not a.kinds or not b.kinds or a.kinds[0] != b.kinds[0]:
            return out
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 4 * min(a.depth, b.depth) + 1000))
        try:
            todo = [(0, 0)]
            while todo:
                i, j = todo.pop()
                out[i] = j
                if a.same[i] == b.same[j]:
                    todo.extend(zip(a.kids[i], b.kids[j]))
                elif a.kids[i] and b.kids[j]:
                    self.weight(i, j)
                    todo.extend(self.known[i, j][1])
        finally:
            sys.setrecursionlimit(before)
        return out


def mark(exemplar: int, node: int, text: int) -> int:
    """The hash of a node of an exemplar together with a text, signed."""
    h = ((text & MASK) ^ ((node * STEP + exemplar * TURN) & MASK)) * TURN & MASK
    return (h ^ (h >> 31)) - (1 << 63)


def marks(page: Tree, exemplars: list[Tree]) -> list[list[int]]:
    """For each node of a page that may be a constant its marks by all exemplars it has a partner in; of others none."""
    out: list[list[int]] = [[] for _ in page.kinds]
    for e, exemplar in enumerate(exemplars):
        for i, j in enumerate(Matching(page, exemplar, limited=False).pairs()):
            if j >= 0 and page.free[i]:
                out[i].append(mark(e, j, page.texts[i]))
    return out
