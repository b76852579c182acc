"""Signature trees over token bitmaps: OR-combined nodes, size ranges, dual traversal (NumPy, one group at a time)."""

from __future__ import annotations

import numpy as np

FANOUT = 8
_CHUNK = 1 << 14


class Tree:
    """Levels of (OR bitmap, least size, largest size, largest slack); level 0 holds the sets themselves.

    slack = size - popcount: how many tokens hide behind another token's bit. For sets a, b
    |a & b| <= popcount(bits a & bits b) + min(slack a, slack b), and for nodes the same holds with
    their OR-combined bitmaps and their largest slacks.
    """

    def __init__(self, ids: np.ndarray, bits: np.ndarray, size: np.ndarray):
        order = np.lexsort((bits[:, 0], size))
        self.ids = ids[order]
        bits, size = bits[order], size[order].astype(np.int64)
        slack = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, slack)]
        while len(self.levels[-1][1]) > FANOUT:
            b, lo, hi, sl = self.levels[-1]
            cut = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sl, cut)))


def _possible(a, i, b, j, num: int, den: int) -> np.ndarray:
    """Node pairs that may hold a link, Jaccard >= num / den."""
    lo, hi = a[1][i] + b[1][j], np.minimum(a[2][i], b[2][j])
    need = -(-num * lo // (num + den))
    ok = (hi >= need) & (den * hi >= num * np.maximum(a[1][i], b[1][j]))
    at = np.flatnonzero(ok)
    if len(at):
        common = np.bitwise_count(a[0][i[at]] & b[0][j[at]]).sum(1, dtype=np.int64)
        ok[at] = common + np.minimum(a[3][i[at]], b[3][j[at]]) >= need[at]
    return ok


def dual(a: Tree, b: Tree, num: int, den: int, skip=None):
    """Yield arrays (id in a, id in b) of set pairs that the bounds can't exclude; a is b: each pair once.

    ``skip(ids a, ids b)`` tells which leaf pairs need no look. Work stacks hold bounded chunks, so memory
    doesn't follow the number of pairs.
    """
    same, top = a is b, (len(a.levels) - 1, len(b.levels) - 1)
    n, m = len(a.levels[-1][1]), len(b.levels[-1][1])
    stack = [(top[0], top[1], np.repeat(np.arange(n), m), np.tile(np.arange(m), n))]
    while stack:
        la, lb, i, j = stack.pop()
        if same:
            keep = i <= j if la else i < j
            i, j = i[keep], j[keep]
        if len(i) > _CHUNK:
            stack.extend((la, lb, i[k : k + _CHUNK], j[k : k + _CHUNK]) for k in range(0, len(i), _CHUNK))
            continue
        if not la and not lb and skip is not None and len(i):
            keep = ~skip(a.ids[i], b.ids[j])
            i, j = i[keep], j[keep]
        keep = _possible(a.levels[la], i, b.levels[lb], j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not la and not lb:
            yield a.ids[i], b.ids[j]
            continue
        for level, side in ((la, 0), (lb, 1)):
            if level and level >= (la, lb)[1 - side]:
                kids = (a if side == 0 else b).levels[level - 1][1]
                x, y = (i, j) if side == 0 else (j, i)
                x = x[:, None] * FANOUT + np.arange(FANOUT)
                y = np.repeat(y, FANOUT)
                x = x.ravel()
                ok = x < len(kids)
                x, y = x[ok], y[ok]
                i, j = (x, y) if side == 0 else (y, x)
                la, lb = (la - 1, lb) if side == 0 else (la, lb - 1)
        stack.append((la, lb, i, j))


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """OR a bitmap of a power of two down to ``words`` 64-bit words; bounds stay valid."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def bitmap(tokens: np.ndarray, bits_per_token: int = 2) -> bytes:
    """Token bitmap of a power-of-two length of at least bits_per_token bits a token, 64 at least."""
    width = max(64, 1 << int(max(1, bits_per_token * len(tokens)) - 1).bit_length())
    flags = np.zeros(width, bool)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


class Forest:
    """One tree per bitmap length. Sets that can link differ by a factor den / num in size, so by no more doublings of length than that holds."""

    def __init__(self, bitmaps: list[bytes], size: np.ndarray):
        width = np.array([len(b) // 8 for b in bitmaps])
        self.trees, self.bits = {}, {}
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            self.bits[int(w)] = at, np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64).reshape(len(at), int(w)), size[at]
            self.trees[int(w)] = Tree(*self.bits[int(w)])

    def pairs(self, num: int, den: int, skip=None):
        for w, tree in self.trees.items():
            yield from dual(tree, tree, num, den, skip)
            wider = 2 * w
            while wider * num < 2 * w * den:
                if wider in self.bits:
                    at, bits, size = self.bits[wider]
                    yield from dual(tree, Tree(at, fold(bits, w), size), num, den, skip)
                wider *= 2


class Labels:
    """Union-find over 0..n-1 whose labels can be read as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def same(self, i, j):
        return self.label[i] == self.label[j]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(self.label[i].tolist(), self.label[j].tolist(), strict=True):
            x, y = self.label[x], self.label[y]
            if x != y:
                lo, hi = (x, y) if x < y else (y, x)
                self.label[self.label == hi] = lo
