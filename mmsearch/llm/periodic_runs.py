"""Periodic runs of words by block convolution.

A run is a maximal stretch with smallest period q, at least ``least`` words and ``times`` periods long. At the
scale B = 8, 16, 32, ... every aligned block of B words is compared with the words behind it at all distances
of the scale at once (1 to 15 at the first, B to 2B - 1 at the others): the squared differences

    D[d] = sum (x[a+j] - x[a+d+j])^2 = sum x[a+j]^2 + sum x[a+d+j]^2 - 2 (x * x)[d]

come from number-theoretic transforms modulo as many primes as bring their product above the largest value D
can take, so D[d] = 0 is exact. A run with a period of the scale holds a whole aligned block and its next
occurrence, so each run has a zero in the table of its scale; the zero's distance seeds an extension to
both sides, word by word.

A block can only have an occurrence within the scale if each of its words has one, which the distance to the
next equal word tells; blocks without are not transformed. Texts are handled one by one inside Arrow tasks: no
shuffle, and a task's memory follows the chunk or the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, chunks, splitmix

_U = np.uint64
BASE = 8
#: Primes of the form k * 2^m + 1 with a primitive root; transforms up to 2^25 values.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Values of one batch of transforms.
BATCH = 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@lru_cache(maxsize=256)
def _powers(p: int, root: int, size: int, back: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of that order."""
    w = pow(root, (p - 1) // size, p)
    w = pow(w, p - 2, p) if back else w
    out = np.ones(max(1, size // 2), _U)
    n = 1
    while n < len(out):
        m = min(n, len(out) - n)
        out[n : n + m] = out[:m] * _U(pow(w, n, p)) % _U(p)
        n *= 2
    return out


def ntt(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Transform of each row (a power of two long), in bit-reversed order; values below p."""
    rows, size = x.shape
    q = _U(p)
    while size > 1:
        v = x.reshape(rows, -1, 2, size // 2)
        a, b = v[:, :, 0], v[:, :, 1]
        high = (a + (q - b)) * _powers(p, root, size, False) % q
        low = a + b
        v[:, :, 0] = np.minimum(low, low - q)  # below q, low - q wraps to a huge value
        v[:, :, 1] = high
        size //= 2
    return x


def intt(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Back from bit-reversed order."""
    rows, size = x.shape
    q = _U(p)
    span = 2
    while span <= size:
        v = x.reshape(rows, -1, 2, span // 2)
        a, b = v[:, :, 0].copy(), v[:, :, 1] * _powers(p, root, span, True) % q
        low, high = a + b, a + (q - b)
        v[:, :, 0] = np.minimum(low, low - q)
        v[:, :, 1] = np.minimum(high, high - q)
        span *= 2
    return x * _U(pow(size, p - 2, p)) % q


def zero_mismatches(pattern: np.ndarray, window: np.ndarray, largest: int) -> np.ndarray:
    """(row, k) booleans: whether pattern[row] equals window[row, k : k + B], for each k that fits.

    Values are whole numbers from 0 to ``largest``; every difference is squared and summed exactly.
    """
    rows, size = pattern.shape
    wide = window.shape[1]
    n = 1 << (wide - 1).bit_length()
    fits = wide - size + 1
    zero = np.ones((rows, fits), bool)
    bound, have = size * largest * largest, 1
    for p, root in PRIMES:
        q = _U(p)
        turned = np.zeros((rows, n), _U)
        turned[:, 0] = pattern[:, 0]
        turned[:, n - size + 1 :] = pattern[:, :0:-1]
        padded = np.zeros((rows, n), _U)
        padded[:, :wide] = window
        product = intt(ntt(turned % q, p, root) * ntt(padded % q, p, root) % q, p, root)[:, :fits]
        squares = np.zeros((rows, wide + 1), _U)
        np.cumsum(window * window % q, axis=1, out=squares[:, 1:])
        own = (pattern * pattern % q).sum(1, dtype=_U)
        both = own[:, None] + squares[:, size : size + fits] - squares[:, :fits]
        zero &= both % q == product * _U(2) % q
        have *= p
        if have > bound:
            return zero
    raise ValueError("a text too long for the primes at hand")


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree."""
    at, step = 0, 64
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, step * 2
    return len(a)


class _Text:
    """Runs of one text found so far, scale by scale."""

    def __init__(self, ids: np.ndarray, least: int, times: int):
        self.x, self.least, self.times = ids, least, times
        self.runs: dict[tuple[int, int], int] = {}
        self.fresh = True

    def cover(self) -> None:
        """Per position the longest run over it, to tell hits that only repeat what is known."""
        if self.fresh:
            found = sorted((e - s, s, e, q) for (s, e), q in self.runs.items())
            self.s, self.e, self.q = (np.array([r[k] for r in found] + [0], np.int64) for k in (1, 2, 3))
            self.over = np.full(len(self.x), len(found), np.int64)
            for k, (_, s, e, _) in enumerate(found):
                self.over[s:e] = k
            self.fresh = False

    def news(self, a: int, size: int, ds: np.ndarray) -> np.ndarray:
        """Of the distances at which the block at a occurs again, those that can belong to a run not known yet.

        If the block and its copy lie in one run whose period divides the distance, the stretch is that run. If
        they lie in two runs of one period, a stretch over both is a run only if it maps an end of the one onto
        that of the other.
        """
        i, j = int(self.over[a]), self.over[a + ds]
        if self.s[i] > a or self.e[i] < a + size:
            return ds
        inside = (self.s[j] <= a + ds) & (self.e[j] >= a + ds + size) & (self.q[j] == self.q[i])
        same = (j == i) & (ds % self.q[i] == 0)
        apart = (j != i) & (self.e[j] - self.e[i] != ds) & (self.s[j] - self.s[i] != ds)
        return ds[~(inside & (same | apart))]

    def seed(self, a: int, size: int, ds: np.ndarray) -> None:
        self.cover()
        x = self.x
        for d in self.news(a, size, ds).tolist():
            stop = a + size + _first_difference(x[a + size : len(x) - d], x[a + size + d :]) + d
            start = a - _first_difference(x[:a][::-1], x[d : a + d][::-1])
            if stop - start >= max(self.least, self.times * d) and (start, stop) not in self.runs:
                self.runs[start, stop] = d  # scales ascend, so the smallest period comes first
                self.fresh = True

    def spans(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        return sorted(((s, e - s, q) for (s, e), q in self.runs.items()), key=lambda r: (r[0], r[2]))


def _next_equal(keys: np.ndarray) -> np.ndarray:
    """Distance to the next equal key, or a very large one."""
    out = np.full(len(keys), 1 << 60, np.int64)
    by = np.argsort(keys, kind="stable")
    same = keys[by[1:]] == keys[by[:-1]]
    out[by[:-1][same]] = (by[1:] - by[:-1])[same]
    return out


def _candidates(near: np.ndarray, first: np.ndarray, count: np.ndarray, least: int, times: int):
    """(block size, least distance, greatest, rows, block starts in the row) at each scale, where each word recurs soon enough."""
    blocks = count // BASE
    offset = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(count)), blocks)
    place = np.arange(offset[-1]) - offset[row]
    most = near[(first[row] + place * BASE)[:, None] + np.arange(BASE)].max(1, initial=0) if len(row) else np.zeros(0, np.int64)
    size, low, high = BASE, 1, 2 * BASE - 1
    while len(row):
        a = place * size
        ok = (most <= high) & (count[row] >= max(least, times * low)) & (a + size + low <= count[row])
        yield size, low, high, row[ok], a[ok]
        half = blocks // 2
        before = offset
        offset = np.concatenate([[0], np.cumsum(half)])
        row = np.repeat(np.arange(len(count)), half)
        place = np.arange(offset[-1]) - offset[row]
        left = before[row] + 2 * place
        most = np.maximum(most[left], most[left + 1]) if len(row) else most[:0]
        blocks, size = half, size * 2
        low, high = size, 2 * size - 1


def find_runs(near: np.ndarray, first: np.ndarray, count: np.ndarray, ids_of: Callable[[int], np.ndarray], least: int, times: int) -> dict[int, _Text]:
    """Runs of the rows of a chunk. near: distance to the next equal word; ids_of(row): the row's words as numbers from 1."""
    texts: dict[int, _Text] = {}
    for size, low, high, rows, starts in _candidates(near, first, count, least, times):
        for r in np.unique(rows).tolist():
            if r not in texts:
                texts[r] = _Text(ids_of(r), least, times)
        wide = size + high - low
        step = max(1, BATCH // (2 * wide))
        for at in range(0, len(rows), step):
            some, begin = rows[at : at + step].tolist(), starts[at : at + step].tolist()
            pattern, window = np.zeros((len(some), size), _U), np.zeros((len(some), wide), _U)
            largest = 0
            for k, (r, a) in enumerate(zip(some, begin, strict=True)):
                x = texts[r].x
                pattern[k] = x[a : a + size]
                behind = x[a + low : a + low + wide]
                window[k, : len(behind)] = behind
            largest = int(max(pattern.max(initial=0), window.max(initial=0)))
            hit, far = np.nonzero(zero_mismatches(pattern, window, largest))
            cut = np.flatnonzero(np.diff(hit, prepend=-1)).tolist() + [len(hit)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                k = int(hit[a])
                texts[some[k]].seed(begin[k], size, far[a:b] + low)
    return texts


Reorder = Callable[[int | None, int], np.ndarray | None]


def _annotate(least: int, times: int, reorder: Reorder | None):
    def run(batches):
        for batch in batches:
            for a, b, raw, at in chunks(batch):
                w = Words(raw, at)
                ids, body = batch.column("doc_id").slice(a, b - a), raw.tobytes()
                order = {}
                take = np.arange(len(w.hash))
                for r, i in enumerate(ids.to_pylist() if reorder else ()):
                    n = int(w.count[r])
                    if n and (own := reorder(i, n)) is not None:
                        order[r] = own
                        take[w.first[r] : w.first[r + 1]] = w.first[r] + own
                with np.errstate(over="ignore"):
                    near = _next_equal(w.hash[take] ^ splitmix(w.row.astype(_U)))

                def words(r: int) -> list[bytes]:
                    found = body[at[r] : at[r + 1]].split()
                    return [found[k] for k in order[r].tolist()] if r in order else found

                def numbers(r: int) -> np.ndarray:
                    seen: dict[bytes, int] = {}
                    return np.array([seen.setdefault(x, len(seen) + 1) for x in words(r)], _U)

                found = find_runs(near, w.first[:-1], w.count, numbers, least, times)
                texts, spans, best = [], [], []
                for r in range(w.rows):
                    own = words(r)
                    runs = found[r].spans() if r in found else []
                    if runs:
                        gone = np.zeros(len(own) + 1, np.int64)
                        for s, n, q in runs:
                            gone[s + q] += 1
                            gone[s + n] -= 1
                        own = [x for x, o in zip(own, np.cumsum(gone)[:-1].tolist(), strict=True) if not o]
                    texts.append(b" ".join(own))
                    spans.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    top = None
                    for s, n, q in runs:  # by start, then period: a later one must be strictly greater
                        if top is None or n * top[2] > top[1] * q:
                            top = (s, n, q)
                    best.append(top and {"start": top[0], "length": top[1], "period": top[2]})
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(w.count, pa.int64()), pa.array(spans, pa.list_(RUN)), pa.array(best, RUN), pa.array(texts, pa.binary()).view(pa.string())],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, reorder: Reorder | None = None) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) per row of docs (columns doc_id, text; others are ignored).

    Words split at ``\\x20\\x09-\\x0D`` and are compared unchanged. runs: (start, length, period) of every maximal
    stretch of at least ``least`` words and ``times`` smallest periods, by start, then period. best: the one of
    greatest length / period, the first on ties, or null. collapsed: the text without what any run repeats (its
    words behind the first period), words joined by one space. ``reorder(doc_id, n)`` may give, for each of a
    text's n words, the place of the word to read instead.

    Null and empty texts and texts under ``least`` words: no runs. A null doc_id stays null, rows that repeat a
    doc_id are judged one by one. Empty table: empty result. ``least`` is 24 at least, ``times`` 3 at least: the
    blocks of the scales rely on it.
    """
    if least < 3 * BASE or times < 3:
        raise ValueError("least must be 24 or more, times 3 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed string"
    return docs.mapInArrow(_annotate(least, times, reorder), schema)
