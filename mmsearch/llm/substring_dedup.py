"""Substring dedup by fixed-block anchors.

A repeated window of ``width`` words holds a whole aligned block of ``block`` words of the text it
repeats, if 2 * block - 1 <= width. So only every block-th position of a text is indexed, while every
rolling block of every text is a probe:

 1. texts are dealt once into lots of about 8 MB. A lot sends each distinct block hash once, with a flag
    for an index block and one for several texts, as sorted packed arrays. The hash has just the bits that
    keep false hits under 1 in 256 probes for the size of the corpus; a false hit costs work in step 3 and
    changes no result.
 2. a hash hits if some text indexes it and two texts hold it. Hits go back to the lots that asked. A block
    that a third of all texts share is asked for once a lot, never once a text, and makes no pairs.
 3. hits are extended: the windows that reach over a hit are hashed whole (64 bits) and sent once a lot with
    the lot's least doc_id; what comes back is the least doc_id of all. Runs of such windows are the maximal
    exact repeats.
 4. words under a window that starts in a smaller doc_id go.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CHUNK_BYTES, Words, chunks, pack, planes, splitmix, unpack, unplanes

_U = np.uint64


def _lot_column(lots: int):
    d = F.col("doc_id")
    return F.pmod(d.bitwiseXOR(F.shiftrightunsigned(d, 13)).bitwiseXOR(F.shiftrightunsigned(d, 29)), F.lit(lots).cast("long"))


SENT = "part long, sender long, hashes binary, docs binary, codes binary"
_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _distinct(h: np.ndarray, d: np.ndarray, indexed: np.ndarray):
    """Per distinct hash, ascending: least doc, whether several docs have it, whether one indexes it."""
    if not len(h):
        return h, d, indexed, indexed
    by = np.lexsort((d, h))
    h, d, indexed = h[by], d[by], indexed[by]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(at[1:], len(h)) - 1
    return h[at], d[at], d[last] > d[at], np.logical_or.reduceat(indexed, at)


def _send(part: np.ndarray, sender: int | None, h: np.ndarray, d: np.ndarray | None, flags: np.ndarray) -> pa.Table:
    """A row for each part: its hashes ascending, and for each a code of flags (two bits) and, with d, a doc_id."""
    cols: list[list] = [[] for _ in _NAMES]
    by = np.lexsort((h, part))
    part, h, flags = part[by], h[by], flags[by]
    cut = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)] if len(part) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if d is None:
            own, codes = np.zeros(0, np.int64), flags[a:b].astype(np.uint8)
        else:
            own, place = np.unique(d[by[a:b]], return_inverse=True)
            codes = place.astype(np.uint32) * np.uint32(4) + flags[a:b].astype(np.uint32)
        for c, x in zip(cols, (part[a], sender, pack(h[a:b]), pack(own.view(_U)), planes(codes)), strict=True):
            c.append(x)
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], _NAMES)


def _received(table: pa.Table, docs: bool):
    """(sender, hash, doc or None, flags), in no order."""
    out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]]
    for sender, hashes, own, codes in zip(*(table.column(c).to_pylist() for c in _NAMES[1:]), strict=True):
        h = unpack(hashes)
        code = unplanes(codes, np.uint32 if docs else np.uint8)
        out[0].append(np.full(len(h), -1 if sender is None else sender, np.int64))
        out[1].append(h)
        if docs:
            out[2].append(unpack(own).view(np.int64)[code >> 2])
        out[3].append(code & 3)
    return [np.concatenate(x) for x in out]


def _groups(h: np.ndarray):
    """(order by hash, where each hash begins, how many there are of each)."""
    by = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    return by, at, np.diff(np.append(at, len(h)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (splitmix(h) % _U(buckets)).astype(np.int64)


def _anchor_hits(table: pa.Table) -> pa.Table:
    sender, h, _, flags = _received(table, False)
    by, at, size = _groups(h)
    sender, h, flags = sender[by], h[by], flags[by]
    hit = np.repeat(((np.bitwise_or.reduceat(flags, at) & 2) > 0) & ((size > 1) | ((flags[at] & 1) > 0)), size)
    return _send(sender[hit], None, h[hit], None, flags[hit])


def _least_docs(table: pa.Table) -> pa.Table:
    sender, h, d, flags = _received(table, True)
    by, at, size = _groups(h)
    sender, h, d, flags = sender[by], h[by], d[by], flags[by]
    least = np.repeat(np.minimum.reduceat(d, at), size)
    tell = (d > least) | ((flags & 1) > 0)
    return _send(sender[tell], None, h[tell], least[tell], flags[tell])


def _texts(table: pa.Table, limit: int = CHUNK_BYTES):
    """(doc_ids, words, bytes, offsets) of the chunks of a lot."""
    for batch in table.combine_chunks().to_batches():
        for a, b, raw, at in chunks(batch, limit=limit):
            yield batch.column("doc_id").slice(a, b - a), Words(raw, at), raw, at


def _gathered(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, d, f = ([np.zeros(0, t)] + [x[k] for x in found] for k, t in enumerate((_U, np.int64, bool)))
    return np.concatenate(h), np.concatenate(d), np.concatenate(f)


def _ask(block: int, bits: int, buckets: int):
    """Every rolling block is a probe; a block at a multiple of ``block`` is indexed too."""

    def run(docs: pa.Table) -> pa.Table:
        found = []
        for ids, w, _, _ in _texts(docs):
            h, start = w.grams(block)
            row = w.row[start]
            found.append((h >> _U(64 - bits), ids.to_numpy(zero_copy_only=False)[row], (start - w.first[row]) % block == 0))
        h, _, several, indexed = _distinct(*_gathered(found))
        return _send(_bucket(h, buckets), docs.column("part")[0].as_py(), h, None, several + 2 * indexed.astype(np.uint8))

    return run


def _has(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each wanted value is in the ascending array, where)."""
    if not len(have):
        return np.zeros(len(want), bool), np.zeros(len(want), np.int64)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return have[at] == want, at


def _extend(block: int, width: int, bits: int, buckets: int):
    """Whole windows that reach over a hit, with the least doc_id of the lot."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        have = np.sort(_received(hits, False)[1])
        found = []
        for ids, w, _, _ in _texts(docs) if len(have) else ():
            h, start = w.grams(block)
            hit = np.zeros(len(w.hash) + 1, np.int64)
            hit[start[_has(have, h >> _U(64 - bits))[0]]] = 1
            before = np.concatenate([[0], np.cumsum(hit)])
            h, start = w.grams(width)
            near = before[start + width - block + 1] > before[start]
            h, start = h[near], start[near]
            found.append((h, ids.to_numpy(zero_copy_only=False)[w.row[start]], np.zeros(len(h), bool)))
        h, d, several, _ = _distinct(*_gathered(found))
        return _send(_bucket(h, buckets), docs.column("part")[0].as_py() if docs.num_rows else None, h, d, several.astype(np.uint8))

    return run


def _remove(width: int, keep_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def run(docs: pa.Table, later: pa.Table) -> pa.Table:
        _, have, least, _ = _received(later, True)
        by = np.argsort(have)
        have, least = have[by], least[by]
        out: list[list] = [[] for _ in names]
        for ids, w, raw, at in _texts(docs):
            h, start = w.grams(width)
            known, place = _has(have, h)
            start, place = start[known], place[known]
            hit = start[ids.to_numpy(zero_copy_only=False)[w.row[start]] > least[place]] if len(start) else start
            covered = np.zeros(len(w.hash) + width + 1, np.int64)
            covered[hit] += 1
            covered[hit + width] -= 1
            gone = np.cumsum(covered)[: len(w.hash)] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[w.first[1:]] - total[w.first[:-1]]
            body = raw.tobytes()
            digests, texts = [], []
            for r in range(w.rows):
                words = body[at[r] : at[r + 1]].split()
                if removed[r]:
                    words = [x for x, o in zip(words, gone[w.first[r] : w.first[r + 1]].tolist(), strict=True) if not o]
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
            for c, x in zip(out, (ids, pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())), strict=False):
                c.append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.chunked_array(c, t) for c, t in zip(out, types, strict=False)], names)

    return run


def remove_repeats(docs: DataFrame, width: int = 13, block: int | None = None, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row of docs (columns doc_id, text; others are ignored).

    Words split at ``\\x20\\x09-\\x0D`` and are compared unchanged. A word goes if it lies in a window of
    ``width`` words that also starts in a text with a smaller doc_id; windows are those of the input.
    Kept words are joined by one space.

    Null text: no words. Null doc_id: the row is neither compared nor changed. Rows that repeat a doc_id
    don't remove from each other, each gets its row. Texts under ``width`` words stay whole. Empty table:
    empty result.
    """
    block = (width + 1) // 2 if block is None else block
    if 2 * block - 1 > width:
        raise ValueError("a window must hold a whole aligned block: 2 * block - 1 <= width")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, rest = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 1
    bits = min(64, max(16, math.ceil(math.log2(chars / 4 / block)) + 8))
    lots = buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / 8_000_000))
    lot = known.withColumn("part", _lot_column(lots))

    def with_lot(answers: DataFrame, work, schema: str) -> DataFrame:
        return lot.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(work, schema)

    asked = lot.groupBy("part").applyInArrow(_ask(block, bits, buckets), SENT)
    hits = asked.groupBy("part").applyInArrow(_anchor_hits, SENT)
    windows = with_lot(hits, _extend(block, width, bits, buckets), SENT)
    later = windows.groupBy("part").applyInArrow(_least_docs, SENT)
    remove = _remove(width, keep_text)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    nothing = _send(np.zeros(0, np.int64), None, np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def alone(batches):
        for batch in batches:
            yield from remove(pa.Table.from_batches([batch]), nothing).to_batches()

    return with_lot(later, remove, result).unionByName(rest.mapInArrow(alone, result))
