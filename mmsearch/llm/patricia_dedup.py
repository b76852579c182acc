"""Exact duplicates by Patricia tries.

 1. each task puts the keys of its texts (bytes without white space) into a compressed radix trie whose terminal
    nodes hold how many rows have that key and which of them stays, so that equal texts of a task are one row
    before anything is shuffled. A trie over its limit hands out its heaviest subtree and goes on.
 2. those rows are dealt out by length and content hash, and a trie of each partition takes the full byte
    strings: its terminals are the groups. What a trie can't hold is spilled by subtree: the subtree's strings, and
    those that come later under the same prefix, are written out and go through another round of smaller partitions.
 3. every row finds its group by the digest of its key. Groups of many rows are broadcast (their number is
    bounded by the rows over the least size), the others are joined by shuffle, so no key is hot.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, materialize
from .text import chunks

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of labels that a trie holds before it spills.
LIMIT = 48 << 20
#: Bytes of keys that a partition of the second step is planned for.
PART = 16 << 20
#: Rows of a group from which it is broadcast; grows with the table so that at most BROADCAST_ROWS groups are.
MANY = 1000


class Owner:
    """What a terminal holds: rows, and of the row that stays its rank (greater wins) and id (smaller wins, null last), and the rows that tie for it."""

    __slots__ = ("rows", "rank", "id", "ties")

    def __init__(self, rows: int, rank: int, id: int | None, ties: int):
        self.rows, self.rank, self.id, self.ties = rows, rank, id, ties

    def _order(self) -> tuple:
        return (-self.rank, self.id is None, self.id or 0)

    def take(self, other: Owner) -> None:
        self.rows += other.rows
        mine, its = self._order(), other._order()
        if mine == its:
            self.ties += other.ties
        elif its < mine:
            self.rank, self.id, self.ties = other.rank, other.id, other.ties


class Node:
    __slots__ = ("label", "next", "owner", "spilled")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.owner, self.next, self.spilled = label, owner, {}, False


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[at + low : at + mid] else (low, mid - 1)
    return low


class Trie:
    """A compressed radix trie of byte strings; edges carry whole labels."""

    def __init__(self, limit: int = LIMIT):
        self.root, self.limit, self.bytes, self.count = Node(b""), limit, 0, 0

    def insert(self, key: bytes, owner: Owner) -> bool:
        """False if the key lies under a prefix that was spilled; then it is not taken."""
        node, at = self.root, 0
        while at < len(key):
            child = node.next.get(key[at])
            if child is None:
                node.next[key[at]] = Node(key[at:], owner)
                self.bytes += len(key) - at
                self.count += 1
                return True
            if not key.startswith(child.label, at):
                n = _common(child.label, key, at)
                upper = Node(child.label[:n])
                upper.next[child.label[n]] = child
                child.label = child.label[n:]
                node.next[key[at]] = child = upper
            elif child.spilled:
                return False
            node, at = child, at + len(child.label)
        if node.spilled:
            return False
        if node.owner is None:
            node.owner = owner
            self.count += 1
        else:
            node.owner.take(owner)
        return True

    def items(self, node: Node | None = None, prefix: bytes = b""):
        """(key, owner) of every terminal below a node."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            here = prefix + node.label
            if node.owner is not None:
                yield here, node.owner
            stack += [(x, here) for x in node.next.values()]

    def _weights(self) -> dict[int, int]:
        """Bytes of labels of each subtree, by the node's identity; what is spilled weighs nothing."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.next.values()
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = 0 if node.spilled else len(node.label) + sum(weight[id(x)] for x in node.next.values())
        return weight

    def spill(self, keep_stub: bool):
        """Hand out the (key, owner) of a heavy subtree: of the heaviest children the first that holds at most half of all, or a single string; with a stub, its prefix stays closed."""
        weight = self._weights()
        parent, node, prefix = self.root, None, b""
        while True:
            below = [x for x in parent.next.values() if not x.spilled]
            if not below:
                break
            node = max(below, key=lambda x: weight[id(x)])
            if weight[id(node)] <= self.bytes // 2 or all(x.spilled for x in node.next.values()):
                break
            prefix += node.label
            parent = node
        if node is None:
            return []
        out = list(self.items(node, prefix))
        self.count -= len(out)
        self.bytes -= weight[id(node)]
        if keep_stub:  # one byte tells it from its siblings
            node.label, node.next, node.owner, node.spilled = node.label[:1], {}, None, True
        else:
            parent.next = {k: x for k, x in parent.next.items() if x is not node}
        return out


_KEYED = "length long, hash long, key binary, rows long, rank long, id long, ties long"
_GROUPS = "digest binary, rows long, rank long, id long, ties long, length long, hash long, key binary"


def _keyed(items) -> pa.RecordBatch:
    rows = [(len(k), xxhash.xxh3_64_intdigest(k) - (1 << 63), k, o.rows, o.rank, o.id, o.ties) for k, o in items]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["length", "hash", "key", "rows", "rank", "id", "ties"])


def _packets(items, size: int = 4 << 20):
    """Lists of items with about ``size`` bytes of keys."""
    now, held = [], 0
    for x in items:
        now.append(x)
        held += len(x[0])
        if held >= size:
            yield now
            now, held = [], 0
    if now:
        yield now


def _heads(batches):
    """(id, rank, digest) of every row."""
    for batch in batches:
        for a, b, raw, at in chunks(batch):
            body = raw.tobytes()
            digests = [hashlib.sha256(body[at[r] : at[r + 1]].translate(None, SPACE)).digest() for r in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("id", "rank", "rid")] + [pa.array(digests, pa.binary())], ["id", "rank", "rid", "digest"])


def _combine(limit: int):
    """Rows of a task with equal keys become one."""

    def run(batches):
        trie = Trie(limit)
        for batch in batches:
            for a, b, raw, at in chunks(batch):
                body = raw.tobytes()
                ids, ranks = (batch.column(c).slice(a, b - a).to_pylist() for c in ("id", "rank"))
                for r in range(b - a):
                    trie.insert(body[at[r] : at[r + 1]].translate(None, SPACE), Owner(1, ranks[r], ids[r], 1))
                while trie.bytes > limit and trie.count:
                    for some in _packets(trie.spill(False)):
                        yield _keyed(some)
        for some in _packets(trie.items()):
            yield _keyed(some)

    return run


def _gather(limit: int):
    """The groups of a partition; rows with a key are spilled ones, for another round."""

    def groups(items, spilled: bool) -> pa.RecordBatch:
        rows = [(None if spilled else hashlib.sha256(k).digest(), o.rows, o.rank, o.id, o.ties, len(k), xxhash.xxh3_64_intdigest(k) - (1 << 63), k if spilled else None) for k, o in items]
        types = [pa.binary(), *[pa.int64()] * 6, pa.binary()]
        names = ["digest", "rows", "rank", "id", "ties", "length", "hash", "key"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        trie = Trie(limit)
        for batch in batches:
            late = []
            for key, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "rows", "rank", "id", "ties")), strict=True):
                if not trie.insert(key, own := Owner(*rest)):
                    late.append((key, own))
            while trie.bytes > limit and trie.count > 1:  # one string stays at least, so every round ends some groups
                late += trie.spill(True)
            for some in _packets(late):
                yield groups(some, True)
        for some in _packets(trie.items()):
            yield groups(some, False)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("rank"), F.monotonically_increasing_id().alias("rid"), text.alias("text"))


def groups(docs: DataFrame, limit: int = LIMIT, part: int = PART) -> DataFrame:
    """(digest, rows, rank, id, ties) per distinct key of docs (doc_id, text): the second step, written to the shared folder.

    rank, id: code points and doc_id of the row that stays; ties: rows that are both.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    chars = rows.agg(F.sum("rank")).first()[0] or 1
    keyed = rows.select("id", "rank", "text").mapInArrow(_combine(limit), _KEYED)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / part))
    done = None
    while True:
        found = materialize(keyed.repartition(parts, "length", "hash").mapInArrow(_gather(limit), _GROUPS), "tries")
        own = found.filter("digest is not null").select("digest", "rows", "rank", "id", "ties")
        done = own if done is None else done.unionByName(own)
        left = found.filter("digest is null")
        if left.isEmpty():
            return done
        keyed, parts = left.select("length", "hash", "key", "rows", "rank", "id", "ties"), parts * 4 + 1


def exact_copies(docs: DataFrame, limit: int = LIMIT, part: int = PART) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of docs (columns doc_id, text; others are ignored).

    Texts are equal when identical without the characters ``\\x20\\x09-\\x0D``; null counts as empty, so all null, empty
    and blank texts are one group. The row with the most code points stays, of those the smallest doc_id, null last.
    Of rows that repeat its doc_id and length exactly one is kept. group_size counts rows. text_sha256: lower-case
    hex of the text without those characters. Empty table: empty result.
    """
    own = groups(docs, limit, part)
    heads = materialize(_rows(docs).mapInArrow(_heads, "id long, rank long, rid long, digest binary"), "heads")
    many = max(MANY, math.ceil(heads.count() / BROADCAST_ROWS))
    several = own.filter("rows > 1").select("digest", "rows", F.col("rank").alias("top"), F.col("id").alias("keep_id"), "ties")
    hot, cold = F.broadcast(several.filter(F.col("rows") >= many)), several.filter(F.col("rows") < many)
    met = heads.join(hot, "digest", "left")
    # rows of hot groups don't take part in the shuffled join
    grouped = met.filter("rows is not null").unionByName(met.filter("rows is null").select("id", "rank", "rid", "digest").join(cold, "digest", "left"))
    claims = (F.col("rows").isNull()) | ((F.col("rank") == F.col("top")) & F.col("id").eqNullSafe(F.col("keep_id")))
    # which of the rows that repeat the staying one is kept: the first, if there are several
    first = heads.join(several.filter("ties > 1"), "digest").filter("rank = top and id <=> keep_id").groupBy("digest").agg(F.min("rid").alias("first"))
    chosen = grouped.join(first, "digest", "left")
    return chosen.select(
        F.col("id").alias("doc_id"), F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("rows", F.lit(1)).alias("group_size"),
        (claims & F.coalesce(F.col("rid") == F.col("first"), F.lit(True))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
