"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS equal cells. A text's hash says its cell, so equal texts meet; a shard owns the cells up
to each of its virtual nodes. No shard holds more than (1 + slack) times the mean bytes: what would overflow
continues clockwise to the next virtual node of a shard with room. Only sums decide this: the bytes of each
cell and the few groups of equal texts that are heavy by themselves, both bounded in number whatever the
input. A heavy group is placed whole if a shard has room for it, else it is dealt out clockwise by document.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
#: A group of equal texts is heavy above this share of a shard, so at most HEAVY * shards groups are.
HEAVY = 64
#: A shard's rows are ranked in lots of about this size; more lots than MOST_LOTS would make the table of their counts too wide to broadcast.
LOT_BYTES, MOST_LOTS = 64 << 20, 1 << 16


def virtual_nodes(shards: int, each: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of all virtual nodes; those of a shard don't depend on the number of shards."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:4], "big") % CELLS
    return sorted((place(s, v), s) for s in range(shards) for v in range(each))


def place(cells: dict[int, int], heavy: list[tuple[int, int, int]], shards: int, nodes: list[tuple[int, int]], capacity: int):
    """Shard of each cell, and per heavy group (cell, document bytes, documents) its list of (shard, documents)."""
    room = [capacity] * shards
    at = [c for c, _ in nodes]

    def clockwise(cell: int):
        first, seen = bisect_left(at, cell), 0
        for k in range(len(nodes)):
            s = nodes[(first + k) % len(nodes)][1]
            if not seen >> s & 1:
                seen |= 1 << s
                yield s
                if seen == (1 << shards) - 1:
                    return

    def roomiest(cell: int) -> int:
        return max(clockwise(cell), key=lambda s: room[s])

    dealt: list[list[tuple[int, int]]] = [[] for _ in heavy]
    for k in sorted(range(len(heavy)), key=lambda k: (-heavy[k][1] * heavy[k][2], heavy[k])):
        cell, size, n = heavy[k]
        whole = next((s for s in clockwise(cell) if room[s] >= size * n), None)
        if whole is not None:
            dealt[k], n = [(whole, n)], 0
            room[whole] -= size * heavy[k][2]
        for s in clockwise(cell):
            if n and (take := min(n, max(0, room[s]) // size)):
                dealt[k].append((s, take))
                room[s] -= take * size
                n -= take
        while n:
            s = roomiest(cell)
            dealt[k].append((s, 1))
            room[s] -= size
            n -= 1
    shard_of = {}
    for cell in sorted(cells, key=lambda c: (-cells[c], c)):
        s = next((s for s in clockwise(cell) if room[s] >= cells[cell]), None)
        shard_of[cell] = roomiest(cell) if s is None else s
        room[shard_of[cell]] -= cells[cell]
    return shard_of, dealt


def indexed(df: DataFrame, keys: list[str], order: list[Column], name: str, lots: int) -> DataFrame:
    """Adds a gapless index from 0 within the keys: each key's rows are ranked in ``lots`` separate tasks' groups.

    The table of lot counts has at most lots rows a key and is broadcast: use it for few keys only. See ``lots_of``.
    """
    df = df.withColumn("__lot", F.pmod(F.xxhash64(*order), F.lit(lots)).cast("int"))
    counts = df.groupBy(*keys, "__lot").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__lot").alias("__l"), F.coalesce(before, F.lit(0)).alias("__before"))
    on = (F.col("__lot") == F.col("__l"), *(F.col(k) == F.col(f"__k_{k}") for k in keys))
    cond = on[0]
    for c in on[1:]:
        cond &= c
    rank = F.row_number().over(Window.partitionBy(*keys, "__lot").orderBy(*order))
    return df.withColumn("__rank", rank).join(F.broadcast(counts), cond).withColumn(name, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__lot", "__l", "__before", "__rank", *(f"__k_{k}" for k in keys))


def lots_of(total: int, shards: int) -> int:
    """Lots a shard for so many bytes in all."""
    return min(MOST_LOTS, max(256, math.ceil(total / shards / LOT_BYTES)))


def shard(docs: DataFrame, shards: int = 16, virtual: int = 256, slack: float = 0.002) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; columns of docs with these names are replaced, all others stay, whatever their names.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32: unsigned, of the text's UTF-8 (null: of
    nothing). law is "bytes": no shard holds over (1 + slack) times the mean size, plus at most the largest
    document where even the roomiest shard is too full for it. slot: gapless from 0 within the shard.
    grown_shard: null, as other documents' sizes decide too. Equal texts share a shard unless none has room
    for them all. Null doc_id and repeated rows are placed as any row. Empty table: empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = {f"__own{k}": c for k, c in enumerate(docs.columns) if c not in own}
    h = F.xxhash64(text)
    base = docs.select("doc_id", *(F.col(f"`{c}`").alias(k) for k, c in rest.items()), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), h.alias("__hash"), F.shiftrightunsigned(h, 48).cast("int").alias("__cell"))
    thin = base.select("size", "text_crc32", "__hash", "__cell")
    cells = {r[0]: r[1] for r in thin.groupBy("__cell").agg(F.sum("size")).collect()}
    total = sum(cells.values())
    capacity = math.ceil((1 + slack) * total / shards)
    groups = thin.groupBy("__cell", "size", "__hash", "text_crc32").agg(F.count("*").alias("n"))
    heavy = sorted(map(tuple, groups.filter(F.col("n") * F.col("size") * HEAVY * shards > total).collect()))
    for cell, size, _, _, n in heavy:
        cells[cell] -= size * n
    where, dealt = place(cells, [(c, s, n) for c, s, _, _, n in heavy], shards, virtual_nodes(shards, virtual), capacity)

    table = lambda cols, types: spark.createDataFrame(pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), types, strict=True)}))
    of_cell = table({"__c": list(where), "__cell_shard": list(where.values())}, [pa.int32(), pa.int32()])
    names = [(g[2], g[3]) for g in heavy]
    whole = [(*names[k], d[0][0]) for k, d in enumerate(dealt) if len(d) == 1]
    cut = [(*names[k], k) for k, d in enumerate(dealt) if len(d) > 1]
    of_heavy = table({"__h": [x[0] for x in whole + cut], "__crc": [x[1] for x in whole + cut], "__whole": [x[2] for x in whole] + [None] * len(cut), "__group": [None] * len(whole) + [x[2] for x in cut]}, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])
    placed = base.join(F.broadcast(of_cell), F.col("__cell") == F.col("__c"), "left").join(F.broadcast(of_heavy), (F.col("__hash") == F.col("__h")) & (F.col("text_crc32") == F.col("__crc")), "left").drop("__c", "__h", "__crc")
    order = [F.col("doc_id"), F.col("text_crc32")]
    if cut:
        spans, start = [], 0
        for _, _, k in cut:
            start = 0
            for s, n in dealt[k]:
                spans.append((k, start, start + n, s))
                start += n
        of_span = table({"__g": [x[0] for x in spans], "__from": [x[1] for x in spans], "__to": [x[2] for x in spans], "__span_shard": [x[3] for x in spans]}, [pa.int32(), pa.int64(), pa.int64(), pa.int32()])
        split = indexed(placed.filter("__group is not null"), ["__group"], order, "__index", lots_of(total, shards))
        split = split.join(F.broadcast(of_span), (F.col("__group") == F.col("__g")) & (F.col("__index") >= F.col("__from")) & (F.col("__index") < F.col("__to")))
        placed = placed.filter("__group is null").withColumn("__span_shard", F.lit(None).cast("int")).unionByName(split.drop("__g", "__from", "__to", "__index"))
    else:
        placed = placed.withColumn("__span_shard", F.lit(None).cast("int"))
    placed = placed.withColumn("shard", F.coalesce("__span_shard", "__whole", "__cell_shard").cast("int")).drop("__span_shard", "__whole", "__cell_shard", "__group", "__cell", "__hash")
    out = indexed(placed, ["shard"], order, "slot", lots_of(total, shards))
    return out.select(*(F.col(k).alias(c) for k, c in rest.items()), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
