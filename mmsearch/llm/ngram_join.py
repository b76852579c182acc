"""N-gram Jaccard join by signature trees: exact links of word-shingle sets, as connected components.

Plan
 1. ``profiles``: one pass gives every document its set size, a 64-bit key of the set (equal sets share a
    key and are looked at once from here on), a token bitmap, and adds its tokens to a count sketch of
    fixed size (2**20 counters, 4 MB, whatever the input).
 2. ``meeting pairs``: under the order (sketch count, token), sets with Jaccard >= t share one of their
    first ``size - ceil(t * size) + 1`` tokens, rare ones first. These prefixes are dealt out by token;
    in a token's group every key meets the group's least key, the pivot. A task sends a set's prefix once,
    however many copies it reads.
 3. first round: every key goes to one group only, that of its least pivot. The keys of a group form a
    tree of bitmaps; dual traversal drops node pairs by size range and greatest possible overlap. The
    token sets of what is left meet once, and exact overlaps give the first components.
 4. second round: groups whose members all lie in one component, or whose pairs the first round has all
    seen, need no look, and of groups with the same members one is enough. In the rest, trees are traversed again for pairs of different components, and
    only the members of such pairs send their token sets.
 5. the star edges of both rounds go through connected components.

Groups above ``GROUP`` keys or ``TOKENS`` tokens are split into blocks. The first round looks within
blocks, each with the pivot in it, the second at all pairs of blocks that more than one component shares;
so no task holds an unbounded group and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard_tree import Forest, Labels, bitmap
from .store import BROADCAST_ROWS, lookup_join, materialize
from .text import Words, chunks, planes, splitmix, unplanes

CELL_BITS, SLICES = 20, 16
CELLS = 1 << CELL_BITS
#: Keys and tokens that one block of a group holds about at most; larger groups are split into blocks.
GROUP, TOKENS = 4096, 1 << 21
#: Set keys that a task remembers, so that it sends the prefix of a copied set once; past these it starts over.
SEEN = 1 << 18
_I64 = lambda a: pa.array(np.asarray(a).astype(np.uint64).view(np.int64), pa.int64())


def _set_key(tokens: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return splitmix(np.array([splitmix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))[0]


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _profile(n: int):
    def run(batches):
        sketch, seen = np.zeros(CELLS, np.uint32), False
        for batch in batches:
            for a, b, raw, at in chunks(batch):
                sets = Words(raw, at, lower=True).shingle_sets(n)
                keys = np.array([_set_key(s) for s in sets], np.uint64)
                tokens = np.concatenate(sets)
                sketch += np.bincount(_cell(tokens), minlength=CELLS).astype(np.uint32)
                seen |= len(tokens) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), _I64(keys), pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())],
                    ["doc_id", "size", "key", "bits", "part", "counts"],
                )
        if seen:
            wide = CELLS // SLICES
            counts = [planes(sketch[k * wide : (k + 1) * wide]) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64())] * 3 + [pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(counts, pa.binary())], ["doc_id", "size", "key", "bits", "part", "counts"])

    return run


def _sum_counts():
    """Streams the slices of one part; memory is one slice."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                x = unplanes(blob, np.uint32).astype(np.uint64)
                total = x if total is None else total + x
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([planes(total)], pa.binary())], ["part", "counts"])

    return run


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The summed sketch: 4 MB on the driver for any input; slices meet in two rounds."""
    slices = profiles.filter("part is not null").select("part", "counts", (F.abs(F.xxhash64("counts")) % 32).cast("int").alias("lot"))
    first = slices.groupBy("part", "lot").applyInArrow(_sum_counts(), "part int, counts binary")
    rows = first.groupBy("part").applyInArrow(_sum_counts(), "part int, counts binary").collect()
    out = np.zeros(CELLS, np.uint32)
    for r in rows:
        out[r.part * (CELLS // SLICES) : (r.part + 1) * (CELLS // SLICES)] = unplanes(bytes(r.counts), np.uint32)
    return out


def _prefix_rows(n: int, num: int, den: int, buckets: int, sketch):
    def run(batches):
        order, seen = sketch.value, set()
        for batch in batches:
            for _, _, raw, at in chunks(batch, limit=1 << 21):
                tok, key = [], []
                for s in Words(raw, at, lower=True).shingle_sets(n):
                    if len(s):
                        k = _set_key(s)
                        if k in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(k)
                        take = len(s) - -(-num * len(s) // den) + 1
                        s = s[np.lexsort((s, order[_cell(s)]))[:take]]
                        tok.append(s)
                        key.append(np.full(len(s), k, np.uint64))
                if not tok:
                    continue
                tok, key = np.concatenate(tok), np.concatenate(key)
                bucket = (splitmix(tok) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                tok, key, bucket = tok[by], key[by], bucket[by]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                spans = list(zip(cut, [*cut[1:], len(bucket)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut], pa.int64()), pa.array([tok[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary())], ["bucket", "tok", "key"]
                )

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: distinct (pivot, member), where pivot is the least key of a token's group."""
    tok = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tok").to_pylist()])
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("key").to_pylist()])
    by = np.lexsort((key, tok))
    tok, key = tok[by], key[by]
    head = np.concatenate([[True], tok[1:] != tok[:-1]])
    pivot = key[np.flatnonzero(head)[np.cumsum(head) - 1]]
    other = key != pivot
    pairs = np.unique(np.stack([pivot[other], key[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.uint64)
    return pa.table({"pivot": _I64(pairs[:, 0]), "key": _I64(pairs[:, 1])})


def _by_group(work, schema_names: list[str], group: list[str]):
    """Run work(columns of one group) on each run of equal group columns of sorted rows, across batches."""

    def run(batches):
        rest: list[pa.RecordBatch] = []

        def emit(table):
            if not table.num_rows:
                return
            ids = np.stack([table.column(g).to_numpy() for g in group], 1)
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))
            got = [x for a, b in zip(cut, [*cut[1:], len(ids)], strict=True) if (x := work(ids[a], table.slice(a, b - a))) is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(g[k]) for g in got]) for k in range(len(got[0]))], schema_names)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(g)[batch.num_rows - 1].as_py() for g in group]
            same = np.ones(batch.num_rows, bool)
            for g, v in zip(group, last, strict=True):
                same &= batch.column(g).to_numpy() == v
            cut = int(np.argmax(same))
            if cut or (rest and [rest[0].column(g)[0].as_py() for g in group] != last):
                yield from emit(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from emit(pa.Table.from_batches(rest))

    return run


def _may_link(num: int, den: int):
    """Members of a group whose bitmaps leave room for a link with a member of another component.

    part: the least place of those that such pairs connect. A pair needs no look if it lies in one component already, in one
    block where two different ones meet, or if both have been flagged in the same part.
    """

    def work(group, table):
        key, label = table.column("key").to_numpy(), table.column("label").to_numpy()
        size, block = table.column("size").to_numpy(), table.column("block").to_numpy()
        cross = group[1] != group[2]
        parts, flagged = Labels(len(key)), np.zeros(len(key), bool)

        def skip(i, j):
            known = (label[i] == label[j]) | (parts.same(i, j) & flagged[i] & flagged[j])
            return known | (block[i] == block[j]) if cross else known

        for i, j in Forest(table.column("bits").to_pylist(), size).pairs(num, den, skip):
            flagged[i] = flagged[j] = True
            parts.join(i, j)
        if not flagged.any():
            return None
        k = int(flagged.sum())
        place = [*(np.full(k, g, np.int64) for g in group), parts.label[flagged].astype(np.int64)]
        return [*place, key[flagged], block[flagged], label[flagged]]

    return work


def _exact(num: int, den: int):
    """Star edges of the exact components inside a group of candidates."""

    def work(group, table):
        _, once = np.unique(np.stack([table.column(c).to_numpy() for c in ("key", "block")], 1), axis=0, return_index=True)
        table = table.take(once)
        key, block, known = (table.column(c).to_numpy() for c in ("key", "block", "label"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        names, flat = np.unique(flat, return_inverse=True)
        head = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(len(names), bool)
        labels = Labels(len(key))
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        labels.label = first[of]
        start = labels.label.copy()
        cross = group[1] != group[2]
        skip = (lambda i, j: labels.same(i, j) | (block[i] == block[j])) if cross else labels.same
        for i, j in Forest([bitmap(s) for s in sets], size).pairs(num, den, skip):
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cut = np.flatnonzero(np.diff(i, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(i)], strict=True):
                x, todo = i[a], j[a:b]
                mark[flat[head[x] : head[x + 1]]] = True
                while len(todo := todo[~labels.same(np.full(len(todo), x), todo)]):
                    now, todo = todo[:256], todo[256:]
                    common = np.array([np.count_nonzero(mark[flat[head[y] : head[y + 1]]]) for y in now])
                    linked = now[den * common >= num * (size[x] + size[now] - common)]
                    if len(linked):
                        labels.join(np.full(len(linked), x), linked)
                mark[flat[head[x] : head[x + 1]]] = False
        child = np.flatnonzero(labels.label != start)
        return [key[child], key[labels.label[child]]] if len(child) else None

    return work


_PLACE = ["pivot", "b1", "b2", "part"]


def _tokens(n: int):
    """Token sets of the texts that have the wanted key, with the place they are wanted at."""

    def run(batches):
        for batch in batches:
            for a, b, raw, at in chunks(batch):
                sets = Words(raw, at, lower=True).shingle_sets(n)
                own = np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)
                right = np.flatnonzero(own == batch.column("key").slice(a, b - a).to_numpy())
                rest = [batch.column(c).slice(a, b - a).take(pa.array(right)) for c in (*_PLACE, "key", "block", "label")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[k].tobytes() for k in right], pa.binary())], [*_PLACE, "key", "block", "label", "tokens"])

    return run


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (columns doc_id, text; others are ignored).

    Words are lower-cased in A-Z and split at ``\\x20\\x09-\\x0D``. A set holds the distinct n-word shingles
    of the whole text; with 1 to n-1 words, the whole sequence. Two sets link when
    den * |a & b| >= num * |a | b|. component_id: the smallest doc_id reachable by links.

    Null or blank text: size 0, own component. Null doc_id: takes part by no link, component_id null. Rows
    that repeat a doc_id each get their row. Equal texts and ties need no order. Empty table: empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialize(docs.mapInArrow(_profile(n), "doc_id long, size long, key long, bits binary, part int, counts binary"), "profiles")
    rows = profiles.filter("part is null").select("doc_id", "size", "key", "bits")
    sketch = spark.sparkContext.broadcast(_sketch(profiles))
    total = rows.agg(F.sum("size")).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, math.ceil(total / 4_000_000))
    keyed = materialize(rows.filter("size > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bits").alias("bits")), "keyed")

    prefixes = docs.filter("doc_id is not null").mapInArrow(_prefix_rows(n, num, den, buckets, sketch), "bucket long, tok binary, key binary")
    met = materialize(prefixes.groupBy("bucket").applyInArrow(_meet, "pivot long, key long").distinct(), "met")
    sizes, bitmaps = keyed.select("key", "size"), keyed.select("key", "size", "bits")
    blocks = F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("total") / TOKENS)).cast("int").alias("blocks")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("long")
    counted = (F.count("*").alias("n"), F.sum("size").alias("total"))

    def looked(places: DataFrame, name: str) -> DataFrame:
        """Star edges of exact links between members of different labels; places: pivot, b1, b2, block, key, label."""
        places = lookup_join(bitmaps, materialize(places, f"places-{name}"), "key")
        ids, fields = _PLACE[:3], [*_PLACE, "key", "block", "label"]
        types = ", ".join(f"{c} long" for c in fields)
        may = places.repartition(*ids).sortWithinPartitions(*ids).mapInArrow(_by_group(_may_link(num, den), fields, ids), types)
        may = materialize(materialize(may, f"may-{name}").join(keyed.select("key", "doc_id"), "key"), f"wanted-{name}")
        texts = lookup_join(docs, may, "doc_id").select("text", *fields)
        sets = texts.mapInArrow(_tokens(n), f"{types}, tokens binary").repartition(*_PLACE).sortWithinPartitions(*_PLACE)
        return materialize(sets.mapInArrow(_by_group(_exact(num, den), ["u", "v"], _PLACE), "u long, v long"), f"links-{name}")

    mine = materialize(met.groupBy("key").agg(F.min("pivot").alias("pivot")), "mine")
    cut = mine.join(sizes, "key").groupBy("pivot").agg(*counted).select("pivot", blocks)
    members = mine.join(cut, "pivot").select("pivot", block.alias("block"), "key")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")
    places = members.unionByName(cut.select("pivot", every, F.col("pivot").alias("key")))
    first = looked(places.select("pivot", F.col("block").alias("b1"), F.col("block").alias("b2"), "block", "key", F.col("key").alias("label")), "first")

    stars = components(first)
    known = stars.select(F.col("node").alias("key"), "label")
    own = met.join(mine.withColumnRenamed("pivot", "least"), "key").select("pivot", "key", (F.col("pivot") == F.col("least")).alias("seen"))
    own = own.union(met.select("pivot", F.col("pivot").alias("key"), F.lit(True)).distinct())
    groups = own.join(known, "key", "left").join(sizes, "key").select("pivot", "key", "size", "seen", F.coalesce("label", "key").alias("label"))
    groups = materialize(groups, "groups")
    same = F.struct(F.count("*"), F.sum(F.xxhash64("key").cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.col("key"), F.lit(7))))
    mixed = groups.groupBy("pivot").agg(*counted, F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("seen").alias("seen"), same.alias("members"))
    mixed = mixed.select("*", blocks).filter("lo <> hi and not (seen and blocks = 1)")
    mixed = mixed.groupBy("members").agg(F.min(F.struct("pivot", "blocks")).alias("g")).select("g.*")
    split = materialize(groups.join(mixed, "pivot").select("pivot", "key", "label", block.alias("block")), "split")
    ends = split.groupBy("pivot", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left = ends.select("pivot", F.col("block").alias("b1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = ends.select("pivot", F.col("block").alias("b2"), "lo", "hi")
    pairs = left.join(right, "pivot").filter("b1 <= b2 and least(lo, lo1) <> greatest(hi, hi1)")
    sides = pairs.select("pivot", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    second = looked(split.join(sides, ["pivot", "block"]).select("pivot", "b1", "b2", "block", "key", "label"), "second")
    labels = components(stars.select(F.col("node").alias("u"), F.col("label").alias("v")).union(second))
    named = labels.join(keyed.select(F.col("key").alias("node"), "doc_id"), "node")
    named = named.join(named.groupBy("label").agg(F.min("doc_id").alias("component")), "label").select(F.col("node").alias("key"), "component")
    # Keys of many rows are few, at most total / hot, and go by broadcast; the rows of the others are dealt by key.
    least = keyed.select("key", "rows", F.col("doc_id").alias("own")).join(named, "key", "left").select("key", "rows", F.coalesce("component", "own").alias("component"))
    least = materialize(least, "least")
    hot = max(64, math.ceil(rows.count() / BROADCAST_ROWS))
    fields = ["doc_id", "size", "component"]
    able = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    apart = rows.filter(~able).select("doc_id", "size", F.col("doc_id").alias("component"))
    found = rows.filter(able).select("doc_id", "size", "key").join(F.broadcast(least.filter(F.col("rows") >= hot).select("key", "component")), "key", "left")
    cold = least.filter(F.col("rows") < hot).select("key", "component")
    rest = found.filter("component is null").drop("component").join(cold, "key").select(*fields)
    out = found.filter("component is not null").select(*fields).unionByName(rest).unionByName(apart)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group: the one of the smallest doc_id. Rows without words all stay.

    Rows that repeat a doc_id with words are copies: one stays. Rows of null doc_id stay.
    """
    found = materialize(jaccard_components(docs, n, num, den), "components")
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = lookup_join(docs, materialize(gone, "gone"), "doc_id", "left_anti")
    twice = found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if twice:
        worded = F.coalesce(F.regexp_like("text", F.lit(r"[^ \t-\r]")), F.lit(False)) & F.col("doc_id").isNotNull()
        kept = kept.filter(~worded).unionByName(kept.filter(worded).dropDuplicates(["doc_id"]))
    return kept
