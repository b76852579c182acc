"""Exact inner-product search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.files import kept

#: Queries, and entries, whose products are one matrix.
QUERY_BLOCK = 1024
ENTRY_BLOCK = 4096
#: Bytes of queries, packed or not, that are broadcast; more of them meet the entries by a nested join.
BROADCAST_BYTES = 64 << 20
#: Queries and entries of a cell of the grid of a block search, and queries whose products with some blocks are one matrix.
GRID_QUERIES, GRID_ENTRIES, CHUNK = 8192, 32768, 256


def crossed(left: DataFrame, right: DataFrame, size: Column) -> DataFrame:
    """Every pair of rows. right is broadcast while the ``size`` of its rows comes to BROADCAST_BYTES at most: Spark's own estimate goes by the table they were filtered from.

    Beyond, left is written first, as it is read once a partition of right.
    """
    if (right.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return left.crossJoin(F.broadcast(right))
    return kept(left, "left").crossJoin(right)


def query_size() -> Column:
    return 8 * F.size("q") + F.length("query")


def score_cross(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, creator, score) of every entry for a stated query set."""
    return crossed(entries.select("creator", "combined"), queries, query_size()).select("query", "creator", dot(F.col("combined"), F.col("q")).alias("score"))


def top_k(scored: DataFrame, k: int, by: list[str], tie: str = "creator") -> DataFrame:
    """Adds rank 1..k within ``by``: score descending, then the tie column."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _packed(name: str, vector: str, most: int):
    """Rows of a batch as few rows of (names, flat vectors)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                flat = part.column(vector).flatten()
                cols = [pa.array([part.column(name).to_pylist()], pa.list_(pa.string())), pa.ListArray.from_arrays([0, len(flat)], flat.cast(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, [f"{name}_names", f"{vector}_flat"])

    return run


def _best(near: np.ndarray, v: np.ndarray, q: np.ndarray, names: np.ndarray, k: int) -> list[tuple[float, str]]:
    """The k best (score, name) of the rows of v for q, ties by name. near: their products as a matrix product rounds them.

    A partition finds the k-th; only rows about as good are scored again, each by itself, so equal vectors score equal wherever they stand.
    """
    if len(near) > k:
        floor = np.partition(near, len(near) - k)[len(near) - k]
        at = np.flatnonzero(near >= floor - 1e-9 * (1 + abs(floor)))
        v, names = v[at], names[at]
    return sorted(zip((v * q).sum(1).tolist(), names.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]


def _products(k: int):
    """(query, creator, score): the best k of all pairs of packs that a task reads, for each query."""

    def run(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for p in batch.to_pylist():
                names, creators = p["query_names"], np.array(p["creator_names"], object)
                q, v = (np.array(p[c]).reshape(len(n), -1) for c, n in (("q_flat", names), ("combined_flat", creators)))
                for name, one, row in zip(names, q, q @ v.T, strict=True):
                    own = _best(row, v, one, creators, k)
                    found[name] = sorted(found[name] + own, key=lambda x: (-x[0], x[1]))[:k] if name in found else own
        rows = [(name, c, s) for name, own in found.items() for s, c in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["query", "creator", "score"])

    return run


def packs(entries: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (creator, combined) and queries (query, q) as rows of (names, flat vectors), without a shuffle."""
    held = entries.select("creator", "combined").mapInArrow(_packed("creator", "combined", ENTRY_BLOCK), "creator_names array<string>, combined_flat array<double>")
    asked = queries.select("query", "q").mapInArrow(_packed("query", "q", QUERY_BLOCK), "query_names array<string>, q_flat array<double>")
    return held, asked


def search(entries: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, creator, score), exact, score descending then creator; k above the number of entries gives all.

    Queries and entries are packed into blocks without a shuffle; every pair of blocks is a matrix product and a partial top k
    that a task carries on, so k rows a query and task are shuffled. Packed queries are broadcast while they fit BROADCAST_BYTES.
    A query with a repeated name is one with the rows of both. For many queries over a standing index see ``search_blocks``.
    """
    held, asked = packs(entries, queries)
    size = queries.agg(F.sum(query_size())).first()[0] or 0
    pairs = held.crossJoin(F.broadcast(asked) if size <= BROADCAST_BYTES else asked)
    found = pairs.mapInArrow(_products(k), "query string, creator string, score double")
    return top_k(found, k, ["query"]).select("query", "rank", "creator", "score")


# ---- bounded search over a standing index ------------------------------------------------------------------------


def _nearest_pivot(pivots: np.ndarray):
    def run(batches):
        sq = (pivots * pivots).sum(1)
        for batch in batches:
            v = batch.column("combined").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            cell = (sq[None, :] - 2 * v @ pivots.T).argmin(1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("creator", "combined")), pa.array(cell, pa.int64())], ["creator", "combined", "cell"])

    return run


def _block(table: pa.Table) -> pa.Table:
    by = np.argsort(np.array(table.column("creator").to_pylist(), object), kind="stable")
    v = np.array(table.column("combined").to_pylist())[by]
    names = np.array(table.column("creator").to_pylist(), object)[by].tolist()
    centre = v.mean(0)
    radius = float(np.sqrt(((v - centre) ** 2).sum(1)).max())
    cols = [[table.column("block")[0].as_py()], [centre.tolist()], [radius], [names], [v.ravel().tolist()]]
    types = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["block", "centre", "radius", "creator_names", "combined_flat"])


BLOCKS = "block long, centre array<double>, radius double, creator_names array<string>, combined_flat array<double>"


def block_index(entries: DataFrame, cells: int = 256, size: int = 1024) -> DataFrame:
    """Entries as blocks of near ones, about ``size`` each: (block, centre, radius, creator_names, combined_flat). Write it once, search it often.

    Entries go to the nearest of ``cells`` pivots, those of smallest name hash (the only rows that reach the driver); a
    cell above the size is dealt into several blocks. Every entry is in one block; blocks only steer how much a search skips.
    """
    rows = entries.select("creator", "combined")
    pivots = rows.orderBy(F.xxhash64("creator"), "creator").limit(cells).collect()
    if not pivots:
        return entries.sparkSession.createDataFrame([], BLOCKS)
    near = rows.mapInArrow(_nearest_pivot(np.array([r.combined for r in pivots])), "creator string, combined array<double>, cell long")
    parts = near.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row a cell, cells at most
    dealt = near.join(F.broadcast(parts), "cell").withColumn("block", F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("creator"), F.col("parts")))
    return dealt.select("block", "creator", "combined").groupBy("block").applyInArrow(_block, BLOCKS)


def _packed_centres(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ENTRY_BLOCK):
            part = batch.slice(at, ENTRY_BLOCK)
            flat = part.column("centre").flatten()
            cols = [pa.array([part.column(c).to_pylist()], pa.list_(t)) for c, t in (("block", pa.int64()), ("radius", pa.float64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays([0, len(flat)], flat)], ["blocks", "radii", "centre_flat"])


def _bound(q: np.ndarray, c: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Per query and block no less than any score: the product with the centre and the query's length times the radius, and a margin for rounding."""
    length = np.sqrt((q * q).sum(1))[:, None]
    return q @ c.T + length * radii[None, :] + 1e-9 * length * (1 + np.sqrt((c * c).sum(1))[None, :])


def _bounds(p: dict) -> np.ndarray:
    q, c = (np.array(p[x]).reshape(len(p[n]), -1) for x, n in (("q_flat", "query_names"), ("centre_flat", "blocks")))
    return _bound(q, c, np.array(p["radii"]))


def _first_blocks(batches):
    """(query, block, bound): of each pack of centres the block with the greatest bound."""
    for batch in batches:
        for p in batch.to_pylist():
            bound = _bounds(p)
            at = bound.argmax(1)
            cols = [p["query_names"], [p["blocks"][k] for k in at], bound[np.arange(len(at)), at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64()), strict=True)], ["query", "block", "bound"])


def _open_blocks(batches):
    """(query, block) whose bound reaches the query's k-th score so far, but for the block that is done."""
    for batch in batches:
        for p in batch.to_pylist():
            ok = _bounds(p) >= np.array(p["floors"])[:, None]
            ok &= np.array(p["done"])[:, None] != np.array(p["blocks"])[None, :]
            i, j = np.nonzero(ok)
            cols = [[p["query_names"][k] for k in i], [p["blocks"][k] for k in j]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["query", "block"])


def _vectors(table: pa.Table, column: str, rows: int) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _first_k(row: np.ndarray, at: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, by score and then by ``order`` (the entries' places by name)."""
    by = np.lexsort((order[at], -score, row))
    row, at, score = row[by], at[by], score[by]
    fresh = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    ok = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < k
    return row[ok], at[ok], score[ok]


def _best_of_blocks(q: np.ndarray, floors: np.ndarray, ok: np.ndarray, v: np.ndarray, sizes: np.ndarray, order: np.ndarray, k: int):
    """(row of q, row of v, score) of the k best at or above each query's floor, over the blocks (``sizes`` rows of v each) that ``ok`` opens to it.

    Products of about ENTRY_BLOCK entries at a time; as in ``_best``, only rows about as good are scored again, each by itself.
    """
    starts = np.r_[0, np.cumsum(sizes)]
    row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floors, blocks = floors.copy(), np.flatnonzero(ok.any(0))
    slabs = np.split(blocks, np.flatnonzero(np.diff(np.cumsum(sizes[blocks]) // ENTRY_BLOCK)) + 1) if len(blocks) else []
    for slab in slabs:
        mine = np.flatnonzero(ok[:, slab].any(1))
        cols = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in slab])
        near = q[mine] @ v[cols].T
        near[~np.repeat(ok[np.ix_(mine, slab)], sizes[slab], axis=1)] = -np.inf
        low = floors[mine]
        if len(cols) > k:
            low = np.maximum(low, np.partition(near, len(cols) - k, axis=1)[:, len(cols) - k])
        low = np.where(np.isfinite(low), low - 1e-9 * (1 + np.abs(np.where(np.isfinite(low), low, 0))), low)
        i, j = np.nonzero((near >= low[:, None]) & (near > -np.inf))
        i, j = mine[i], cols[j]
        row, at, score = _first_k(np.r_[row, i], np.r_[at, j], np.r_[score, (q[i] * v[j]).sum(1)], order, k)
        full, count = np.unique(row, return_counts=True)
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, row, score)
        full = full[count >= k]
        floors[full] = np.maximum(floors[full], worst[full])
    return row, at, score


def _cell(k: int):
    """(query, creator, score) of a cell of queries and blocks: for each query the best k of the blocks it may look into.

    Queries without ``floor`` and ``done`` look into all blocks of the cell, others into those whose bound reaches the floor, but for the one that is done.
    """

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            if "done" in asked.column_names:
                asked = asked.sort_by("done")  # queries that are near each other open the same blocks
            held = held.sort_by("block")
            queries, blocks = asked.column("query").to_pylist(), held.column("block").to_numpy()
            q, centres = _vectors(asked, "q", len(queries)), _vectors(held, "centre", len(blocks))
            flat = held.column("creator_names").combine_chunks().flatten().to_pylist()
            names, v = np.array(flat, object), _vectors(held, "combined_flat", len(flat))
            sizes = held.column("creator_names").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            order = np.empty(len(names), np.int64)
            order[np.argsort(names, kind="stable")] = np.arange(len(names))
            radii = held.column("radius").to_numpy()
            for begin in range(0, len(queries), CHUNK):
                own = slice(begin, begin + CHUNK)
                floors, ok = np.full(len(q[own]), -np.inf), np.ones((len(q[own]), len(blocks)), bool)
                if "done" in asked.column_names:
                    floors = asked.column("floor").to_numpy()[own]
                    ok = _bound(q[own], centres, radii) >= floors[:, None]
                    ok &= asked.column("done").to_numpy()[own][:, None] != blocks[None, :]
                row, at, score = _best_of_blocks(q[own], floors, ok, v, sizes, order, k)
                out.append(([queries[begin + r] for r in row], names[at], score))
        cols = [[x for o in out for x in o[j]] for j in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], ["query", "creator", "score"])

    return run


FOUND = "query string, creator string, score double"


def _evaluate_first(first: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Scores of each query in its first block. A block that many queries want is dealt to several parts of about QUERY_BLOCK queries."""
    parts = first.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    wanted = first.hint("merge").join(parts, "block").join(queries.hint("merge"), "query").select("block", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"), "query", "q")
    copies = blocks.hint("merge").join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "radius", "centre", "creator_names", "combined_flat")
    return wanted.groupBy("block", "part").cogroup(copies.groupBy("block", "part")).applyInArrow(_cell(k), FOUND)


def _evaluate_open(known: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Scores of all further blocks a query may look into, by a grid: queries are dealt to rows, blocks to columns, a cell is a task's group.

    A query is sent once a column and a block once a row; pairs of a query and a block are never rows of a table.
    """
    n, m = known.count(), blocks.agg(F.sum(F.size("creator_names"))).first()[0] or 0
    rows, columns = max(1, -(-n // GRID_QUERIES)), max(1, -(-m // GRID_ENTRIES))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = known.select("query", "q", "floor", "done", deal("query", rows).alias("a"), every(columns).alias("b"))
    right = blocks.select("block", "radius", "centre", "creator_names", "combined_flat", deal("block", columns).alias("b"), every(rows).alias("a"))
    cells = rows * columns
    return left.repartition(cells, "a", "b").groupBy("a", "b").cogroup(right.repartition(cells, "a", "b").groupBy("a", "b")).applyInArrow(_cell(k), FOUND)


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """W1 over a block index: ((query, rank, creator, score) exactly as ``search`` gives them, (query, block) pairs that were looked into).

    Each query first takes the block with its greatest bound; its k-th score there is a floor, and only blocks whose
    bound reaches it are looked into. Names of queries must be unique. Queries are never collected; what the two
    steps found is written to the shared folder. The pairs are made only when they are read.
    """
    queries = queries.select("query", F.col("q").cast("array<double>").alias("q"))
    centres = blocks.select("block", "radius", "centre").mapInArrow(_packed_centres, "blocks array<long>, radii array<double>, centre_flat array<double>")
    size = blocks.agg(F.sum(8 * F.size("centre") + 16)).first()[0] or 0
    centres = F.broadcast(centres) if size <= BROADCAST_BYTES else centres
    packs = queries.mapInArrow(_packed("query", "q", QUERY_BLOCK), "query_names array<string>, q_flat array<double>")
    first = packs.crossJoin(centres).mapInArrow(_first_blocks, "query string, block long, bound double")
    first = kept(first.groupBy("query").agg(F.max_by("block", "bound").alias("block")), "first")
    seeds = kept(_evaluate_first(first, queries, blocks, k), "seeds")
    floors = seeds.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    known = queries.hint("merge").join(first.withColumnRenamed("block", "done").hint("merge"), "query").join(floors.hint("merge"), "query", "left")
    known = kept(known.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "known")
    found = seeds.unionByName(_evaluate_open(known, blocks, k))
    deal = F.spark_partition_id(), F.floor(F.monotonically_increasing_id() / QUERY_BLOCK)
    lists = [F.collect_list(c).alias(n) for c, n in (("query", "query_names"), ("q", "qs"), ("floor", "floors"), ("done", "done"))]
    packs = known.withColumn("a", deal[0]).withColumn("b", deal[1]).groupBy("a", "b").agg(*lists).select("query_names", F.flatten("qs").alias("q_flat"), "floors", "done")
    more = packs.crossJoin(centres).mapInArrow(_open_blocks, "query string, block long")
    return top_k(found, k, ["query"]).select("query", "rank", "creator", "score"), first.unionByName(more)


def config_sweep(embeddings: DataFrame, configs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(config, image_weight, text_weight, query, rank, creator, score) of every fusion config and query, both small and stated.

    The score of a fused vector is (wi <img, q> + wt <txt, q>) / |wi img + wt txt|, so a creator needs two products a query and
    three of its own; each config then is scalar arithmetic. A fused vector without length scores as it is.
    """
    img, txt = F.col("img"), F.col("txt")
    own = embeddings.select("creator", img.alias("img"), txt.alias("txt"), dot(img, img).alias("ii"), dot(img, txt).alias("it"), dot(txt, txt).alias("tt"))
    near = crossed(own, queries, query_size()).select("creator", "query", "ii", "it", "tt", dot(F.col("img"), F.col("q")).alias("iq"), dot(F.col("txt"), F.col("q")).alias("tq"))
    wi, wt = F.col("image_weight"), F.col("text_weight")
    norm = F.sqrt(F.greatest(wi * wi * F.col("ii") + 2 * wi * wt * F.col("it") + wt * wt * F.col("tt"), F.lit(0.0)))
    both = crossed(near, configs, 16 + F.length("config")).withColumn("norm", norm).withColumn("score", wi * F.col("iq") + wt * F.col("tq"))
    scored = both.select("config", "image_weight", "text_weight", "query", "creator", F.when(F.col("norm") == 0, F.col("score")).otherwise(F.col("score") / F.col("norm")).alias("score"))
    return top_k(scored, k, ["config", "query"])
