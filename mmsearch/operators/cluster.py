"""Ward clustering of creators and its quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept

#: Centroids left at which one task ends a dendrogram; a constant, so that task's work doesn't grow with the table.
LAST = 64
#: Centroids up to which Spark may broadcast a table of them by its own rule; above, their joins sort both sides, so the driver holds none.
DRIVER_ROWS = 8192
#: Centroids of a block whose costs to another block are one matrix.
BLOCK = 1024


def ward_merges(size: np.ndarray, center: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) merges of weighted centroids, ids as first members, by rounds of mutually nearest pairs (exact: Ward is reducible)."""
    ids, n, c = np.arange(len(size)), size.astype(float), center.astype(float).copy()
    out = []
    while len(ids) > 1:
        sq = (c * c).sum(1)
        cost = np.maximum(sq[:, None] + sq[None, :] - 2 * c @ c.T, 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
        np.fill_diagonal(cost, np.inf)
        near = cost.argmin(1)
        me = np.arange(len(ids))
        first = me[(near[near] == me) & (me < near)]
        if not len(first):
            i, j = np.unravel_index(cost.argmin(), cost.shape)
            first, near = np.array([min(i, j)]), near.copy()
            near[first] = max(i, j)
        other = near[first]
        for i, j in zip(first, other, strict=True):
            out.append((float(cost[i, j]), int(ids[i]), int(ids[j])))
        total = n[first] + n[other]
        c[first] = (c[first] * n[first, None] + c[other] * n[other, None]) / total[:, None]
        n[first] = total
        ids[first] = np.minimum(ids[first], ids[other])
        keep = np.setdiff1d(me, other)
        ids, n, c = ids[keep], n[keep], c[keep]
    return out


def _rows(batch: pa.RecordBatch, side: str, k: int) -> list[np.ndarray]:
    """(ids, weights, vectors) of one block of a batch, as NumPy views: no other block of the batch becomes Python values."""
    rows = batch.column(side).slice(k, 1).flatten()
    i, n, v = (rows.field(f) for f in ("id", "n", "v"))
    return [i.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)]


def _nearest(batches):
    """(id, cost, other) of the least Ward cost of each centroid of either block, over pairs of blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            (i, n, x), (j, m, y) = (_rows(batch, side, k) for side in ("left", "right"))
            cost = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0) * (n[:, None] * m[None, :] / (n[:, None] + m[None, :]))
            if batch.column("a")[k] == batch.column("b")[k]:
                cost[np.tril_indices(len(i))] = np.inf
            at, to = cost.argmin(1), cost.argmin(0)
            ids, costs, others = np.concatenate([i, j]), np.concatenate([cost[np.arange(len(i)), at], cost[to, np.arange(len(j))]]), np.concatenate([j[at], i[to]])
            ok = np.isfinite(costs)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(costs[ok]), pa.array(others[ok])], ["id", "cost", "other"])


def _cells(pivots: np.ndarray):
    """Adds the nearest pivot's number to (id, n, v)."""

    def run(batches):
        sq = (pivots * pivots).sum(1)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            yield batch.append_column("cell", pa.array((sq[None, :] - 2 * v @ pivots.T).argmin(1) if len(v) else [], pa.int64()))

    return run


def _ball(table: pa.Table) -> pa.Table:
    """A block of centroids in one row, with its centre, radius, least weight, and the greatest of its centroids' least costs within it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["id"])
    i, n, v = (np.array([r[f] for r in rows]) for f in ("id", "n", "v"))
    centre = v.mean(0)
    cost = np.maximum((v * v).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * v @ v.T, 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(cost, np.inf)
    cols = [[rows[0]["b"]], [centre.tolist()], [float(np.sqrt(((v - centre) ** 2).sum(1)).max())], [float(n.min())], [float(cost.min(1).max())], [[{"id": a, "n": w, "v": x} for a, w, x in zip(i.tolist(), n.tolist(), v.tolist(), strict=True)]]]
    types = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.float64()), ("v", pa.list_(pa.float64()))]))]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["b", "centre", "radius", "least", "worst", "rows"])


def _apart(df: DataFrame, count: int | None = None) -> DataFrame:
    """df, not to be broadcast where it has more rows than DRIVER_ROWS or nobody counted them."""
    return df if count is not None and count <= DRIVER_ROWS else df.hint("merge")


def near_pairs(cents: DataFrame, parts: int) -> DataFrame:
    """(a, left, b, right): the pairs of blocks of centroids between which a nearest pair may lie, a block and itself too.

    Centroids near to each other share a block (nearest of at most 256 pivots, which the driver sees; large cells are dealt to several).
    No cost between two blocks is below w d^2, w from their least weights and d the gap between their balls, so a pair is left out if
    that is over what every centroid of both finds in its own block. Only the heads of blocks are compared with each other.
    """
    pivots = cents.orderBy(F.xxhash64("id"), "id").limit(min(parts, 256)).collect()
    celled = cents.select("id", "n", "v").mapInArrow(_cells(np.array([r.v for r in pivots])), "id long, n double, v array<double>, cell long")
    deal = celled.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("deal"))  # a row a pivot
    dealt = celled.join(F.broadcast(deal), "cell").select("id", "n", "v", (F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("deal"))).alias("b"))
    schema = "b long, centre array<double>, radius double, least double, worst double, rows array<struct<id: long, n: double, v: array<double>>>"
    blocks = kept(dealt.groupBy("b").applyInArrow(_ball, schema), "blocks")
    heads = blocks.drop("rows")
    x, y = heads.select(*(F.col(c).alias(f"x_{c}") for c in heads.columns)), heads.select(*(F.col(c).alias(f"y_{c}") for c in heads.columns))
    between = F.sqrt(F.aggregate(F.zip_with("x_centre", "y_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, d: t + d))
    gap = F.greatest(between - F.col("x_radius") - F.col("y_radius"), F.lit(0.0))
    weight = F.col("x_least") * F.col("y_least") / (F.col("x_least") + F.col("y_least"))
    wanted = (F.col("x_b") == F.col("y_b")) | (weight * gap * gap * (1 - 1e-9) <= F.greatest("x_worst", "y_worst"))
    pairs = x.join(y, (F.col("x_b") <= F.col("y_b")) & wanted).select(F.col("x_b").alias("a"), F.col("y_b").alias("b"))
    count = parts * BLOCK
    left = pairs.join(_apart(blocks.select(F.col("b").alias("a"), F.col("rows").alias("left")), count), "a")
    return _apart(left, count).join(_apart(blocks.select("b", F.col("rows").alias("right")), count), "b").select("a", "left", "b", "right").repartition(F.col("a"), F.col("b"))


def ward_round(cents: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(centroids after, merges (cost, a, b)) of one round of mutually nearest pairs of centroids (id, n, v).

    Both sides of a pair read one cost matrix and ties go to the smaller id, so the least pair always merges.
    """
    parts = -(-count // BLOCK)
    if parts > 1:
        pairs = near_pairs(cents, parts)
    else:
        rows = cents.agg(F.array_sort(F.collect_list(F.struct("id", "n", "v"))).alias("left"))  # BLOCK centroids at most
        pairs = rows.select(F.lit(0).alias("a"), "left", F.lit(0).alias("b"), F.col("left").alias("right"))
    near = pairs.mapInArrow(_nearest, "id long, cost double, other long").groupBy("id").agg(F.min(F.struct("cost", "other")).alias("m"))
    near = kept(near.select("id", "m.cost", "m.other"), "nearest")
    back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
    merges = _apart(near, count).join(_apart(back, count), ["id", "other"]).filter("id < other").select("cost", F.col("id").alias("a"), F.col("other").alias("b"))
    into = merges.select(F.col("b").alias("id"), F.col("a").alias("to"))
    part = cents.join(_apart(into, count), "id", "left").select(F.coalesce("to", "id").alias("id"), "n", "v")
    rows = F.array_sort(F.collect_list(F.struct("n", "v")))
    mean = F.when(F.size("r") == 1, F.col("r")[0]["v"]).otherwise(F.zip_with(F.col("r")[0]["v"], F.col("r")[1]["v"], lambda x, y: (x * F.col("r")[0]["n"] + y * F.col("r")[1]["n"]) / F.col("n")))
    return kept(part.groupBy("id").agg(F.sum("n").alias("n"), rows.alias("r")).select("id", "n", mean.alias("v")), "centroids"), merges


def _end(batches):
    """The merges of the last few centroids, which are all rows of this task."""
    rows = sorted((r["id"], r["n"], r["v"]) for batch in batches for r in batch.to_pylist())
    merges = ward_merges(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) if len(rows) > 1 else []
    cols = [[m[0] for m in merges], [rows[m[1]][0] for m in merges], [rows[m[2]][0] for m in merges], list(range(len(merges)))]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["cost", "a", "b", "step"])


def ward_dendrogram(first: DataFrame) -> DataFrame:
    """(cost, a, b, step): every merge of weighted centroids (id, n, v); the cluster of b goes into that of a, a < b, both called by their smallest id.

    Rounds of Spark joins until LAST centroids are left, whose merges one task finds; merges stay a table. step: later merges have greater ones.
    """
    cents, count, step, merges = first, first.count(), 0, []
    while count > LAST:
        cents, merged = ward_round(cents, count)
        left = cents.count()
        if left == count:
            raise ValueError("no pair of centroids has a finite cost")
        merges.append(merged.withColumn("step", F.lit(step)))
        count, step = left, step + 1
    last = cents.coalesce(1).mapInArrow(_end, "cost double, a long, b long, step int").withColumn("step", F.col("step") + step)
    for m in merges:
        last = last.unionByName(m)
    return kept(last, "dendrogram")


def cut_dendrogram(first: DataFrame, merges: DataFrame, ks: list[int]) -> DataFrame:
    """(id, cluster_<k> for each k): clusters after all but the k - 1 greatest merges, numbered by smallest member.

    Merges below the greatest max(ks) - 1 hold for every k: pointers to the absorbing centroid are followed by
    doubling. The few above are a bounded list, from which the driver makes each k's labels of what then is left.
    """
    most = max(ks)
    top = [(r.a, r.b) for r in merges.orderBy(F.desc("cost"), F.desc("step"), F.desc("b")).limit(most - 1).collect()]
    free = [b for _, b in top]
    up = first.select("id").join(_apart(merges.select(F.col("b").alias("id"), "a")), "id", "left")
    up = kept(up.select("id", F.when(F.col("id").isin(free), F.col("id")).otherwise(F.coalesce("a", "id")).alias("root")), "pointers")
    while True:
        further = up.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = kept(_apart(up).join(_apart(further), "root").select("id", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "pointers")
        up = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    heads = sorted(r[0] for r in up.select("root").distinct().limit(most + 1).collect())
    labels = {}
    for k in ks:
        into = {b: a for a, b in top[k - 1 :]}
        ends = {}
        for h in heads:
            end = h
            while end in into:
                end = into[end]
            ends[h] = end
        number = {e: n for n, e in enumerate(sorted(set(ends.values())))}
        labels[k] = [number[ends[h]] for h in heads]
    table = first.sparkSession.createDataFrame(list(zip(heads, *(labels[k] for k in ks), strict=True)), "root long, " + ", ".join(f"cluster_{k} int" for k in ks))
    return up.join(F.broadcast(table), "root").drop("root")


def ward_clusters(entries: DataFrame, ks: list[int]) -> DataFrame:
    """(creator, features, cluster_<k> for each k) of unit vectors (creator, combined). One dendrogram serves every k.

    Exact at every size and by one path. Equal vectors are one weighted centroid from the start and never parted: k above the
    number of distinct vectors gives that many clusters.
    """
    rows = kept(entries.select("creator", F.col("combined").alias("v")).orderBy("creator").withColumn("id", F.monotonically_increasing_id()), "numbered")
    first = kept(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("n")).select("id", "n", "v"), "centroids")
    if first.isEmpty():
        return rows.select("creator", array_to_vector("v").alias("features"), *(F.lit(0).alias(f"cluster_{k}") for k in ks))
    labels = cut_dendrogram(first, ward_dendrogram(first), ks)
    labelled = _apart(first.select("id", "v")).join(_apart(labels), "id").drop("id")
    return _apart(rows.drop("id")).join(_apart(labelled), "v").select("creator", array_to_vector("v").alias("features"), *(f"cluster_{k}" for k in ks))


def cluster_sizes(df: DataFrame, column: str = "cluster_id") -> DataFrame:
    """(cluster, size, least size of all)."""
    sizes = df.groupBy(F.col(column).alias("cluster_id")).agg(F.count("*").alias("size"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.min("size").alias("min_size"))))


def silhouette(df: DataFrame, column: str) -> float:
    """Mean cosine silhouette; vectors must not be zero (gate them first)."""
    return ClusteringEvaluator(predictionCol=column, featuresCol="features", distanceMeasure="cosine").evaluate(df)


def k_sweep(clustered: DataFrame, ks: list[int]) -> DataFrame:
    """(k, silhouette, min_size). The labelled vectors are written once and read by every evaluation."""
    spark, clustered = clustered.sparkSession, kept(clustered, "labelled")
    long = clustered.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"cluster_{k}").alias("c")) for k in ks))).alias("x")).groupBy("x.k", "x.c").count()
    sizes = long.groupBy("k").agg(F.min("count").alias("min_size"))
    scores = spark.createDataFrame([(k, float(silhouette(clustered, f"cluster_{k}"))) for k in ks], "k int, silhouette double")
    return scores.join(sizes, "k").select("k", "silhouette", "min_size")


def best_k(scores: DataFrame, min_size: int = 5) -> DataFrame:
    """Scores with degenerate and best: among k whose clusters all have min_size members (all k, if none) the first greatest silhouette. One row a k."""
    every = Window.partitionBy()
    scores = scores.withColumn("degenerate", F.col("min_size") < min_size)
    some = F.max((~F.col("degenerate")).cast("int")).over(every) == 1
    order = Window.orderBy((some & F.col("degenerate")).cast("int"), F.desc("silhouette"), "k")
    return scores.withColumn("best", F.row_number().over(order) == 1)


def dominant_share(hits: DataFrame, clusters: DataFrame, k: int = 10) -> DataFrame:
    """(query, cluster_id, share): the most frequent cluster of a query's hits, the lowest on ties, in percent of k."""
    counts = hits.join(clusters, "creator").groupBy("query", "cluster_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc("n"), "cluster_id")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("query", "cluster_id", (F.lit(100.0) * F.col("n") / k).alias("share"))
