import numpy as np
import pytest
from pyspark.sql import functions as F

from mmsearch.operators import cluster, report, transcripts
from mmsearch.sources import files
from mmsearch.streaming import ingest


def naive_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a):
                ca, cb = x[groups[a]].mean(0), x[groups[b]].mean(0)
                na, nb = len(groups[a]), len(groups[b])
                cost = na * nb / (na + nb) * ((ca - cb) ** 2).sum()
                if best is None or cost < best[0]:
                    best = cost, a, b
        _, a, b = best
        groups[b] += groups.pop(a)
    return {frozenset(g) for g in groups}


def points(spark, n=60):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 5)) + 2 * rng.normal(size=(6, 5))[rng.integers(0, 6, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(f"c{k:03d}", v.tolist()) for k, v in enumerate(x)], "creator string, combined array<double>")


def test_ward_matches_naive_ward_and_silhouette_its_definition(spark):
    x, df = points(spark)
    ks = [3, 6, 10]
    got = cluster.ward_clusters(df, ks)
    rows = sorted(got.collect(), key=lambda r: r.creator)
    for k in ks:
        labels = np.array([r[f"cluster_{k}"] for r in rows])
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())} == naive_ward(x, k)
        dist = 1 - x @ x.T
        s = []
        for i in range(len(x)):
            own = labels == labels[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = dist[i][own].sum() / (own.sum() - 1)
            b = min(dist[i][labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
            s.append((b - a) / max(a, b))
        assert np.isclose(cluster.silhouette(got, f"cluster_{k}"), np.mean(s))


def test_micro_centroids_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LAST", 20)
    x, df = points(spark)
    rows = cluster.ward_clusters(df, [4]).collect()
    assert len(rows) == len(x) and len({r.cluster_4 for r in rows}) == 4


def test_best_k(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, silhouette double, min_size long")
    pick = lambda rows: [r.k for r in cluster.best_k(make(rows)).collect() if r.best]
    assert pick([(3, 0.1, 9), (4, 0.9, 1), (5, 0.3, 5), (6, 0.3, 7)]) == [5]
    assert pick([(3, 0.1, 1), (4, 0.9, 1)]) == [4]


def test_reports(spark):
    log = spark.createDataFrame([(1, "s", 1, 0.0, 2.0), (1, "s", 2, 1.0, 5.0), (2, "s", 1, 0.0, 2.5), (3, "s", 1, 1.0, 1.0)], "run int, stage string, item int, start double, end double")
    got = {r.run: r for r in report.speedup(report.run_metrics(log)).collect()}
    assert (got[1].items, got[1].mean_sec, got[1].wall_sec, got[1].items_per_sec, got[1].speedup) == (2, 3.0, 5.0, 0.4, 1.0)
    assert got[2].speedup == 2.0 and got[3].speedup == 0.0 and got[3].items_per_sec == 0.0


VIDEOS = [(f"m/c{k % 4}/{k:02d}.mp4", f"c{k % 4}", None if k % 5 == 0 else f"text {k}") for k in range(22)]


@pytest.mark.parametrize("parts", [1, 2, 6])
def test_stream_equals_batch_over_any_micro_batches(spark, parts):
    texts = spark.createDataFrame(VIDEOS, "mp4 string, creator string, text string")
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    repeated = texts.unionByName(texts.limit(6))
    repeated.repartition(parts).write.parquet(path)
    stream = ingest.stream_source(spark, path, "mp4 string, creator string, text string", 1)
    groups = ingest.complete_groups(stream, ingest.expected_counts(texts))
    ingest.run_available(groups, out, state)
    got = spark.read.parquet(out).collect()
    want = {r.creator: r.transcription for r in transcripts.creator_text(texts, texts).collect()}
    assert len(got) == len(want) and {r.creator: r.transcription for r in got} == want and all(r.complete for r in got)


def test_restart_emits_each_creator_once_and_incomplete_ones_wait(spark):
    texts = spark.createDataFrame(VIDEOS, "mp4 string, creator string, text string")
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    expected = ingest.expected_counts(texts)
    for half in ("mp4 < 'm/c2'", "mp4 >= 'm/c2' and mp4 < 'm/c3/07'", "mp4 >= 'm/c3/07'"):
        texts.filter(half).write.mode("append").parquet(path)
        ingest.run_available(ingest.complete_groups(ingest.stream_source(spark, path, "mp4 string, creator string, text string", 1), expected), out, state)
        done = [r.creator for r in spark.read.parquet(out).collect()]
        assert len(done) == len(set(done))
    assert sorted(done) == ["c0", "c1", "c2", "c3"]


def test_upserts_replace_a_repeated_batch(spark):
    path, out = files.shared_path(spark, "arrive"), files.shared_path(spark, "up")
    spark.range(10).write.parquet(path)
    for attempt in ("a", "b"):
        ingest.index_upsert(ingest.stream_source(spark, path, "id long", 99), lambda b: b.withColumn("v", F.lit(1)), out, files.shared_path(spark, f"state{attempt}"))
    assert spark.read.parquet(out).count() == 10


def test_an_incomplete_group_comes_out_after_the_timeout(spark):
    import time

    texts = spark.createDataFrame(VIDEOS, "mp4 string, creator string, text string")
    path, out = files.shared_path(spark, "arrive"), files.shared_path(spark, "late")
    texts.filter("not (creator = 'c1' and mp4 like '%05%')").coalesce(1).write.parquet(path)
    stream = ingest.stream_source(spark, path, "mp4 string, creator string, text string", 1)
    groups = ingest.complete_groups(stream, ingest.expected_counts(texts), timeout_ms=500)
    q = groups.writeStream.format("parquet").option("path", out).option("checkpointLocation", files.shared_path(spark, "state")).trigger(processingTime="200 milliseconds").start()
    try:
        schema, until, rows = "creator string, transcription string, complete boolean", time.time() + 90, []
        while len(rows) < 4 and time.time() < until:
            time.sleep(1)
            rows = spark.read.schema(schema).parquet(out).collect()
    finally:
        q.stop()
    assert {r.creator: r.complete for r in rows} == {"c0": True, "c1": False, "c2": True, "c3": True}


@pytest.mark.parametrize("block", [1024, 16])
def test_rounds_in_spark_give_the_clusters_of_naive_ward(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "LAST", 20)
    monkeypatch.setattr(cluster, "BLOCK", block)
    x, df = points(spark)
    df = df.unionByName(df.filter("creator < 'c003'").withColumn("creator", F.concat(F.lit("x"), "creator")))
    ks = [3, 6, 10]
    rows = sorted(cluster.ward_clusters(df, ks).collect(), key=lambda r: r.creator)
    x = np.concatenate([x, x[:3]])
    for k in ks:
        labels = np.array([r[f"cluster_{k}"] for r in rows])
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())} == naive_ward(x, k)


def test_far_blocks_are_left_out_and_no_nearest_pair_with_them(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 20)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 3)) + 100 * rng.normal(size=3) for _ in range(6)])
    w = rng.integers(1, 5, len(x)).astype(float)
    cents = spark.createDataFrame([(k, float(n), v.tolist()) for k, (n, v) in enumerate(zip(w, x, strict=True))], "id long, n double, v array<double>").repartition(3)
    pairs = cluster.near_pairs(cents, 12)
    blocks = pairs.select("a").union(pairs.select("b")).distinct().count()
    assert pairs.count() < blocks * (blocks + 1) / 4
    near = {r.id: r.m.other for r in pairs.mapInArrow(cluster._nearest, "id long, cost double, other long").groupBy("id").agg(F.min(F.struct("cost", "other")).alias("m")).collect()}
    cost = ((x[:, None] - x[None]) ** 2).sum(2) * (w[:, None] * w[None] / (w[:, None] + w[None]))
    np.fill_diagonal(cost, np.inf)
    assert [near[k] for k in range(len(x))] == cost.argmin(1).tolist()


def test_pairs_of_blocks_are_read_one_by_one_from_their_batch():
    """Each pair of a batch gives the least costs of its own blocks, from views of the batch."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    block = lambda at, n: [{"id": at + k, "n": 1.0 + k, "v": rng.normal(size=4).tolist()} for k in range(n)]
    rows = [block(0, 3), block(10, 5), block(20, 1)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.float64()), ("v", pa.list_(pa.float64()))]))
    pairs = [(a, b) for a in range(3) for b in range(a, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([rows[p[0]] for p in pairs], kind), pa.array([p[1] for p in pairs]), pa.array([rows[p[1]] for p in pairs], kind)], ["a", "left", "b", "right"])
    ids, n, v = cluster._rows(batch, "right", 1)
    assert ids.tolist() == [r["id"] for r in rows[1]] and n.tolist() == [r["n"] for r in rows[1]] and v.tolist() == [r["v"] for r in rows[1]]
    best = {}
    for out in cluster._nearest([batch.slice(0, 2), batch.slice(2)]):
        for r in out.to_pylist():
            best[r["id"]] = min(best.get(r["id"], (np.inf, 0)), (r["cost"], r["other"]))
    every = [r for b in rows for r in b]
    cost = lambda x, y: sum((p - q) ** 2 for p, q in zip(x["v"], y["v"], strict=True)) * x["n"] * y["n"] / (x["n"] + y["n"])
    for x in every:
        near = min((cost(x, y), y["id"]) for y in every if y is not x)
        assert best[x["id"]][1] == near[1] and abs(best[x["id"]][0] - near[0]) < 1e-9


def test_ward_joins_of_many_centroids_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cluster, "DRIVER_ROWS", 10)
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(5)
    cents = spark.createDataFrame([(n, 1.0, x.tolist()) for n, x in enumerate(rng.normal(size=(40, 3)))], "id long, n double, v array<double>")
    plan = cluster.near_pairs(cents, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    assert "BroadcastHashJoin" not in plan
