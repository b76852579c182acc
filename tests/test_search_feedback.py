import numpy as np
import pytest
from pyspark.sql import functions as F

from mmsearch.operators import evaluate, feedback, index, personalize, planning, search


def entries(spark, n=50, dims=8, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(f"c{k:03d}", x.tolist()) for k, x in enumerate(v)], "creator string, combined array<double>").repartition(5)


def test_search_is_exact_with_ties_and_large_k(spark):
    v, e = entries(spark)
    twice = e.unionByName(e.withColumn("creator", F.concat(F.lit("z"), "creator")))
    q = spark.createDataFrame([(f"q{k}", v[k].tolist()) for k in range(3)], "query string, q array<double>")
    for k in (1, 7, 500):
        got = search.search(twice, q, k).orderBy("query", "rank").collect()
        for j in range(3):
            own = [r for r in got if r.query == f"q{j}"]
            best = sorted(((-(v[i] @ v[j]), name) for i in range(len(v)) for name in (f"c{i:03d}", f"zc{i:03d}")))[:k]
            assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
            assert np.allclose([r.score for r in own], [-s for s, _ in best])
            assert own[0].creator == f"c{j:03d}"
    plain = search.top_k(search.score_cross(twice, q), 7, ["query"])
    assert {(r.query, r.creator) for r in plain.collect()} == {(r.query, r.creator) for r in search.search(twice, q, 7).collect()}
    assert search.search(e, q.filter("query = 'none'")).count() == 0 and search.search(e.filter("creator = 'none'"), q).count() == 0


def test_personalized_scores_match_a_plain_loop(spark):
    v, e = entries(spark)
    vec = {f"c{k:03d}": x for k, x in enumerate(v)}
    q = spark.createDataFrame([("q", v[0].tolist())], "query string, q array<double>")
    pool = search.search(e, q, 30)
    good = ["nobody"] + [f"c{k:03d}" for k in range(10, 21)]
    bad = ["c005", "c005", "nobody2"]
    rows = [("u", k, "q", c, "good") for k, c in enumerate(good)] + [("u", 100 + k, "q", c, "bad") for k, c in enumerate(bad)] + [("w", 1, "q", "nobody", "good"), ("x", 1, "other", "c001", "good")]
    fb = spark.createDataFrame(rows, "username string, n int, query string, creator string, label string")
    scored = personalize.personalize(pool, fb, e).collect()
    for r in scored:
        s = vec[r.creator] @ v[0]
        if r.username == "u":
            boost = 0.25 * np.mean([vec[r.creator] @ vec[c] for c in good[:10] if c in vec])
            penalty = 0.25 * np.mean([vec[r.creator] @ vec[c] for c in bad[:10] if c in vec])
        else:
            boost = penalty = 0.0
        assert np.isclose(r.score, 0.7 * s + boost - penalty) and np.isclose(r.similarity_boost, boost)
        assert r.is_boosted == (boost > 0.05) and r.is_penalized == (penalty > 0.05)
    assert {r.username for r in scored} == {"u", "w"}
    top = personalize.rerank(personalize.personalize(pool, fb, e), 10)
    assert [r.original_rank for r in top.filter("username = 'w'").orderBy("rank").collect()] == list(range(1, 11))
    st = {r.username: r for r in personalize.stats(top, pool.filter("rank <= 10")).collect()}
    assert st["w"].new_creators == st["w"].removed_creators == 0 and st["u"].new_creators == st["u"].removed_creators


def test_requests_without_feedback_get_their_pool_at_its_share(spark):
    v, e = entries(spark)
    pool = search.search(e, spark.createDataFrame([("q", v[0].tolist()), ("r", v[1].tolist())], "query string, q array<double>"), 30)
    fb = spark.createDataFrame([("u", 1, "q", "c003", "good")], "username string, n int, query string, creator string, label string")
    asked = spark.createDataFrame([("u", "q"), ("u", "r"), ("new", "q"), ("new", "q"), ("new", "none")], "username string, query string")
    rows = personalize.personalize(pool, fb, e, requests=asked).collect()
    assert {(r.username, r.query) for r in rows} == {("u", "q"), ("u", "r"), ("new", "q")} and len(rows) == 90
    assert all(np.isclose(r.score, 0.7 * r.original_score) and not r.is_boosted for r in rows if (r.username, r.query) != ("u", "q"))
    assert any(r.is_boosted for r in rows)


def test_feedback_above_the_cap_of_the_app_counts_in_the_evaluation(spark):
    rows = [(k, "u", f"c{k}", "click", "good", k) for k in range(1100)]
    df = spark.createDataFrame(rows, "event_id int, username string, liked_creator string, query_context string, label string, timestamp int")
    assert feedback.feedback(df).count() == 500 and feedback.feedback(df, feedback.EVALUATION_CAP).count() == 1000


def test_more_queries_than_a_block_takes(spark, monkeypatch):
    v, e = entries(spark)
    q = spark.createDataFrame([(f"q{k}", v[k % len(v)].tolist()) for k in range(11)], "query string, q array<double>")
    want = sorted((r.query, r.rank, r.creator) for r in search.search(e, q, 3).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    assert sorted((r.query, r.rank, r.creator) for r in search.search(e, q, 3).collect()) == want and len(want) == 33


def test_feedback_rules(spark):
    rows = [(k, "u", c, q, lab, k) for k, (c, q, lab) in enumerate([("a", " Click ", "Bad"), ("a", "click", None), ("b", None, "x"), ("", "click", "good"), (None, "click", "good"), ("c", "CLICK creators", "bad")])]
    df = spark.createDataFrame(rows, "event_id int, username string, liked_creator string, query_context string, label string, timestamp int")
    fb = feedback.feedback(df)
    assert sorted((r.query, r.creator, r.label) for r in fb.collect()) == [("", "b", "good"), ("click", "a", "bad"), ("click", "a", "good"), ("click creators", "c", "bad")]
    assert {(r.creator, r.label) for r in feedback.feedback_map(fb).filter("query = 'click'").collect()} == {("a", "bad")}
    aliases = spark.createDataFrame([("click", ["click", "Click  creators"]), ("view", ["view"])], "query string, aliases array<string>")
    al = feedback.alias_feedback(fb, aliases)
    assert {(r.query, r.label, r.creator) for r in al.collect()} == {("click", "bad", "a"), ("click", "good", "a"), ("click", "bad", "c")}
    p = evaluate.feedback_precision(al, 10)
    assert [(r.query, r.precision) for r in p.collect()] == [("click", 0.1)]
    assert evaluate.feedback_average(p, 2).first().average is None and evaluate.feedback_average(p, 1).first().average == 0.1
    assert feedback.user_rows(df, 2).count() == 2


def test_precision_winner_and_blank_labels(spark):
    rows = [("a", "q1", 1, "x", 1), ("a", "q1", 2, "y", 0), ("b", "q1", 1, "x", 1), ("b", "q1", 2, "y", None)]
    labels = spark.createDataFrame(rows, "config string, query string, rank int, creator string, relevant int")
    with pytest.raises(ValueError, match="config=b"):
        evaluate.validate_labels(labels)
    filled = evaluate.apply_judgments(labels, spark.createDataFrame([("q1", "y", 0), ("q1", "x", 0)], "query string, creator string, judged int"))
    assert sorted((r.config, r.creator, r.relevant, r.filled) for r in filled.collect()) == [("a", "x", 1, False), ("a", "y", 0, False), ("b", "x", 1, False), ("b", "y", 0, True)]
    precision = evaluate.precision_at_k(evaluate.validate_labels(filled))
    configs = spark.createDataFrame([(0, "b"), (1, "a"), (2, "none")], "config_pos int, config string")
    average = evaluate.avg_precision(precision, configs, spark.createDataFrame([("q1",), ("q2",)], "query string"))
    assert {r.config: r.avg_precision for r in average.collect()} == {"a": 0.25, "b": 0.25, "none": 0.0}
    assert evaluate.pick_winner(average).first().config == "b"
    assert evaluate.precision_table(precision, ["q1", "q2"]).filter("config = 'a'").first()["q2"] == 0.0


@pytest.mark.parametrize("most", [search.BROADCAST_BYTES, 0])
def test_a_sweep_computes_each_creator_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(search, "BROADCAST_BYTES", most)
    rng, computed = np.random.default_rng(3), spark.sparkContext.accumulator(0)
    img, txt = rng.normal(size=(2, 60, 8))
    rows = spark.createDataFrame([(f"c{k:03d}", a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(img, txt, strict=True))], "creator string, img array<double>, txt array<double>")

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    weights = [("a", 1.0, 0.0), ("b", 0.5, 0.5), ("c", 0.15, 0.85)]
    configs = spark.createDataFrame(weights, "config string, image_weight double, text_weight double")
    asked = rng.normal(size=(4, 8))
    path = f"{tmp_path}/queries"
    spark.createDataFrame([(f"q{k}", q.tolist()) for k, q in enumerate(asked)], "query string, q array<double>").repartition(4).write.parquet(path)
    queries = spark.read.parquet(path)
    got = search.config_sweep(rows.mapInArrow(counted, rows.schema), configs, queries, 5).collect()
    assert computed.value == 60
    for name, wi, wt in weights:
        fused = wi * img + wt * txt
        scores = asked @ (fused / np.linalg.norm(fused, axis=1, keepdims=True)).T
        for k in range(4):
            own = sorted((r for r in got if (r.config, r.query) == (name, f"q{k}")), key=lambda r: r["rank"])
            best = np.argsort(-scores[k])[:5]
            assert [r.creator for r in own] == [f"c{i:03d}" for i in best] and np.allclose([r.score for r in own], scores[k][best])


def test_the_grid_of_configs_and_queries_is_no_product_of_partitions(spark):
    configs = spark.createDataFrame([(0, "a")], "config_pos int, config string")
    queries = spark.createDataFrame([("q1",)], "query string").repartition(4)
    precision = spark.createDataFrame([("a", "q1", 0.5)], "config string, query string, precision double")
    average = evaluate.avg_precision(precision, configs, queries)
    assert "CartesianProduct" not in average._jdf.queryExecution().executedPlan().toString() and average.first().avg_precision == 0.5


def test_repeated_profiles_fail(spark):
    creators = spark.createDataFrame([("a",), ("b",)], "creator string")
    profiles = spark.createDataFrame([("a", 5, None), ("x", 1, 1)], "username string, follower_count long, video_count long")
    assert sorted(map(tuple, index.attach_profile(creators, profiles).collect())) == [("a", 5, 0), ("b", 0, 0)]
    with pytest.raises(Exception, match="repeated username"):
        index.attach_profile(creators, profiles.unionByName(profiles)).collect()


def test_planning_edges(spark):
    p = spark.createDataFrame([("A ", "[1, 2, '3']", "[10, 9.9]"), ("b", "['7','8','9','10','11']", "[50, 51, null, 20, 30, 40]"), ("c", "[]", "[]")], "username string, video_ids string, video_durations_list string")
    got = [(r.username, r.pick, r.video_id, r.duration) for r in planning.select_videos(p).collect()]
    assert got == [("A ", 0, "1", 10.0), ("b", 0, "7", 50.0), ("b", 1, "10", 20.0), ("b", 2, "11", 30.0)]
    names = spark.createDataFrame([(0, " a"), (1, "A"), (2, "zz")], "pos long, creator string")
    export = spark.createDataFrame([("a", 1, 0), ("A ", 2, 1), ("b", 3, 2)], "username string, v int, pos long")
    assert sorted((r.pos, r.v) for r in planning.match_profiles(names, export).collect()) == [(0, 2), (1, 2)]
    assert [r.creator for r in planning.missing_profiles(names, export).collect()] == ["zz"]
    videos = spark.createDataFrame([("b",), ("a",), ("c",)], "mp4 string")
    assert [(r.slot, r.mp4) for r in planning.recycle_to_target(videos, 7).orderBy("slot").collect()] == list(enumerate("abcabca"))
    assert planning.recycle_to_target(videos, 2).count() == 2 and planning.recycle_to_target(videos.filter("mp4 > 'x'"), 5).count() == 0


def test_the_evaluation_reads_1000_rows_of_a_user(spark, monkeypatch):
    from mmsearch.plans import registry
    from mmsearch.plans.inputs import Inputs

    i = F.col("id")
    rows = spark.range(1200).select(i.alias("event_id"), F.lit("u").alias("username"), F.concat(F.lit("c"), i.cast("string")).alias("liked_creator"), F.lit("click").alias("query_context"), F.lit("good").alias("label"), i.alias("timestamp"))
    monkeypatch.setattr(Inputs, "interactions", lambda self: rows)
    assert registry.QUERIES["J6_U3_alias_feedback"](spark, "none").count() == 1000
    assert [r.precision for r in registry.QUERIES["A7_feedback_precision"](spark, "none").collect()] == [100.0]
    assert registry.QUERIES["F8_F10_feedback"](spark, "none").count() == 500
