import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mmsearch.functions import text as tx
from mmsearch.functions import vectors as vx
from mmsearch.operators.index import nonzero_ok, pool_frames, usable_frames, vectors_ok
from mmsearch.operators.transcripts import creator_text, join_chunks, segment_ok, text_gate


def test_vector_functions_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(30)] + [([0.0] * 8, [1.0] * 8), ([1.0] * 8, [-1.0] * 8)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", vx.dot(a, b).alias("dot"), vx.norm(a).alias("norm"), vx.unit(a).alias("unit"), vx.fuse(a, b, 0.5, 0.5).alias("fuse"), vx.cosine_distance(a, b).alias("dist")).collect()
    for r in got:
        x, y = np.array(r.a), np.array(r.b)
        n = np.linalg.norm(x)
        assert np.isclose(r.dot, x @ y) and np.isclose(r.norm, n)
        assert np.allclose(r.unit, x / (n or 1))
        w = 0.5 * x + 0.5 * y
        assert np.allclose(r.fuse, w / (np.linalg.norm(w) or 1))
        assert np.isclose(r.dist, 1 - (x @ y / (n * np.linalg.norm(y)) if n else 0))


def test_unit_with_a_least_norm(spark):
    got = spark.createDataFrame([([1e-10, 0.0],)], "a array<double>").select(vx.unit(F.col("a"), 1e-8).alias("u")).first().u
    assert got == [pytest.approx(1e-2), 0.0]


def test_pooling_is_a_mean_of_unit_frames_and_zeros_without_frames(spark):
    rng = np.random.default_rng(2)
    frames = [(f"c{k % 3}", rng.normal(size=4).tolist()) for k in range(20)] + [("c0", [0.0] * 4)]
    creators = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("none",)], "creator string")
    got = {r.creator: r.img for r in pool_frames(spark.createDataFrame(frames, "creator string, v array<double>"), creators, 4).collect()}
    for c in ("c0", "c1", "c2"):
        own = np.array([v for k, v in frames if k == c])
        assert np.allclose(got[c], (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-8)).mean(0))
    assert got["none"] == [0.0] * 4


def test_gates_are_strict(spark):
    rows = [("zero_img", [0.0, 0.0], [1.0, 0.0]), ("zero_txt", [1.0, 0.0], [0.0, 0.0]), ("edge", [0.01, 0.0], [1.0, 0.0]), ("ok", [0.02, 0.0], [0.02, 0.0]), ("opposite", [0.15, 0.0], [-0.85, 0.0])]
    df = spark.createDataFrame(rows, "creator string, img array<double>, txt array<double>")
    assert {r.creator for r in df.filter(vectors_ok()).collect()} == {"ok"}
    assert {r.creator for r in df.filter(nonzero_ok()).collect()} == {"edge", "ok", "opposite"}


def python_gate(text):
    text = str(text or "").strip()
    words = text.lower().split()
    return len(text) >= 50 and bool(words) and max(words.count(w) for w in set(words)) / len(words) <= 0.4


def test_text_gate_matches_plain_python(spark):
    rng = random.Random(3)
    blanks = [" ", "\n", chr(0xA0), chr(0x3000), chr(0x1C), chr(0x85), chr(0x2003)]
    texts = ["".join(rng.choice(["aa", "Bb", "c", "É"]) + rng.choice(blanks) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["x" * 49, "x" * 50, "a " * 20 + "b " * 30 + "c", "a a b c d " * 10, None, "", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.meaningful for r in text_gate(df).collect()}
    assert [got[k] for k in range(len(texts))] == [python_gate(t) for t in texts]


def test_normalized_queries_and_paths(spark):
    row = spark.createDataFrame([("  A  b\tC ", "m/c1/v.mp4", "root\\c1\\frames\\a.png", None)], "q string, p string, f string, n string").select(
        tx.normalize_query(F.col("q")).alias("q"), tx.normalize_query(F.col("n")).alias("n"), tx.creator_of(F.col("p")).alias("c"), tx.rel_path(F.col("f"), "root").alias("f"), tx.preview(F.col("n")).alias("none"), tx.preview(F.col("p"), 3).alias("some")
    ).first()
    assert tuple(row) == ("a b c", "", "c1", "c1/frames/a.png", "No transcription", "m/c")


def test_segments_and_joined_texts(spark):
    segs = [("m", 0, 1, "b", 0.7, -0.5, 1.0), ("m", 0, 0, "a", 0.7, -1.0, 1.0), ("m", 1, 0, "c", 0.1, -3.0, 2.5), ("m", 1, 1, " ", 0.0, 0.0, 1.0), ("m", 2, 0, "d", 0.6, -2.0, 2.4), ("m", 0, 2, "e", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(segs, "mp4 string, chunk_idx int, seg_idx int, text string, no_speech_prob double, avg_logprob double, compression_ratio double")
    assert {r.text for r in df.filter(segment_ok()).collect()} == {"b", "d", "e"}
    assert {r.text for r in df.filter(segment_ok(ns=None, cr=None)).collect()} == {"a", "b", "c", "d", "e"}
    assert join_chunks(df.filter(segment_ok())).first().text == "b e d"
    videos = spark.createDataFrame([("m/c/2", "c"), ("m/c/1", "c"), ("m/c/3", "c"), ("m/d/1", "d")], "mp4 string, creator string")
    texts = spark.createDataFrame([("m/c/1", "one"), ("m/c/3", "three")], "mp4 string, text string")
    assert {r.creator: r.transcription for r in creator_text(videos, texts).collect()} == {"c": "one  three", "d": ""}


def test_frames_of_silent_videos(spark):
    frames = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "mp4 string, f int")
    texts = spark.createDataFrame([("m1", "hi"), ("m1", "hi"), ("m2", " "), ("m3", None)], "mp4 string, text string")
    assert usable_frames(frames, texts).count() == 3
    assert [r.mp4 for r in usable_frames(frames, texts, drop_silent_frames=True).collect()] == ["m1"]


def test_top_share_reads_one_text_of_a_batch_at_a_time(spark):
    """The batch stays an Arrow array; null, empty and blank texts have no share."""
    import pyarrow as pa
    from pyspark.util import PythonEvalType

    from mmsearch.functions import text

    assert text._top_share.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert text._top_share.func(pa.array(["a b a", None, "", " \t", "x"])).to_pylist() == [2 / 3, None, None, None, 1.0]
