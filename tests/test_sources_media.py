import os

import numpy as np
from pyspark.sql import functions as F

from mmsearch.operators import media
from mmsearch.sources import files


def test_scans(spark, tmp_path):
    for p in ("b/2.mp4", "a/1.mp4", "a/0.mp4", "_skip/1.mp4", "top.mp4", "a/deep/3.mp4", "a/x/frames/f1.JPG", "a/frames/f0.png", "a/frames/no.txt", "b/y/frames/z/n.png"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    got = [(r.creator, r.mp4.rsplit("/", 1)[1]) for r in files.scan_media(spark, str(tmp_path)).collect()]
    assert got == [("a", "0.mp4"), ("a", "1.mp4"), ("b", "2.mp4")]
    frames = sorted((r.creator, r.frame_path.rsplit("/", 1)[1], bytes(r.content)) for r in files.scan_frames(spark, str(tmp_path)).collect())
    assert frames == [("a", "f0.png", b"a/frames/f0.png"), ("a", "f1.JPG", b"a/x/frames/f1.JPG")]


def test_csv_keeps_quotes_newlines_and_nulls(spark):
    rows = [("a", 'say "hi"\nnext, line'), ("b", ""), ("c", " padded ")]
    path = files.write_csv(spark.createDataFrame(rows, "creator string, transcription string"), files.shared_path(spark, "csv"))
    assert sorted(map(tuple, files.read_transcriptions(spark, path).collect())) == rows


def test_feedback_table(spark):
    path = files.init_interactions(spark, files.shared_path(spark, "fb"))
    rows = [("u", "c", "q", "BAD", None), ("u", "c", "q", None, None), ("u", "", "q", "good", None), ("u", None, "q", "good", None), ("u", "c", "q", "other", None)]
    bad = files.append_feedback(spark.createDataFrame(rows, "username string, liked_creator string, query_context string, label string, timestamp timestamp"), path)
    assert bad.count() == 3
    got = spark.read.parquet(path).collect()
    assert sorted(r.label for r in got) == ["bad", "good"] and all(r.timestamp for r in got)


def test_search_docs_keep_the_last_of_a_key(spark):
    path, n = files.write_search_docs(spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "username string, pos int, v string"), files.shared_path(spark, "docs"))
    assert n == 2 and {r.username: r.v for r in spark.read.parquet(path).collect()} == {"a": "z", "b": "y"}


def test_frames_are_split_at_markers(spark):
    jpeg = lambda k: b"\xff\xd8" + b"%d" % k + b"\xff\xd9"
    rows = [("a", b"junk" + b"".join(map(jpeg, range(12)))), ("b", jpeg(1) + b"\xff\xd8 open"), ("c", b""), ("d", None), ("e", b"\xff\xd9" + jpeg(5))]
    got = media.split_frames(spark.createDataFrame(rows, "mp4 string, stream binary")).collect()
    assert [(r.mp4, r.frame_idx, bytes(r.jpeg)) for r in got] == [("a", k, jpeg(k)) for k in range(10)] + [("b", 0, jpeg(1)), ("e", 0, jpeg(5))]


def test_audio_chunks(spark):
    rows = [("a", bytes(range(250)) * 2), ("b", b""), ("c", None), ("d", b"12")]
    df = spark.createDataFrame(rows, "mp4 string, audio_pcm binary")
    got = [(r.mp4, r.chunk_idx, r.offset, r.duration, bytes(r.pcm)) for r in media.chunk_audio(df, seconds=10, rate=10, most_seconds=None).collect()]
    whole = rows[0][1]
    assert got == [("a", 0, 0.0, 10.0, whole[:200]), ("a", 1, 10.0, 10.0, whole[200:400]), ("a", 2, 20.0, 5.0, whole[400:]), ("d", 0, 0.0, 0.1, b"12")]
    short = media.chunk_audio(df, seconds=10, rate=10, most_seconds=10, skip_seconds=1).collect()
    assert [bytes(r.pcm) for r in short] == [whole[20:220]]


def test_samples_and_reports(spark):
    pcm = np.array([0, 32767, -32768], "<i2").tobytes()
    row = media.pcm_to_float(spark.createDataFrame([(pcm + b"x",), (None,)], "pcm binary")).collect()
    assert row[0].samples == [0.0, 32767 / 32768, -1.0] and row[1].samples == []
    df = spark.createDataFrame([("a", b"1", [b"f"]), ("b", b"", []), ("c", None, None)], "mp4 string, audio_pcm binary, frames array<binary>")
    assert [tuple(r) for r in media.extract_report(df).collect()] == [("a", True, 1), ("b", False, 0), ("c", False, 0)]


def test_encoder_is_deterministic_and_batched(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "b a", "c", "", None])], "id int, text string").repartition(3)
    got = {r.id: r.vector for r in media.encode(df, "text", media.hashed_text_encoder(16), 2).collect()}
    assert got[0] == got[1] and abs(np.linalg.norm(got[2]) - 1) < 1e-6 and not any(got[3]) and not any(got[4])


def test_last_wins_takes_expressions(spark):
    df = spark.createDataFrame([("A", 1), ("a", 2), ("b", 1)], "k string, pos int")
    assert sorted(map(tuple, files.last_wins(df, [F.lower("k")], "pos").collect())) == [("a", 2), ("b", 1)]


def test_a_customer_without_orders_has_the_profile_that_the_sql_gives(spark, tmp_path):
    """Its one outer row has no duration, which the SQL writes as null."""
    import duckdb

    from mmsearch.plans import registry

    spark.createDataFrame([(1, "with"), (2, "without")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(7, 1), (9, 1)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(7, 3.0), (7, 2.0)], "l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES["S1_read_profiles"](spark, str(tmp_path))
    con.execute("CREATE VIEW embeddings AS SELECT 0 AS vec_id, 0 AS label, [1.0] AS embedding; CREATE VIEW documents AS SELECT 0 AS doc_id, '' AS text; CREATE VIEW conversations AS SELECT 0 AS conv_id, 0 AS turn, '' AS text")
    con.execute("CREATE VIEW events AS SELECT 0 AS event_id, 0 AS user_id, 'view' AS event_type, TIMESTAMP '2020-01-01' AS ts, 1.0 AS value, '{}' AS props")
    found = con.execute(registry.ORACLE["S1_read_profiles"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    assert {r.username: r.video_durations_list for r in got.collect()} == {"with": "[2.0, null]", "without": "[null]"}
