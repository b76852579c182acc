import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mmsearch.operators import media, search, transcripts
from mmsearch.functions import text as tx
from mmsearch.sources import files, schemas, versioned
from mmsearch.streaming import ingest

TEXTS = "mp4 string, creator string, text string, ts timestamp"


def at(minutes):
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(minutes=minutes)


def arrive(spark, path, rows, schema=TEXTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return ingest.stream_source(spark, path, schema, 1000)


def test_groups_end_at_a_gap_or_with_the_watermark(spark):
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2)], "creator string, expected int")
    batches = [
        [("a1", "a", "A1", at(0)), ("b1", "b", "B1", at(1)), ("c2", "c", None, at(2)), ("b1", "b", "again", at(3))],
        [("a2", "a", "A2", at(30)), ("b2", "b", "late", at(70)), ("c1", "c", "C1", at(40)), ("d1", "d", "D1", at(80))],
        [("b2", "b", "later", at(81)), ("a2", "a", "A2", at(82)), ("d2", "d", "too late", at(145))],
    ]
    for rows in batches:
        ingest.run_available(ingest.complete_groups(arrive(spark, path, rows), expected, 3_600_000, "ts"), out, state)
    got = sorted((r.creator, r.transcription, r.complete) for r in spark.read.schema(ingest.GROUPS).parquet(out).collect())
    assert got == [("a", "A1 A2", True), ("b", "B1", False), ("c", "C1 ", True), ("d", "D1", False)]


def test_a_group_left_alone_comes_out_once_the_watermark_passes(spark):
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    expected = spark.createDataFrame([("a", 2), ("b", 1)], "creator string, expected int")
    read = lambda: sorted((r.creator, r.complete) for r in spark.read.schema(ingest.GROUPS).parquet(out).collect())
    ingest.run_available(ingest.complete_groups(arrive(spark, path, [("a1", "a", "x", at(0))]), expected, 60_000, "ts"), out, state)
    assert read() == []
    ingest.run_available(ingest.complete_groups(arrive(spark, path, [("b1", "b", "y", at(10))]), expected, 60_000, "ts"), out, state)
    assert read() == [("a", False), ("b", True)]
    with pytest.raises(ValueError):
        ingest.complete_groups(ingest.stream_source(spark, path, TEXTS), expected, None, "ts")


def test_a_batch_writes_state_for_its_arrivals_only(spark):
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    expected = spark.createDataFrame([("a", 10_000)], "creator string, expected int")
    touched = []
    for rows in ([(f"m{n:05d}", "a", "t" * 500, at(0)) for n in range(2000)], [("m99999", "a", "one", at(1))]):
        stream = ingest.complete_groups(arrive(spark, path, rows), expected)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        touched.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in (x.jsonValue if hasattr(x, "jsonValue") else __import__("json").loads(x.json) for x in q.recentProgress) if p["numInputRows"]))
    assert touched[0] >= 2000 and touched[1] <= 3


def test_a_small_group_is_one_value_of_state_and_a_large_one_a_map(spark):
    """eight paths were nine rows of state; a group that outgrows the value loses and repeats nothing."""
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    expected = spark.createDataFrame([("a", 9), ("b", 101)], "creator string, expected int")
    large = [(f"b{n:03d}", "b", None if n % 7 == 0 else f"t{n}", at(n)) for n in range(101)]
    batches = [[(f"a{n}", "a", f"t{n}", at(n)) for n in range(8)], [("a3", "a", "again", at(8)), *large[:90]], [*large[5:100], ("a8", "a", None, at(9))], large[90:]]
    written = []
    for rows in batches:
        q = ingest.complete_groups(arrive(spark, path, rows), expected).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        written.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in (x.jsonValue if hasattr(x, "jsonValue") else __import__("json").loads(x.json) for x in q.recentProgress) if p["numInputRows"]))
    assert written[0] == 1
    got = sorted((r.creator, r.transcription, r.complete) for r in spark.read.schema(ingest.GROUPS).parquet(out).collect())
    assert got == [("a", " ".join([*(f"t{n}" for n in range(8)), ""]), True), ("b", " ".join(t or "" for _, _, t, _ in large), True)]


def test_repeats_and_late_rows_are_dropped_over_restarts(spark):
    path, out, state = (files.shared_path(spark, n) for n in ("arrive", "out", "state"))
    run = lambda rows: ingest.run_available(ingest.drop_repeats(arrive(spark, path, rows), ["mp4"], "ts", "1 hour"), out, state)
    run([("a", "c", "1", at(0)), ("a", "c", "1", at(5)), ("b", "c", "1", at(100))])
    run([("a", "c", "1", at(50)), ("b", "c", "1", at(101)), ("d", "c", "1", at(30)), ("e", "c", "1", at(60))])
    assert sorted(r.mp4 for r in spark.read.schema(TEXTS).parquet(out).collect()) == ["a", "b", "e"]


def test_merged_batches_survive_a_replay(spark):
    path, root = files.shared_path(spark, "arrive"), files.shared_path(spark, "merged")
    build = lambda batch: batch.groupBy("creator").agg(F.max("text").alias("text"))
    state = files.shared_path(spark, "state")
    for rows in ([("m1", "a", "1", at(0)), ("m2", "b", "1", at(0))], [("m3", "b", "2", at(1)), ("m4", "c", "2", at(1))]):
        ingest.index_merge(arrive(spark, path, rows), build, root, state, buckets=4)
    want = [("a", "1"), ("b", "2"), ("c", "2")]
    assert sorted((r.creator, r.text) for r in versioned.read(spark, root).collect()) == want
    number = versioned.current(spark, root).number
    replay = ingest.stream_source(spark, path, TEXTS, 1)
    ingest.index_merge(replay, build, root, files.shared_path(spark, "again"), buckets=4)
    assert sorted((r.creator, r.text) for r in versioned.read(spark, root).collect()) == want and versioned.current(spark, root).number == number


def test_both_outputs_of_a_stream_are_written_once(spark):
    path, out = files.shared_path(spark, "clicks"), files.shared_path(spark, "out")
    rows = [("u", "c", "q", "GOOD", at(0)), ("u", "", "q", "good", at(1)), ("v", "c", None, None, None), ("v", "c", "q", "maybe", at(2)), ("w", None, "q", "bad", at(3))]
    stream = lambda: arrive(spark, path, rows, schemas.INTERACTIONS)
    ingest.feedback_outputs(stream(), out, files.shared_path(spark, "s1"))
    first = [sorted((r.username, r.liked_creator, r.label) for r in x.collect()) for x in ingest.read_outputs(spark, out, schemas.INTERACTIONS)]
    assert first == [[("u", "c", "good"), ("v", "c", "good")], sorted([("u", "", "good"), ("v", "c", "maybe"), ("w", None, "bad")], key=repr)] or len(first[1]) == 3
    assert all(r.timestamp is not None for r in ingest.read_outputs(spark, out, schemas.INTERACTIONS)[0].collect())
    ingest.feedback_outputs(ingest.stream_source(spark, path, schemas.INTERACTIONS, 1000), out, files.shared_path(spark, "s2"))
    assert [x.count() for x in ingest.read_outputs(spark, out, schemas.INTERACTIONS)] == [2, 3]


def test_media_stream_archives_and_skips(spark):
    root, out, state, archive = (files.shared_path(spark, n) for n in ("media", "out", "state", "archive"))
    media_rows = spark.createDataFrame([("a/1.mp4", b"one"), ("a/2.mp4", b""), ("_tmp/3.mp4", b"x"), ("b/n.txt", b"x"), ("b/4.mp4", b"four")], "path string, content binary")
    files.write_media(media_rows, root)
    schema = "mp4 string, creator string, content binary"
    for _ in range(2):
        ingest.run_available(files.media_stream(spark, root, 2, archive=archive), out, state)
    got = sorted((r.creator, r.mp4.rsplit("/", 1)[1], bytes(r.content)) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [("a", "1.mp4", b"one"), ("b", "4.mp4", b"four")]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_written_media_is_scanned_by_any_path(spark, scheme):
    root = scheme + files.shared_path(spark, "media").removeprefix("file://").removeprefix("file:")
    rows = [("a/1.mp4", b"one"), ("b/x/frames/f.PNG", b"png"), ("b/x/cover.png", b"no"), ("b/deep/2.mp4", b"no")]
    files.write_media(spark.createDataFrame(rows, "path string, content binary"), root)
    assert [(r.creator, r.mp4.rsplit("/", 1)[1], bytes(r.content)) for r in files.scan_media(spark, root + "/", content=True).collect()] == [("a", "1.mp4", b"one")]
    assert [(r.creator, r.frame_path.rsplit("/", 1)[1], bytes(r.content)) for r in files.scan_frames(spark, root).collect()] == [("b", "f.PNG", b"png")]


def test_frames_are_encoded_in_batches_of_tensors(spark):
    pictures = [(f"m{n}", 0, b"\xff\xd8" + bytes([n]) * n + b"\xff\xd9") for n in range(70)] + [("bad", 0, b"nothing"), ("null", 0, None)]
    df = spark.createDataFrame(pictures, "mp4 string, frame_idx int, jpeg binary").repartition(2)
    got = {r.mp4: r.v for r in media.encode_frames(media.decode_frames(df, media.decode_bytes(4)), media.row_sums(4), [4, 4], 8).collect()}
    assert set(got) == {f"m{n}" for n in range(70)}
    for n in (0, 3, 40):
        raw = np.frombuffer((b"\xff\xd8" + bytes([n]) * n + b"\xff\xd9")[:16].ljust(16, b"\0"), np.uint8).reshape(4, 4)
        assert got[f"m{n}"] == raw.sum(1).tolist()


def test_chunks_become_segments(spark):
    pcm = np.arange(-7, 11, dtype="<i2").tobytes()
    chunks = media.pcm_to_float(media.chunk_audio(spark.createDataFrame([("a", pcm), ("b", b"")], "mp4 string, audio_pcm binary"), seconds=3, rate=3, most_seconds=None).select("mp4", "chunk_idx", "pcm"))
    got = sorted((r.mp4, r.chunk_idx, r.seg_idx, r.text, r.no_speech_prob, r.avg_logprob, r.compression_ratio) for r in media.transcribe(chunks, media.counting_speech(3), 9, 2).collect())
    sums = [abs(int(x)) for x in np.arange(-7, 11).reshape(6, 3).sum(1)]
    assert got == [("a", k // 3, k % 3, f"n{x}" if x else "", x % 100 / 100, -(x % 20) / 10, 1 + x % 30 / 10) for k, x in enumerate(sums)]
    with pytest.raises(Exception, match="longer than the model"):
        media.transcribe(chunks, media.counting_speech(3), 6).collect()


def test_pcm_is_transcribed_as_its_samples_by_one_python_worker(spark):
    audio = [np.arange(k - 20, k, dtype="<i2").tobytes()[: 2 * k + k % 2] for k in range(10)]
    rows = [(f"v{k}", k % 3, pcm) for k, pcm in enumerate(audio)] + [("none", 0, None)]
    chunks = spark.createDataFrame(rows, "mp4 string, chunk_idx int, pcm binary").coalesce(2)
    said = media.transcribe(chunks, media.counting_speech(3), 9, 4)
    assert sorted(map(tuple, said.collect())) == sorted(map(tuple, media.transcribe(media.pcm_to_float(chunks), media.counting_speech(3), 9, 4).collect()))
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    with pytest.raises(Exception, match="longer than the model"):
        media.transcribe(chunks, media.counting_speech(3), 6).collect()


def test_the_transcribe_query_has_one_python_step(spark, sf_dir):
    from __spark_entry__ import queries

    plan = queries()["M2_M3_M4_F7_A2_transcribe"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


def test_heavy_tokens_over_videos(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "COUNTERS", 9)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        for v in range(5):
            words = [f"w{x}" for x in rng.integers(0, 300, 60)]
            words[: 60 * c // 12] = ["Heavy"] * (60 * c // 12)
            rows.append((f"c{c:02d}", f"m{v}", " ".join(words)))
    rows += [("edge", "m", "x x y z w"), ("over", "m", "x x x y z"), ("null", "m", None), ("blank", "m", " \n")]
    videos = spark.createDataFrame(rows, "creator string, mp4 string, text string").repartition(6)
    got = {r.creator: (r.token, r.share) for r in transcripts.heavy_tokens(videos).collect()}
    assert set(got) == {f"c{c:02d}" for c in range(5, 12)} | {"over"}
    assert got["over"] == ("x", 0.6) and all(t == "heavy" for c, (t, _) in got.items() if c != "over")


def test_creator_gate_equals_the_gate_of_the_joined_text(spark):
    texts = [None, "", "  ", " a b", "word " * 20, "　x", "y\n\n", "many different words stand here so that nothing is repeated too often at all"]
    rows = [(f"c{c}", f"c{c}/m{v}", texts[(3 * c + v * (c % 5)) % len(texts)]) for c in range(24) for v in range(c % 6 + 1)]
    videos = spark.createDataFrame(rows, "creator string, mp4 string, text string").repartition(4)
    whole = transcripts.text_gate(transcripts.creator_text(videos, videos), "transcription").select("creator", "n_stripped", "meaningful")
    assert sorted(map(tuple, transcripts.creator_gate(videos).collect())) == sorted(map(tuple, whole.collect()))


def test_counting_a_very_long_text_equals_sorting_it(spark, monkeypatch):
    monkeypatch.setattr(tx, "PIECE", 50)
    text = " ".join(["aa", "b c", "　dd"] * 400) + " end"
    want = {"aa": 400, "b": 400, "c": 400, "dd": 400, "end": 1}
    assert dict(tx.word_counts(text)) == want and dict(tx.word_counts("x" * 500)) == {"x" * 500: 1}
    df = spark.createDataFrame([("One one\x1ctwo",), ("",), (None,), ("İ i",)], "text string")
    assert [tuple(r) for r in df.select(tx.exact_top_share(F.col("text")), tx.top_token_share(F.col("text"))).collect()] == [(2 / 3, 2 / 3), (None, None), (None, None), (0.5, 0.5)]


def test_a_text_of_a_hundred_megabytes_passes_the_gate(spark):
    text = F.repeat(F.concat(F.lit("seven different words stand in this sentence "), F.col("k").cast("string"), F.lit(" ")), F.lit(2_000_000))
    row = transcripts.text_gate(spark.range(1).select(F.lit("1").alias("k")).select(text.alias("text"))).select("n_stripped", "top_share", "meaningful").first()
    assert row.n_stripped > 90_000_000 and abs(row.top_share - 1 / 8) < 1e-9 and row.meaningful


@pytest.mark.parametrize(("cells", "size", "pack"), [(1, 4000, 1024), (40, 20, 7), (300, 5, 1024)])
def test_block_search_equals_plain_search(spark, monkeypatch, cells, size, pack):
    monkeypatch.setattr(search, "QUERY_BLOCK", pack)
    monkeypatch.setattr(search, "ENTRY_BLOCK", 3 * pack)
    rng = np.random.default_rng(cells)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 240)] + 0.1 * rng.normal(size=(240, 8))
    entries = spark.createDataFrame([(f"c{n:03d}", x.tolist()) for n, x in enumerate(v)] + [(f"twin{n}", v[n].tolist()) for n in range(5)], "creator string, combined array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{n}", x.tolist()) for n, x in enumerate(rng.normal(size=(30, 8)))], "query string, q array<double>").repartition(2)
    blocks = files.kept(search.block_index(entries, cells, size), "blocks")
    for k in (1, 10, 500):
        found, looked = search.search_blocks(blocks, queries, k)
        plain = {(r.query, r.rank, r.creator, round(r.score, 9)) for r in search.search(entries, queries, k).collect()}
        assert {(r.query, r.rank, r.creator, round(r.score, 9)) for r in found.collect()} == plain and len(plain) == 30 * min(k, 245)
        if k == 1 and cells == 40:
            assert looked.count() < 30 * blocks.count() / 2
    assert search.search_blocks(blocks, queries.limit(0), 3)[0].count() == 0
    empty = search.block_index(entries.limit(0))
    assert search.search_blocks(empty, queries, 3)[0].count() == 0


def test_block_search_sends_no_pairs_of_queries_and_blocks(spark, monkeypatch):
    """Queries that may look into every block: cells of the grid are the only groups, and no table of (query, block) rows is written or broadcast."""
    monkeypatch.setattr(search, "GRID_QUERIES", 16)
    monkeypatch.setattr(search, "GRID_ENTRIES", 40)
    monkeypatch.setattr(search, "CHUNK", 5)
    monkeypatch.setattr(search, "ENTRY_BLOCK", 12)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(100, 4))
    v[60:] = v[60]  # equal vectors: ties by name, more of them than k
    entries = spark.createDataFrame([(f"c{n:03d}", x.tolist()) for n, x in enumerate(v)], "creator string, combined array<double>")
    queries = spark.createDataFrame([(f"q{n}", x.tolist()) for n, x in enumerate(rng.normal(size=(50, 4)))], "query string, q array<double>")
    written, plainly = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df, name: written.append(name) or plainly(df, name))
    found, looked = search.search_blocks(plainly(search.block_index(entries, 9, 4), "blocks"), queries, 7)
    plain = {(r.query, r.rank, r.creator, r.score) for r in search.search(entries, queries, 7).collect()}
    assert {(r.query, r.rank, r.creator, r.score) for r in found.collect()} == plain and len(plain) == 350
    assert "open" not in written and looked.count() > 50


def test_a_task_holds_few_summaries_at_a_time(monkeypatch):
    """Summaries are given out whenever enough creators are held, and their sums stay the same."""
    import pyarrow as pa

    rows = [(f"c{n % 7}", "a b a " + "c " * (n % 3)) for n in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["creator", "lowered"])

    def sums(held):
        monkeypatch.setattr(transcripts, "HELD", held)
        out = list(transcripts._summaries([batch]))
        found = {}
        for b in out:
            assert len(set(b.column("creator").to_pylist())) <= held
            for r in b.to_pylist():
                x = found.setdefault((r["creator"], r["token"]), [0, 0, 0])
                x[0], x[1], x[2] = x[0] + r["total"], x[1] + r["lost"], x[2] + r["n"]
        return found, len(out)

    few, parts = sums(3)
    assert parts > 1 and few == sums(100)[0]


def test_media_are_split_in_slices_and_read_in_few_tasks(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(media, "PIECE_BYTES", 10)
    sizes = [0, 4, 25, 3, 3, 3, 3, None, 30, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], ["pcm"])
    cut = list(media.pieces(batch, "pcm"))
    assert len(cut) > 3 and pa.Table.from_batches(cut).column("pcm").to_pylist() == batch.column("pcm").to_pylist()
    assert [p.num_rows for p in media.pieces(batch.slice(0, 0), "pcm")] in ([], [0])
    for n in range(200):
        (tmp_path / f"m/c{n % 9}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"m/c{n % 9}/{n}.mp4").write_bytes(b"x")
    found = files.scan_media(spark, f"{tmp_path}/m", content=True, ordered=False)
    assert found.count() == 200 and found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    stream = files.media_stream(spark, f"{tmp_path}/m", 100)
    assert "Repartition" in stream._jdf.queryExecution().logical().toString()
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 4 * spark.sparkContext.defaultParallelism
