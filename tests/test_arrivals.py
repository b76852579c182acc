import glob
import os
import time

import numpy as np
import pytest

from mmsearch.operators import media
from mmsearch.sources import arrivals, files, tree
from mmsearch.streaming import ingest

MEDIA = "mp4 string, creator string, content binary"


def put(root, *names):
    for name in names:
        os.makedirs(f"{root}/{os.path.dirname(name)}", exist_ok=True)
        with open(f"{root}/{name}", "wb") as out:
            out.write(name.encode())


def left(root):
    return sorted(p[len(root) + 1 :] for p in glob.glob(f"{root}/*/*.mp4"))


def read(spark, out, schema=MEDIA):
    rows = spark.read.schema(schema).parquet(out).collect()
    assert all(bytes(r.content).decode() == "/".join(r.mp4.rsplit("/", 2)[1:]) for r in rows)
    return sorted(bytes(r.content).decode() for r in rows)


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("media", "out", "state", "done")]


def test_a_drained_stream_has_moved_all_its_files_and_knows_them(spark, places):
    """every file was a line of the stream's log on the driver, and the last batch was not moved."""
    root, out, state, done = places
    names = [f"c{n % 7}/{n}.mp4" for n in range(60)]
    put(root, *names, "_tmp/1.mp4", "c1/.2.mp4", "c1/3.txt")
    ingest.run_available(files.media_stream(spark, root, 20, archive=done), out, state)
    assert read(spark, out) == sorted(names) and left(root) == ["_tmp/1.mp4"]
    assert sorted(p[len(done + root) + 1 :] for p in glob.glob(f"{done}{root}/*/*.mp4")) == sorted(names)
    assert sum(x.startswith("{") for f in glob.glob(f"{state}/sources/0/*") for x in open(f).read().splitlines()) < 20
    put(root, "c1/late.mp4", names[0])  # a path that was read already doesn't count again
    ingest.run_available(files.media_stream(spark, root, 20, archive=done), out, state)
    ingest.run_available(files.media_stream(spark, root, 20, archive=done), out, state)
    assert read(spark, out) == sorted([*names, "c1/late.mp4"]) and left(root) == ["_tmp/1.mp4", names[0]]


@pytest.mark.parametrize(("per", "noted"), [(1, 1000), (7, 3), (7, 1000)])
def test_a_micro_batch_has_per_trigger_files_at_most(spark, places, monkeypatch, per, noted):
    monkeypatch.setattr(arrivals, "NOTED", noted)
    root, _, state, _ = places
    put(root, *(f"c{n % 2}/{n}.mp4" for n in range(15)))
    sizes = []
    files.media_stream(spark, root, per).writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 15 and max(sizes) <= per and len(left(root)) == 15


def test_a_batch_that_fails_leaves_its_files_and_comes_again(spark, places):
    root, out, state, done = places
    names = [f"a/{n}.mp4" for n in range(9)]
    put(root, *names)
    tries = []

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        tries.append(batch)
        if len(tries) == 2:
            raise RuntimeError("down")

    run = lambda: files.media_stream(spark, root, 3, archive=done).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query = run()
    with pytest.raises(Exception, match="down"):
        query.awaitTermination()
    arrivals.settled(spark, query)
    assert len(left(root)) == 6
    query = run()
    query.awaitTermination()
    arrivals.settled(spark, query)
    assert read(spark, out) == names and left(root) == []


def test_a_stream_that_goes_on_finds_what_arrives(spark, places):
    root, out, state, done = places
    os.makedirs(root)
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", 300)
    query = files.media_stream(spark, root, 10, archive=done).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
    try:
        for n, name in enumerate(["a/1.mp4", "a/2.mp4", "b/3.mp4"]):
            put(root, name)
            until = time.time() + 90
            while time.time() < until and (left(root) or not glob.glob(f"{done}{root}/*/{n + 1}.mp4")):
                time.sleep(0.5)
    finally:
        query.stop()
        arrivals.settled(spark, query)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    assert read(spark, out) == ["a/1.mp4", "a/2.mp4", "b/3.mp4"] and left(root) == []


def test_patterns_and_roots_that_spark_takes(spark, places):
    root, out, state, done = places
    early = files.media_stream(spark, root, 5)  # nothing is there yet
    put(root, "a/1.mp4", "b/2.mp4", "b/x/3.mp4", "b/4.mpeg", "c/5.mp4")
    ingest.run_available(early, out, state)
    assert read(spark, out) == ["a/1.mp4", "b/2.mp4", "c/5.mp4"]
    for k, (glob_, want) in enumerate({"{a,b}/*.mp4": ["a/1.mp4", "b/2.mp4"], "b/*.mp*": ["b/2.mp4", "b/4.mpeg"], "?/*.mp4": ["a/1.mp4", "b/2.mp4", "c/5.mp4"]}.items()):
        assert arrivals.simple(glob_) == ("{" not in glob_)
        ingest.run_available(files.media_stream(spark, root, 5, glob=glob_), f"{out}{k}", f"{state}{k}")
        assert read(spark, f"{out}{k}") == want
    assert files.scan_media(spark, root).count() == 3 and not arrivals.simple("a//b")


def test_frames_decoded_where_media_are_read(spark, places, monkeypatch):
    root, out, state, _ = places
    one = lambda k: b"\xff\xd8" + bytes([k]) * (k % 90) + b"\xff\xd9"
    rows = [(f"c{n % 3}/{n}.mp4", b"junk".join(one(k) for k in range(n % 13)) + b"\xff\xd8 open") for n in range(40)]
    files.write_media(spark.createDataFrame(rows, "path string, content binary"), root)
    step = media.frames_step(lambda jpeg: None if len(jpeg) == 5 else media.decode_bytes(4)(jpeg), 11)
    monkeypatch.setattr(tree, "PIECE_BYTES", 500)
    stored = files.scan_media(spark, root, content=True).withColumnRenamed("content", "stream")
    plain = media.decode_frames(media.split_frames(stored, 11), media.decode_bytes(4)).filter("length(jpeg) <> 5").drop("jpeg")
    want = sorted((r.mp4, r.frame_idx, r.pixels) for r in plain.collect())
    assert len(want) > 150 and {len(p) for _, _, p in want} == {16} and np.sum(want[-1][2]) > 0
    ingest.run_available(files.media_stream(spark, root, 9, then=step), out, state)
    read_frames = lambda df: sorted((r.mp4, r.frame_idx, r.pixels) for r in df.collect())
    assert read_frames(files.scan_media(spark, root, then=step)) == want and read_frames(spark.read.schema(step[1]).parquet(out)) == want
    monkeypatch.setattr(tree, "opened", lambda *_: None)
    assert read_frames(files.scan_media(spark, root, ordered=False, then=step)) == want
    ingest.run_available(files.media_stream(spark, root, 9, then=step), out + "2", state + "2")
    assert read_frames(spark.read.schema(step[1]).parquet(out + "2")) == want
