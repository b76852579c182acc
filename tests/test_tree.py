import os

import pytest
from pyspark.sql import functions as F

from mmsearch.sources import files, tree

NAMES = [
    "a/1.mp4", "a/two words.mp4", "a/100%25é#.mp4", "a/.hid.mp4", "a/_x.mp4", "a/_k=v.mp4", "a/UP.MP4", "a/empty.mp4", "a/deep/2.mp4", "top.mp4", ".dot/3.mp4", "_tmp/4.mp4", "_k=v/5.mp4",
    "b c/x/frames/f.jpeg", "b c/frames/x/f.PNG", "b c/frames/f.Png", "b c/.x/frames/g.png", "b c/frames/.g.png", "a/frames/empty.png", "é/frames/f.jpg", "frames/f.jpg", "a/frames/x.jpg/7.mp4",
]


@pytest.fixture
def odd(tmp_path):
    root = tmp_path / "odd names"
    for name in NAMES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else name.encode())
    return str(root)


def test_tasks_find_what_sparks_own_reader_finds(spark, odd, monkeypatch):
    def found():
        media = [files.scan_media(spark, odd, content, ordered) for content in (False, True) for ordered in (False, True)]
        return [[tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in df.collect()] for df in [*media, files.scan_frames(spark, odd)]]

    by_tasks = found()
    monkeypatch.setattr(tree, "opened", lambda *_: None)
    by_spark = found()
    assert len(by_tasks[0]) == 4 and len(by_tasks[4]) > 3
    assert by_tasks[1] == by_spark[1] and by_tasks[3] == by_spark[3]  # in order
    assert [sorted(rows) for rows in by_tasks] == [sorted(rows) for rows in by_spark]


def test_the_driver_holds_no_list_of_media(spark, tmp_path):
    """the driver had every file's status; what a scan's plan names now doesn't grow with the files, also where one folder has them all."""
    for n in range(300):
        place = tmp_path / f"m/c{n % 3 if n < 30 else 0}/frames"
        place.mkdir(parents=True, exist_ok=True)
        (place.parent / f"{n}.mp4").write_bytes(b"x")
        (place / f"{n}.jpg").write_bytes(b"x")
    tasks = 4 * spark.sparkContext.defaultParallelism
    for df in (files.scan_media(spark, f"{tmp_path}/m", content=True, ordered=False), files.scan_media(spark, f"{tmp_path}/m"), files.scan_frames(spark, f"{tmp_path}/m")):
        assert df.count() == 300 and len(df.inputFiles()) <= tasks
        assert "binaryFile" not in df._jdf.queryExecution().toString()
    names = tree.names(spark, tree.opened(spark, f"{tmp_path}/m"), [lambda _: True], lambda name: name.endswith(".mp4"))
    most = names.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 4 * 300 / tasks


def test_contents_come_in_slices_and_flags_skip(spark, odd, monkeypatch):
    place = tree.opened(spark, odd)
    there = spark.createDataFrame([(f"{place.path}/{name}", n) for n, name in enumerate(["a/1.mp4", "a/gone.mp4", "a/deep", "a/empty.mp4", "a/100%25é#.mp4"])], "path string, n int").coalesce(1)
    got = tree.contents(there, place, unreadable=True, vanished=True).collect()
    assert [(r.n, bytes(r.content)) for r in got] == [(0, b"a/1.mp4"), (3, b""), (4, "a/100%25é#.mp4".encode())]
    for rows, flags in ((there.filter("n = 1"), {"unreadable": True}), (there.filter("n = 2"), {"vanished": True})):
        with pytest.raises(Exception, match="gone.mp4|deep"):
            tree.contents(rows, place, **flags).collect()


def test_what_arrow_does_not_open_is_left_to_spark(spark, odd):
    assert tree.opened(spark, odd) and tree.opened(spark, f"file:{odd}/").path == f"file:{odd}"
    assert tree.opened(spark, f"{odd}/*") is None and tree.opened(spark, f"{odd}/top.mp4") is None and tree.opened(spark, f"{odd}/none") is None
    assert {r.mp4.rsplit("/", 1)[1] for r in files.scan_media(spark, os.path.dirname(odd) + "/odd*").collect()} == {"_k=v.mp4", "100%25é#.mp4", "1.mp4", "two words.mp4"}
    with pytest.raises(Exception, match="(?i)path"):
        files.scan_media(spark, f"{odd}/none").collect()
