import pytest
from pyspark.sql import functions as F

from mmsearch.operators import index
from mmsearch.sources import files, versioned


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int, pos int")


def test_readers_keep_their_version_while_it_is_replaced(spark):
    root = files.shared_path(spark, "t")
    versioned.overwrite(spark.range(3), root)
    pinned = versioned.read(spark, root)
    versioned.overwrite(versioned.read(spark, root).selectExpr("id + 10 as id"), root)
    assert rows(pinned) == [(0,), (1,), (2,)] and rows(versioned.read(spark, root)) == [(10,), (11,), (12,)]
    assert rows(versioned.read(spark, root, 1)) == [(0,), (1,), (2,)] and versioned.versions(spark, root) == [1, 2]
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, files.shared_path(spark, "none"))


def test_a_write_that_dies_changes_nothing(spark, monkeypatch):
    root = files.shared_path(spark, "t")
    versioned.overwrite(spark.range(3), root)
    with pytest.raises(Exception, match="half-way"):
        versioned.overwrite(spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id"))), root)
    assert rows(versioned.read(spark, root)) == [(0,), (1,), (2,)]

    def die(*_):
        raise OSError("killed before the commit")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(versioned, "_create", die)
        versioned.overwrite(spark.range(9), root)
    assert rows(versioned.read(spark, root)) == [(0,), (1,), (2,)]
    versioned.overwrite(spark.range(1), root)
    assert rows(versioned.read(spark, root)) == [(0,)]


def test_the_second_of_two_writers_fails(spark):
    root = files.shared_path(spark, "t")
    first = versioned.overwrite(spark.range(3), root)
    with pytest.raises(versioned.Conflict):
        versioned._commit(spark, root, first)
    assert versioned.versions(spark, root) == [1]


def test_upserts_insert_replace_and_touch_only_their_buckets(spark):
    root = files.shared_path(spark, "t")
    versioned.upsert(table(spark, *((f"k{n}", n, 0) for n in range(40))), root, "k", "pos", buckets=16)
    before = versioned.current(spark, root)
    after = versioned.upsert(table(spark, ("k3", 300, 1), ("new", 1, 1), ("k3", 301, 2), (None, 5, 1)), root, "k", "pos")
    want = {f"k{n}": n for n in range(40)} | {"k3": 301, "new": 1}
    assert {r.k: r.v for r in versioned.read(spark, root).collect()} == want and versioned.read(spark, root).count() == 41
    assert after.counts == {"inserted": 1, "replaced": 1, "rejected": 1}
    changed = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(changed) <= 2 and after.buckets == 16


def test_a_repeated_batch_changes_nothing(spark):
    root = files.shared_path(spark, "t")
    for batch, pairs in enumerate([[("a", 1, 0), ("b", 1, 0)], [("b", 2, 1), ("c", 2, 1)], [("c", 3, 2)]]):
        versioned.upsert(table(spark, *pairs), root, "k", "pos", 4, batch)
    number = versioned.current(spark, root).number
    versioned.upsert(table(spark, ("b", 9, 1), ("c", 9, 1)), root, "k", "pos", 4, 1)
    versioned.upsert(table(spark), root, "k", "pos", 4, 7)
    assert versioned.current(spark, root).number == number
    assert rows(versioned.read(spark, root).select("k", "v")) == [("a", 1), ("b", 2), ("c", 3)]


def test_ordinary_rows_of_an_empty_first_batch(spark):
    root = files.shared_path(spark, "t")
    versioned.upsert(table(spark), root, "k", "pos", 4)
    assert versioned.read(spark, root).count() == 0
    versioned.upsert(table(spark, ("a", 1, 0)), root, "k", "pos", 4)
    assert rows(versioned.read(spark, root)) == [("a", 1, 0)]
    with pytest.raises(ValueError):
        versioned.upsert(table(spark, ("a", 1, 0)), root, "v", "pos")
    with pytest.raises(ValueError):
        versioned.overwrite(spark.range(2).withColumnRenamed("id", "bucket"), root)


def test_vacuum_keeps_what_kept_versions_name(spark):
    root = files.shared_path(spark, "t")
    for v in range(4):
        versioned.upsert(table(spark, *((f"k{n}", v, v) for n in range(v, 12))), root, "k", "pos", 4)
    want = rows(versioned.read(spark, root))
    older = versioned.versions(spark, root)[-2]
    before = rows(versioned.read(spark, root, older))
    assert versioned.vacuum(spark, root, 2)
    assert rows(versioned.read(spark, root)) == want and rows(versioned.read(spark, root, older)) == before
    assert versioned.versions(spark, root) == [older, older + 1] and versioned.vacuum(spark, root, 2) == []


def test_an_index_is_rebuilt_in_place(spark):
    root = files.shared_path(spark, "index")
    entries = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0], [9.0, 9.0]), ("zero", [0.0, 0.0], [1.0, 0.0], [1.0, 1.0])], "creator string, img array<double>, txt array<double>, combined array<double>")
    files.write_index(entries, root)
    index.rebuild_index(spark, root, 0.6, 0.8)
    got = files.read_index(spark, root).collect()
    assert [(r.creator, [round(x, 9) for x in r.combined]) for r in got] == [("a", [0.6, 0.8])]
    assert files.read_index(spark, root, 1).count() == 2


def test_documents_are_merged_stamped_and_skipped(spark):
    root = files.shared_path(spark, "docs")
    schema = "username string, transcription string, img array<double>, txt array<double>, follower_count long, video_count long, pos int"
    one = spark.createDataFrame([("a", "x", [1.0, 0.0], [0.0, 1.0], 1, 2, 0), ("b", "y", [1.0, 0.0], [0.0, 1.0], 1, 2, 0), ("z", "", [0.0, 0.0], [1.0, 0.0], 0, 0, 0), (None, "", [1.0, 0.0], [1.0, 0.0], 0, 0, 0)], schema)
    assert files.upsert_search_docs(one, root, buckets=4) == {"inserted": 2, "replaced": 0, "skipped": 2}
    stamp = {r.username: r.indexed_at for r in versioned.read(spark, root).collect()}
    two = spark.createDataFrame([("b", "new", [0.0, 1.0], [0.0, 1.0], 5, 6, 1), ("c", "", [1.0, 1.0], [0.0, 1.0], 0, 0, 1)], schema)
    assert files.upsert_search_docs(two, root, buckets=4) == {"inserted": 1, "replaced": 1, "skipped": 0}
    got = {r.username: r for r in versioned.read(spark, root).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].transcription == "new" and got["b"].image_embedding == [0.0, 1.0] and got["a"].transcription == "x"
    assert got["a"].indexed_at == stamp["a"] and got["b"].indexed_at > stamp["b"] and abs(sum(x * x for x in got["c"].combined_embedding) - 1) < 1e-9


def test_bucketed_interactions_need_no_exchange(spark):
    from mmsearch.operators import feedback

    table_ = files.init_bucketed_interactions(spark, "interactions_test", 4)
    schema = "username string, liked_creator string, query_context string, label string, timestamp timestamp, event_id long"
    rows_ = spark.createDataFrame([(f"u{n % 3}", f"c{n}", "q", "good", None, n) for n in range(30)], schema).withColumn("timestamp", F.timestamp_seconds(F.col("event_id")))
    for half in ("event_id < 15", "event_id >= 15"):
        bad = files.append_bucketed(rows_.filter(half).unionByName(rows_.limit(1).withColumn("label", F.lit("maybe"))), table_, 4)
        assert bad.count() == 1
    firsts = feedback.user_rows(spark.table(table_), 500)
    assert "Exchange" not in firsts._jdf.queryExecution().executedPlan().toString()
    assert rows(firsts.select("username", "n", "liked_creator")) == rows(feedback.user_rows(rows_, 500).select("username", "n", "liked_creator"))


def test_released_places_are_empty(spark, monkeypatch):
    monkeypatch.setattr(files, "_HANDED_OUT", [])
    path = files.shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    files.shared_path(spark, "never written")
    assert files.release(spark) == 1 and files._HANDED_OUT == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_a_bucket_is_written_by_as_many_tasks_as_its_bytes_ask_for(spark, monkeypatch):
    """a task for each bucket read an eighth of the table, whatever its size."""
    monkeypatch.setattr(versioned, "TASK_BYTES", 4000, raising=False)
    root = files.shared_path(spark, "t")
    new = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.lit(0).alias("pos"))
    for shift in (0, 2000):
        versioned.upsert(new.withColumn("k", (F.col("k").cast("long") + shift).cast("string")), root, "k", "pos", 2)
    read = versioned.read(spark, root)
    assert read.count() == read.select("k").distinct().count() == 5000
    per = read.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert len(per) > 20 and max(r.n for r in per) < 500


def test_an_upsert_computes_its_rows_once(spark):
    """rejected rows were counted by computing the batch, and with it the stream's state, again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows_ = table(spark, ("a", 1, 1), ("a", 2, None), ("b", 3, None), (None, 4, 1), (None, 5, 2)).mapInPandas(count, "k string, v int, pos int")
    root = files.shared_path(spark, "t")
    counts = versioned.upsert(rows_, root, "k", "pos", 2).counts
    assert seen.value == 5 and counts == {"inserted": 2, "replaced": 0, "rejected": 2}
    assert rows(versioned.read(spark, root)) == [("a", 1, 1), ("b", 3, None)]
