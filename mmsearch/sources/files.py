"""Readers and writers (S1-S15). Writers return the path they wrote; readers declare their schema."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import creator_of, strip
from . import arrivals, schemas, tree, versioned

CSV = {"header": True, "multiLine": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


_HANDED_OUT: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete what was written to the places that shared_path gave out; call it once their results have been read. Returns how many there were."""
    gone = 0
    while _HANDED_OUT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that driver and executors share; a temporary folder stands in for it in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    _HANDED_OUT.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _HANDED_OUT[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: nobody computes it again, and it outlives an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.options(**CSV).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**{k: v for k, v in CSV.items() if k != "quoteAll"}).csv(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PROFILES)


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """A blank cell is an empty text."""
    return read_csv(spark, path, schemas.TRANSCRIPTIONS).withColumn("transcription", F.coalesce("transcription", F.lit("")))


def read_creators(spark: SparkSession, path: str) -> DataFrame:
    """(creator): one name a line, stripped, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("creator")).filter("creator <> ''")


def _plain(path: str) -> str:
    """A folder without the scheme of local files and without a slash at its end."""
    return re.sub("^file:/+", "/", path).rstrip("/")


def _list_in_few_tasks(spark: SparkSession) -> int:
    """Folders and files of many small ones are listed by a few tasks of many paths each; Spark's default is a task a path, up to 10,000. Returns how many."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", tasks)
    return tasks


def scan_media(spark: SparkSession, path: str, content: bool = False, ordered: bool = True, then: tree.Step | None = None) -> DataFrame:
    """(mp4, creator[, content]) of path/<creator>/*.mp4; names that begin with _ are skipped; sorted by creator, path unless ``ordered`` is False.

    ``then``, a step on Arrow batches (mp4, creator, content) and its schema, runs where the files are read, and its rows are returned.
    Tasks list the folders when this is called and keep the list in the shared folder; its paths are sorted, never the content. In a
    store that only Spark opens, its own reader is used, with which the driver lists all files and sorting sends their content through a shuffle.
    """
    tasks = _list_in_few_tasks(spark)
    if place := tree.opened(spark, path):
        found = tree.names(spark, place, [lambda name: not tree.hidden(name) and not name.startswith("_")], lambda name: not tree.hidden(name) and name.endswith(".mp4"))
        listed = kept(tree.paths(found, place), "media_list")
        if ordered:
            listed = listed.repartitionByRange(tasks, creator_of(F.col("path")), "path").sortWithinPartitions(creator_of(F.col("path")), "path")
        rows = listed.select(F.col("path").alias("mp4"), creator_of(F.col("path")).alias("creator"))
        return tree.contents(rows, place, "mp4", then=then) if content or then else rows
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(path)
    rows = files.select(F.col("path").alias("mp4"), creator_of(F.col("path")).alias("creator"), *(["content"] if content or then else []))
    depth = len(_plain(path).split("/"))
    plain = F.regexp_replace("mp4", "^file:/+", "/")
    found = rows.filter((F.size(F.split(plain, "/")) == depth + 2) & ~F.col("creator").startswith("_"))
    found = found.orderBy("creator", "mp4") if ordered else found.coalesce(tasks)  # else a task reads a few small files only
    return found.mapInArrow(*then) if then else found


def scan_frames(spark: SparkSession, path: str, exts: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(creator, frame_path, content) of path/<creator>/**/frames/*; unreadable files are skipped. Listed as by ``scan_media``."""
    picture = rf"/frames/[^/]+\.({'|'.join(exts)})$"
    if place := tree.opened(spark, path):
        seen = lambda name: not any(map(tree.hidden, name.split("/")))
        found = tree.names(spark, place, [seen], seen, deep=True).filter(F.lower("name").rlike(picture))
        rows = tree.contents(kept(tree.paths(found, place), "frame_list"), place, unreadable=True).withColumnRenamed("path", "frame_path")
        return rows.select(F.split(F.substring("frame_path", len(place.path) + 2, 2**31 - 1), "/")[0].alias("creator"), "frame_path", "content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    rest = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(_plain(path)) + 2, 2**31 - 1)
    return files.filter(F.lower("path").rlike(picture)).select(F.element_at(F.split(rest, "/"), 1).alias("creator"), F.col("path").alias("frame_path"), "content")


def write_media(df: DataFrame, root: str) -> str:
    """Files (path below root, content) written by the tasks that hold them, to any store that Arrow opens; a task that runs again writes the same files."""

    full = tree.qualified(df.sparkSession, root).uri

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(full)
        made = None  # the last folder made
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), (x.as_py() for x in batch.column("content")), strict=True):
                place = f"{base}/{path}"
                if (folder := place.rsplit("/", 1)[0]) != made:
                    fs.create_dir(folder, recursive=True)
                    made = folder
                with fs.open_output_stream(place) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    df.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root


BINARY = "path string, modificationTime timestamp, length long, content binary"


def media_stream(spark: SparkSession, root: str, per_trigger: int = 100, glob: str = "*/*.mp4", archive: str | None = None, then: tree.Step | None = None) -> DataFrame:
    """S14 over S3: (mp4, creator, content) of media files as they arrive, ``per_trigger`` a micro-batch; unreadable, vanished and empty files are skipped.

    With ``archive``, a folder of the same store outside root, files are moved there once their batch is done. ``then`` is as in ``scan_media``.

    What is there is found by tasks when this is called, later whenever a query has nothing left to read, and noted in a table beside
    the media that the stream reads (``arrivals``). Stores that only Spark opens, patterns beyond * and ? and a root that isn't there
    yet are left to Spark's own file stream, with which the driver holds the list of all files.
    """
    tasks = _list_in_few_tasks(spark)
    place = tree.opened(spark, root)
    if place and arrivals.simple(glob):
        noted = arrivals.stream(spark, place, glob, per_trigger, archive)
        rows = noted.select(F.col("path").alias("mp4"), creator_of(F.col("path")).alias("creator")).filter(~F.col("creator").startswith("_"))
        return tree.contents(rows, place, "mp4", unreadable=True, vanished=True, then=then)
    options = {"maxFilesPerTrigger": per_trigger, "ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    if archive is not None:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    rows = spark.readStream.format("binaryFile").schema(BINARY).options(**options).load(f"{root}/{glob}")
    rows = rows.select(F.col("path").alias("mp4"), creator_of(F.col("path")).alias("creator"), "content").filter(~F.col("creator").startswith("_")).coalesce(tasks)
    return rows.mapInArrow(*then) if then else rows


def write_index(entries: DataFrame, path: str) -> str:
    """Names, both vectors and the fused one as the next version of one table, so rows can't fall apart; ``entries`` may read the present one."""
    versioned.overwrite(entries, path)
    return path


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The index pinned to its newest version or a given one: a rebuild doesn't disturb who reads it."""
    return versioned.read(spark, path, version)


def write_json(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def last_wins(df: DataFrame, key: list[Column | str], order: Column | str) -> DataFrame:
    """Of rows with one key, the last in input order; key parts may be expressions."""
    w = Window.partitionBy(*key).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def write_search_docs(docs: DataFrame, path: str, key: str = "username", order: str = "pos") -> tuple[str, int]:
    """The store anew, one document a key (the last one); returns the path and the number of documents."""
    seen = Observation("indexed")
    last_wins(docs, [key], order).observe(seen, F.count("*").alias("n")).write.parquet(path)
    return path, seen.get["n"]


def upsert_search_docs(docs: DataFrame, root: str, order: str = "pos", buckets: int = 64, batch: int | None = None) -> dict[str, int]:
    """Merge documents (username, transcription, img, txt, follower_count, video_count, ``order``) by username into a versioned store.

    Documents whose image or text vector has no length are skipped, as are those without a name. The others get the fused vector and
    indexed_at; a document known by its username is replaced. Returns the inserted, replaced and skipped documents.
    """
    from ..functions.vectors import fuse, norm

    ok = F.coalesce((norm(F.col("img")) > 0) & (norm(F.col("txt")) > 0), F.lit(False))
    good = docs.filter(ok).select(
        "username", "transcription", F.col("img").alias("image_embedding"), F.col("txt").alias("text_embedding"), fuse(F.col("img"), F.col("txt")).alias("combined_embedding"),
        "follower_count", "video_count", F.current_timestamp().alias("indexed_at"), order,
    )
    counts = versioned.upsert(good, root, "username", order, buckets, batch).counts
    return {"inserted": counts.get("inserted", 0), "replaced": counts.get("replaced", 0), "skipped": docs.filter(~ok).count() + counts.get("rejected", 0)}


def init_bucketed_interactions(spark: SparkSession, table: str, buckets: int = 64) -> str:
    """An empty table of interactions in the catalogue, dealt to buckets by user and sorted by time within each."""
    empty = spark.createDataFrame([], f"{schemas.INTERACTIONS}, event_id long")
    empty.write.bucketBy(buckets, "username").sortBy("timestamp", "event_id").mode("overwrite").saveAsTable(table)
    return table


def append_bucketed(df: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """S10 on a bucketed table: accepted rows are appended in its layout, so reads by user need no shuffle; returns the rejected ones."""
    good, bad = validate_feedback(df)
    rows = good.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())).select(*df.sparkSession.table(table).columns)
    rows.repartition(buckets, "username").write.bucketBy(buckets, "username").sortBy("timestamp", "event_id").mode("append").saveAsTable(table)
    return bad


def init_interactions(spark: SparkSession, path: str) -> str:
    """An empty interactions table."""
    spark.createDataFrame([], schemas.INTERACTIONS).write.mode("overwrite").parquet(path)
    return path


def feedback_ok() -> Column:
    """A creator and one of two labels are needed."""
    return F.coalesce(F.length("liked_creator") > 0, F.lit(False)) & F.col("label").isin("good", "bad")


def validate_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Label null: good; lower-cased."""
    df = df.withColumn("label", F.lower(F.coalesce("label", F.lit("good"))))
    return df.filter(feedback_ok()), df.filter(~feedback_ok())


def append_feedback(df: DataFrame, path: str) -> DataFrame:
    """Append the accepted rows, stamping missing times; returns the rejected ones."""
    good, bad = validate_feedback(df)
    good.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())).write.mode("append").parquet(path)
    return bad
