"""Files as they arrive: tasks find them in a tree and note them in a table beside it; streams read that table, so the driver holds no list of files."""

from __future__ import annotations

import logging
import queue
import re
import threading
import uuid
import zlib
from fnmatch import translate
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from . import tree

#: Paths in a file of the table at most: a micro-batch is whole files.
NOTED = 1000
#: Seconds without work after which an ended stream no longer waits for its last files to be moved.
QUIET_S = 60


class _Source(NamedTuple):
    place: tree.Tree
    glob: str
    notes: str
    most: int
    archive: tree.Tree | None


def simple(glob: str) -> bool:
    """Whether a pattern, a part a level, has * and ? only."""
    return not re.search(r"[][{}\\]", glob) and all(glob.split("/"))


def _found(spark: SparkSession, of: _Source) -> DataFrame:
    """Files in folders whose names begin with _ are no media: they aren't noted, so they are not moved either."""
    *folders, file = (re.compile(translate(part)).match for part in of.glob.split("/"))
    levels = [lambda name, match=match, last=match is folders[-1]: bool(match(name)) and not (last and name.startswith("_")) for match in folders]
    return tree.paths(tree.names(spark, of.place, levels, lambda name: not tree.hidden(name) and bool(file(name))), of.place)


def _noted(spark: SparkSession, notes: str) -> DataFrame:
    return spark.read.schema("path string").parquet(notes)


class _Watch(StreamingQueryListener):
    """After each batch of a stream its files are moved; when a query has nothing left to read, its tree is searched again.

    Spark drops events of a listener that takes long, so one thread of its own does the work, in the order of the events.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.read_by, self.asked, self.ended = spark, {}, {}, set(), set()
        self.noting, self.change, self.todo, self.busy = threading.Lock(), threading.Condition(), queue.SimpleQueue(), False
        threading.Thread(target=self._work, name="arrivals", daemon=True).start()

    def _work(self) -> None:
        while True:
            step, *args = self.todo.get()
            self.busy = True
            try:
                step(*args)
            except Exception:  # files stay where they are; a search comes again
                logging.getLogger(__name__).exception("after a batch of a stream")
            self.busy = False

    def note(self, of: _Source) -> None:
        """What is in the tree and not in the table is added to it."""
        with self.noting:
            new = _found(self.spark, of).join(_noted(self.spark, of.notes), "path", "left_anti").persist()
            try:
                if n := new.count():
                    tasks = max(1, min(4 * self.spark.sparkContext.defaultParallelism, n // (4 * of.most)))
                    new.repartition(tasks).write.mode("append").option("maxRecordsPerFile", of.most).parquet(of.notes)
            finally:
                new.unpersist()

    def _move(self, of: _Source, notes: list[str]) -> None:
        tree.move(self.spark.read.schema("path string").parquet(*(f"{of.notes}/{name}" for name in notes)), of.place, of.archive)

    def _search(self, query: str, key: str) -> None:
        self.asked.discard(key)
        if query in [q.id for q in self.spark.streams.active]:
            self.note(self.sources[key])

    def _end(self, run: str) -> None:
        with self.change:
            self.ended.add(run)
            self.change.notify_all()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for key, seen in event.progress.observedMetrics.items():
            if of := self.sources.get(key):
                self.read_by[str(event.progress.id)] = key
                if of.archive and seen.notes:
                    self.todo.put((self._move, of, list(seen.notes)))

    def onQueryIdle(self, event) -> None:
        key = self.read_by.get(str(event.id))
        for k in [key] if key else set(self.sources) - set(self.read_by.values()):  # a query that has read nothing yet may be any of these streams
            if k not in self.asked:
                self.asked.add(k)
                self.todo.put((self._search, str(event.id), k))

    def onQueryTerminated(self, event) -> None:
        self.todo.put((self._end, str(event.runId)))


_WATCHES: dict[SparkSession, _Watch] = {}


def stream(spark: SparkSession, place: tree.Tree, glob: str, per_trigger: int, archive: str | None = None) -> DataFrame:
    """(path) of files below a tree that match, ``per_trigger`` a micro-batch; a path comes once, whichever stream over the tree asks.

    The table is in the tree, in a folder whose name begins with _arrived; one process at a time may note files in it. Its files, of at most
    NOTED and ``per_trigger`` paths, are not split later, if a stream with a smaller ``per_trigger`` reads on.
    """
    target = archive and tree.qualified(spark, archive)
    if target and urlsplit(target.uri)[:2] != urlsplit(place.uri)[:2]:
        raise ValueError("the archive must be in the store of the media")
    notes = f"{place.path}/_arrived" + ("" if glob == "*/*.mp4" else f"-{zlib.crc32(glob.encode()):08x}")
    of, key = _Source(place, glob, notes, min(per_trigger, NOTED), target), f"media-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(place.uri)
    fs.create_dir(f"{base.rstrip('/')}/{notes.rsplit('/', 1)[1]}", recursive=True)
    if (watch := _WATCHES.get(spark)) is None:
        watch = _WATCHES[spark] = _Watch(spark)
        spark.streams.addListener(watch)
    watch.note(of)
    watch.sources[key] = of
    rows = spark.readStream.schema("path string").option("maxFilesPerTrigger", max(1, per_trigger // of.most)).parquet(notes)
    seen = rows.select("path", F.col("_metadata.file_name").alias("note")).observe(key, F.collect_set("note").alias("notes"))
    return seen.select("path").repartition(min(spark.sparkContext.defaultParallelism, per_trigger))


def settled(spark: SparkSession, query) -> None:
    """Wait until all that follows the batches of a query that ended is done."""
    if (watch := _WATCHES.get(spark)) and watch.sources:
        with watch.change:
            while not watch.change.wait_for(lambda: str(query.runId) in watch.ended, QUIET_S) and (watch.busy or not watch.todo.empty()):
                pass
