"""Structured Streaming ingest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import arrivals, versioned
from ..sources.files import feedback_ok, validate_feedback


def stream_source(spark: SparkSession, path: str, schema: str, per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """Files as they arrive, ``per_trigger`` a micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def expected_counts(videos: DataFrame) -> DataFrame:
    """R2: distinct videos a creator."""
    return videos.groupBy("creator").agg(F.count_distinct("mp4").cast("int").alias("expected"))


#: Sessions keep the state of a stream in RocksDB, whose changes (not the whole state) are written a batch.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = "creator string, transcription string, complete boolean"


#: What the operator gets of a row, in this order; behind them only the event time that the watermark goes by.
ARRIVED = ["creator", "mp4", "text", "at", "expected"]
#: Texts of a group that wait in its one state value, whole and by characters; beyond, the map by path holds them.
NEAR, NEAR_CHARS = 64, 1 << 18


class _Group(StatefulProcessor):
    """Texts of one creator by path, how many there are, and whether the group is out.

    A call of the state store costs more than a row, so a small group is one value, read and written once a batch. The texts of a
    larger one are a map: a batch looks up and writes only the paths that arrive; all of them are read once, when the group comes out.
    """

    def __init__(self, timeout_ms: int | None, event_time: bool):
        self.timeout_ms, self.event_time = timeout_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "mp4 string", "text string")
        self.state = handle.getValueState("state", "n int, done boolean, last long, timer long, far boolean, paths array<string>, near array<string>")

    def _get(self) -> tuple:
        n, done, last, timer, far, paths, near = self.state.get() or (0, False, None, None, False, [], [])
        return n, done, last, timer, far, dict(zip(paths, near, strict=True))

    def _put(self, n, done, last, timer, far, near) -> None:
        self.state.update((n, done, last, timer, far, list(near), list(near.values())))

    def _out(self, key, far: bool, near: dict, complete: bool) -> Row:
        found = list(near.items())
        if far:
            found += ((k[0], v[0]) for k, v in self.texts.iterator())
            self.texts.clear()
        return Row(creator=key[0], transcription=" ".join(t for _, t in sorted(found)), complete=complete)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, done, last, timer, far, near = self._get()
        if done:
            return
        arrived = (tuple(r)[:5] for r in rows)  # as ARRIVED names them: a look-up by name costs more than a row
        if self.event_time:
            arrived = sorted(arrived, key=lambda r: (r[3], r[1]))
        complete, seen = False, set(near)
        for _, mp4, text, at, expected in arrived:
            if self.event_time:
                if last is not None and at - last > self.timeout_ms:
                    done = True
                    break
                last = at
            if mp4 not in seen:
                seen.add(mp4)
                if not (far and self.texts.containsKey((mp4,))):
                    near[mp4] = text or ""
                    n += 1
            if n >= expected:
                done = complete = True
                break
        if done:
            yield self._out(key, far, near, complete)
            near = {}
        elif far or len(near) > NEAR or sum(map(len, near.values())) > NEAR_CHARS:
            for mp4, text in near.items():
                self.texts.updateValue((mp4,), (text,))
            far, near = True, {}
        if timer is not None and (done or self.timeout_ms is not None):
            self.handle.deleteTimer(timer)
            timer = None
        if not done and self.timeout_ms is not None:
            timer = (last if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.timeout_ms
            self.handle.registerTimer(timer)
        self._put(n, done, last, timer, far, near)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, done, last, _, far, near = self._get()
        if not done:
            yield self._out(key, far, near, False)
            self._put(n, True, last, None, far, {})


def complete_groups(texts: DataFrame, expected: DataFrame, timeout_ms: int | None = None, event_time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(creator, transcription, complete) once per creator, when as many distinct videos as expected have arrived.

    texts: a stream (mp4, creator, text); a silent or failed video counts with "". Repeated videos count once,
    the first text stays (R7). With ``timeout_ms``, a group that gets nothing for so long comes out with
    complete = false (R6): by the clock, or with ``event_time`` (a timestamp column of texts) by the stream's own
    time, at the first gap longer than that or once the watermark, ``delay`` behind the latest row, is past the
    timeout. What arrives for a group that is out is dropped.

    State is in RocksDB: a value a small group, a map by path a large one, of which a batch touches the arriving videos only. A finished
    group keeps a mark. A checkpoint made while every group was a map is refused: begin a new one.
    """
    if event_time is not None and timeout_ms is None:
        raise ValueError("event_time is for timeouts: give timeout_ms")
    texts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if event_time is None:
        mode = "None" if timeout_ms is None else "ProcessingTime"
        rows = texts.select("mp4", "creator", "text", F.lit(None).cast("long").alias("at"))
    else:
        mode = "EventTime"
        at = F.unix_millis(F.col(event_time)).alias("at")
        rows = texts.withWatermark(event_time, delay).select("mp4", "creator", "text", at, event_time)
    joined = rows.join(expected, "creator").select(*ARRIVED, *([] if event_time is None else [event_time]))
    return joined.groupBy("creator").transformWithState(_Group(timeout_ms, event_time is not None), GROUPS, "Append", mode)


def drop_repeats(rows: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Of rows with one key within ``delay`` of event time the first to arrive; rows later than the watermark are dropped.

    State holds the keys of the last ``delay`` only, so it doesn't grow with the stream.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is there into parquet under path and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    arrivals.settled(df.sparkSession, query)


def index_upsert(groups: DataFrame, build, path: str, checkpoint: str) -> None:
    """Each micro-batch of finished creators goes through ``build`` into path/batch=<id>; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    groups.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index_merge(groups: DataFrame, build, root: str, checkpoint: str, key: str = "creator", buckets: int = 64) -> None:
    """Each micro-batch goes through ``build`` and is merged by key into a versioned table: one row a key, the last batch wins.

    A batch that comes again after a failure changes nothing, as the table knows the last one it merged.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        versioned.upsert(build(batch).withColumn("batch", F.lit(batch_id)), root, key, "batch", buckets, batch_id)

    groups.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def feedback_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Accepted interactions of a stream are appended to the table that the next search reads."""
    run_available(validate_feedback(rows)[0], path, checkpoint)


def feedback_outputs(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Every micro-batch in one write into path/batch=<id>/accepted=<true|false>; missing times are stamped.

    A batch that comes again replaces itself, so both outputs hold each row once. Read them with ``read_outputs``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())).withColumn("label", F.lower(F.coalesce("label", F.lit("good"))))
        stamped.withColumn("accepted", feedback_ok()).write.mode("overwrite").partitionBy("accepted").parquet(f"{path}/batch={batch_id}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_outputs(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of feedback_outputs, each with the number of its batch."""
    rows = spark.read.schema(f"{schema}, batch long, accepted boolean").parquet(path)
    return rows.filter("accepted").drop("accepted"), rows.filter("not accepted").drop("accepted")
