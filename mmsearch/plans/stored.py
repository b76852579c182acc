"""Registered queries of versioned tables, keyed merges and event-time streams, and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import feedback, index, media, transcripts
from ..sources import files, schemas, versioned
from ..streaming import ingest
from .inputs import _NORM, _UNIT, _WEIGH, Inputs
from .registry import _MEANINGFUL, _SIGNED16, _TOTAL, _WORDS16, query, total

# ---- versions and merges -----------------------------------------------------------------------------------------


@query(
    "S5_rebuild_index",
    f"SELECT 1 AS version, creator, {_TOTAL.format('combined')} AS combined FROM entries "
    f"UNION ALL SELECT 2, creator, {_TOTAL.format(_UNIT('w'))} FROM (SELECT creator, {_WEIGH('0.15::DOUBLE', '0.85::DOUBLE')} AS w FROM entries)",
    "entries",
)
def _(t: Inputs) -> DataFrame:
    """The index rebuilt in place from its own vectors with other weights; a reader that pinned the first version still has it."""
    path = files.write_index(t.entries(), files.shared_path(t.spark, "index"))
    pinned = files.read_index(t.spark, path)
    index.rebuild_index(t.spark, path, 0.15, 0.85)
    both = pinned.withColumn("version", F.lit(1)).unionByName(files.read_index(t.spark, path).withColumn("version", F.lit(2)))
    return both.select("version", "creator", total(F.col("combined")).alias("combined"))


_LIKES = "SELECT liked_creator AS creator, count(*) AS n FROM interactions GROUP BY liked_creator"
_LONG = f"{_NORM('img')} > 0 AND {_NORM('txt')} > 0"


@query(
    "S8_upsert_search_docs",
    f"""SELECT v.creator AS username, CASE WHEN l.n IS NULL THEN CAST(length(coalesce(x.transcription, '')) AS BIGINT) ELSE l.n END AS n_chars, coalesce(p.follower_count, 0) AS follower_count,
  l.n IS NOT NULL AS replaced, true AS stamped, {_TOTAL.format('v.img')} AS img, {_TOTAL.format('v.txt')} AS txt, {_TOTAL.format(_UNIT('v.w'))} AS combined,
  (SELECT count(*) FROM vecs JOIN ({_LIKES}) USING (creator) WHERE {_LONG}) AS n_replaced, (SELECT count(*) FROM vecs JOIN ({_LIKES}) USING (creator) WHERE NOT ({_LONG})) AS n_skipped
FROM fused v LEFT JOIN texts x USING (creator) LEFT JOIN creators c USING (creator) LEFT JOIN profiles p ON p.pos = c.i LEFT JOIN ({_LIKES}) l ON l.creator = v.creator WHERE {_LONG.replace('img', 'v.img').replace('txt', 'v.txt')}""",
)
def _(t: Inputs) -> DataFrame:
    """All documents, then those of creators with feedback anew (a text as long as their likes): each creator is there once."""
    v = t.video_texts()
    texts = transcripts.creator_text(v, v).withColumn("pos", F.lit(0))
    profiles = t.profiles().withColumn("username", t.name(F.col("pos")))
    docs = index.attach_profile(index.attach_transcription(t.embeddings(), texts), profiles).withColumnRenamed("creator", "username").withColumn("pos", F.lit(0))
    likes = t.interactions().groupBy(F.col("liked_creator").alias("username")).agg(F.count("*").cast("int").alias("n"))
    again = docs.join(likes, "username").withColumn("transcription", F.repeat(F.lit("+"), F.col("n"))).withColumn("pos", F.lit(1)).drop("n")
    root = files.shared_path(t.spark, "docs")
    files.upsert_search_docs(docs, root, buckets=8)
    counts = files.upsert_search_docs(again, root, buckets=8)
    return versioned.read(t.spark, root).select(
        "username", F.length("transcription").cast("long").alias("n_chars"), "follower_count", (F.col("pos") == 1).alias("replaced"), F.col("indexed_at").isNotNull().alias("stamped"),
        *(total(F.col(f"{long}_embedding")).alias(short) for long, short in (("image", "img"), ("text", "txt"), ("combined", "combined"))),
        F.lit(counts["replaced"]).cast("long").alias("n_replaced"), F.lit(counts["skipped"]).cast("long").alias("n_skipped"),
    )


#: Three stretches of time that arrive one after the other.
_SLICES = ["day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20"]
_SLICE = "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"


def _arrive(t: Inputs, slices: list[DataFrame], schema: str, run) -> None:
    """Each slice is written to one folder in turn and drained by ``run(stream)``, which goes on where it stopped."""
    path = files.shared_path(t.spark, "arrivals")
    for rows in slices:
        rows.write.mode("append").parquet(path)
        run(ingest.stream_source(t.spark, path, schema, 1 << 20))


@query(
    "R4_index_merge",
    f"SELECT creator, arg_max(n, slice) AS likes, arg_max(last, slice) AS last_event FROM (SELECT liked_creator AS creator, {_SLICE.replace('ts', 'timestamp')} AS slice, count(*) AS n, max(event_id) AS last FROM interactions GROUP BY ALL) GROUP BY creator",
)
def _(t: Inputs) -> DataFrame:
    """Likes by creator in three batches that share creators: the last batch of a creator is its only row."""
    rows, root, state = t.interactions(), files.shared_path(t.spark, "merged"), files.shared_path(t.spark, "state")
    slices = [rows.filter(s.replace("ts", "timestamp")) for s in _SLICES]
    build = lambda batch: batch.groupBy(F.col("liked_creator").alias("creator")).agg(F.count("*").alias("likes"), F.max("event_id").alias("last_event"))
    _arrive(t, slices, f"event_id long, {schemas.INTERACTIONS}", lambda stream: ingest.index_merge(stream, build, root, state, buckets=8))
    return versioned.read(t.spark, root).select("creator", "likes", "last_event")


# ---- event time --------------------------------------------------------------------------------------------------

_GAP_MS = 24 * 3600 * 1000


@query(
    "R6_incomplete_groups",
    f"""SELECT creator, string_agg(DISTINCT mp4, ' ' ORDER BY mp4) AS transcription, count(DISTINCT mp4) = any_value(expected) AS complete
FROM (SELECT *, sum(CASE WHEN gap > {_GAP_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY creator ORDER BY ms, mp4) AS part, max(ms) OVER () - max(ms) OVER (PARTITION BY creator) AS idle FROM (
  SELECT 'user_' || user_id AS creator, event_type AS mp4, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS gap FROM events))
JOIN (SELECT 'user_' || user_id AS creator, count(DISTINCT event_type) AS expected FROM events GROUP BY user_id) USING (creator)
WHERE part = 0 GROUP BY creator HAVING complete OR any_value(idle) > {_GAP_MS} OR creator IN (
  SELECT 'user_' || user_id FROM (SELECT user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap > {_GAP_MS})""",
)
def _(t: Inputs) -> DataFrame:
    """Users as groups of their event types: complete with all of them, or out as they are after a day without an event."""
    rows = t.table("events").select(F.col("event_type").alias("mp4"), F.concat(F.lit("user_"), "user_id").alias("creator"), F.col("event_type").alias("text"), "ts")
    expected, out, state = files.kept(ingest.expected_counts(rows), "expected"), files.shared_path(t.spark, "groups"), files.shared_path(t.spark, "state")
    run = lambda stream: ingest.run_available(ingest.complete_groups(stream, expected, _GAP_MS, "ts"), out, state)
    _arrive(t, [rows.filter(s) for s in _SLICES], "mp4 string, creator string, text string, ts timestamp", run)
    return t.spark.read.schema(ingest.GROUPS).parquet(out)


@query("R7_late_and_repeated", "SELECT event_id, user_id, event_type FROM events")
def _(t: Inputs) -> DataFrame:
    """Every event comes twice, the end of each slice again in the next one, the first slice once more, too late and under other ids."""
    rows = t.table("events").select("event_id", "user_id", "event_type", "ts")
    again = rows.withColumn("ts", F.col("ts") + F.expr("interval 10 minutes"))
    ends = [rows.filter(s).agg(F.max("ts").alias("end")) for s in _SLICES]
    tails = [rows.filter(s).join(F.broadcast(e), F.col("ts") > F.col("end") - F.expr("interval 30 minutes")).drop("end") for s, e in zip(_SLICES, ends, strict=True)]
    slices = [rows.filter(s).unionByName(again.join(rows.filter(s).select("event_id"), "event_id", "left_semi")) for s in _SLICES]
    late = rows.filter(_SLICES[0]).withColumn("event_id", F.col("event_id") + 10**9)
    slices = [slices[0], slices[1].unionByName(tails[0]), slices[2].unionByName(tails[1]).unionByName(late)]
    out, state = files.shared_path(t.spark, "once"), files.shared_path(t.spark, "state")
    run = lambda stream: ingest.run_available(ingest.drop_repeats(stream, ["event_id"], "ts", "1 hour"), out, state)
    _arrive(t, slices, "event_id long, user_id long, event_type string, ts timestamp", run)
    return t.spark.read.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(out).drop("ts")


# ---- text gate over videos ---------------------------------------------------------------------------------------


@query(
    "F6_creator_gate",
    f"SELECT creator, CAST(length(trim(transcription, '{tx.WS_CHARS}')) AS BIGINT) AS n_stripped, creator IN ({_MEANINGFUL}) AS meaningful FROM texts",
)
def _(t: Inputs) -> DataFrame:
    """The text gate of every creator from its videos, without a row that holds all of them."""
    return transcripts.creator_gate(t.video_texts())


# ---- media -------------------------------------------------------------------------------------------------------

_JPEG = "'FFD8' || hex(encode(coalesce(text, ''))) || 'FFD9'"
_ROW_SUMS = f"list_transform(range(8), lambda r: list_sum(list_transform(range(8), lambda c: CASE WHEN length(j) >= 16 * r + 2 * c + 2 THEN CAST(CAST('0x' || substr(j, 1 + 16 * r + 2 * c, 2) AS BIGINT) AS DOUBLE) ELSE 0 END)))"
_POOLED = f"""SELECT creator, {_TOTAL.format('list(m ORDER BY p)')} AS img FROM (
  SELECT creator, p, sum(k * x) / sum(k) AS m FROM (
    SELECT creator, k, unnest(range(1, 9)) AS p, unnest(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8))) AS x
    FROM (SELECT creator, doc_id % 10 + 1 AS k, {_ROW_SUMS} AS v FROM (SELECT creator, doc_id, substr({_JPEG}, 1, 128) AS j FROM video_texts))
  ) GROUP BY creator, p) GROUP BY creator"""


def _videos(t: Inputs) -> DataFrame:
    """(path, content): a file a document, holding one to ten pictures of its text."""
    mark = lambda h: F.to_binary(F.lit(h), F.lit("hex"))
    one = F.concat(mark("FFD8"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), mark("FFD9"))
    stream = F.to_binary(F.repeat(F.hex(one), (F.col("doc_id") % 10 + 1).cast("int")), F.lit("hex"))
    return t.video_texts().select(F.concat("creator", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".mp4")).alias("path"), stream.alias("content"))


_FRAMES = media.frames_step(media.decode_bytes(8))


def _frame_vectors(frames: DataFrame) -> DataFrame:
    return media.encode_frames(frames, media.row_sums(8), [8, 8]).select("mp4", "frame_idx", "v")


def _pooled(vectors: DataFrame) -> DataFrame:
    v = vectors.withColumn("creator", tx.creator_of(F.col("mp4")))
    return index.pool_frames(v, v.select("creator").distinct(), 8).select("creator", total(F.col("img")).alias("img"))


@query("S3_M1_M4_A1_scan_and_encode", _POOLED)
def _(t: Inputs) -> DataFrame:
    """Media files of all creators scanned, split, decoded, encoded in batches of frames and pooled."""
    root = files.write_media(_videos(t), files.shared_path(t.spark, "media"))
    vectors = _frame_vectors(files.scan_media(t.spark, root, ordered=False, then=_FRAMES))
    return _pooled(files.kept(vectors, "vectors"))  # read for the creators and for the means


@query("S14_S3_media_stream", _POOLED)
def _(t: Inputs) -> DataFrame:
    """The same files as a stream, moved to an archive once encoded; the vectors of finished batches are pooled."""
    root = files.write_media(_videos(t), files.shared_path(t.spark, "media"))
    out, state, archive = (files.shared_path(t.spark, n) for n in ("vectors", "state", "archive"))
    ingest.run_available(_frame_vectors(files.media_stream(t.spark, root, 4000, archive=archive, then=_FRAMES)), out, state)
    return _pooled(t.spark.read.schema("mp4 string, frame_idx int, v array<double>").parquet(out))


@query("S4_scan_frames", "SELECT creator, count(*) AS frames, CAST(sum(8 * len(v)) AS BIGINT) AS n_bytes FROM frames GROUP BY creator")
def _(t: Inputs) -> DataFrame:
    """Frame files of all creators, scanned with their bytes; files beside the frames folders don't count."""
    pictures = t.frames().select(F.concat("creator", F.lit("/v/frames/f"), F.col("frame_idx").cast("string"), F.when(F.col("frame_idx") % 2 == 0, ".jpg").otherwise(".PNG")).alias("path"), F.repeat(F.lit("8 bytes."), F.size("v")).cast("binary").alias("content"))
    other = t.creators().select(F.concat("creator", F.lit("/v/cover.jpg")).alias("path"), F.lit("no frame").cast("binary").alias("content"))
    root = files.write_media(pictures.unionByName(other), files.shared_path(t.spark, "frames"))
    return files.scan_frames(t.spark, root).groupBy("creator").agg(F.count("*").alias("frames"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


_SAID = f"""said AS (
  SELECT doc_id, c, s, abs(coalesce(list_sum(list_transform(w[480 * c + 160 * s + 1:480 * c + 160 * s + 160], lambda x: {_SIGNED16})), 0)) AS x
  FROM (SELECT doc_id, w, c, unnest(range(3)) AS s FROM (SELECT doc_id, w, unnest(range(CAST(ceil(bytes / 960.0) AS BIGINT))) AS c
    FROM (SELECT doc_id, {_WORDS16} AS w, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents)))
), kept AS (
  SELECT doc_id, c, s, 'n' || x AS w FROM said WHERE x > 0 AND NOT ((x % 100) / 100.0 > 0.6 AND NOT -(x % 20) / 10.0 > -1.0) AND NOT 1 + (x % 30) / 10.0 > 2.4
)"""


@query("M2_M3_M4_F7_A2_transcribe", f"SELECT doc_id, text FROM (WITH {_SAID} SELECT doc_id, string_agg(w, ' ' ORDER BY c, s) AS text FROM kept GROUP BY doc_id)")
def _(t: Inputs) -> DataFrame:
    """Audio of all documents cut into chunks of 30 s, transcribed in batches of 16, segments gated and joined to a text a file."""
    pcm = t.table("documents").select(F.col("doc_id").alias("mp4"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("audio_pcm"))
    chunks = media.chunk_audio(pcm, seconds=30, rate=16, most_seconds=None)
    segments = media.transcribe(chunks, media.counting_speech(3), 480)
    return transcripts.join_chunks(segments.filter(transcripts.segment_ok())).withColumnRenamed("mp4", "doc_id")


# ---- interactions ------------------------------------------------------------------------------------------------


@query(
    "S10_R5_two_outputs",
    "SELECT label <> 'broken' AS accepted, username, label, count(*) AS n FROM (SELECT username, CASE WHEN lower(trim(query_context)) = 'error' THEN 'broken' ELSE lower(coalesce(label, 'good')) END AS label FROM interactions) GROUP BY ALL",
)
def _(t: Inputs) -> DataFrame:
    """Accepted and rejected rows of one stream; the stream is run twice over the same files, which changes nothing."""
    label = F.when(F.lower(F.btrim("query_context")) == "error", "broken").otherwise(F.col("label"))
    path, out = files.shared_path(t.spark, "clicks"), files.shared_path(t.spark, "outputs")
    t.interactions().withColumn("label", label).drop("event_id").write.parquet(path)
    for attempt in ("first", "again"):
        ingest.feedback_outputs(ingest.stream_source(t.spark, path, schemas.INTERACTIONS, 2), out, files.shared_path(t.spark, attempt))
    good, bad = ingest.read_outputs(t.spark, out, schemas.INTERACTIONS)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted", "username", "label").agg(F.count("*").alias("n"))


@query("S9_S10_F8_bucketed", "SELECT username, CAST(n AS INT) AS n, query, creator, label FROM fb")
def _(t: Inputs) -> DataFrame:
    """Feedback from a table dealt to buckets by user, appended to three times: no shuffle by user is left."""
    table = files.init_bucketed_interactions(t.spark, f"interactions_{uuid.uuid4().hex}", 8)
    for s in _SLICES:
        files.append_bucketed(t.interactions().filter(s.replace("ts", "timestamp")), table, 8)
    return feedback.feedback(t.spark.table(table)).select("username", "n", "query", "creator", "label")
