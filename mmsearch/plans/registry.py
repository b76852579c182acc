"""Registered queries of the search engine, by operator id, and their DuckDB oracles.

Doubles are rounded to six places at the output only; ranking uses the full values.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import cluster, evaluate, feedback, index, media, personalize, planning, report, search, sql, transcripts
from ..sources import files, schemas, versioned
from ..streaming import ingest
from .inputs import DIMS, QUERIES as NAMES, Inputs, oracle

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, text: str | None = None, upto: str = "stage_log"):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if text is not None:
            ORACLE[name] = oracle(text, upto)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def total(v: Column) -> Column:
    """A vector as one comparable number: its components weighted by position, rounded."""
    return F.round(F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.size(v)), lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x), 6)


_TOTAL = "round(list_sum(list_transform({0}, lambda x, k: x * k)), 6)"


# ---- sources and sinks -------------------------------------------------------------------------------------------


@query("S1_read_profiles", "SELECT username, follower_count, video_count, video_ids, video_durations_list, '[]' AS video_desc_list, CAST(NULL AS VARCHAR) AS tiktok_url, pos FROM profiles")
def _(t: Inputs) -> DataFrame:
    path = files.write_csv(t.profiles(), files.shared_path(t.spark, "profiles"))
    return files.read_profiles(t.spark, path).withColumn("tiktok_url", F.nullif("tiktok_url", F.lit("")))


@query("S2_S6_transcriptions_csv", "SELECT creator, md5(transcription) AS digest, CAST(length(transcription) AS BIGINT) AS n FROM texts")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    path = files.write_csv(transcripts.creator_text(v, v), files.shared_path(t.spark, "transcriptions"))
    return files.read_transcriptions(t.spark, path).select("creator", F.md5("transcription").alias("digest"), F.length("transcription").cast("long").alias("n"))


@query("S5_index_round_trip", f"SELECT creator, {_TOTAL.format('img')} AS img, {_TOTAL.format('txt')} AS txt, {_TOTAL.format('combined')} AS combined FROM entries", "entries")
def _(t: Inputs) -> DataFrame:
    path = files.write_index(t.entries(), files.shared_path(t.spark, "index"))
    return files.read_index(t.spark, path).select("creator", *(total(F.col(c)).alias(c) for c in ("img", "txt", "combined")))


@query("S7_metrics_csv", "SELECT run, stage, count(DISTINCT item) AS items, round(max(stop) - min(start), 2) AS wall_sec FROM stage_log GROUP BY run, stage")
def _(t: Inputs) -> DataFrame:
    path = files.write_csv(report.run_metrics(t.stage_log()).select("run", "stage", "items", "wall_sec"), files.shared_path(t.spark, "metrics"))
    return files.read_csv(t.spark, path, "run int, stage string, items long, wall_sec double")


@query("S8_search_docs", "SELECT v.creator AS username, CAST(length(coalesce(x.transcription, '')) AS BIGINT) AS n_chars, coalesce(p.follower_count, 0) AS follower_count, coalesce(p.video_count, 0) AS video_count FROM vecs v LEFT JOIN texts x USING (creator) LEFT JOIN (SELECT 'creator_' || lpad(CAST(pos AS VARCHAR), 9, '0') AS creator, follower_count, video_count FROM profiles) p USING (creator) WHERE list_dot_product(img, img) > 0 AND list_dot_product(txt, txt) > 0")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    texts = transcripts.creator_text(v, v).withColumn("pos", F.lit(0))
    profiles = t.profiles().withColumn("username", t.name(F.col("pos")))
    docs = index.attach_profile(index.attach_transcription(t.embeddings().filter(index.nonzero_ok()), texts), profiles).withColumnRenamed("creator", "username").withColumn("pos", F.lit(0))
    path, _n = files.write_search_docs(docs, files.shared_path(t.spark, "docs"))
    return t.spark.read.parquet(path).select("username", F.length("transcription").cast("long").alias("n_chars"), "follower_count", "video_count")


@query("S10_append_feedback", "SELECT username, label, count(*) AS n FROM (SELECT username, lower(coalesce(label, 'good')) AS label FROM interactions WHERE liked_creator <> '') GROUP BY username, label")
def _(t: Inputs) -> DataFrame:
    path = files.init_interactions(t.spark, files.shared_path(t.spark, "interactions"))
    files.append_feedback(t.interactions().drop("event_id"), path)
    return t.spark.read.schema(schemas.INTERACTIONS).parquet(path).groupBy("username", "label").agg(F.count("*").alias("n"))


@query("S11_labels_csv", "SELECT config, query, CAST(rank AS INT) AS rank, creator, score, relevant FROM labelled")
def _(t: Inputs) -> DataFrame:
    path = files.write_csv(t.labels(), files.shared_path(t.spark, "labels"))
    return files.read_csv(t.spark, path, schemas.LABELS).select("config", "query", "rank", "creator", "score", "relevant")


@query("S13_winner_json", "SELECT config, round(avg(relevant), 6) AS avg_precision FROM labelled JOIN configs USING (config) GROUP BY config, config_pos ORDER BY avg(relevant) DESC, config_pos LIMIT 1")
def _(t: Inputs) -> DataFrame:
    average = evaluate.avg_precision(evaluate.precision_at_k(t.labels()), t.configs(), t.queries())
    path = files.write_json(evaluate.pick_winner(average), files.shared_path(t.spark, "winner"))
    return t.spark.read.schema("config string, avg_precision double").json(path).select("config", r6("avg_precision").alias("avg_precision"))


@query("S15_read_creators", "SELECT creator FROM creators")
def _(t: Inputs) -> DataFrame:
    path = files.shared_path(t.spark, "names")
    t.creators().select(F.concat(F.lit("  "), "creator", F.lit(" \n  ")).alias("value")).write.text(path)
    return files.read_creators(t.spark, path)


# ---- planning ----------------------------------------------------------------------------------------------------


@query("F1_creators_to_fetch", "SELECT username, video_count FROM profiles WHERE video_count > 10 AND pos % 3 <> 0 ORDER BY pos LIMIT 50")
def _(t: Inputs) -> DataFrame:
    p = t.profiles()
    return planning.creators_to_fetch(p, p.filter("pos % 3 = 0").select(F.col("username").alias("creator")), 50).select("username", "video_count")


@query("F2_fetch_budget", "SELECT count(*) AS existing, greatest(0, 20000 - count(*)) AS needed, CAST(ceil(greatest(0, 20000 - count(*)) / 3.0) AS BIGINT) AS creators FROM documents")
def _(t: Inputs) -> DataFrame:
    return planning.fetch_budget(t.video_texts(), 20000, 3)


@query("F3_select_videos", "SELECT c_name AS username, CAST(k - 1 AS INT) AS pick, CAST(o_orderkey AS VARCHAR) AS video_id, d AS duration, 'https://video.example/@' || c_name || '/video/' || o_orderkey AS url, 'media/' || c_name || '/' || o_orderkey || '.mp4' AS path FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM durations WHERE d BETWEEN 10 AND 50) JOIN customer ON c_custkey = o_custkey WHERE k <= 3")
def _(t: Inputs) -> DataFrame:
    return planning.select_videos(t.profiles())


@query("J1_match_profiles", "SELECT c_custkey AS pos, upper(c_name) || ' ' AS creator, c_name AS username, 1 AS version, 'https://video.example/@' || c_name AS tiktok_url FROM customer")
def _(t: Inputs) -> DataFrame:
    c = t.table("customer")
    names = c.select(F.col("c_custkey").alias("pos"), F.concat(F.upper("c_name"), F.lit(" ")).alias("creator"))
    export = c.select(F.lower("c_name").alias("username"), F.col("c_custkey").alias("pos"), F.lit(0).alias("version")).unionByName(c.select(F.col("c_name").alias("username"), (F.col("c_custkey") + 10**9).alias("pos"), F.lit(1).alias("version")))
    return planning.match_profiles(names, export)


@query("J2_missing_profiles", "SELECT upper(c_name) AS creator FROM customer WHERE c_custkey % 5 = 0")
def _(t: Inputs) -> DataFrame:
    c = t.table("customer")
    return planning.missing_profiles(c.select(F.upper("c_name").alias("creator")), c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("username")))


@query("W4_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(t: Inputs) -> DataFrame:
    return files.last_wins(t.table("events"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("W9_recycle_to_target", "SELECT s.slot, v.mp4 FROM (SELECT mp4, row_number() OVER (ORDER BY mp4) - 1 AS i, count(*) OVER () AS total FROM video_texts) v JOIN (SELECT unnest(range(0, 25000)) AS slot) s ON s.slot % v.total = v.i")
def _(t: Inputs) -> DataFrame:
    return planning.recycle_to_target(t.video_texts().select("mp4"), 25000)


@query("A15_corpus_counts", "SELECT creator, count(*) AS videos, (SELECT count(*) FROM video_texts) AS total, (SELECT count(DISTINCT creator) FROM video_texts) AS creators FROM video_texts GROUP BY creator")
def _(t: Inputs) -> DataFrame:
    return planning.corpus_counts(t.video_texts())


@query("X6_X10_paths", "SELECT mp4, creator, 'https://video.example/@' || creator AS profile_url, 'https://video.example/@' || creator || '/video/' || doc_id AS video_url FROM video_texts")
def _(t: Inputs) -> DataFrame:
    creator = tx.creator_of(F.col("mp4"))
    return t.video_texts().select("mp4", creator.alias("creator"), tx.profile_url(planning.SITE, creator).alias("profile_url"), tx.video_url(planning.SITE, creator, F.col("doc_id").cast("string")).alias("video_url"))


@query("W10_ordered_rows", "SELECT creator, mp4 FROM video_texts ORDER BY creator, mp4")
def _(t: Inputs) -> DataFrame:
    return t.video_texts().select("creator", "mp4").orderBy("creator", "mp4")


# ---- transcripts, media ------------------------------------------------------------------------------------------


@query("F7_segment_gate", "SELECT mp4, chunk_idx, seg_idx FROM kept_segments")
def _(t: Inputs) -> DataFrame:
    return t.segments().filter(transcripts.segment_ok()).select("mp4", "chunk_idx", "seg_idx")


@query("A2_join_chunks", "SELECT mp4, string_agg(t, ' ' ORDER BY chunk_idx) AS text FROM (SELECT mp4, chunk_idx, string_agg(text, ' ' ORDER BY seg_idx) AS t FROM kept_segments GROUP BY mp4, chunk_idx) WHERE t <> '' GROUP BY mp4")
def _(t: Inputs) -> DataFrame:
    return transcripts.join_chunks(t.segments().filter(transcripts.segment_ok()))


@query("A3_creator_text", "SELECT creator, transcription FROM texts")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    return transcripts.creator_text(v, v)


_TOKENS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{tx.WS}'), lambda w: w <> '')"


@query("F6_X7_text_gate", f"SELECT d.doc_id, CAST(length(trim(text, '{tx.WS_CHARS}')) AS BIGINT) AS n_stripped, round(max_n / tokens, 6) AS top_share, coalesce(length(trim(text, '{tx.WS_CHARS}')) >= 50 AND max_n / tokens <= 0.4, false) AS meaningful FROM documents d LEFT JOIN (SELECT doc_id, max(n) AS max_n, sum(n) AS tokens FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents) GROUP BY doc_id, w) GROUP BY doc_id) USING (doc_id)")
def _(t: Inputs) -> DataFrame:
    return transcripts.text_gate(t.table("documents").select("doc_id", "text")).select("doc_id", "n_stripped", r6("top_share").alias("top_share"), "meaningful")


@query("M2_chunk_audio", "SELECT doc_id, k AS chunk_idx, CAST(k * 30 AS DOUBLE) AS offset, CAST(least(960, octet_length(encode(text)) - k * 960) AS DOUBLE) / 32 AS duration, CAST(least(960, octet_length(encode(text)) - k * 960) AS BIGINT) AS n_bytes FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(octet_length(encode(text)) / 960.0) AS BIGINT))) AS k FROM documents)")
def _(t: Inputs) -> DataFrame:
    pcm = t.table("documents").select(F.col("doc_id").alias("mp4"), F.encode("text", "UTF-8").alias("audio_pcm"))
    cut = media.chunk_audio(pcm, seconds=30, rate=16, most_seconds=None)
    return cut.select(F.col("mp4").alias("doc_id"), F.col("chunk_idx").cast("long").alias("chunk_idx"), "offset", "duration", F.octet_length("pcm").cast("long").alias("n_bytes"))


@query("M6_extract_report", "SELECT doc_id, octet_length(encode(text)) > 0 AS has_audio, CAST(doc_id % 4 AS INT) AS n_frames FROM documents")
def _(t: Inputs) -> DataFrame:
    frames = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("array<binary>")).otherwise(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int")), lambda k: F.encode(k.cast("string"), "UTF-8")))
    d = t.table("documents").select(F.col("doc_id").alias("mp4"), F.encode("text", "UTF-8").alias("audio_pcm"), frames.alias("frames"))
    return media.extract_report(d).withColumnRenamed("mp4", "doc_id")


@query("M1_split_frames", "SELECT doc_id, CAST(k AS INT) AS frame_idx, CAST(octet_length(encode(text)) + 4 AS BIGINT) AS n_bytes FROM (SELECT doc_id, text, unnest(range(0, least(10, 1 + doc_id % 12))) AS k FROM documents)")
def _(t: Inputs) -> DataFrame:
    mark = lambda h: F.to_binary(F.lit(h), F.lit("hex"))
    one = F.concat(mark("FFD8"), F.encode("text", "UTF-8"), mark("FFD9"))
    stream = F.concat(F.aggregate(F.array_repeat(one, (1 + F.col("doc_id") % 12).cast("int")), F.lit(b""), lambda a, x: F.concat(a, x)), mark("FFD8"), F.encode("text", "UTF-8"))
    return media.split_frames(t.table("documents").select(F.col("doc_id").cast("string").alias("mp4"), stream.alias("stream"))).select(F.col("mp4").cast("long").alias("doc_id"), "frame_idx", F.octet_length("jpeg").cast("long").alias("n_bytes"))


#: 16-bit samples of a text's bytes as hexadecimal words, low byte first, and the value of one.
_WORDS16 = "regexp_extract_all(hex(encode(coalesce(text, ''))), '....')"
_SIGNED16 = "(CAST('0x' || substr(x, 3, 2) || substr(x, 1, 2) AS BIGINT) + 32768) % 65536 - 32768"


@query(
    "M3_pcm_to_float",
    f"SELECT doc_id, CAST(len(w) AS INT) AS n, round(coalesce(list_sum(list_transform(w, lambda x: {_SIGNED16})), 0) / 32768.0, 6) AS total FROM (SELECT doc_id, {_WORDS16} AS w FROM documents)",
)
def _(t: Inputs) -> DataFrame:
    pcm = t.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("pcm"))
    return media.pcm_to_float(pcm).select("doc_id", F.size("samples").alias("n"), r6(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


@query("M4_M5_encode_and_search")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    texts = media.encode(transcripts.creator_text(v, v), "transcription", media.hashed_text_encoder(DIMS), 32)
    entries = texts.select("creator", vx.unit(vx.as_double(F.col("vector"))).alias("combined"))
    asked = media.encode(t.table("benchmark").select(F.col("item_id").cast("string").alias("query"), "text"), "text", media.hashed_text_encoder(DIMS)).select("query", vx.as_double(F.col("vector")).alias("q"))
    return search.search(entries, asked, 10).withColumn("score", r6("score"))


# ---- index and search --------------------------------------------------------------------------------------------


@query("A1_pool_frames", f"SELECT creator, {_TOTAL.format('img')} AS img FROM img_vecs", "img_vecs")
def _(t: Inputs) -> DataFrame:
    return t.img().select("creator", total(F.col("img")).alias("img"))


@query("X2_X5_X12_vectors", "SELECT creator, round(list_dot_product(img, txt), 6) AS dot, round(sqrt(list_dot_product(img, img)), 6) AS norm, round(1 - CASE WHEN sqrt(list_dot_product(img, img)) * sqrt(list_dot_product(txt, txt)) = 0 THEN 0 ELSE list_dot_product(img, txt) / (sqrt(list_dot_product(img, img)) * sqrt(list_dot_product(txt, txt))) END, 6) AS distance FROM vecs", "vecs")
def _(t: Inputs) -> DataFrame:
    a, b = F.col("img"), F.col("txt")
    return t.embeddings().select("creator", r6(vx.dot(a, b)).alias("dot"), r6(vx.norm(a)).alias("norm"), r6(vx.cosine_distance(a, b)).alias("distance"))


@query("F4_vector_gate", f"SELECT creator, {_TOTAL.format('combined')} AS combined FROM entries", "entries")
def _(t: Inputs) -> DataFrame:
    return t.entries().select("creator", total(F.col("combined")).alias("combined"))


@query("F5_nonzero_gate", "SELECT creator FROM vecs WHERE list_dot_product(img, img) > 0 AND list_dot_product(txt, txt) > 0", "vecs")
def _(t: Inputs) -> DataFrame:
    return t.embeddings().filter(index.nonzero_ok()).select("creator")


@query("A16_index_stats", "SELECT count(*) FILTER (list_dot_product(img, img) > 0 AND list_dot_product(txt, txt) > 0) AS indexed, count(*) FILTER (NOT (list_dot_product(img, img) > 0 AND list_dot_product(txt, txt) > 0)) AS skipped FROM vecs", "vecs")
def _(t: Inputs) -> DataFrame:
    return index.index_stats(t.embeddings())


_MEANINGFUL = f"SELECT creator FROM (SELECT creator, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY creator) AS tokens FROM (SELECT creator, unnest({_TOKENS.replace('text', 'transcription')}) AS w FROM texts WHERE length(trim(transcription, '{tx.WS_CHARS}')) >= 50) GROUP BY creator, w) GROUP BY creator HAVING max(n / tokens) <= 0.4"


@query("F12_gate_report", f"SELECT v.creator, CASE WHEN e.creator IS NULL THEN 'vector' ELSE 'text' END AS reason FROM vecs v LEFT JOIN entries e USING (creator) LEFT JOIN ({_MEANINGFUL}) m ON m.creator = v.creator WHERE e.creator IS NULL OR m.creator IS NULL")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    return index.gate_report(t.embeddings(), transcripts.creator_text(v, v))


@query("build_index", f"SELECT creator, {_TOTAL.format('combined')} AS combined FROM entries WHERE creator IN ({_MEANINGFUL})")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    return index.build_index(t.embeddings(), transcripts.creator_text(v, v)).select("creator", total(F.col("combined")).alias("combined"))


@query("J3_attach_transcription", "SELECT v.creator, CAST(length(coalesce(x.text, '')) AS BIGINT) AS n_chars FROM vecs v LEFT JOIN (SELECT creator, arg_max(text, doc_id) AS text FROM video_texts GROUP BY creator) x USING (creator)")
def _(t: Inputs) -> DataFrame:
    texts = t.video_texts().select("creator", F.col("text").alias("transcription"), F.col("doc_id").alias("pos"))
    return index.attach_transcription(t.embeddings().select("creator"), texts).select("creator", F.length("transcription").cast("long").alias("n_chars"))


@query("J4_attach_profile", "SELECT c.creator, coalesce(p.follower_count, 0) AS follower_count, coalesce(p.video_count, 0) AS video_count FROM creators c LEFT JOIN profiles p ON c.i = p.pos")
def _(t: Inputs) -> DataFrame:
    profiles = t.profiles().withColumn("username", t.name(F.col("pos")))
    return index.attach_profile(t.creators().select("creator"), profiles)


@query("J14_attach_media", "SELECT creator, coalesce(frames, []) AS frames FROM (SELECT DISTINCT creator FROM video_texts) LEFT JOIN (SELECT creator, list(frame_path ORDER BY frame_path) AS frames FROM frame_refs GROUP BY creator) USING (creator)")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    return index.attach_media(transcripts.creator_text(v, v), t.frame_refs()).select("creator", "frames")


@query("J13_lookup_vector", f"SELECT i.creator, {_TOTAL.format('combined')} AS combined FROM (SELECT DISTINCT liked_creator AS creator FROM interactions) i JOIN entries USING (creator)")
def _(t: Inputs) -> DataFrame:
    names = t.interactions().select(F.col("liked_creator").alias("creator")).distinct()
    return index.lookup_vector(t.entries(), names).select("creator", total(F.col("combined")).alias("combined"))


@query("W8_browse_docs", "SELECT creator AS username, coalesce(nullif(substr(transcription, 1, 100), ''), 'No transcription') AS preview, (SELECT count(*) FROM texts) AS total FROM texts ORDER BY creator LIMIT 100")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    return index.browse_docs(transcripts.creator_text(v, v).withColumnRenamed("creator", "username"))


@query("SQL_table_function_search", "SELECT query, CAST(rank AS INT) AS rank, creator, round(score, 6) AS score FROM hits30 WHERE rank <= 10", "hits30")
def _(t: Inputs) -> DataFrame:
    """W1 as a SQL text over table functions."""
    sql.register(t.spark)
    sql.pack_views(t.entries(), t.queries())
    nearest = "SELECT * FROM nearest(TABLE(SELECT * FROM entry_packs CROSS JOIN query_packs), 10)"
    return t.spark.sql(f"SELECT query, rank, creator, round(score, 6) AS score FROM ranked(TABLE({nearest}), 10)")


@query("J7_score_cross", "SELECT query, creator, round(list_dot_product(combined, q), 6) AS score FROM entries, qvecs", "qvecs")
def _(t: Inputs) -> DataFrame:
    return search.score_cross(t.entries(), t.queries()).withColumn("score", r6("score"))


@query("W1_search", "SELECT query, CAST(rank AS INT) AS rank, creator, round(score, 6) AS score FROM hits30 WHERE rank <= 10", "hits30")
def _(t: Inputs) -> DataFrame:
    return search.search(t.entries(), t.queries(), 10).withColumn("score", r6("score"))


@query("J8_W2_config_sweep", "SELECT config, image_weight, text_weight, query, CAST(rank AS INT) AS rank, creator, round(score, 4) AS score FROM sweep", "sweep")
def _(t: Inputs) -> DataFrame:
    return search.config_sweep(t.embeddings(), t.configs().drop("config_pos"), t.queries()).withColumn("score", F.round("score", 4))


@query("J11_attach_frames", "SELECT h.query, h.creator, coalesce(f.frames, []) AS frames FROM hits30 h LEFT JOIN (SELECT creator, list(frame_path ORDER BY frame_path) AS frames FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY frame_path) AS k FROM frame_refs) WHERE k <= 3 GROUP BY creator) f USING (creator) WHERE h.rank <= 10")
def _(t: Inputs) -> DataFrame:
    return personalize.attach_frames(search.search(t.entries(), t.queries(), 10), t.frame_refs()).select("query", "creator", "frames")


@query("X11_X13_paths_and_previews", "SELECT r.creator, replace(substr(r.frame_path, 7), '\\', '/') AS path, coalesce(nullif(substr(x.transcription, 1, 20), ''), 'none') AS preview FROM frame_refs r JOIN texts x USING (creator)")
def _(t: Inputs) -> DataFrame:
    v = t.video_texts()
    return t.frame_refs().join(transcripts.creator_text(v, v), "creator").select("creator", tx.rel_path(F.col("frame_path"), "media").alias("path"), tx.preview(F.col("transcription"), 20, "none").alias("preview"))


# ---- feedback and personalisation --------------------------------------------------------------------------------


@query("F8_F10_feedback", "SELECT username, CAST(n AS INT) AS n, query, creator, label FROM fb")
def _(t: Inputs) -> DataFrame:
    return feedback.feedback(t.interactions()).select("username", "n", "query", "creator", "label")


@query("F9_query_filter", "SELECT username, creator, label FROM fb WHERE query = 'click creators'")
def _(t: Inputs) -> DataFrame:
    return feedback.for_query(feedback.feedback(t.interactions()), "  CLICK  creators ").select("username", "creator", "label")


@query("X1_normalize_query", "SELECT event_id, trim(regexp_replace(lower(query_context), '\\s+', ' ', 'g')) AS query FROM interactions")
def _(t: Inputs) -> DataFrame:
    return t.interactions().select("event_id", tx.normalize_query(F.col("query_context")).alias("query"))


@query("J6_U3_alias_feedback", "SELECT username, query, label, creator FROM aliased")
def _(t: Inputs) -> DataFrame:
    return feedback.alias_feedback(feedback.feedback(t.interactions(), feedback.EVALUATION_CAP), t.aliases())


@query("A9_feedback_counts", "SELECT username, count(*) FILTER (label = 'good') AS liked, count(*) FILTER (label = 'bad') AS disliked FROM fb GROUP BY username")
def _(t: Inputs) -> DataFrame:
    return feedback.feedback_counts(t.interactions())


@query("J10_feedback_map", "SELECT username, query, creator, min(label) AS label FROM fb GROUP BY username, query, creator")
def _(t: Inputs) -> DataFrame:
    return feedback.feedback_map(feedback.feedback(t.interactions()))


def _scored(t: Inputs) -> tuple[DataFrame, DataFrame]:
    entries = t.entries()
    pool = search.search(entries, t.queries(), 30)
    asked = t.interactions().select("username").distinct().withColumn("query", F.explode(F.array(*(F.lit(q) for q in NAMES))))
    return personalize.personalize(pool, feedback.feedback(t.interactions()), entries, requests=asked), pool.filter("rank <= 10")


@query("J9_X8_X9_personalize", "SELECT username, query, creator, round(original_score, 6) AS original_score, round(score, 6) AS score, round(similarity_boost, 6) AS similarity_boost, round(similarity_penalty, 6) AS similarity_penalty FROM scored")
def _(t: Inputs) -> DataFrame:
    return _scored(t)[0].select("username", "query", "creator", *(r6(c).alias(c) for c in ("original_score", "score", "similarity_boost", "similarity_penalty")))


@query("W3_W5_rerank", "SELECT username, query, CAST(rank AS INT) AS rank, creator, round(score, 6) AS score, is_boosted, is_penalized FROM reranked")
def _(t: Inputs) -> DataFrame:
    return personalize.rerank(_scored(t)[0]).select("username", "query", "rank", "creator", r6("score").alias("score"), "is_boosted", "is_penalized")


_PLAIN = "SELECT DISTINCT r.username, r.query, h.creator FROM reranked r JOIN hits30 h USING (query) WHERE h.rank <= 10"


@query("U1_new_creators", f"SELECT username, query, creator FROM reranked EXCEPT ({_PLAIN})")
def _(t: Inputs) -> DataFrame:
    scored, plain = _scored(t)
    return personalize.new_and_removed(personalize.rerank(scored), plain)[0]


@query("U2_removed_creators", f"{_PLAIN} EXCEPT (SELECT username, query, creator FROM reranked)")
def _(t: Inputs) -> DataFrame:
    scored, plain = _scored(t)
    return personalize.new_and_removed(personalize.rerank(scored), plain)[1]


@query("A10_personalization_stats", "SELECT r.username, r.query, count(*) FILTER (is_boosted) AS boosted_creators, count(*) FILTER (is_penalized) AS penalized_creators, round(avg(similarity_boost - similarity_penalty), 6) AS avg_adjustment, count(*) FILTER (h.creator IS NULL) AS new_creators, 10 - count(h.creator) AS removed_creators FROM reranked r LEFT JOIN (SELECT * FROM hits30 WHERE rank <= 10) h ON h.query = r.query AND h.creator = r.creator GROUP BY r.username, r.query")
def _(t: Inputs) -> DataFrame:
    scored, plain = _scored(t)
    return personalize.stats(personalize.rerank(scored), plain).withColumn("avg_adjustment", r6("avg_adjustment"))


# ---- evaluation --------------------------------------------------------------------------------------------------


@query("J5_apply_judgments", "SELECT config, query, CAST(rank AS INT) AS rank, creator, relevant, config = 'half' AS filled FROM labelled")
def _(t: Inputs) -> DataFrame:
    rows = t.labels()
    judged = rows.groupBy("query", "creator").agg(F.max("relevant").alias("judged"))
    blank = rows.withColumn("relevant", F.when(F.col("config") != "half", F.col("relevant")))
    return evaluate.apply_judgments(blank, judged).select("config", "query", "rank", "creator", "relevant", "filled")


@query("F11_A4_precision_at_k", "SELECT config, query, round(avg(relevant), 6) AS precision FROM labelled GROUP BY config, query")
def _(t: Inputs) -> DataFrame:
    labels = files.kept(t.labels(), "labels")  # checked, then read again
    return evaluate.precision_at_k(evaluate.validate_labels(labels)).withColumn("precision", r6("precision"))


@query("A5_avg_precision", "SELECT config, round(sum(p) / 5, 6) AS avg_precision FROM (SELECT config, query, avg(relevant) AS p FROM labelled WHERE NOT (config = 'half' AND query = 'view') GROUP BY config, query) GROUP BY config")
def _(t: Inputs) -> DataFrame:
    rows = t.labels().filter("not (config = 'half' and query = 'view')")
    return evaluate.avg_precision(evaluate.precision_at_k(rows), t.configs(), t.queries()).select("config", r6("avg_precision").alias("avg_precision"))


@query("A6_precision_table", "SELECT config, " + ", ".join(f"round(avg(relevant) FILTER (query = '{q}'), 6) AS {q}" for q in NAMES) + " FROM labelled GROUP BY config")
def _(t: Inputs) -> DataFrame:
    return evaluate.precision_table(evaluate.precision_at_k(t.labels()), NAMES).select("config", *(r6(q).alias(q) for q in NAMES))


@query("A7_feedback_precision", "SELECT username, query, count(DISTINCT creator) FILTER (label = 'good') / 10.0 AS precision FROM aliased GROUP BY username, query")
def _(t: Inputs) -> DataFrame:
    return evaluate.feedback_precision(feedback.alias_feedback(feedback.feedback(t.interactions(), feedback.EVALUATION_CAP), t.aliases()))


@query("A8_pick_winner", "SELECT config, round(avg(relevant), 6) AS avg_precision FROM labelled JOIN configs USING (config) GROUP BY config, config_pos ORDER BY avg(relevant) DESC, config_pos LIMIT 1")
def _(t: Inputs) -> DataFrame:
    return evaluate.pick_winner(evaluate.avg_precision(evaluate.precision_at_k(t.labels()), t.configs(), t.queries())).select("config", r6("avg_precision").alias("avg_precision"))


@query("U4_comparison", "SELECT config, round(avg(relevant), 6) AS avg_precision FROM labelled GROUP BY config UNION ALL SELECT 'existing:' || username, round(sum(p) / 5, 6) FROM (SELECT username, query, count(DISTINCT creator) FILTER (label = 'good') / 10.0 AS p FROM aliased GROUP BY username, query) GROUP BY username HAVING count(*) = 5")
def _(t: Inputs) -> DataFrame:
    average = evaluate.avg_precision(evaluate.precision_at_k(t.labels()), t.configs(), t.queries())
    own = evaluate.feedback_average(evaluate.feedback_precision(feedback.alias_feedback(feedback.feedback(t.interactions(), feedback.EVALUATION_CAP), t.aliases())), len(NAMES))
    return evaluate.comparison(average, own).withColumn("avg_precision", r6("avg_precision"))


# ---- clustering --------------------------------------------------------------------------------------------------

_KS = list(range(3, 16))


@query("C1_ward_cluster")
def _(t: Inputs) -> DataFrame:
    return cluster.ward_clusters(t.entries(), [10]).select("creator", F.col("cluster_10").alias("cluster_id"))


@query("S12_clusters_csv")
def _(t: Inputs) -> DataFrame:
    rows = cluster.ward_clusters(t.entries(), [10]).select("creator", F.col("cluster_10").alias("cluster_id"))
    return files.read_csv(t.spark, files.write_csv(rows, files.shared_path(t.spark, "clusters")), schemas.CLUSTERS)


@query("C2_W7_k_sweep")
def _(t: Inputs) -> DataFrame:
    return cluster.best_k(cluster.k_sweep(cluster.ward_clusters(t.entries(), _KS), _KS)).withColumn("silhouette", r6("silhouette"))


@query("A12_silhouette")
def _(t: Inputs) -> DataFrame:
    rows = cluster.ward_clusters(t.entries(), [5, 10])
    return cluster.k_sweep(rows, [5, 10]).withColumn("silhouette", r6("silhouette"))


@query("A11_cluster_sizes", "SELECT label AS cluster_id, count(*) AS size, min(count(*)) OVER () AS min_size FROM embeddings GROUP BY label")
def _(t: Inputs) -> DataFrame:
    return cluster.cluster_sizes(t.table("embeddings"), "label")


@query("J12_A13_dominant_share", f"SELECT query, cluster_id, share FROM (SELECT h.query, e.label AS cluster_id, 100.0 * count(*) / 10 AS share, row_number() OVER (PARTITION BY h.query ORDER BY count(*) DESC, e.label) AS k FROM hits30 h JOIN creators c USING (creator) JOIN embeddings e ON e.vec_id = 5 * c.i WHERE h.rank <= 10 GROUP BY h.query, e.label) WHERE k = 1")
def _(t: Inputs) -> DataFrame:
    known = t.table("embeddings").filter("vec_id % 5 = 0").select(t.name((F.col("vec_id") / 5).cast("long")).alias("creator"), F.col("label").alias("cluster_id"))
    return cluster.dominant_share(search.search(t.entries(), t.queries(), 10), known)


@query("C3_cluster_report")
def _(t: Inputs) -> DataFrame:
    """Clusters of the index fused with the winner's weights, at the best k of the sweep; what cluster each query's hits are in most."""
    average = evaluate.avg_precision(evaluate.precision_at_k(t.labels()), t.configs(), t.queries())
    winner = evaluate.pick_winner(average).join(t.configs(), "config").first()  # one row
    fused = t.embeddings().filter(index.vectors_ok()).withColumn("combined", vx.fuse(F.col("img"), F.col("txt"), winner.image_weight, winner.text_weight))
    entries = files.kept(fused.select("creator", "combined"), "entries")
    clustered = files.kept(cluster.ward_clusters(entries, _KS), "clusters")
    k = cluster.best_k(cluster.k_sweep(clustered, _KS)).filter("best").first().k
    return cluster.dominant_share(search.search(entries, t.queries(), 10), clustered.select("creator", F.col(f"cluster_{k}").alias("cluster_id")))


@query(
    "A12_silhouette_of_labels",
    """SELECT CAST(0 AS INT) AS k, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS min_size FROM (
  SELECT u.vec_id, any_value(u.n) AS n, any_value(CASE WHEN u.n > 1 THEN (u.n - list_dot_product(u.v, o.s)) / (u.n - 1) END) AS a, min(1 - list_dot_product(u.v, c.s) / c.n) AS b
  FROM (SELECT vec_id, x.label, v, n FROM units x JOIN sums USING (label)) u JOIN sums o ON o.label = u.label JOIN sums c ON c.label <> u.label GROUP BY u.vec_id)""",
    "sums",
)
def _(t: Inputs) -> DataFrame:
    """The silhouette of the given labels as clusters of all vectors."""
    rows = t.table("embeddings").select(array_to_vector(vx.unit(vx.as_double(F.col("embedding")))).alias("features"), F.col("label").alias("cluster_0"))
    return cluster.k_sweep(rows, [0]).withColumn("silhouette", r6("silhouette"))


@query("S12_clusters_of_labels", "SELECT creator, label AS cluster_id FROM creators JOIN embeddings ON vec_id = 5 * i", "creators")
def _(t: Inputs) -> DataFrame:
    """Given clusters written to CSV and read back."""
    rows = t.table("embeddings").filter("vec_id % 5 = 0").select(t.name((F.col("vec_id") / 5).cast("long")).alias("creator"), F.col("label").cast("int").alias("cluster_id"))
    return files.read_csv(t.spark, files.write_csv(rows, files.shared_path(t.spark, "clusters")), schemas.CLUSTERS)


@query(
    "W7_best_k",
    """SELECT k, silhouette, min_size, min_size < 5 AS degenerate, row_number() OVER (ORDER BY CASE WHEN min_size < 5 AND any_ok THEN 1 ELSE 0 END, silhouette DESC, k) = 1 AS best
FROM (SELECT *, bool_or(min_size >= 5) OVER () AS any_ok FROM (SELECT CAST(user_id % 97 AS INT) AS k, round(avg(value), 3) AS silhouette, min(event_id % 11) AS min_size FROM events GROUP BY user_id % 97))""",
)
def _(t: Inputs) -> DataFrame:
    """The rule of the best k over a table of scores, here made of the events."""
    scores = t.table("events").groupBy((F.col("user_id") % 97).cast("int").alias("k")).agg(F.round(F.avg("value"), 3).alias("silhouette"), F.min(F.col("event_id") % 11).alias("min_size"))
    return cluster.best_k(scores)


@query(
    "W1_block_search",
    "SELECT query, CAST(rank AS INT) AS rank, creator, round(score, 6) AS score FROM (SELECT q.vec_id AS query, creator, list_dot_product(combined, CAST(q.embedding AS DOUBLE[])) AS score, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(combined, CAST(q.embedding AS DOUBLE[])) DESC, creator) AS rank FROM entries, embeddings q) WHERE rank <= 10",
    "entries",
)
def _(t: Inputs) -> DataFrame:
    """All vectors as queries over a written block index."""
    blocks = files.kept(search.block_index(t.entries(), 64, 128), "blocks")
    asked = t.table("embeddings").select(F.col("vec_id").cast("string").alias("query"), vx.as_double(F.col("embedding")).alias("q"))
    return search.search_blocks(blocks, asked, 10)[0].select(F.col("query").cast("long").alias("query"), "rank", "creator", r6("score").alias("score"))


# ---- reports -----------------------------------------------------------------------------------------------------

_RATE = "CASE WHEN max(stop) - min(start) > 0 THEN round(count(DISTINCT item) / (max(stop) - min(start)), 3) ELSE 0 END"


@query("A14_run_metrics", f"SELECT run, stage, count(DISTINCT item) AS items, round(avg(stop - start), 2) AS mean_sec, round(max(stop) - min(start), 2) AS wall_sec, {_RATE} AS items_per_sec FROM stage_log GROUP BY run, stage")
def _(t: Inputs) -> DataFrame:
    return report.run_metrics(t.stage_log())


@query("A17_mean_load", "SELECT event_type, coalesce(round(avg(value), 1), 0) AS mean_cpu FROM events GROUP BY event_type")
def _(t: Inputs) -> DataFrame:
    return report.mean_load(t.table("events").withColumn("cpu", F.col("value")), "event_type")


@query("W6_speedup", "SELECT run, stage, CASE WHEN w > 0 THEN round(first_value(w) OVER (PARTITION BY stage ORDER BY run) / w, 2) ELSE 0 END AS speedup FROM (SELECT run, stage, round(max(stop) - min(start), 2) AS w FROM stage_log GROUP BY run, stage)")
def _(t: Inputs) -> DataFrame:
    return report.speedup(report.run_metrics(t.stage_log())).select("run", "stage", "speedup")


# ---- streaming ---------------------------------------------------------------------------------------------------


def _texts_stream(t: Inputs) -> tuple[DataFrame, str]:
    path = files.shared_path(t.spark, "arrivals")
    t.video_texts().select("mp4", "creator", "text", "doc_id").repartition(4, "doc_id").drop("doc_id").write.parquet(path)
    return ingest.stream_source(t.spark, path, "mp4 string, creator string, text string", 1), path


@query("R1_R2_R3_complete_groups", "SELECT creator, md5(transcription) AS digest, true AS complete FROM texts")
def _(t: Inputs) -> DataFrame:
    stream, path = _texts_stream(t)
    out = files.shared_path(t.spark, "groups")
    expected = files.kept(ingest.expected_counts(t.video_texts()), "expected")  # every batch joins it
    ingest.run_available(ingest.complete_groups(stream, expected), out, files.shared_path(t.spark, "state"))
    return t.spark.read.schema("creator string, transcription string, complete boolean").parquet(out).select("creator", F.md5("transcription").alias("digest"), "complete")


@query("R5_feedback_stream", "SELECT username, lower(coalesce(label, 'good')) AS label, count(*) AS n FROM interactions WHERE liked_creator <> '' GROUP BY ALL")
def _(t: Inputs) -> DataFrame:
    path, out = files.shared_path(t.spark, "clicks"), files.shared_path(t.spark, "stored")
    t.interactions().drop("event_id").repartition(4).write.parquet(path)
    ingest.feedback_stream(ingest.stream_source(t.spark, path, schemas.INTERACTIONS, 2), out, files.shared_path(t.spark, "state"))
    return t.spark.read.schema(schemas.INTERACTIONS).parquet(out).groupBy("username", "label").agg(F.count("*").alias("n"))


@query("R2_expected_counts", "SELECT creator, CAST(count(DISTINCT mp4) AS INT) AS expected FROM video_texts GROUP BY creator")
def _(t: Inputs) -> DataFrame:
    return ingest.expected_counts(t.video_texts())


@query("R4_index_upsert", f"SELECT creator, {_TOTAL.format('combined')} AS combined FROM entries WHERE creator IN ({_MEANINGFUL})")
def _(t: Inputs) -> DataFrame:
    stream, _ = _texts_stream(t)
    out = files.shared_path(t.spark, "upserts")
    embeddings, expected = files.kept(t.embeddings(), "embeddings"), files.kept(ingest.expected_counts(t.video_texts()), "expected")  # every batch joins them
    groups = ingest.complete_groups(stream, expected)
    build = lambda batch: index.build_index(embeddings, batch.select("creator", "transcription")).select("creator", "combined")
    ingest.index_merge(groups, build, out, files.shared_path(t.spark, "state"), buckets=8)
    return versioned.read(t.spark, out).select("creator", total(F.col("combined")).alias("combined"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["W1_search"](spark, sf_dir)


from . import stored  # noqa: E402, F401  the queries of stored tables and streams register themselves
