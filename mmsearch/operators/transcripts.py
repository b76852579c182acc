"""From recognised segments to one text a creator."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS, exact_top_share, strip, word_counts


def segment_ok(ns: float | None = 0.6, lp: float | None = -1.0, cr: float | None = 2.4) -> Column:
    """silence needs a high no_speech_prob and no confident text; repetition a high compression ratio. None: check off."""
    ok = F.coalesce(F.length(strip(F.col("text"))) > 0, F.lit(False))
    if ns is not None:
        silent = F.col("no_speech_prob") > ns
        ok &= ~(silent if lp is None else silent & ~(F.col("avg_logprob") > lp))
    return ok if cr is None else ok & ~(F.col("compression_ratio") > cr)


def _joined(order: str, text: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), " ")


def join_chunks(segments: DataFrame) -> DataFrame:
    """A2: (mp4, text) from kept segments: by segment within a chunk, non-empty chunks by index."""
    per_chunk = segments.groupBy("mp4", "chunk_idx").agg(_joined("seg_idx", "text").alias("text")).filter("text <> ''")
    return per_chunk.groupBy("mp4").agg(_joined("chunk_idx", "text").alias("text"))


def creator_text(videos: DataFrame, texts: DataFrame) -> DataFrame:
    """A3: (creator, transcription): video texts in path order; a missing one is empty, so double blanks stay."""
    rows = videos.select("mp4", "creator").join(texts.select("mp4", "text"), "mp4", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy("creator").agg(_joined("mp4", "text").alias("transcription"))


def text_gate(df: DataFrame, text: str = "text", min_chars: int = 50, max_ratio: float = 0.4) -> DataFrame:
    """adds n_chars, top_share and meaningful (long enough, and no token above max_ratio)."""
    df = df.withColumn("n_stripped", F.length(strip(F.coalesce(F.col(text), F.lit("")))).cast("long")).withColumn("top_share", exact_top_share(F.col(text)))
    return df.withColumn("meaningful", (F.col("n_stripped") >= min_chars) & F.coalesce(F.col("top_share") <= max_ratio, F.lit(False)))


#: Counters of a Misra-Gries summary: a token is counted too low by at most its creator's tokens / (COUNTERS + 1).
COUNTERS = 63
#: Creators whose summaries a task holds at a time.
HELD = 2000


def shrink(counts: Counter, most: int = COUNTERS) -> tuple[Counter, int]:
    """The Misra-Gries merge: at most ``most`` counters, all lowered by the greatest count left out; and by how much."""
    if len(counts) <= most:
        return counts, 0
    low = sorted(counts.values(), reverse=True)[most]
    return Counter({w: n - low for w, n in counts.items() if n > low}), low


def _summaries(batches):
    """(creator, total, lost, token, n): summaries of what the task reads; one row with a null token carries total and lost.

    A summary a creator and HELD creators: then all are given out and begun anew, as summaries merge by sums wherever they come from.
    """
    kept: dict[str, list] = {}
    for batch in batches:
        for creator, text in zip(batch.column("creator"), batch.column("lowered"), strict=True):
            creator, found = creator.as_py(), word_counts(text.as_py() or "")
            if creator not in kept and len(kept) >= HELD:
                yield _summary_rows(kept)
                kept = {}
            own = kept.setdefault(creator, [0, 0, Counter()])
            own[0] += found.total()
            own[2].update(found)
            own[2], low = shrink(own[2])
            own[1] += low
    yield _summary_rows(kept)


def _summary_rows(kept: dict[str, list]) -> pa.RecordBatch:
    rows = [(c, total, lost, None, 0) for c, (total, lost, _) in kept.items()] + [(c, 0, 0, w, n) for c, (_, _, counts) in kept.items() for w, n in counts.items()]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["creator", "total", "lost", "token", "n"])


def heavy_tokens(videos: DataFrame, max_ratio: float = 0.4) -> DataFrame:
    """(creator, token, share): the token that makes more than ``max_ratio`` (0.1 or more) of a creator's tokens over all its videos (creator, text).

    Each task sums up its videos in COUNTERS counters a creator; sums of the summaries decide but for creators whose heaviest token
    is within the summaries' error of the limit: only their videos are read again and counted exactly for those tokens. share is exact
    where the summaries lost nothing or were counted again, else at most the exact one.
    """
    if max_ratio < 0.1:
        raise ValueError("max_ratio must be 0.1 or more")
    lowered = videos.select("creator", F.lower("text").alias("lowered"))
    summed = lowered.mapInArrow(_summaries, "creator string, total long, lost long, token string, n long")
    by_token = summed.groupBy("creator", "token").agg(F.sum("total").alias("total"), F.sum("lost").alias("lost"), F.sum("n").alias("n"))
    per = by_token.groupBy("creator").agg(F.sum("total").alias("total"), F.sum("lost").alias("lost"), F.filter(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "token"))), lambda x: x.isNotNull()).alias("found"))
    limit = F.col("total") * max_ratio
    per = per.select("creator", "total", F.filter("found", lambda x: x["n"] + F.col("lost") > limit).alias("near"), "lost").filter(F.size("near") > 0)
    sure = per.filter((F.array_max("near")["n"] > limit) | (F.col("lost") == 0)).select("creator", F.array_max("near").alias("top"), "total")
    open_ = per.filter(~((F.array_max("near")["n"] > limit) | (F.col("lost") == 0))).select("creator", "total", F.transform("near", lambda x: x["token"]).alias("tokens"))
    again = lowered.join(open_, "creator").select("creator", "total", F.explode("tokens").alias("token"), "lowered")
    edge = f"[{WS_CHARS}]"
    times = F.size(F.filter(F.split("lowered", f"{edge}+"), lambda w: w == F.col("token")))
    counted = again.withColumn("n", times).groupBy("creator", "total", "token").agg(F.sum("n").alias("n")).groupBy("creator", "total").agg(F.max(F.struct("n", "token")).alias("top"))
    both = sure.unionByName(counted.select("creator", "top", "total"))
    return both.filter(F.col("top.n") > limit).select("creator", F.col("top.token").alias("token"), (F.col("top.n") / F.col("total")).alias("share"))


def creator_gate(videos: DataFrame, min_chars: int = 50, max_ratio: float = 0.4) -> DataFrame:
    """F6 on the text of each creator without joining it: (creator, n_stripped, meaningful) from its videos (mp4, creator, text; mp4 once a creator).

    The joined text has one blank between videos in path order. Its stripped length follows from the first and last video
    that isn't blank and sums over those between; heavy tokens from summaries.
    """
    text = F.coalesce("text", F.lit(""))
    sized = videos.select("creator", "mp4", F.length(text).cast("long").alias("n"), F.length(F.ltrim(text, F.lit(WS_CHARS))).cast("long").alias("rest"), F.length(F.rtrim(text, F.lit(WS_CHARS))).cast("long").alias("upto"))
    solid = F.col("rest") > 0
    ends = sized.groupBy("creator").agg(
        F.min(F.when(solid, F.struct("mp4", (F.col("n") - F.col("rest")).alias("cut")))).alias("first"), F.max(F.when(solid, F.struct("mp4", (F.col("n") - F.col("upto")).alias("cut")))).alias("last")
    )
    between = sized.join(ends, "creator").groupBy("creator", "first", "last").agg(F.sum(F.when(F.col("mp4").between(F.col("first.mp4"), F.col("last.mp4")), F.col("n") + 1)).alias("n"))
    stripped = F.coalesce(F.col("n") - 1 - F.col("first.cut") - F.col("last.cut"), F.lit(0))
    heavy = heavy_tokens(videos, max_ratio).select("creator", F.lit(True).alias("heavy"))
    judged = between.select("creator", stripped.alias("n_stripped")).join(heavy, "creator", "left")
    return judged.select("creator", "n_stripped", ((F.col("n_stripped") >= min_chars) & (F.col("n_stripped") > 0) & F.col("heavy").isNull()).alias("meaningful"))
