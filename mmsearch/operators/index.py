"""Pooling, gates, the index and search documents."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, strip
from ..functions.vectors import fuse, norm, unit, weigh
from ..sources.files import last_wins, read_index, write_index


def pool_frames(frames: DataFrame, creators: DataFrame, dims: int) -> DataFrame:
    """A1: (creator, img): mean of unit frame vectors, not normalised again; zeros where no frame decodes.

    One vector aggregate with partial sums before the shuffle, whatever the dimensions; no explode.
    """
    unit_frames = frames.filter("v is not null").select("creator", array_to_vector(unit(F.col("v"), 1e-8)).alias("u"))
    pooled = unit_frames.groupBy("creator").agg(Summarizer.mean(F.col("u")).alias("m")).select("creator", vector_to_array("m").alias("img"))
    zeros = F.array_repeat(F.lit(0.0), dims)
    return creators.select("creator").join(pooled, "creator", "left").select("creator", F.coalesce("img", zeros).alias("img"))


def usable_frames(frames: DataFrame, texts: DataFrame, drop_silent_frames: bool = False) -> DataFrame:
    """Frames (mp4, ...) that are pooled: all, or with drop_silent_frames only those of videos with a text (mp4, text)."""
    if not drop_silent_frames:
        return frames
    return frames.join(texts.filter(F.length(strip(F.coalesce("text", F.lit("")))) > 0).select("mp4").distinct(), "mp4", "left_semi")


def vectors_ok(eps: float = 0.01) -> Column:
    """image, text and fused (before normalisation) norms all above eps."""
    img, txt = F.col("img"), F.col("txt")
    return (norm(img) > eps) & (norm(txt) > eps) & (norm(weigh(img, txt, 0.85, 0.15)) > eps)


def nonzero_ok() -> Column:
    """the looser gate of search documents."""
    return (norm(F.col("img")) > 0) & (norm(F.col("txt")) > 0)


def build_index(embeddings: DataFrame, texts: DataFrame, wi: float = 0.85, wt: float = 0.15) -> DataFrame:
    """(creator, img, txt, combined) that pass F4 and F6; texts: (creator, transcription)."""
    from .transcripts import text_gate

    good = text_gate(texts, "transcription").filter("meaningful").select("creator")
    return embeddings.filter(vectors_ok()).join(good, "creator", "left_semi").withColumn("combined", fuse(F.col("img"), F.col("txt"), wi, wt))


def rebuild_index(spark, path: str, wi: float = 0.85, wt: float = 0.15) -> None:
    """The index anew from its own stored vectors with other weights, as the next version in the same place; readers of the present one go on."""
    stored = read_index(spark, path)
    write_index(stored.filter(vectors_ok()).withColumn("combined", fuse(F.col("img"), F.col("txt"), wi, wt)), path)


def gate_report(embeddings: DataFrame, texts: DataFrame) -> DataFrame:
    """(creator, reason) of what the gates drop, vectors first."""
    from .transcripts import text_gate

    judged = embeddings.withColumn("v", vectors_ok()).select("creator", "v").join(text_gate(texts, "transcription").select("creator", "meaningful"), "creator", "left")
    reason = F.when(~F.col("v"), "vector").when(~F.coalesce("meaningful", F.lit(False)), "text")
    return judged.select("creator", reason.alias("reason")).filter("reason is not null")


def attach_transcription(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Left join on creator, default empty, last row of a creator wins (column pos)."""
    return df.join(last_wins(texts, ["creator"], "pos").select("creator", "transcription"), "creator", "left").withColumn("transcription", F.coalesce("transcription", F.lit("")))


def attach_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join creator = username, counts default 0. A repeated username fails the query."""
    one = profiles.groupBy("username").agg(F.first("follower_count").alias("follower_count"), F.first("video_count").alias("video_count"), F.count("*").alias("__n"))
    one = one.withColumn("follower_count", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated username: "), "username")).cast("long")).otherwise(F.col("follower_count"))).drop("__n")
    joined = df.join(one, df.creator == one.username, "left").drop("username")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("follower_count", "video_count")})


def attach_media(texts: DataFrame, frames: DataFrame) -> DataFrame:
    """(creator, transcription, frames) sorted by creator; no frame: empty list."""
    lists = frames.groupBy("creator").agg(F.array_sort(F.collect_list("frame_path")).alias("frames"))
    return texts.join(lists, "creator", "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<string>"))).orderBy("creator")


def lookup_vector(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(creator, combined) of the names that exist."""
    return names.select("creator").join(entries.select("creator", "combined"), "creator")


def browse_docs(docs: DataFrame, n: int = 100, chars: int = 100) -> DataFrame:
    """The first n documents by name with a preview, and the number of all."""
    first = docs.orderBy("username").limit(n).select("username", preview(F.col("transcription"), chars).alias("preview"))
    return first.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))


def index_stats(embeddings: DataFrame) -> DataFrame:
    """(indexed, skipped) under F5."""
    ok = embeddings.select(nonzero_ok().alias("ok"))
    return ok.agg(F.count_if("ok").alias("indexed"), F.count_if(~F.col("ok")).alias("skipped"))
