"""What to fetch and which profiles match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import profile_url, video_url
from ..sources.files import last_wins

SITE = "https://video.example"


def creators_to_fetch(profiles: DataFrame, done: DataFrame, n: int, least: int = 10) -> DataFrame:
    """more than ``least`` videos, not done yet, the first n in input order (column pos)."""
    left = profiles.filter(F.col("video_count") > least).join(done, profiles.username == done.creator, "left_anti")
    return left.orderBy("pos").limit(n)


def fetch_budget(videos: DataFrame, target: int, per_creator: int) -> DataFrame:
    """(existing, needed, creators)."""
    counted = videos.agg(F.count("*").alias("existing")).withColumn("needed", F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("existing")))
    return counted.withColumn("creators", F.ceil(F.col("needed") / per_creator))


def select_videos(profiles: DataFrame, lo: float = 10, hi: float = 50, most: int = 3) -> DataFrame:
    """(username, pick, video_id, duration, url, path): both lists zipped to the shorter, durations in [lo, hi], first ``most``.

    Lists are parsed as data, never evaluated; a null duration fails.
    """
    ids, durations = F.from_json("video_ids", "array<string>"), F.from_json("video_durations_list", "array<double>")
    pairs = F.arrays_zip(ids.alias("video_id"), durations.alias("duration"))
    kept = F.slice(F.filter(pairs, lambda p: p["video_id"].isNotNull() & F.coalesce(p["duration"].between(lo, hi), F.lit(False))), 1, most)
    rows = profiles.select("username", F.posexplode(kept).alias("pick", "v"))
    return rows.select("username", "pick", "v.video_id", "v.duration", video_url(SITE, F.col("username"), F.col("v.video_id")).alias("url"), F.concat(F.lit("media/"), "username", F.lit("/"), "v.video_id", F.lit(".mp4")).alias("path"))


def match_profiles(creators: DataFrame, export: DataFrame) -> DataFrame:
    """Creators (pos, creator) with their profile, trimmed and case-insensitive; the export's last row of a name wins."""
    right = last_wins(export.withColumn("__k", F.lower(F.btrim("username"))), ["__k"], "pos").drop("pos")
    return creators.withColumn("__k", F.lower(F.btrim("creator"))).join(right, "__k").withColumn("tiktok_url", profile_url(SITE, F.col("username"))).drop("__k")


def missing_profiles(creators: DataFrame, export: DataFrame) -> DataFrame:
    """Creators without a profile."""
    right = export.select(F.lower(F.btrim("username")).alias("__k"))
    return creators.withColumn("__k", F.lower(F.btrim("creator"))).join(right, "__k", "left_anti").drop("__k")


def recycle_to_target(videos: DataFrame, n: int, order: str = "mp4") -> DataFrame:
    """The ordered videos repeated cyclically to n rows (slot, then videos' columns); no videos: no rows.

    Copies of a video come from a sequence of its own slots; numbering runs over partition ranges.
    """
    from pyspark.sql import Window

    total = videos.agg(F.count("*").alias("__total"))
    ranged = videos.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    numbered = ranged.join(F.broadcast(before), "__p").crossJoin(F.broadcast(total)).withColumn("__i", F.col("__before") + F.col("__r"))
    slots = F.when(F.col("__i") < n, F.sequence(F.col("__i"), F.lit(n - 1).cast("long"), F.col("__total")))
    return numbered.select(F.explode(slots).alias("slot"), *videos.columns)


def corpus_counts(videos: DataFrame) -> DataFrame:
    """(creator, videos, total, creators)."""
    per = videos.groupBy("creator").agg(F.count("*").alias("videos"))
    return per.crossJoin(F.broadcast(videos.agg(F.count("*").alias("total"), F.countDistinct("creator").alias("creators"))))
