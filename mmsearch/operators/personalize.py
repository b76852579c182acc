"""Re-ranking by feedback, for a table of (username, query) pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.files import kept


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def _mean(vectors: str):
    every = F.col(vectors)
    total = F.aggregate(F.slice(every, 2, F.size(every)), every[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(every))


def feedback_vectors(fb: DataFrame, entries: DataFrame, most: int = 10) -> DataFrame:
    """(username, query, label, v): mean vector of the first ``most`` rows a label; a row without a vector uses up its place.

    The mean of a candidate's similarities is its similarity to the mean, so a candidate needs one product a label.
    """
    chosen = first_n(fb, ["username", "query", "label"], ["n"], most).join(entries.select("creator", F.col("combined").alias("v")), "creator")
    return chosen.groupBy("username", "query", "label").agg(F.collect_list("v").alias("vectors")).select("username", "query", "label", _mean("vectors").alias("v"))


#: Rows of a pool with their vectors that are broadcast; a larger pool is joined by shuffle, each query in SALTS parts by user.
POOL_ROWS = 5_000
SALTS = 16


def personalize(pool: DataFrame, fb: DataFrame, entries: DataFrame, most: int = 10, requests: DataFrame | None = None) -> DataFrame:
    """Candidates (query, rank, creator, score) re-scored for each distinct (username, query) of requests.

    Without requests, every pair that gave feedback is one. A pair without feedback gets its pool at 0.7.

    0.7 * score + 0.25 * mean similarity to liked - 0.25 * mean similarity to disliked creators; a term is
    absent without usable feedback, the 0.7 stays. Negative means flip their sign.
    """
    v = feedback_vectors(fb, entries, most).groupBy("username", "query").agg(F.first(F.when(F.col("label") == "good", F.col("v")), True).alias("good"), F.first(F.when(F.col("label") == "bad", F.col("v")), True).alias("bad"))
    asked = (fb if requests is None else requests).select("username", "query").distinct()
    # A pool row gets its vector once, not once a user; users then meet the few rows of their query.
    known = kept(pool.join(entries.select("creator", "combined"), "creator"), "pool")
    rows = asked.join(v, ["username", "query"], "left")
    if known.limit(POOL_ROWS + 1).count() <= POOL_ROWS:
        rows = rows.join(F.broadcast(known), "query")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("username"), F.lit(SALTS)).cast("int")).join(salted, ["query", "salt"])
    near = lambda v: F.coalesce(dot(F.col("combined"), v), F.lit(0.0)) * 0.25
    rows = rows.withColumn("boost", near(F.col("good"))).withColumn("penalty", near(F.col("bad")))
    return rows.select(
        "username", "query", "creator", F.col("rank").alias("original_rank"), F.col("score").alias("original_score"), (F.col("score") * 0.7 + F.col("boost") - F.col("penalty")).alias("score"),
        F.col("boost").alias("similarity_boost"), F.col("penalty").alias("similarity_penalty"), (F.col("boost") > 0.05).alias("is_boosted"), (F.col("penalty") > 0.05).alias("is_penalized"),
    )


def rerank(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best k of a (username, query) by the new score; ties keep their first rank."""
    w = Window.partitionBy("username", "query").orderBy(F.desc("score"), "original_rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def new_and_removed(reranked: DataFrame, plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(username, query, creator) only in the personalised, and only in the plain top k."""
    mine = reranked.select("username", "query", "creator")
    base = mine.select("username", "query").distinct().join(plain.select("query", "creator"), "query").select("username", "query", "creator")
    return mine.exceptAll(base), base.exceptAll(mine)


def stats(reranked: DataFrame, plain: DataFrame) -> DataFrame:
    """A10: per (username, query) what personalisation changed. A hit of both lists is matched once, so one pass over either does."""
    base = plain.select("query", "creator").withColumn("both", F.lit(True))
    sizes = plain.groupBy("query").agg(F.count("*").alias("n_plain"))
    both = F.coalesce("both", F.lit(False))
    out = reranked.join(base, ["query", "creator"], "left").groupBy("username", "query").agg(
        F.count_if("is_boosted").alias("boosted_creators"), F.count_if("is_penalized").alias("penalized_creators"), F.avg(F.col("similarity_boost") - F.col("similarity_penalty")).alias("avg_adjustment"),
        F.count_if(~both).alias("new_creators"), F.count_if(both).alias("matched"),
    )
    return out.join(sizes, "query").withColumn("removed_creators", F.col("n_plain") - F.col("matched")).select("username", "query", "boosted_creators", "penalized_creators", "avg_adjustment", "new_creators", "removed_creators")


def attach_frames(hits: DataFrame, frames: DataFrame, n: int = 3) -> DataFrame:
    """Up to n frame paths, in order, of every image type; none: an empty list."""
    few = first_n(frames, ["creator"], ["frame_path"], n).groupBy("creator").agg(F.array_sort(F.collect_list("frame_path")).alias("frames"))
    return hits.join(few, "creator", "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<string>")))
