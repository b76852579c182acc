"""Feedback selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_query

#: Rows of a user that the evaluation reads; the app reads the default of feedback().
EVALUATION_CAP = 1000


def label_of(label: Column) -> Column:
    """``bad`` in any case is bad; anything else, null too, is good."""
    return F.when(F.lower(label) == "bad", "bad").otherwise("good")


def user_rows(interactions: DataFrame, cap: int = 500) -> DataFrame:
    """F8 for all users at once: the first ``cap`` rows of each user by time and id, three columns and the user."""
    w = Window.partitionBy("username").orderBy("timestamp", "event_id")
    return interactions.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).select("username", "n", "liked_creator", "query_context", "label")


def feedback(interactions: DataFrame, cap: int = 500) -> DataFrame:
    """F8 + F9's key + F10: (username, n, query, creator, label); rows without a creator are dropped."""
    rows = user_rows(interactions, cap).filter("liked_creator <> ''")
    return rows.select("username", "n", normalize_query(F.col("query_context")).alias("query"), F.col("liked_creator").alias("creator"), label_of(F.col("label")).alias("label"))


def for_query(fb: DataFrame, query: str) -> DataFrame:
    """feedback given for one query."""
    return fb.filter(F.col("query") == normalize_query(F.lit(query)))


def alias_feedback(fb: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (username, query, label, creator) under each test query's aliases (query, aliases)."""
    keys = aliases.select(F.col("query").alias("test"), F.explode("aliases").alias("a")).select("test", normalize_query(F.col("a")).alias("query"))
    return fb.join(keys, "query").select("username", F.col("test").alias("query"), "label", "creator").distinct()


def feedback_counts(interactions: DataFrame) -> DataFrame:
    """(username, liked, disliked) over all queries, repeats counted."""
    rows = feedback(interactions)
    return rows.groupBy("username").agg(F.count_if(F.col("label") == "good").alias("liked"), F.count_if(F.col("label") == "bad").alias("disliked"))


def feedback_map(fb: DataFrame) -> DataFrame:
    """(username, query, creator, label); bad overrides good."""
    return fb.groupBy("username", "query", "creator").agg(F.min("label").alias("label"))
