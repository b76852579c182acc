"""Precision at k and the winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import crossed


def apply_judgments(labels: DataFrame, judgments: DataFrame) -> DataFrame:
    """Fills blank labels from (query, creator, judged); adds filled."""
    out = labels.join(judgments, ["query", "creator"], "left")
    return out.withColumn("filled", F.col("relevant").isNull() & F.col("judged").isNotNull()).withColumn("relevant", F.coalesce("relevant", "judged")).drop("judged")


def validate_labels(labels: DataFrame) -> DataFrame:
    """labels unchanged; raises with the first blank row."""
    bad = labels.filter("relevant is null").orderBy("config", "query", "rank").first()
    if bad is not None:
        raise ValueError(f"row not labelled: config={bad.config}, query={bad.query}, creator={bad.creator}")
    return labels


def precision_at_k(labels: DataFrame) -> DataFrame:
    """A4: relevant over labelled rows of each (config, query)."""
    return labels.groupBy("config", "query").agg((F.sum("relevant") / F.count("*")).alias("precision"))


def avg_precision(precision: DataFrame, configs: DataFrame, queries: DataFrame) -> DataFrame:
    """A5: (config_pos, config, avg_precision); a query without rows counts 0."""
    grid = crossed(configs.select("config_pos", "config"), queries.select("query"), F.length("query"))
    return grid.join(precision, ["config", "query"], "left").groupBy("config_pos", "config").agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("avg_precision"))


def precision_table(precision: DataFrame, queries: list[str]) -> DataFrame:
    """A row a config, a column a query."""
    return precision.groupBy("config").pivot("query", queries).agg(F.first("precision")).na.fill(0.0)


def feedback_precision(fb: DataFrame, k: int = 10) -> DataFrame:
    """(username, query, precision): distinct liked creators over k; from alias_feedback rows."""
    return fb.groupBy("username", "query").agg((F.count_distinct(F.when(F.col("label") == "good", F.col("creator"))) / k).alias("precision"))


def feedback_average(precision: DataFrame, n_queries: int) -> DataFrame:
    """(username, average); only users with feedback for all queries."""
    return precision.groupBy("username").agg(F.when(F.count("*") == n_queries, F.sum("precision") / n_queries).alias("average"))


def pick_winner(average: DataFrame) -> DataFrame:
    """The best config, the first in list order on ties."""
    return average.orderBy(F.desc("avg_precision"), "config_pos").limit(1)


def comparison(average: DataFrame, feedback: DataFrame) -> DataFrame:
    """U4: config averages, and each complete feedback average under ``existing:<user>``."""
    rows = feedback.filter("average is not null").select(F.concat(F.lit("existing:"), "username").alias("config"), F.col("average").alias("avg_precision"))
    return average.select("config", "avg_precision").unionByName(rows)
