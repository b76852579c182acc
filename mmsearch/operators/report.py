"""Run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(n: Column, x: Column) -> Column:
    return F.when(x > 0, F.round(n / x, 3)).otherwise(F.lit(0.0))


def run_metrics(stage_log: DataFrame) -> DataFrame:
    """From (run, stage, item, start, end) in seconds: items, mean item time, wall time and items a second."""
    wall = F.max("end") - F.min("start")
    out = stage_log.groupBy("run", "stage").agg(F.countDistinct("item").alias("items"), F.round(F.avg(F.col("end") - F.col("start")), 2).alias("mean_sec"), wall.alias("__w"))
    return out.select("run", "stage", "items", "mean_sec", F.round("__w", 2).alias("wall_sec"), _rate(F.col("items"), F.col("__w")).alias("items_per_sec"))


def mean_load(samples: DataFrame, by: str) -> DataFrame:
    """Mean of cpu, 0 without samples, one decimal."""
    return samples.groupBy(by).agg(F.coalesce(F.round(F.avg("cpu"), 1), F.lit(0.0)).alias("mean_cpu"))


def speedup(runs: DataFrame) -> DataFrame:
    """Wall of the first run over this run's, two decimals; 0 for a wall of 0. One row a run."""
    first = F.first_value("wall_sec").over(Window.partitionBy("stage").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("speedup", F.when(F.col("wall_sec") > 0, F.round(first / F.col("wall_sec"), 2)).otherwise(F.lit(0.0)))
