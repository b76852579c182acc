"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, targets fill up by weight under a cap, and a source's repetition rate is
target over size. A document is taken floor(rate) times, and once more if its seeded hash, uniform in
[0, 1), is under the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, materialize

WORD = r"[^ \t-\r]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """Uniform in [0, 1), fixed by key and seed: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def before(table: DataFrame, order: list[Column], values: dict[str, Column], few: bool) -> DataFrame:
    """table with, per name, the sum of its value over the rows before in ``order``, which tells all rows apart.

    few: one window over all rows. Else rows go to ranges of the order, each with a window of its own, and the
    sums of the ranges before, one row a range, are added.
    """
    none = lambda v: F.coalesce(v, F.lit(0))
    own = Window.orderBy(*order) if few else Window.partitionBy("__range").orderBy(*order)
    own = own.rowsBetween(Window.unboundedPreceding, -1)
    if few:
        return table.withColumns({n: none(F.sum(v).over(own)) for n, v in values.items()})
    ranges = materialize(table.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("__range").agg(*(F.sum(v).alias(f"__{n}") for n, v in values.items()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", *(none(F.sum(f"__{n}").over(earlier)).alias(f"__{n}") for n in values))
    summed = ranges.join(F.broadcast(sums), "__range").withColumns({n: none(F.sum(v).over(own)) + F.col(f"__{n}") for n, v in values.items()})
    return summed.drop("__range", *(f"__{n}" for n in values))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, few: bool = True) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size), one row a source, null last.

    Sources in code point order weigh weights[0], weights[1], ..., repeating. They share the sum of all
    sizes by weight; a target stops at cap times its source's size and the excess is shared again. With
    ratios cap * size / weight ascending, the capped sources are a prefix: a source is capped if its ratio is
    at most the level that the rest would get, which running sums tell without a loop.

    few: the sources fit one task's window (see ``before``); false for domains or users as sources.
    """
    name = F.col("source").asc_nulls_last()
    t = before(sizes.select("source", "source_size"), [name], {"place": F.lit(1)}, few)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double")
    most = F.lit(cap) * F.col("source_size")
    t = t.withColumn("w", w).withColumn("ratio", most / F.col("w"))
    t = before(t, [F.col("ratio").asc(), name], {"before": most, "lighter": F.col("w")}, few)
    if few:
        every = Window.partitionBy()
        size, weight = F.sum("source_size").over(every), F.sum("w").over(every)
    else:
        t = materialize(t, "sources")
        size, weight = map(F.lit, t.agg(F.sum("source_size"), F.sum("w")).first())
    t = t.withColumn("level", (size - F.col("before")) / (weight - F.col("lighter"))).withColumn("open", F.col("ratio") > F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct("ratio", "level")))
    if few:
        final = first.over(Window.partitionBy())["level"]
    else:
        final = F.lit(t.agg(first["level"]).first()[0]).cast("double")
    t = t.withColumn("final", final)
    return t.select("source", "source_size", F.when(F.col("final").isNull() | ~F.col("open"), most.cast("double")).otherwise(F.col("w") * F.col("final")).alias("target"))


def _rates(docs: DataFrame, weights, cap: int, seed: int) -> DataFrame:
    """docs with __size, __source_size, __target and __copies."""
    docs = docs.withColumn("__size", n_words(F.col("text").cast("string"))).withColumn("__source", F.col("source").cast("string"))
    sizes = docs.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    few = docs.select("__source").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sizes = sizes if few else materialize(sizes, "sizes")
    table = targets(sizes, weights, cap, few).select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    joined = docs.join(F.broadcast(table) if few else table, F.col("__source").eqNullSafe(F.col("__of")))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("__copies", F.floor(rate) + extra)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of docs (columns doc_id, text, source).

    size: words of the text, null: 0. Null source: a source of its own, last. A source without words has
    target 0 and gives nothing. Null doc_id draws by its text; rows that repeat a doc_id share its draw.
    Empty table: empty result.
    """
    t = _rates(docs.select("doc_id", "text", "source"), weights, cap, seed)
    return t.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """docs' rows, each as often as the mix takes it, with docs' own columns (see ``mix_sizes``), whatever their names."""
    own = {f"__own{k}": c for k, c in enumerate(docs.columns)}
    needed = docs.select("doc_id", "text", "source", *(F.col(f"`{c}`").alias(k) for k, c in own.items()))
    t = _rates(needed, weights, cap, seed).filter("__copies > 0")
    t = t.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return t.select(*(F.col(k).alias(c) for k, c in own.items()))
