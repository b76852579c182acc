"""The search as SQL: vector functions and table functions that take a table (section 2.11 of the survey).

    register(spark)
    pack_views(entries, queries)
    spark.sql("SELECT * FROM ranked(TABLE(SELECT * FROM nearest(TABLE(SELECT * FROM entry_packs CROSS JOIN query_packs), 10)), 10)")
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, SkipRestOfInputTableException

from .search import _best, packs

_VECTOR = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "dot": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "norm": (f"a {_VECTOR}", "DOUBLE", "sqrt(dot(a, a))"),
    "unit": (f"a {_VECTOR}", _VECTOR, "IF(norm(a) = 0, a, transform(a, x -> x / norm(a)))"),
    "fuse": (f"img {_VECTOR}, txt {_VECTOR}, wi DOUBLE, wt DOUBLE", _VECTOR, "unit(zip_with(img, txt, (x, y) -> wi * x + wt * y))"),
}


def _constant(k: AnalyzeArgument, function: str) -> None:
    if not k.isConstantExpression or not isinstance(k.value, int) or k.value < 1:
        raise ValueError(f"{function}: k must be a constant of 1 or more")


def _table(table: AnalyzeArgument, needed: list[str], function: str) -> None:
    names = table.dataType.fieldNames() if table.isTable else []
    if missing := [c for c in needed if c not in names]:
        raise ValueError(f"{function}: the table argument lacks {', '.join(missing)}")


class Nearest:
    """(query, creator, score): of pairs of packs the best k of each query that a task sees, scored exactly."""

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        _constant(k, "nearest")
        columns = ["creator_names", "combined_flat", "query_names", "q_flat"]
        _table(table, columns, "nearest")
        return AnalyzeResult(StructType().add("query", "string").add("creator", "string").add("score", "double"), select=[SelectedColumn(c) for c in columns])

    def __init__(self):
        self.found: dict[str, list] = {}

    def eval(self, row, k: int):
        creators = np.array(row["creator_names"], object)
        v, q = (np.array(row[c]).reshape(n, -1) for c, n in (("combined_flat", len(creators)), ("q_flat", len(row["query_names"]))))
        for name, one, near in zip(row["query_names"], q, q @ v.T, strict=True):
            both = self.found.get(name, []) + _best(near, v, one, creators, k)
            self.found[name] = sorted(both, key=lambda x: (-x[0], x[1]))[:k]

    def terminate(self):
        for name, best in self.found.items():
            for score, creator in best:
                yield name, creator, score


class Ranked:
    """(query, rank, creator, score): the first k rows of each query by score, then creator; what comes behind them isn't read."""

    @staticmethod
    def analyze(table: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        _constant(k, "ranked")
        columns = ["query", "creator", "score"]
        _table(table, columns, "ranked")
        return AnalyzeResult(
            StructType().add("query", "string").add("rank", "integer").add("creator", "string").add("score", "double"),
            partitionBy=[PartitioningColumn("query")],
            orderBy=[OrderingColumn("score", ascending=False), OrderingColumn("creator")],
            select=[SelectedColumn(c) for c in columns],
        )

    def __init__(self):
        self.n = 0

    def eval(self, row, k: int):
        self.n += 1
        if self.n > k:
            raise SkipRestOfInputTableException
        yield row["query"], self.n, row["creator"], row["score"]


def register(spark: SparkSession) -> None:
    """Temporary functions dot, norm, unit, fuse, and the table functions nearest(TABLE, k) and ranked(TABLE, k)."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("nearest", udtf(Nearest))
    spark.udtf.register("ranked", udtf(Ranked))


def pack_views(entries: DataFrame, queries: DataFrame) -> None:
    """Views entry_packs (creator_names, combined_flat) and query_packs (query_names, q_flat) of entries and queries."""
    held, asked = packs(entries, queries)
    held.createOrReplaceTempView("entry_packs")
    asked.createOrReplaceTempView("query_packs")
