import numpy as np
import pytest

from mmsearch.functions import vectors as vx
from mmsearch.operators import search, sql
from pyspark.sql import functions as F


@pytest.fixture
def views(spark):
    rng = np.random.default_rng(9)
    entries = spark.createDataFrame([(f"c{n:02d}", rng.normal(size=4).tolist()) for n in range(40)], "creator string, combined array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{n}", rng.normal(size=4).tolist()) for n in range(7)], "query string, q array<double>")
    sql.register(spark)
    sql.pack_views(entries, queries)
    entries.createOrReplaceTempView("entries")
    queries.createOrReplaceTempView("queries")
    return entries, queries


def test_table_functions_give_the_rows_of_the_search(spark, views):
    want = sorted((r.query, r.rank, r.creator) for r in search.search(*views, 5).collect())
    packed = spark.sql("SELECT * FROM ranked(TABLE(SELECT * FROM nearest(TABLE(SELECT * FROM entry_packs CROSS JOIN query_packs), 5)), 5)")
    plain = spark.sql("SELECT * FROM ranked(TABLE(SELECT query, creator, dot(combined, q) AS score FROM entries CROSS JOIN queries), 5)")
    for found in (packed, plain):
        assert sorted((r.query, r.rank, r.creator) for r in found.collect()) == want and len(want) == 35


def test_vector_functions_equal_the_column_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [0.0, 0.0])], "img array<double>, txt array<double>")
    sql.register(spark)
    df.createOrReplaceTempView("pairs")
    got = spark.sql("SELECT dot(img, txt), norm(img), unit(img), fuse(img, txt, 0.5D, 0.25D) FROM pairs").collect()
    img, txt = F.col("img"), F.col("txt")
    assert list(map(tuple, got)) == list(map(tuple, df.select(vx.dot(img, txt), vx.norm(img), vx.unit(img), vx.fuse(img, txt, 0.5, 0.25)).collect()))


@pytest.mark.parametrize("text", ["SELECT * FROM ranked(TABLE(SELECT 1 AS query), 5)", "SELECT * FROM nearest(TABLE(SELECT * FROM entry_packs CROSS JOIN query_packs), 0)"])
def test_wrong_arguments_are_refused(spark, views, text):
    with pytest.raises(Exception, match="lacks creator, score|constant of 1 or more"):
        spark.sql(text).collect()
