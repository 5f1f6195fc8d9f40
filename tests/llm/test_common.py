import pytest
from pyspark.sql import functions as F

from siftstone.llm import common
from siftstone.llm.components import components


def test_row_ids_stay(spark, documents, odd):
    assert common.is_scan(documents) and common.is_scan(documents.select("doc_id").where("doc_id > 3")) and not common.is_scan(odd) and not common.is_scan(documents.groupBy("lang").count())
    a = common.with_rid(odd)
    assert [tuple(r) for r in a.select("rid", "doc_id").collect()] == [tuple(r) for r in a.select("rid", "doc_id").collect()]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_keys_are_joined_as_others(spark, how):
    left = spark.range(6000).select((F.col("id") % 2000 * (F.col("id") % 3 != 0).cast("int")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    right = left.where("k is not null and k != 7").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert right.where("n > 1000").count() == 1
    got = common.join_counted(left, right, "k", "n", left.count(), how)
    assert got.select(*sorted(got.columns)).exceptAll((w := left.join(right, "k", how)).select(*sorted(w.columns))).isEmpty() and got.count() == left.join(right, "k", how).count()


def test_picked_either_way(spark):
    df, ids = spark.range(10).withColumnRenamed("id", "rid"), spark.range(3).withColumnRenamed("id", "rid")
    for most in (100, 0):
        assert common.picked(df, ids, "left_semi", most=most).count() == 3 and common.picked(df, ids, "left_anti", most=most).count() == 7


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 5 for i in range(5, 10)}, **{i: 100 for i in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
