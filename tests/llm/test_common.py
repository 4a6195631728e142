"""Helpers: joins that deal out frequent keys, the shared folder, components of a star."""

import pytest
from pyspark.sql import functions as F

from tracewright.llm import common as c


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_one(spark, how):
    left = spark.range(3000).select((F.col("id") % 3 * F.col("id")).alias("k"), F.col("id").alias("v")).withColumn("k", F.when(F.col("v") % 500 == 1, None).otherwise(F.col("k")))
    right = spark.createDataFrame([(0, "zero"), (1, "one"), (7, "seven"), (14, "a"), (14, "b"), (None, "none")], "k long, w string")
    want = sorted(map(str, left.join(right, ["k"], how).collect()))
    for counts in (None, left.groupBy("k").agg(F.count("*").alias("__c"))):
        got = c.join_salted(left, right, ["k"], ["v"], how, counts, share=10, least=20, few=0)
        assert sorted(map(str, got.collect())) == want
    assert c.join_salted(left.where("false"), right, ["k"], ["v"], how, few=0).count() == 0


def test_components_of_a_large_star(spark):
    edges = spark.range(1, 30_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = c.connected_components(edges)
    assert got.count() == 30_000 and got.where("root <> 0").count() == 0


def test_no_machine_local_folder_on_a_cluster():
    class Stand:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        c.shared_dir(Stand)
