"""Scratch tables and salted joins."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators.skew import frequent, salted_join


def here(df):
    return os.path.isdir(df._scratch.removeprefix("file://"))


def test_tables_are_discarded_and_swept(spark):
    other = session.materialise(spark, spark.range(5), "other")  # of no step
    chain, made = session.Chain(), {}

    def make(name):
        def run(spark, docs, sf_dir):
            made[name] = [session.materialise(spark, docs, f"{name}{k}") for k in range(2)]
            return made[name][0]

        return run

    first, second, third = (chain.stage(k, make(n)) for k, n in enumerate("abc"))
    a = first(spark, spark.range(3), "")
    again = first(spark, spark.range(4), "")  # the same stage twice: both results stay
    assert a.count() == 3 and again.count() == 4
    written = session.materialise(spark, a, "written")
    b = second(spark, written, "")
    assert not here(made["a"][0]) and not here(a) and b.count() == 3
    third(spark, b, "")  # what its input reads stays
    assert here(made["b"][0]) and not here(made["b"][1]) and here(other) and here(written)
    loose = make("d")(spark, spark.range(2), "")
    session.discard(made["d"][1])
    assert not here(made["d"][1]) and loose.count() == 2


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        session.scratch(SimpleNamespace(conf=conf, sparkContext=sc))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_joins_equal_plain_ones(spark, how):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("k"), "id")
    few = spark.range(35).select(F.col("id").alias("k"), *([] if how == "left_semi" else [(F.col("id") * 2).alias("v")]))
    keys = frequent(many.groupBy("k").agg(F.count("*").alias("n")), "k", "n", 3000, 10)
    assert keys == [7]
    want = many.join(few, ["k"], how)
    got = salted_join(many, few, ["k"], keys, ["id"], how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert salted_join(many, few, ["k"], [], ["id"], how).count() == want.count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_key_of_a_small_share_is_split_by_its_rows(spark, how):
    many = spark.range(40_000).select(F.when(F.col("id") % 1000 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.range(3).select(F.lit(None).cast("long").alias("k"), "id"))
    few = spark.range(-1, 30).select(F.col("id").alias("k"), *([] if how == "left_semi" else [(F.col("id") * 2).alias("v")]))
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    assert frequent(counts, "k", "n", 40_003) == []
    keys = frequent(counts, "k", "n", 40_003, rows=9)  # a thousandth of all rows
    assert (keys, keys.parts) == ([-1], [64])
    keys.parts = [100]  # more parts than the usual ones: the list is joined
    want = many.join(few, ["k"], how)
    got = salted_join(many, few, ["k"], keys, ["id"], how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
