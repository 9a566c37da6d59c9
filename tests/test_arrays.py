"""Scans of arrays and numbers over an order, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from changeloom.functions.arrays import CHUNK, cut_at, prefix_sums
from changeloom.operators.numbering import running


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_prefix_sums(spark, levels):
    rng = random.Random(levels)
    rows = [([rng.randrange(-9, 9) for _ in range(n)],) for n in (0, 1, 2, CHUNK - 1, CHUNK, CHUNK + 1, CHUNK * CHUNK + 3)] + [(None,)]
    for r in spark.createDataFrame(rows, "a array<int>").select("a", prefix_sums(F.col("a"), levels).alias("p")).collect():
        assert r.p == (list(itertools.accumulate(r.a, initial=0))[:-1] if r.a else None if r.p is None else [])


def test_cut_at(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [0, 3]), ([1, 2, 3], []), ([], []), ([1, 2], [1])], "a array<int>, s array<int>")
    assert [r[0] for r in df.select(cut_at(F.col("a"), F.col("s"))).collect()] == [[[], [1, 2, 3], [4, 5]], [[1, 2, 3]], [[]], [[1], [2]]]


def test_running(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 1, 2, 3]), k, rng.randrange(5), "x") for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, k long, v long, _part string").withColumnRenamed("_part", "n").repartition(7)
    out = running(df, [F.desc("k")], ("g",), total=F.col("v"))
    assert out.columns == ["g", "k", "v", "n", "place", "total"]
    found = {r.k: (r.place, r.total) for r in out.collect()}
    seen = {}
    for g, k, v, _ in sorted(rows, key=lambda r: -r[1]):
        n, s = seen.get(g, (0, 0))
        seen[g] = n + 1, s + v
        assert found[k] == seen[g]
    assert sorted(r.place for r in running(df, [F.col("v"), F.col("k")]).collect()) == list(range(1, 401))
    assert [r.k for r in running(df, [F.col("v"), F.col("k")]).orderBy("place").collect()] == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert running(df.limit(0), [F.col("k")]).collect() == []


def test_running_deals_a_group_out(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts this small would be united
    parts = running(df, [F.col("id")], ("g",)).select(F.spark_partition_id().alias("p"), "place").groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 2500
