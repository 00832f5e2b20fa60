"""Plans and skew."""

import pytest
from pyspark.sql import functions as F

from shoalmark.catalog import QUERIES
from shoalmark.operators import community as C, ordering as O, series as S
from tools.plans import plan_of

SF = "/root/testdata/sf0.001"


def test_flagship_reads_only_its_columns(spark):
    plan = QUERIES["cwm"](spark, SF)._jdf.queryExecution().toString()
    scan = [x for x in plan.splitlines() if "FileScan" in x and "l_partkey" in x][0]
    assert "l_orderkey" not in scan.split("ReadSchema")[1] and "l_tax" not in scan.split("ReadSchema")[1]
    # distinct and both aggregates have a map-side partial
    assert plan.split("== Physical Plan ==")[1].count("HashAggregate") >= 6


def test_hot_join_key_is_split(spark):
    """A species with most of the rows is spread over several tasks of the trait join."""
    keep = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "50KB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1KB")
        n = 60_000
        catch = spark.range(0, n, 1, 8).select(
            (F.col("id") % 5000).alias("site"), F.when(F.col("id") < n * 0.8, 1).otherwise(F.col("id") % 400).cast("int").alias("sp"),
            F.rand(1).alias("b"))
        traits = spark.range(400).select(F.col("id").cast("int").alias("sp"), (F.col("id") / 7).alias("t"))
        out = C.cwm(catch, traits, ["site"], "sp", "b", ["t"])
        assert len(out.collect()) == 5000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_positions_of_one_long_series(spark):
    """Numbering a series that holds all rows does not put them in one task."""
    df = spark.range(0, 40_000, 1, 8).select(F.lit("a").alias("g"), F.xxhash64("id").alias("t"))
    out = S.positions(df, ["g"], ["t"])
    assert "Window [row_number" not in plan_of(out)
    assert out.agg(F.max("pos"), F.countDistinct("pos")).first() == (40_000, 40_000)


def test_first_per_key_reduces_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    out = O.first_per_key(df, ["k"], ["v"])
    plan = plan_of(out)
    assert "Window" not in plan and "partial_min_by" in plan and out.first().v == 0


# ---- one series that holds all rows -----------------------------------------------------------

def _largest_tasks(spark, df):
    """Rows of the largest last task, with small partitions left apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_long_series_previous(spark):
    n = 40_000
    df = spark.range(n).select(F.lit("a").alias("s"), (F.col("id") * 3).alias("t"), (F.col("id") % 17).cast("double").alias("y"))
    df = df.unionByName(spark.createDataFrame([(None, 5, 1.0), (None, 9, 2.0), ("b", 1, 7.0)], "s string, t long, y double"))
    out = S.previous(df, ["s"], "t", ["y"], longest=1000)
    assert _largest_tasks(spark, out) < n / 4
    want = S.previous(df, ["s"], "t", ["y"])
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    assert out.columns == want.columns and key(out) == key(want)


def test_one_long_series_recursion(spark):
    n, phi = 30_000, 0.9
    df = spark.range(n).select(F.lit(1).alias("r"), F.col("id").alias("t"), ((F.col("id") * 7919) % 13).cast("double").alias("m"), F.lit(2.5).alias("x0"))
    df = df.unionByName(spark.createDataFrame([(2, k, None if k == 3 else 1.0, 4.0) for k in range(300)], "r int, t long, m double, x0 double"))
    out = S.ar1_recursion(df, "r", "t", "m", "x0", phi, block=16)  # several levels
    got = {(r.r, r.t): r.x_hat for r in out.collect()}
    x = 2.5
    for t in range(n):
        x = x if t == 0 else phi * x + (t * 7919) % 13
        assert abs(got[1, t] - x) < 1e-9
    assert [got[2, k] for k in range(3)] == pytest.approx([4.0, 4.6, 5.14]) and all(got[2, k] is None for k in range(3, 300))
    assert _largest_tasks(spark, out) < n / 4


def test_one_long_series_rolling(spark):
    n = 20_000
    df = spark.range(n).where("id % 5 <> 3").select(F.lit("a").alias("g"), F.col("id").cast("int").alias("t"), (F.col("id") % 11).cast("double").alias("y"))
    out = S.rolling_mean(df, ["g"], "t", "y")
    assert "Window" not in plan_of(out)
    got = {r.t: r.trend for r in out.collect()}
    have = {t: t % 11 for t in range(n) if t % 5 != 3}
    assert set(got) == set(have)
    for t in (0, 1, 2, 4, 999, n - 1):
        own = [have[k] for k in range(t - 2, t + 3) if k in have]
        assert got[t] == pytest.approx(sum(own) / len(own))


def test_quantiles_of_crowded_values(spark):
    """Values that crowd in one bin of a histogram, infinite ones, and many equal ones."""
    from shoalmark.operators import quantiles as Q

    import numpy as np
    rng = np.random.default_rng(3)
    parts = {"crowd": np.concatenate([1 + rng.random(4000) * 1e-12, [1e300, -1e300]]), "equal": np.repeat([3.0, 7.0], [900, 100]),
             "far": np.concatenate([[-np.inf, np.inf, 1.7e308, -1.7e308], rng.normal(size=500)]), "one": np.array([5.0])}
    rows = [(k, float(x)) for k, xs in parts.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for accuracy in (10_000, 20):  # a poor sketch changes nothing
        for r in Q.exact_quantiles(df, ["g"], "v", [0.025, 0.5, 0.975], accuracy=accuracy).collect():
            want = np.quantile(np.sort(parts[r.g])[:], [0.025, 0.5, 0.975])
            assert r.n == len(parts[r.g]) and np.allclose(r.q, want, rtol=1e-15, atol=0), r.g
