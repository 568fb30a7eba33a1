"""Ordered operators against plain windows, with a hot group and small blocks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from descry.operators.access_logs import expand_counts, safe_dates
from descry.operators.keys import keep_first, keep_last, last_k, without_groups
from descry.operators.ordering import (
    batch_keys,
    carry_forward,
    cut_at_first_bad,
    row_index,
    running_total,
)


@pytest.fixture(scope="module")
def rows(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    return spark.range(3000).select("id", hot.alias("k"), (F.col("id") * 7919 % 101).alias("v"))


def disagreements(df, a, b):
    return df.filter(~F.col(a).eqNullSafe(F.col(b))).count()


def test_row_index(rows):
    plain = F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1
    result = row_index(rows, ["k"], ["v", "id"]).withColumn("expected", plain)
    assert result.count() == 3000
    assert disagreements(result, "row_index", "expected") == 0


def test_running_total(rows):
    plain = F.sum("id").over(Window.orderBy("v", "id"))
    result = running_total(rows, ["v", "id"], F.col("id"), "total").withColumn("expected", plain)
    assert disagreements(result, "total", "expected") == 0


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_carry_forward(rows, block):
    value = F.when(F.col("v") < 5, F.col("id"))
    plain = F.last(value, ignorenulls=True).over(Window.partitionBy("k").orderBy("id"))
    result = carry_forward(rows, ["k"], "id", value, "header", block).withColumn("expected", plain)
    assert result.count() == 3000
    assert disagreements(result, "header", "expected") == 0


def test_cut_at_first_bad(rows):
    bad = F.col("v") == 77
    seen_bad = F.max(bad.cast("int")).over(Window.partitionBy("k").orderBy("id"))
    expected = rows.withColumn("bad", seen_bad).filter("bad = 0").select("id")
    result = cut_at_first_bad(rows, ["k"], "id", bad).select("id")
    assert sorted(expected.collect()) == sorted(result.collect())


def test_batches(spark):
    keys = spark.range(500).select(F.lit("server").alias("t"), F.format_string("%03d", "id").alias("d"))
    micro = spark.range(93).select(F.lit("micro").alias("t"), F.format_string("%03d", "id").alias("d"))
    result = batch_keys(
        keys.union(micro).union(micro),
        "t",
        "d",
        lambda t: F.when(t == "micro", 92).otherwise(96),
        lambda t: F.when(t == "micro", "-").otherwise("+"),
    ).orderBy("t", "batch").collect()
    assert [(r.t, r.batch, r.n_keys) for r in result] == [
        ("micro", 0, 92),
        ("micro", 1, 1),
        *[("server", i, 96) for i in range(5)],
        ("server", 5, 20),
    ]
    assert result[0]["keys"] == "-".join(f"{i:03d}" for i in range(92))


def test_expand_counts(spark):
    counts = spark.createDataFrame([("hot", 25_001), ("one", 1), ("none", 0)], "line string, n bigint")
    result = expand_counts(counts, lines_per_chunk=1000).groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("copy").alias("d"), F.max("copy").alias("m")
    )
    assert {tuple(r) for r in result.collect()} == {("hot", 25_001, 25_001, 25_001), ("one", 1, 1, 1)}


@pytest.mark.parametrize(
    "days, expected", [(range(19, 24), [20, 21]), (range(1, 4), []), (range(1, 5), [2]), ([], [])]
)
def test_safe_dates(spark, days, expected):
    rows = [("v", "p", f"2016-11-{d:02d}") for d in days]
    df = spark.createDataFrame(rows, "virtual_host string, physical_host string, d string")
    df = df.withColumn("log_date", F.to_date("d"))
    assert sorted(r.log_date.day for r in safe_dates(df).collect()) == expected
    assert safe_dates(df, limits=False).count() == len(list(days))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_filters_are_pushed_below_the_shuffle(rows):
    for df in (
        keep_first(rows, ["k"], ["v", "id"]),
        keep_last(rows, ["k"], ["v", "id"]),
        last_k(rows, ["k"], ["id"]),
    ):
        plan = plan_of(df)
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert "TakeOrderedAndProject" in plan_of(last_k(rows, [], ["id"]))


def test_hot_group_is_rejected_or_kept_whole(rows):
    kept = without_groups(rows, ["k"], F.col("id") == 3)
    assert kept.filter("k = 'hot'").count() == 0 and kept.count() == 2000
