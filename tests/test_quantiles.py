"""Exact quantiles against Spark's own, and curves and dates at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import quantiles
from quern.operators import metrics, recipe_ops

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [20_000, 50])
def test_exact_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)  # coarse brackets hold many values
    r = random.Random(5)
    rows = [("one", 3.5), ("none", None), ("ties", 1.0)] + [("ties", float(r.randrange(4))) for _ in range(500)]
    rows += [("wide", r.gauss(0, 1e6)) for _ in range(3000)] + [("two", -1.0), ("two", 4.0), ("inf", float("inf")), ("inf", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: x["q"] for x in quantiles.exact_quantiles(df, "k", "v", PROBS).collect()}
    expected = df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()
    assert got == {x["k"]: x["q"] for x in expected}
    assert quantiles.exact_quantiles(df.limit(0), "k", "v", [0.5]).count() == 0


def test_quantiles_of_small_groups(spark):
    df = spark.createDataFrame([(n, float(i * i % 101)) for n in [*range(1, 125), 2500, 7001] for i in range(n)], "k int, v double")
    got = {x["k"]: x["q"] for x in quantiles.exact_quantiles(df, "k", "v", PROBS).collect()}
    expected = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()
    assert len(got) == 126
    for x in expected:
        assert got[x["k"]] == pytest.approx(x["q"], rel=1e-12)


def test_cutoffs_count_scores_on_and_beyond_the_grid(spark):
    df = spark.createDataFrame([(1, 0.05), (0, 0.04), (1, 0.95), (0, 1.0), (1, float("nan")), (0, -5.0)], "y int, s double")
    curve = {r["cutoff"]: (r["tp"], r["fp"]) for r in metrics.threshold_curve(df, F.col("y"), F.col("s"), steps=2).collect()}
    assert curve == {0.05: (3, 1), 0.95: (2, 1)}


def test_moments_are_read_in_many_forms(spark):
    texts = ["2024-01-05T10:00:00Z", "2024-01-05 10:00:00.123", "5 Jan 2024", "2024-1-5", "1/5/2024 10:30", "05.01.2024", "January 5, 2024", "nope", "2024-13-45"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(recipe_ops.parsed_moment(F.col("t")), "yyyy-MM-dd").alias("d"))
    assert [r["d"] for r in rows.collect()] == ["2024-01-05"] * 7 + [None, None]


def test_an_unknown_date_part_is_named(spark):
    df = spark.createDataFrame([("2024-01-05",)], "t string")
    with pytest.raises(ValueError, match="era"):
        recipe_ops.datepart(df, {"columns": ["t"], "parts": ["year", "era"]})
