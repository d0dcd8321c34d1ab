import math

import pytest
from pyspark.sql import functions as F

from quern.functions.stats import t_quantile, t_two_sided
from quern.operators import drift, findings, profile


@pytest.fixture(scope="module")
def messy(spark):
    """120 rows with one planted case of each defect."""
    rows = []
    for i in range(120):
        age = 20 + 7 * i % 45
        bought = 1 if i % 12 == 0 else 0
        rows.append((age, None if i % 9 == 0 else 30000.0 + 137 * i % 50000, f"C{i}" if i % 8 == 0 else None, None, "JP", "JP", f"id-{i:04d}",
                     10000.0 if i >= 117 else 5.0 + i % 10, f"{1000 + i:,}", f"2024-{i % 11 + 1:02d}-15", age * 12, f"class-{bought}", bought))
    return spark.createDataFrame(rows, "age long, salary double, cabin string, notes string, country string, country_copy string, record_id string, fare double, amount_text string, signup_date string, age_months long, outcome_code string, purchased long").cache()


def test_findings_of_planted_defects(messy):
    found = {(r["kind"], tuple(r["columns"])): r["severity"] for r in findings.detect_findings(messy, "purchased").collect()}
    expected = {
        ("missing", ("salary",)): "warn", ("high-missing", ("cabin",)): "high", ("empty-column", ("notes",)): "high", ("constant-column", ("country",)): "high",
        ("duplicate-columns", ("country", "country_copy")): "warn", ("identifier-like", ("record_id",)): "info", ("high-skew", ("fare",)): "warn", ("outliers", ("fare",)): "info",
        ("numeric-stored-as-text", ("amount_text",)): "warn", ("datetime-stored-as-text", ("signup_date",)): "warn", ("highly-correlated", ("age", "age_months")): "warn",
        ("leakage-suspect", ("outcome_code",)): "high", ("class-imbalance", ("purchased",)): "warn",
    }
    assert {k: found.get(k) for k in expected} == expected


def test_findings_come_most_severe_first(messy):
    ranks = [r["rank"] for r in findings.detect_findings(messy).collect()]
    assert ranks == sorted(ranks)


def test_tidy_table_has_no_high_finding(spark):
    df = spark.createDataFrame([(i % 37, 3 * i % 11, ["north", "south", "east", "west"][i % 4], int((7 * i + 3) % 5 < 2)) for i in range(200)], "a long, b long, g string, y long")
    assert findings.detect_findings(df, "y").where("severity = 'high'").isEmpty()


def test_numeric_profile_against_pandas(spark):
    import pandas as pd

    x = [1.0, 2.0, 2.0, 5.0, 100.0, -3.0, 0.0, float("nan"), None]
    row = profile.numeric_profile(spark.createDataFrame([(v,) for v in x], "x double")).first()
    s = pd.Series(x, dtype=float)
    assert (row["count"], row["missing"], row["unique"], row["zeros"], row["negatives"], row["outliers"]) == (7, 2, 6, 1, 1, 1)
    for name, value in {"mean": s.mean(), "std": s.std(), "p25": s.quantile(0.25), "p75": s.quantile(0.75), "skew": s.skew(), "kurtosis": s.kurtosis()}.items():
        assert row[name] == pytest.approx(value), name


@pytest.mark.parametrize("values", [[], [None, None], [7.0], [7.0, 7.0, 7.0, 7.0]])
def test_degenerate_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = profile.numeric_profile(df, ["x"]).first()
    if row is not None:
        assert row["outliers"] == 0 and row["std"] == 0
    bins = profile.histogram(df, ["x"]).collect()
    assert sum(r["count"] for r in bins) == sum(v is not None for v in values)


def test_histogram_is_closed_on_the_right_end(spark):
    bins = profile.histogram(spark.range(101).select(F.col("id").cast("double").alias("x")), ["x"]).orderBy("bin").collect()
    assert len(bins) == 20 and sum(r["count"] for r in bins) == 101 and bins[-1]["count"] == 6


def test_partitioning_does_not_matter(messy):
    a = profile.numeric_profile(messy.repartition(1)).orderBy("column").toPandas()
    b = profile.numeric_profile(messy.repartition(7)).orderBy("column").toPandas()
    assert all(math.isclose(x, y, rel_tol=1e-9) or (x != x and y != y) for x, y in zip(a.drop(columns="column").astype(float).to_numpy().ravel(), b.drop(columns="column").astype(float).to_numpy().ravel(), strict=True))
    assert profile.top_values(messy.repartition(1)).orderBy("column", "rank").collect() == profile.top_values(messy.repartition(7)).orderBy("column", "rank").collect()


def test_drift(spark, messy):
    kinds = {(r["kind"], r["column"]) for r in drift.drift(messy, messy.drop("cabin").withColumn("new", F.lit(1)).withColumn("fare", F.col("fare") + 5000)).collect()}
    assert {("column-removed", "cabin"), ("column-added", "new"), ("distribution-shifted", "fare")} <= kinds
    assert drift.drift(messy, messy).isEmpty()


def test_student_t():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-5)
    assert t_two_sided(0.5, 3) == pytest.approx(0.6514, rel=1e-3)
    assert t_quantile(0.975, 4) == pytest.approx(2.776445, rel=1e-5)


def test_variants_of_several_types(spark):
    df = spark.sql("SELECT id, parse_json(CASE WHEN id < 5 THEN '1' WHEN id = 5 THEN 'null' ELSE '\"x\"' END) AS v, parse_json('2') AS w, id % 2 AS y FROM range(60)")
    found = {(r["kind"], tuple(r["columns"])) for r in findings.detect_findings(df, "y").collect()}
    assert ("mixed-types", ("v",)) in found and ("mixed-types", ("w",)) not in found


def test_a_regression_target_is_not_parted(spark):
    df = spark.range(400).selectExpr("floor(id / 4) * 1.5 AS y", "cast(floor(id / 4) AS string) AS g", "floor(id / 4) * 3.0 AS z")
    found = [r for r in findings.detect_findings(df, "y").collect() if r["kind"] == "leakage-suspect"]
    assert [list(r["columns"]) for r in found] == [["z"]]
