import pytest
from pyspark.sql import functions as F

from quern.operators import artifacts, metrics, modelling, runs, significance


@pytest.fixture(scope="module")
def table(spark):
    x = F.randn(1)
    return spark.range(300).select("id", x.alias("a"), F.randn(2).alias("b"), F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c")).withColumn(
        "y", F.when(F.col("a") + 0.3 * F.col("b") > 0, "yes").otherwise("no")
    ).withColumn("z", 3 * F.col("a") - F.col("b")).cache()


def test_benchmark_beats_the_dummy_and_isolates_failures(table):
    out = modelling.run_benchmark(table.drop("z"), "y", ["linear", "knn", "xgb"], ["id"], folds=3)
    by = {r.name: r for r in out.results}
    assert out.task == "classification" and by["linear"].mean > 0.85 and by["knn"].mean > 0.8 > by["dummy"].mean and by["xgb"].failed
    assert ("model-failed", "warn") in out.checks and any(c["other"] == "dummy" and c["distinct"] for c in out.comparisons)
    assert out.oof.where("model = 'linear'").count() == 300


def test_regression_and_importance(table):
    out = modelling.run_benchmark(table.drop("y"), "z", ["linear"], ["id"], folds=3)
    assert out.results[0].name == "linear" and out.results[0].mean < 0.1
    model = modelling.fit_model(table.drop("y"), "z", "linear", exclude=["id"])
    drops = {r["column"]: r["drop"] for r in modelling.permutation_importance(model, table.drop("y"), ["id"], ["a", "c"], 2).collect()}
    assert drops["a"] > 1 > abs(drops["c"]) * 100


def test_ensembles_and_tuning(table):
    df = table.drop("z")
    for method in ("vote", "stack"):
        e = modelling.fit_ensemble(df, "y", ["linear", "tree"], ["id"], method, folds=2)
        assert modelling.score(e.predict(df), "y", "classification")["accuracy"] > 0.85
    found = modelling.tune_model(df, "y", "tree", ["id"], "random", 2, 2, 2)
    assert set(found["params"]) <= set(modelling.SPACES["tree"]) and found["outer"] > 0.6
    with pytest.raises(ImportError):
        modelling.tune_model(df, "y", "tree", ["id"], "bayes")


def test_parameters_are_checked(table):
    with pytest.raises(ValueError):
        modelling.fit_model(table.drop("z"), "y", "tree", params={"depth": 3}, exclude=["id"])
    with pytest.raises(ValueError):
        modelling.register(modelling.CATALOGUE["tree"])


def test_sweep_resumes(table, tmp_path):
    plan = runs.SweepPlan((None,), ("dummy",), (0, 1), 3)
    first = runs.run_sweep(table.drop("z"), "sha", "y", ["id"], plan, str(tmp_path))
    again = runs.run_sweep(table.drop("z"), "sha", "y", ["id"], plan, str(tmp_path))
    assert [c["status"] for c in first] == ["ran", "ran"] and [c["status"] for c in again] == ["cached", "cached"]
    assert runs.cell_key("s", None, "m", 0, 5, "y", None) != runs.cell_key("s", None, "m", 0, 5, "z", None)


def test_manifests_and_reports(spark, tmp_path):
    for model, value in (("a", 0.9), ("b<", 0.7)):
        runs.save_manifest(runs.manifest("bench", "sha", "y", "classification", model, {"balanced_accuracy": value}), str(tmp_path))
    (tmp_path / "broken.json").write_text("{")
    ranked = runs.rank_runs(runs.runs_table(spark, runs.load_manifests(str(tmp_path)))).orderBy("rank").collect()
    assert [r["model"] for r in ranked] == ["a", "b<"]
    assert "b&lt;" in runs.render([r.asDict() for r in ranked], ["model"], "html")
    with pytest.raises(ValueError):
        runs.load_manifests(str(tmp_path / "none"))


def test_significance():
    a, b = [0.9, 0.91, 0.92, 0.9, 0.93], [0.8, 0.83, 0.81, 0.82, 0.8]
    _, t, p = significance.corrected_paired_t_test(a, b, 80, 20)
    assert t > 0 and p < 0.01
    assert significance.corrected_paired_t_test(a, a, 80, 20)[2] == 1
    adjusted = significance.holm({"x": 0.01, "y": 0.04, "z": 0.03})
    assert adjusted == {"x": pytest.approx(0.03), "y": pytest.approx(0.06), "z": pytest.approx(0.06)}


def test_bootstrap_brackets_the_estimate(spark):
    cells = [("a", "a", 80), ("a", "b", 20), ("b", "b", 70), ("b", "a", 30)]
    low, high = metrics.bootstrap_label_metric(cells, metrics.balanced_accuracy_of)
    assert low < 0.75 < high and 0.05 < high - low < 0.25
    assert metrics.bootstrap_label_metric([("a", "a", 5)], metrics.balanced_accuracy_of) is None
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    r = metrics.bootstrap_rows(df, {"m": F.col("x")}, ["id"], 100).first()
    assert r["ci_low"] < 2.998 < r["ci_high"] and r["ci_high"] - r["ci_low"] < 0.4


def test_bootstrap_of_a_large_table_uses_all_rows(spark):
    # one row in 40,000 holds nearly all of the sum: its Poisson weight must show in the replicates
    df = spark.range(40_000).select("id", F.when(F.col("id") % 8000 == 0, 8000.0).otherwise(0.0).alias("x"))
    values = df.select("x").toPandas()["x"]
    r = metrics.bootstrap_rows(df, {"m": F.col("x")}, ["id"], 200).first()
    width, exact = r["ci_high"] - r["ci_low"], 2 * 1.96 * values.std() / len(values) ** 0.5
    assert r["ci_low"] < values.mean() < r["ci_high"] and 0.7 * exact < width < 1.4 * exact
    # centred on the whole table's estimate at this and other seeds, as an interval of a fixed subset is not
    wave = spark.range(60_000).select("id", ((F.col("id") * 7919) % 60_000).cast("double").alias("x"))
    for seed in range(8):
        low, high = metrics.bootstrap_rows(wave, {"m": F.col("x")}, ["id"], 100, seed).select("ci_low", "ci_high").first()
        assert abs((low + high) / 2 - 29_999.5) < 0.25 * (high - low)


def test_auc_of_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    r = metrics.score_metrics(df, F.col("y"), F.col("s")).first()
    assert r["roc_auc"] == pytest.approx(0.875)


def test_evaluation_checks():
    kinds = {k for k, _ in modelling.evaluation_checks("classification", {"balanced_accuracy": 0.9995}, 0.5, 50, (0.8, 1.0), 1, 0.2, [0.5, 0.9])}
    assert kinds == {"beats-baseline", "suspiciously-perfect", "wide-interval", "single-class-predictions", "miscalibrated", "slice-gap", "small-evaluation-set"}
    assert ("suspiciously-perfect", "high") in modelling.evaluation_checks("regression", {"rmse": 0.0, "r2": 1.0}, 2.0, 500)


def test_profile_round_trip_and_evaluation(table):
    p = artifacts.profile_table(table.drop("z"), "y")
    assert artifacts.DatasetProfile.from_json(p.to_json()).columns == p.columns
    a = next(c for c in p.columns if c.name == "a")
    assert p.n_rows == 300 and a.kind == "numeric" and sum(b[2] for b in a.histogram) == 300
    with pytest.raises(ValueError):
        artifacts.ColumnProfile("x", "numeric", "int", 1, 0, 2)
    e = artifacts.evaluate_model(modelling.fit_model(table.drop("z"), "y", "linear", exclude=["id"]), table.drop("z"), "y", ["c"])
    assert e.interval[0] <= e.metrics["balanced_accuracy"] <= e.interval[1] + 1e-9 and e.metrics["roc_auc"] > 0.95
    assert ("beats-baseline", "info") in e.checks and {s["value"] for s in e.slices} == {"u", "v"} and e.calibration
