import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import recipe, splits
from quern.sources import io


def run(df, *steps):
    return recipe.apply(recipe.Recipe(tuple(recipe.Step(op, p) for op, p in steps)), df).frame


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        ("2021-11-27", "north", "red old", 7.5), ("2021-11-28", "south", "kite", 1.25), ("2021-11-29", "south", "a long rope", 40.0),
        ("2021-12-02", "north", "", 3.0), ("2021-12-03", "south", None, 18.5), ("2022-01-15", "north", "lamp", 0.5),
    ]
    return spark.createDataFrame(rows, "when string, store string, note string, sales double")


def test_unknown_operations_and_parameters():
    with pytest.raises(recipe.RecipeError):
        recipe.Step("explode", {})
    with pytest.raises(recipe.RecipeError):
        recipe.Step("drop", {"cols": []})


def test_lag_and_rolling_match_pandas(series):
    pdf = series.toPandas()
    got = run(series, ("lag", {"columns": ["sales"], "by": "when"}), ("rolling", {"columns": ["sales"], "by": "when", "window": 3, "stat": "std"})).orderBy("when").toPandas()
    pd.testing.assert_series_equal(got["sales_lag1"], pdf["sales"].shift(1), check_names=False)
    pd.testing.assert_series_equal(got["sales_roll3_std"], pdf["sales"].rolling(3, min_periods=1).std(), check_names=False)
    grouped = run(series, ("lag", {"columns": ["sales"], "by": "when", "group": "store"})).orderBy("when").toPandas()
    pd.testing.assert_series_equal(grouped["sales_lag1"], pdf.groupby("store")["sales"].shift(1), check_names=False)


def test_whole_table_windows_cross_buckets(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("t"), F.rand(1).alias("v"))
    got = run(df, ("rolling", {"columns": ["v"], "by": "t", "window": 60, "stat": "sum"}), ("lag", {"columns": ["v"], "by": "t", "periods": 40})).orderBy("t").toPandas()
    pd.testing.assert_series_equal(got["v_roll60_sum"], got["v"].rolling(60, min_periods=1).sum(), check_names=False)
    pd.testing.assert_series_equal(got["v_lag40"], got["v"].shift(40), check_names=False)


def test_text_length(series):
    assert [r["note_words"] for r in run(series, ("text-length", {"columns": ["note"]})).orderBy("when").collect()] == [2, 1, 3, 0, None, 1]


@pytest.mark.parametrize("values", [[1, 1, 1, 2, 3, 4, 4, 4, 9, 10], list(range(17)), [5.5, 5.5, 1, 2, 2, 2, 2, 2, 2, 3]])
@pytest.mark.parametrize("method", ["quantile", "uniform"])
def test_bins_match_pandas(spark, values, method):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    got = run(df, ("bin", {"columns": ["x"], "bins": 4, "method": method})).orderBy("i").toPandas()["x"].tolist()
    s = pd.Series(values, dtype=float)
    expected = (pd.qcut(s, 4, labels=False, duplicates="drop") if method == "quantile" else pd.cut(s, 4, labels=False)).tolist()
    assert got == expected


def test_fitted_state_is_applied_to_other_rows(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b")], "x double, c string")
    steps = (recipe.Step("impute", {"columns": ["x"], "strategy": "mean"}), recipe.Step("scale", {"columns": ["x"], "method": "minmax"}), recipe.Step("encode", {"columns": ["c"]}))
    fitted, out = recipe.fit(recipe.Recipe(steps), train)
    assert out.columns == ["x", "c_a", "c_b"]
    other = fitted.transform(spark.createDataFrame([(5.0, "z"), (None, None)], "x double, c string")).collect()
    assert [tuple(r) for r in other] == [(2.0, False, False), (0.5, False, False)]


def test_casts(spark):
    df = spark.createDataFrame([("$1,200.50", "2024-03-05"), ("n/a", "03/07/2023"), (None, "12:30")], "m string, d string")
    got = run(df, ("cast", {"columns": ["m"], "to": "numeric"}), ("cast", {"columns": ["d"], "to": "datetime"})).collect()
    assert [r["m"] for r in got] == [1200.5, None, None]
    assert [r["d"] and str(r["d"].date()) for r in got] == ["2024-03-05", "2023-03-07", None]


def test_target_encoding_does_not_memorise(spark):
    df = spark.range(400).select("id", F.concat(F.lit("k"), "id").alias("c"), (F.pmod(F.xxhash64("id"), F.lit(2))).cast("double").alias("y"))
    out = run(df, ("target-encode", {"columns": ["c"], "target": "y", "key": ["id"]}))
    assert out.select(F.countDistinct("c")).first()[0] <= 5


def test_yaml_round_trip_and_export(spark, series):
    r = recipe.Recipe((recipe.Step("impute", {"columns": ["sales"], "strategy": "median"}, "gaps"), recipe.Step("encode", {"columns": ["store"]}), recipe.Step("rolling", {"columns": ["sales"], "by": "when"}), recipe.Step("tfidf", {"column": "note", "max_features": 3})), {"when": "text"}, None)
    assert recipe.Recipe.from_yaml(r.to_yaml()).as_dict() == r.as_dict()
    space: dict = {}
    code = recipe.export(r)
    assert "quern" not in code
    exec(compile(code, "prepare", "exec"), space)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(space["prepare"](series)) == key(recipe.apply(r, series).frame)


def test_missing_columns(series):
    r = recipe.Recipe((recipe.Step("drop", {"columns": ["gone"]}),), {"gone": "numeric"})
    assert recipe.apply(r, series).notes
    with pytest.raises(recipe.RecipeError):
        recipe.apply(r, series, strict=True)


def test_splits_keep_their_promises(spark):
    df = spark.range(600).select("id", (F.col("id") % 50).alias("g"), (F.col("id") % 10 == 0).cast("int").alias("y"), F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    group = splits.split(df, ["id"], group="g")
    assert not splits.overlap(group, "g")
    strat = splits.split(df, ["id"], "stratified", target="y").groupBy("y").agg(F.avg(F.col("is_test").cast("int"))).collect()
    assert all(abs(r[1] - 0.2) < 0.01 for r in strat)
    time = splits.split(df, ["id"], time="t")
    assert time.where("is_test").agg(F.min("t")).first()[0] > time.where("not is_test").agg(F.max("t")).first()[0]
    assert time.where("is_test").count() == 120
    a, b = (splits.split(df.repartition(n), ["id"], "random", seed=3).where("is_test").orderBy("id").collect() for n in (1, 6))
    assert a == b
    folds = splits.make_folds(df, ["id"], "y", None, 5).groupBy("fold").agg(F.sum("y").alias("s")).collect()
    assert {r["s"] for r in folds} == {12}


def test_reading_and_writing(spark, tmp_path):
    with pytest.raises(io.InputError):
        io.read_table(spark, f"{tmp_path}/x.feather")
    with pytest.raises(io.InputError):
        io.read_table(spark, f"{tmp_path}/none.csv")
    (tmp_path / "a.csv").write_bytes("name,x\ncaf\xe9,1\nz,2\n".encode("latin-1"))
    got = io.read_table(spark, f"{tmp_path}/a.csv").frame.collect()
    assert got[0]["name"] == "café" and got[1]["x"] == 2
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0))
    for name in ("o.parquet", "o.tsv"):
        io.write_table(df, f"{tmp_path}/{name}")
        assert io.read_table(spark, f"{tmp_path}/{name}").frame.where("x is null").count() == 500
    one, two = (io.read_table(spark, f"{tmp_path}/o.parquet", 100, 5).frame.orderBy("id").collect() for _ in range(2))
    assert one == two and 50 < len(one) < 170
    assert io.hash_file(str(tmp_path / "a.csv")) == io.hash_file(str(tmp_path / "a.csv"))


def test_target_encode_of_too_many_classes_raises(spark):
    from quern.operators import recipe_ops

    df = spark.range(1001).selectExpr("id", "cast(id % 3 as string) AS g", "concat('c', id) AS y")
    with pytest.raises(ValueError, match="more than 1000 classes"):
        recipe_ops.target_encode_oof(df, {"target": "y", "columns": ["g"], "key": ["id"]})
    assert len(recipe_ops.fit_target_encode(df.where("id < 1000"), {"target": "y", "columns": ["g"]})["codes"]) == 1000


def test_large_classes_are_numbered_in_slices(spark, monkeypatch):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit("x")).alias("y"))
    key = lambda d, c: [r[c] for r in d.orderBy("id").collect()]
    whole = key(splits.split(df, ["id"], "stratified", target="y"), "is_test"), key(splits.stratified_folds(df, ["id"], "y"), "fold")
    monkeypatch.setattr(splits, "SLICE_ROWS", 40)
    assert (key(splits.split(df, ["id"], "stratified", target="y"), "is_test"), key(splits.stratified_folds(df, ["id"], "y"), "fold")) == whole
    assert sum(whole[0]) == round(72 * 0.2) + round(428 * 0.2)


def test_dedupe_keeps_the_first_row_by_key(spark):
    df = spark.createDataFrame([(2, "a", {"k": 1}), (1, "a", None), (5, None, None), (4, None, {"k": 2}), (3, "b", None)], "i long, `g.x` string, m map<string,int>")
    got = run(df, ("dedupe", {"subset": ["g.x"], "key": ["i"]}))
    assert got.columns == df.columns and sorted((r["i"], r["g.x"], r["m"]) for r in got.collect()) == [(1, "a", None), (3, "b", None), (4, None, {"k": 2})]


def test_times_in_text_are_dealt_to_many_buckets(spark):
    from quern.operators import recipe_ops

    df = spark.range(400).select(F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 9000), "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("id").cast("double").alias("v"))
    window = recipe_ops.over_all_rows(df, [F.col("t")], 2, lambda w: F.sum("v").over(w.rowsBetween(-2, 0)), "s").orderBy("t").toPandas()
    pd.testing.assert_series_equal(window["s"], window["v"].rolling(3, min_periods=1).sum(), check_names=False)


def test_windows_of_large_groups_cross_buckets(spark):
    from quern.operators import recipe_ops

    df = spark.range(300).select(F.when(F.col("id") % 50 != 7, F.col("id") % 9 % 3).alias("g"), ((F.col("id") * 7919) % 300).alias("t"), F.rand(4).alias("v"))
    value = lambda w: F.sum("v").over(w.rowsBetween(-19, 0))
    p = {"by": "t", "group": "g", "key": ["t"]}
    plain, cut, some = (recipe_ops.ordered_window(df, p, 19, value, "s", n).orderBy("t").toPandas() for n in (1000, 10, 98))
    pd.testing.assert_frame_equal(cut, plain)
    pd.testing.assert_frame_equal(some, plain)
    assert cut["s"].isna().sum() == 6
