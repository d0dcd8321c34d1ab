import json

import pytest
from pyspark.sql import functions as F

from quern import cli


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    rows = ["a,b,y"] + [f"{i % 17},{'u' if i % 3 else 'v'},{'yes' if i % 17 > 8 else 'no'}" for i in range(240)]
    (at / "t.csv").write_text("\n".join(rows) + "\n")
    return at


def test_inspect_writes_json_and_gates(data):
    assert cli.main(["inspect", f"{data}/t.csv", "--target", "y", "--json", f"{data}/p.json", "--html", f"{data}/p.html", "--quiet"]) == 0
    profile = json.loads((data / "p.json").read_text())
    assert profile["n_rows"] == 240 and {c["name"] for c in profile["columns"]} == {"a", "b", "y"}
    assert "<script" not in (data / "p.html").read_text()
    assert cli.main(["inspect", f"{data}/t.csv", "--quiet", "--fail-on", "info"]) == 1


def test_user_errors_exit_with_2(data, capsys):
    assert cli.main(["inspect", f"{data}/none.csv"]) == 2
    assert cli.main(["inspect", f"{data}/t.csv", "--target", "z"]) == 2
    assert "error:" in capsys.readouterr().err


def test_recipe_verbs(data):
    assert cli.main(["clean", f"{data}/t.csv", "--out", f"{data}/r.yaml", "--step", 'encode:{"columns": ["b"]}', "--step", 'binarize:{"columns": ["a"], "threshold": 8}']) == 0
    assert cli.main(["apply", f"{data}/r.yaml", f"{data}/t.csv", "--out", f"{data}/o.parquet"]) == 0
    assert cli.main(["export", f"{data}/r.yaml", "--out", f"{data}/prepare.py"]) == 0
    compile((data / "prepare.py").read_text(), "prepare", "exec")
    assert cli.main(["diff", f"{data}/t.csv", f"{data}/o.parquet", "--fail-on", "high"]) == 1


def test_split_fit_predict_judge(data):
    assert cli.main(["split", f"{data}/t.csv", "--target", "y", "--train", f"{data}/train.parquet", "--test", f"{data}/test.parquet"]) == 0
    assert cli.main(["fit", f"{data}/train.parquet", "--target", "y", "--model", "tree", "--out", f"{data}/model"]) == 0
    assert cli.main(["predict", f"{data}/model", f"{data}/test.parquet", "--out", f"{data}/pred.csv"]) == 0
    assert cli.main(["eval", f"{data}/model", f"{data}/test.parquet", "--target", "y", "--fail-under", "accuracy=0.9"]) == 0
    assert cli.main(["eval", f"{data}/model", f"{data}/test.parquet", "--target", "y", "--fail-under", "accuracy=1.1"]) == 1
    assert cli.main(["threshold", f"{data}/model", f"{data}/test.parquet", "--target", "y"]) == 0
    assert cli.main(["errors", f"{data}/model", f"{data}/test.parquet", "--target", "y"]) == 0


def test_fitted_steps_stay_with_the_model(data):
    steps = ['impute:{"columns": ["a"], "strategy": "mean"}', 'scale:{"columns": ["a"]}', 'target-encode:{"columns": ["b"], "target": "y"}']
    assert cli.main(["clean", f"{data}/t.csv", "--out", f"{data}/f.yaml", "--target", "y", *[x for s in steps for x in ("--step", s)]]) == 0
    assert cli.main(["fit", f"{data}/t.csv", "--target", "y", "--model", "tree", "--recipe", f"{data}/f.yaml", "--out", f"{data}/prepared"]) == 0
    (data / "one.csv").write_text("a,b,y\n16,u,yes\n0,v,no\n,w,no\n")  # scaled by itself, or without its gap, this would differ
    assert cli.main(["predict", f"{data}/prepared", f"{data}/one.csv", "--out", f"{data}/one.parquet"]) == 0
    found = cli.spark_session().read.parquet(f"{data}/one.parquet")
    rows = found.orderBy(F.desc("a")).collect()
    assert len(rows) == 3 and (rows[0]["prediction"], rows[2]["prediction"]) == ("yes", "no")
    assert 1 < rows[0]["a"] < 2 and abs(rows[1]["a"]) < 1e-9 and rows[2]["a"] < -1
    assert cli.main(["fit", f"{data}/t.csv", "--target", "y", "--model", "tree", "--out", f"{data}/plain"]) == 0
    assert cli.main(["predict", f"{data}/plain", f"{data}/one.csv", "--recipe", f"{data}/f.yaml", "--out", f"{data}/no.parquet"]) == 2


def test_eval_reports_and_diff_takes_a_profile(data):
    assert cli.main(["fit", f"{data}/t.csv", "--target", "y", "--model", "tree", "--out", f"{data}/m2"]) == 0
    assert cli.main(["eval", f"{data}/m2", f"{data}/t.csv", "--json", f"{data}/e.json", "--runs-dir", f"{data}/runs"]) == 0
    report = json.loads((data / "e.json").read_text())
    assert report["interval"] and report["baselines"] and report["confusion"] and ["beats-baseline", "info"] in report["checks"]
    assert len(list((data / "runs").glob("*.json"))) == 1
    assert cli.main(["inspect", f"{data}/t.csv", "--json", f"{data}/base.json", "--quiet"]) == 0
    assert cli.main(["diff", f"{data}/base.json", f"{data}/t.csv", "--json", f"{data}/d.json"]) == 0
    assert json.loads((data / "d.json").read_text()) == []
    (data / "half.csv").write_text("\n".join((data / "t.csv").read_text().splitlines()[:60]) + "\n")
    assert cli.main(["diff", f"{data}/base.json", f"{data}/half.csv", "--json", f"{data}/d.json"]) == 0
    assert "row-count-changed" in {r["kind"] for r in json.loads((data / "d.json").read_text())}


def test_hashes_and_keys_follow_the_rows_alone(spark):
    from quern.sources import io

    df = spark.createDataFrame([(i % 7, str(i % 3)) for i in range(40)], "a int, b string")
    assert io.hash_table(df) == io.hash_table(df.repartition(5).select("b", "a")) != io.hash_table(df.limit(39))
    keys = lambda d: sorted(r[0] for r in cli.keyed(d).select(cli.KEY).collect())
    assert keys(df) == keys(df.repartition(3)) and len(set(keys(df))) == 40
