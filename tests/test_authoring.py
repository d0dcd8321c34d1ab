"""Recipes from decisions, charts, project defaults and plugins."""

import json
import shlex
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.operators import artifacts, authoring, charts, defaults, modelling, plugins, recipe


def profile(**columns):
    found = [artifacts.ColumnProfile(n, kind, "x", 100, 0, unique, stats) for n, (kind, unique, stats) in columns.items()]
    return artifacts.DatasetProfile(100, 3, found, [], "y")


@pytest.fixture
def seen():
    p = profile(a=("numeric", 90, {"skew": 2.5}), b=("numeric", 80, {"skew": 0.1}), c=("categorical", 40, {}), t=("datetime", 99, {}), y=("categorical", 2, {}))
    make = lambda kind, severity, *columns: {"kind": kind, "severity": severity, "columns": list(columns), "summary": "", "metrics": {}}
    p.findings = [
        make("missing", "warn", "a"), make("missing", "warn", "c"), make("outliers", "info", "b"), make("duplicate-rows", "warn"),
        make("highly-correlated", "warn", "a", "b"), make("leakage-suspect", "high", "y"), make("identifier-like", "info", "t"), make("tiny-dataset", "warn"),
    ]
    return p


def test_questions_gather_columns_and_leave_out_what_no_step_mends(seen):
    asked = {q.kind: q for q in authoring.questions(seen)}
    assert set(asked) == {"missing", "duplicate-rows", "highly-correlated", "identifier-like"}
    assert asked["missing"].columns == ("a", "c") and all("keep" in q.choices for q in asked.values())
    assert asked["missing"].answer("median")[0].params["columns"] == ["a"]
    assert asked["missing"].answer("most_frequent")[0].params["columns"] == ["c"]
    assert asked["highly-correlated"].answer("drop")[0].params["columns"] == ["b"]


def test_answers_make_a_recipe_in_order(seen):
    made = authoring.recipe_from_answers(seen, {"missing": "median", "duplicate-rows": "dedupe", "identifier-like": "drop", "highly-correlated": "keep"})
    assert [s.op for s in made.steps] == ["drop", "dedupe", "impute"] and made.target == "y" and made.schema["a"] == "numeric"
    for bad in ({"missing": "nothing"}, {"outliers": "clip"}):
        with pytest.raises(recipe.RecipeError):
            authoring.recipe_from_answers(seen, bad)


def test_opportunities_follow_the_columns(seen):
    offers = {o.op: o for o in authoring.opportunities(seen)}
    assert {k: o.columns for k, o in offers.items()} == {"datepart": ("t",), "log": ("a",), "interact": ("a", "b"), "bin": ("a", "b"), "target-encode": ("c",)}
    assert offers["log"].step(["a"]).params == {"columns": ["a"], "method": "log1p"}
    with pytest.raises(recipe.RecipeError):
        offers["log"].step(["b"])
    assert authoring.opportunities(profile(y=("categorical", 2, {}))) == []


def test_order_covers_every_operation():
    assert sorted(authoring.ORDER) == sorted(recipe.OPERATIONS) and sorted([*authoring.TOGETHER, *authoring.FORMS, "dedupe"]) == sorted(recipe.OPERATIONS)


def test_a_command_says_what_the_recipe_does():
    flags = {"drop": ["p,q"], "impute": ["a=mean", "b"], "bin": ["a=7:uniform"], "datepart": ["t=year+month"], "clip": ["a=0.05"], "rolling": ["a=4:max"], "tfidf": ["n"], "target-encode": ["c"], "interact": ["a,b"]}
    made = authoring.recipe_of(None, authoring.steps_from_flags(flags, True, "y", "t"), "y")
    words = shlex.split(authoring.command(made, "my data.csv"))[1:]
    args = cli.parser().parse_args(words)
    again = authoring.steps_from_flags({op: getattr(args, op.replace("-", "_")) for op in (*authoring.TOGETHER, *authoring.FORMS)}, args.dedupe, args.target, args.order_by)
    assert sorted(map(str, again)) == sorted(map(str, made.steps)) and args.data == "my data.csv" and not args.step
    odd = recipe.Recipe((recipe.Step("impute", {"columns": ["a=b"], "strategy": "constant", "value": 0}), recipe.Step("dedupe", {"subset": ["a"]})))
    args = cli.parser().parse_args(shlex.split(authoring.command(odd, "d"))[1:])
    assert [json.loads(x.partition(":")[2]) for x in args.step] == [s.params for s in odd.steps]


@pytest.mark.parametrize(("op", "text"), [("target-encode", "c"), ("lag", "a=1"), ("bin", "a=x"), ("log", "a=b:c")])
def test_flags_that_cannot_be_read(op, text):
    with pytest.raises(recipe.RecipeError):
        authoring.step_of_flag(op, text)


def test_charts_are_whole_documents():
    drawn = [
        charts.bars([("<a&b>", 3), ("b", 0)]), charts.bars([]), charts.histogram([(0.0, 1.0, 4), (1.0, 2.0, 0)]), charts.histogram([]), charts.box(0, 1, 2, 3, 4), charts.box(1, 1, 1, 1, 1),
        charts.intervals([("m", 0.5, 0.4, 0.6), ("n", 0.5, None, None)]), charts.cells({("x", "x"): 3, ("x", "y"): 1}), charts.cells({}), charts.curve([(0, 0), (1, 1)], diagonal=True),
    ]
    for text in drawn:
        assert xml.dom.minidom.parseString(text).documentElement.tagName == "svg"


def test_clean_by_flags_and_answers(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    rows = ["a,b,y"] + [f"{i % 17 if i % 9 else ''},{'u' if i % 3 else 'v'},{'yes' if i % 17 > 8 else 'no'}" for i in range(240)]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    assert cli.main(["clean", f"{tmp_path}/t.csv", "--ask"]) == 0
    assert "missing" in capsys.readouterr().out
    assert cli.main(["clean", f"{tmp_path}/t.csv", "--answer", "missing=median", "--encode", "b=ordinal", "--out", "r.yaml"]) == 0
    assert [s.op for s in recipe.Recipe.from_yaml((tmp_path / "r.yaml").read_text()).steps] == ["impute", "encode"]
    assert cli.main(["clean", f"{tmp_path}/t.csv", "--lag", "a=1"]) == 2
    assert cli.main(["init", "--set", f"data={tmp_path}/t.csv", "--set", "seed=5"]) == 0
    assert cli.main(["init"]) == 2
    assert cli.main(["info"]) == 0
    assert "t.csv" in capsys.readouterr().out
    assert cli.main(["inspect", "--html", "p.html", "--quiet"]) == 0
    page = (tmp_path / "p.html").read_text()
    assert page.count("<svg") >= 3 and "<script" not in page


def test_defaults_are_found_above_and_give_way_to_flags(tmp_path):
    (tmp_path / "in").mkdir()
    assert defaults.load(tmp_path / "in") == {}
    (tmp_path / defaults.FILE).write_text(defaults.as_toml({"target": 'a "b"', "cv": 3}))
    values = defaults.load(tmp_path / "in")
    assert values == {"target": 'a "b"', "cv": 3}
    args = cli.parser(values).parse_args(["bench", "d.csv", "--cv", "7"])
    assert (args.cv, args.target) == (7, 'a "b"')
    for bad in ("[defaults", "[defaults]\nfolds = 3\n", '[defaults]\ncv = "3"\n'):
        (tmp_path / defaults.FILE).write_text(bad)
        with pytest.raises(ValueError, match="quern.toml"):
            defaults.load(tmp_path)


def test_plugins(spark, monkeypatch):
    class Point:
        def __init__(self, name, found):
            self.name, self.value, self.found = name, f"pkg:{name}", found

        def load(self):
            if isinstance(self.found, Exception):
                raise self.found
            return self.found

    entry = modelling.ModelEntry("mine", ("regression",), lambda task, n: None)
    points = {"quern.models": [Point("mine", entry), Point("odd", 3), Point("gone", ImportError("x"))], "quern.metrics": [Point("bias", lambda t, p: F.avg(p - t))], "quern.adapters": [Point("none", lambda spark, path: None)]}
    monkeypatch.setattr(plugins.metadata, "entry_points", lambda group: points[group])
    for store in (modelling.CATALOGUE, plugins.METRICS, plugins.ADAPTERS):
        monkeypatch.setattr(plugins if store is not modelling.CATALOGUE else modelling, {id(modelling.CATALOGUE): "CATALOGUE", id(plugins.METRICS): "METRICS", id(plugins.ADAPTERS): "ADAPTERS"}[id(store)], dict(store))
    for _ in range(2):
        assert [(p.name, p.error is None) for p in plugins.load()] == [("mine", True), ("odd", False), ("gone", False), ("bias", True), ("none", True)]
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, prediction double")
    assert modelling.score(df, "y", "regression")["bias"] == 0.5
    assert plugins.read_model(spark, "x") is None
