"""Command line: one verb per operator; user errors exit with 2, a failed gate with 1."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import quern
from quern.operators import artifacts, authoring, charts, defaults, drift, findings, metrics, modelling, plugins, profile, recipe, runs, splits
from quern.operators.explain import EXPLANATIONS
from quern.sources import io

KEY = "_row_key"


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def load(spark, args, path=None) -> DataFrame:
    return io.read_table(spark, path or args.data, args.sample, args.seed).frame


def keyed(df: DataFrame) -> DataFrame:
    """A key from the row alone, equal in any partitioning; equal rows are numbered, and which has which number is all one."""
    named = df.withColumn(KEY, F.md5(F.to_json(F.struct("*"))))
    k = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))
    return named.withColumn("_k", k).withColumn(KEY, F.concat_ws("-", KEY, "_k")).drop("_k")


def rows_of(df: DataFrame, limit: int = 1000) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def show(rows: list[dict]) -> None:
    print(runs.render(rows, list(rows[0]) if rows else ["(nothing)"]))


def gate(rows: list[dict], least: str | None) -> int:
    return int(bool(least) and any(findings.RANKS[r["severity"]] <= findings.RANKS[least] for r in rows))


def inspect(spark, a) -> int:
    df = load(spark, a)
    if a.target and a.target not in df.columns:
        raise io.InputError(f"no column {a.target}")
    done = artifacts.profile_table(df, a.target, {"path": a.data})
    found = done.findings
    kinds = [{"column": c.name, "kind": c.kind, "count": c.count, "missing": c.missing, "unique": c.unique} for c in done.columns]
    if a.json:
        with open(a.json, "w") as f:
            f.write(done.to_json())
    if a.html:
        with open(a.html, "w") as f:
            f.write(charts.profile_page(done))
    if not a.quiet:
        show(kinds)
        show(found)
    if a.explain:
        for kind in sorted({r["kind"] for r in found}):
            print(f"{kind}: {EXPLANATIONS.get(kind, '')}")
    return gate(found, a.fail_on)


def _side(spark, a, path: str) -> tuple[DataFrame, int]:
    """The snapshot and number of rows of a table, or of a profile that ``inspect --json`` wrote."""
    if path.endswith(".json"):
        with open(path) as f:
            saved = artifacts.DatasetProfile.from_json(f.read())
        return drift.snapshot_of_profile(spark, saved), saved.n_rows
    df = load(spark, a, path)
    return drift.snapshot(df), df.count()


def diff(spark, a) -> int:
    found = rows_of(drift.drift_of_sides(_side(spark, a, a.baseline), _side(spark, a, a.current)))
    if a.json:
        with open(a.json, "w") as f:
            json.dump(found, f, default=str)
    show(found)
    return gate(found, a.fail_on)


def _recipe(path: str) -> recipe.Recipe:
    with open(path) as f:
        return recipe.Recipe.from_yaml(f.read())


def clean(spark, a) -> int:
    """Write a recipe from flags, from answers to the questions that findings raise, and from ``--step op:{json}``."""
    df = load(spark, a)
    flags = {op: getattr(a, op.replace("-", "_")) for op in (*authoring.TOGETHER, *authoring.FORMS)}
    steps = authoring.steps_from_flags(flags, a.dedupe, a.target, a.order_by)
    for text in a.step:
        op, _, params = text.partition(":")
        steps.append(recipe.Step(op, json.loads(params or "{}")))
    if a.ask or a.answer:
        seen = artifacts.profile_table(df, a.target)
        if a.ask:
            show([{"question": q.kind, "columns": ", ".join(q.columns), "choices": ", ".join(q.choices)} for q in authoring.questions(seen)])
            show([{"operation": o.op, "columns": ", ".join(o.columns), "why": o.summary} for o in authoring.opportunities(seen)])
            return 0
        steps += authoring.recipe_from_answers(seen, dict(x.partition("=")[::2] for x in a.answer), a.target).steps
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    made = recipe.Recipe(authoring.ordered(steps), kinds, a.target)
    with open(a.out, "w") as f:
        f.write(made.to_yaml())
    print(authoring.command(made, a.data))
    return 0


def apply(spark, a) -> int:
    done = recipe.apply(_recipe(a.recipe), load(spark, a), a.strict)
    io.write_table(done.frame, a.out)
    print("\n".join(done.notes))
    return 0


def export(spark, a) -> int:
    with open(a.out, "w") as f:
        f.write(recipe.export(_recipe(a.recipe)))
    return 0


def split(spark, a) -> int:
    df = keyed(load(spark, a))
    df = splits.split(df, [KEY], a.strategy, a.test_size, a.target, a.group, a.time, a.seed)
    io.write_table(df.where(~F.col("is_test")).drop("is_test", KEY), a.train)
    io.write_table(df.where("is_test").drop("is_test", KEY), a.test)
    return 0


def bench(spark, a) -> int:
    if a.list_models:
        print("\n".join(modelling.available_models()))
        return 0
    df = keyed(load(spark, a))
    params = json.loads(a.params) if a.params else None
    steps = _recipe(a.recipe) if a.recipe else None
    out = modelling.run_benchmark(df, a.target, a.models.split(","), [KEY], a.cv, a.task, a.group, steps, params, a.metric, a.seed, a.balance)
    rows = [{"model": r.name, out.metric: r.mean if not r.failed else None, "seconds": r.seconds, "failed": r.failed} for r in out.results]
    show(rows)
    show(out.comparisons)
    if a.oof and out.oof is not None:
        io.write_table(out.oof, a.oof)
    if not a.no_save:
        sha = io.hash_table(df.drop(KEY))
        for r in out.results:
            if not r.failed:
                runs.save_manifest(runs.manifest("bench", sha, a.target, out.task, r.name, {out.metric: r.mean}, a.seed, 0, r.seconds), a.runs_dir)
    return 0


def tune(spark, a) -> int:
    out = modelling.tune_model(keyed(load(spark, a)), a.target, a.model, [KEY], a.strategy, a.candidates, a.cv, a.inner_cv, a.task, a.group, a.seed)
    print(json.dumps(out, indent=1))
    return 0


def ensemble(spark, a) -> int:
    df = keyed(load(spark, a))
    df = splits.split(df, [KEY], "random", 0.25, seed=a.seed)
    joined = modelling.fit_ensemble(df.where(~F.col("is_test")).drop("is_test"), a.target, a.models.split(","), [KEY], a.method, a.cv, a.task)
    print(json.dumps(modelling.score(joined.predict(df.where("is_test").drop("is_test")), a.target, joined.task), indent=1))
    return 0


def fit(spark, a) -> int:
    df, fitted = load(spark, a), None
    if a.recipe:
        fitted, df = recipe.fit(_recipe(a.recipe), df)
    model = modelling.fit_model(df, a.target, a.model, a.task, json.loads(a.params) if a.params else None)
    if model.model is None:
        raise io.InputError("the dummy is not saved")
    model.model.write().overwrite().save(a.out)
    spark.createDataFrame([(model.task, model.target, model.labels, fitted is not None)], FACTS).write.mode("overwrite").json(f"{a.out}/quern")
    if fitted:
        fitted.save(spark, f"{a.out}/quern-recipe")
    return 0


#: What stands beside a saved model; ``prepared``: the fitted steps of its recipe stand there, too.
FACTS = "task string, target string, labels array<string>, prepared boolean"


def _prepared(spark, a) -> DataFrame:
    """The rows as the model's recipe prepares them, by what it learned from the training rows."""
    df = load(spark, a)
    own = plugins.read_model(spark, a.model) is None
    if own and spark.read.schema(FACTS).json(f"{a.model}/quern").first()["prepared"]:
        return recipe.FittedRecipe.load(spark, f"{a.model}/quern-recipe").transform(df, keep_rows=True)
    given = getattr(a, "recipe", None)
    if not given:
        return df
    steps = _recipe(given)
    if learned := [s.op for s in steps.steps if s.fitted or s.op == "clip"]:
        raise recipe.RecipeError(f"{', '.join(learned)} must be learned with the model: give the recipe to fit")
    return recipe.apply_deterministic(steps, df)


def _model(spark, path: str) -> modelling.Fitted:
    if (foreign := plugins.read_model(spark, path)) is not None:
        return foreign
    facts = spark.read.schema(FACTS).json(f"{path}/quern").first()
    return modelling.Fitted(facts["task"], facts["target"], modelling.PipelineModel.load(path), list(facts["labels"] or []))


def predict(spark, a) -> int:
    df = _prepared(spark, a)
    model = _model(spark, a.model)
    out = model.predict(df).withColumnRenamed("prediction", a.label)
    if model.task == "classification":
        out = out.select("*", *[F.col("probability")[i].alias(f"proba_{x}") for i, x in enumerate(model.labels)]).drop("probability")
    if a.id:
        out = out.select(a.id, *[c for c in out.columns if c not in df.columns])
    io.write_table(out, a.out)
    return 0


def evaluate(spark, a) -> int:
    df, model = _prepared(spark, a), _model(spark, a.model)
    if not a.target:
        a.target = model.target
    if a.target not in df.columns:
        raise io.InputError(f"no column {a.target}")
    done = artifacts.evaluate_model(model, df, a.target, a.slice_by.split(",") if a.slice_by else None)
    found = done.metrics
    print(json.dumps({"task": done.task, "rows": done.rows, "metrics": found, "interval": done.interval}, indent=1, default=str))
    for rows in (done.baselines, done.slices, done.calibration):
        if rows:
            show(rows)
    show([{"severity": s, "check": c, "meaning": EXPLANATIONS.get(c, "")} for c, s in done.checks])
    if a.json:
        with open(a.json, "w") as f:
            json.dump(asdict(done), f, indent=1, default=str)
    if a.runs_dir:
        made = runs.manifest("eval", io.hash_table(df), a.target, done.task, a.model, found, a.seed, done.rows, details={"checks": done.checks})
        runs.save_manifest(made, a.runs_dir)
    for rule in a.fail_under or []:
        name, _, value = rule.partition("=")
        if name not in found:
            raise io.InputError(f"no metric {name}")
        if found[name] < float(value):
            return 1
    return 0


def _positive(df: DataFrame, model, a):
    at = model.labels.index(a.positive or model.labels[-1])
    return (F.col(a.target).cast("string") == model.labels[at]).cast("int"), F.col("probability")[at]


def threshold(spark, a) -> int:
    model = _model(spark, a.model)
    df = model.predict(_prepared(spark, a))
    y, s = _positive(df, model, a)
    curve = metrics.threshold_curve(df, y, s, a.steps, a.miss_cost, a.alarm_cost)
    show(rows_of(curve))
    show(rows_of(metrics.best_cutoff(curve, a.objective)))
    return 0


def errors(spark, a) -> int:
    model = _model(spark, a.model)
    df = model.predict(_prepared(spark, a))
    if model.task == "regression":
        wrong = metrics.residual_rows(df, a.target, "prediction")
    else:
        wrong = metrics.error_rows(df.withColumn("_t", F.col(a.target).cast("string")), "_t", "prediction", F.array_max("probability"))
    if a.out:
        io.write_table(wrong.drop("probability", "_t"), a.out)
    show(rows_of(wrong.drop("probability", "_t"), a.show))
    return 0


def sweep(spark, a) -> int:
    import yaml

    with open(a.plan) as f:
        data = yaml.safe_load(f)
    steps = tuple(_recipe(r) if r else None for r in data.get("recipes") or [None])
    plan = runs.SweepPlan(steps, tuple(data["models"]), tuple(data.get("seeds", [0])), data.get("folds", 5))
    if a.dry_run:
        print(f"{len(plan.cells())} cells")
        return 0
    df = load(spark, a, data["data"])
    show(runs.run_sweep(keyed(df), io.hash_table(df), data["target"], [KEY], plan, a.out, data.get("task"), a.force))
    return 0


def report(spark, a) -> int:
    rows = rows_of(runs.rank_runs(runs.runs_table(spark, runs.load_manifests(a.source))))
    text = runs.render(rows, ["dataset", "target", "rank", "model", "value"], a.format)
    with open(a.out, "w") as f:
        f.write(text)
    return 0


def info(spark, a) -> int:
    """Versions, and where each default comes from."""
    values, at = defaults.load(), defaults.find()
    show([{"what": "quern", "value": quern.__version__}, {"what": "Spark", "value": spark.version}, {"what": "Python", "value": platform.python_version()}])
    show([{"default": k, "value": values.get(k), "from": str(at) if k in values else "built-in"} for k in defaults.KEYS])
    return 0


def list_plugins(spark, a) -> int:
    show([asdict(p) for p in plugins.load()])
    return 0


def init(spark, a) -> int:
    """Write the project's defaults file; one that is there stays."""
    given = {k: v for k, v in (x.partition("=")[::2] for x in a.set)}
    if unknown := sorted(set(given) - set(defaults.KEYS)):
        raise io.InputError(f"no default {', '.join(unknown)}")
    with open(defaults.FILE, "x") as f:
        f.write(defaults.as_toml({k: defaults.KEYS[k](v) for k, v in given.items()}))
    return 0


def parser(values: dict | None = None) -> argparse.ArgumentParser:
    """The verbs; ``values`` stand in for flags that are not given."""
    values = values or {}
    top = argparse.ArgumentParser(prog="quern")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name, f, *positional, **options):
        p = verbs.add_parser(name)
        for x in positional:
            p.add_argument(x, **({"nargs": "?", "default": values[x]} if x == "data" and x in values else {}))
        p.add_argument("--sample", type=int, default=None)
        p.add_argument("--full", action="store_true")
        p.add_argument("--seed", type=int, default=values.get("seed", 0))
        for k, v in options.items():
            v = values.get(k, v)
            flag = "--" + k.replace("_", "-")
            if isinstance(v, bool):
                p.add_argument(flag, action="store_true")
            elif isinstance(v, list):
                p.add_argument(flag, action="append", default=v)
            else:
                p.add_argument(flag, default=v, type=type(v) if v is not None else str)
        p.set_defaults(run=f)

    verb("inspect", inspect, "data", target=None, html=None, json=None, explain=False, quiet=False, fail_on=None)
    verb("diff", diff, "baseline", "current", json=None, fail_on=None)
    flags = {op.replace("-", "_"): [] for op in (*authoring.TOGETHER, *authoring.FORMS)}
    verb("clean", clean, "data", out="recipe.yaml", target=None, step=[], dedupe=False, order_by=None, ask=False, answer=[], **flags)
    verb("apply", apply, "recipe", "data", out="out.parquet", strict=False)
    verb("export", export, "recipe", out="prepare.py")
    verb("split", split, "data", target=None, test_size=0.2, strategy="auto", group=None, time=None, train="train.parquet", test="test.parquet")
    verb("eval", evaluate, "model", "data", target=None, fail_under=[], slice_by=None, json=None, runs_dir=None)
    verb("threshold", threshold, "model", "data", target=None, positive=None, objective="f1", steps=19, miss_cost=1.0, alarm_cost=1.0)
    verb("errors", errors, "model", "data", target=None, show=20, out=None)
    verb("bench", bench, "data", target=None, models="linear,tree", list_models=False, task=None, cv=5, recipe=None, params=None, metric=None, group=None, balance=False, oof=None, no_save=False, runs_dir="runs")
    verb("tune", tune, "data", target=None, model="linear", strategy="random", candidates=30, cv=3, inner_cv=3, group=None, task=None)
    verb("ensemble", ensemble, "data", target=None, models="linear,tree", method="vote", cv=5, task=None)
    verb("fit", fit, "data", target=None, model="linear", out="model", recipe=None, params=None, task=None)
    verb("predict", predict, "model", "data", out="predictions.parquet", recipe=None, id=None, label="prediction")
    verb("sweep", sweep, "plan", out="sweep", force=False, dry_run=False)
    verb("report", report, "source", out="report.md", format="markdown")
    verb("info", info)
    verb("plugins", list_plugins)
    verb("init", init, set=[])
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        plugins.load()
        args = parser(defaults.load()).parse_args(argv)
        return args.run(spark_session(), args)
    except (io.InputError, recipe.RecipeError, ValueError, ImportError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
