"""Declarative recipes: a versioned list of steps, checked, fitted, applied and exported."""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from quern.operators import recipe_ops as ops

SCHEMA_VERSION = "1.0"
#: The operations and the parameters each one takes.
OPERATIONS = {
    "drop": {"columns"}, "dedupe": {"subset", "key"}, "cast": {"columns", "to"}, "impute": {"columns", "strategy", "value"},
    "clip": {"columns", "lower_quantile", "upper_quantile"}, "encode": {"columns", "method", "max_values"}, "scale": {"columns", "method"},
    "datepart": {"columns", "parts"}, "log": {"columns", "method"}, "interact": {"columns", "method"}, "binarize": {"columns", "threshold"},
    "bin": {"columns", "method", "bins"}, "target-encode": {"columns", "target", "smoothing", "folds", "seed", "key"}, "text-length": {"columns"},
    "tfidf": {"column", "max_features", "ngrams"}, "lag": {"columns", "by", "periods", "group", "key"},
    "rolling": {"columns", "by", "window", "stat", "min_periods", "group", "key"},
}
FITTED = {"impute", "encode", "scale", "bin", "target-encode", "tfidf"}


class RecipeError(ValueError):
    """A recipe, or a table it is applied to, is not as it must be."""


@dataclass(frozen=True)
class Step:
    op: str
    params: dict
    why: str = ""

    def __post_init__(self):
        if self.op not in OPERATIONS:
            raise RecipeError(f"unknown operation {self.op!r}; known are {', '.join(sorted(OPERATIONS))}")
        if extra := sorted(set(self.params) - OPERATIONS[self.op]):
            raise RecipeError(f"{self.op} takes no {', '.join(extra)}")

    @property
    def fitted(self) -> bool:
        """Whether the step learns from rows; dropping rows with gaps does not."""
        return self.op in FITTED and self.params.get("strategy") != "drop_rows"

    def columns(self) -> list[str]:
        p = self.params
        return [*p.get("columns", []), *([p["column"]] if "column" in p else []), *(p.get("subset") or [])]


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...]
    schema: dict[str, str] = field(default_factory=dict)
    target: str | None = None

    def as_dict(self) -> dict:
        steps = [{"op": s.op, **s.params, **({"why": s.why} if s.why else {})} for s in self.steps]
        return {"schema_version": SCHEMA_VERSION, "target": self.target, "source": {"columns": self.schema}, "steps": steps}

    @classmethod
    def from_dict(cls, data: dict) -> Recipe:
        if str(data.get("schema_version", SCHEMA_VERSION)).split(".")[0] != "1":
            raise RecipeError(f"recipes of version {data['schema_version']} are not known")
        steps = tuple(Step(s["op"], {k: v for k, v in s.items() if k not in ("op", "why")}, s.get("why", "")) for s in data.get("steps") or [])
        return cls(steps, dict((data.get("source") or {}).get("columns") or {}), data.get("target"))

    def to_yaml(self) -> str:
        import yaml

        return "# A recipe: steps run from top to bottom.\n" + yaml.safe_dump(self.as_dict(), sort_keys=False, allow_unicode=True)

    @classmethod
    def from_yaml(cls, text: str) -> Recipe:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})


def check_schema(recipe: Recipe, df: DataFrame, strict: bool = False) -> list[str]:
    """Notes on columns that the recipe knows and the table lacks, or the other way; the former is an error if strict."""
    gone = sorted(set(recipe.schema) - set(df.columns))
    if gone and strict:
        raise RecipeError(f"columns missing: {', '.join(gone)}")
    new = sorted(set(df.columns) - set(recipe.schema)) if recipe.schema else []
    return [*([f"columns missing: {', '.join(gone)}"] if gone else []), *([f"columns not in the recipe: {', '.join(new)}"] if new else [])]


def _runnable(step: Step, df: DataFrame, strict: bool) -> bool:
    names = step.columns()
    gone = [n for n in names if n not in df.columns]
    if gone and strict:
        raise RecipeError(f"{step.op}: no column {', '.join(gone)}")
    return step.op == "dedupe" or not names or len(gone) < len(names)


def _function(name: str):
    return getattr(ops, name.replace("-", "_"), None)


def fit_step(step: Step, df: DataFrame):
    fit = _function(f"fit_{step.op}")
    return fit(df, step.params) if fit else None


def _plain(x):
    """A learned value that JSON lacks, tagged with its type."""
    for name, kind in (("timestamp", datetime), ("date", date)):
        if isinstance(x, kind):
            return {f"${name}": x.isoformat()}
    if isinstance(x, Decimal):
        return {"$decimal": str(x)}
    raise TypeError(f"{type(x).__name__} can't be saved")


def _typed(x: dict):
    made = {"$timestamp": datetime.fromisoformat, "$date": date.fromisoformat, "$decimal": Decimal}
    tag = next(iter(x), None)
    return made[tag](x[tag]) if len(x) == 1 and tag in made else x


@dataclass
class FittedRecipe:
    """A recipe with what its steps learned, to be applied to other rows."""

    recipe: Recipe
    states: list

    def transform(self, df: DataFrame, keep_rows: bool = False) -> DataFrame:
        """``df`` prepared by what was learned; ``keep_rows`` leaves out steps that drop rows, as predictions need."""
        for step, state in zip(self.recipe.steps, self.states, strict=True):
            if keep_rows and (step.op == "dedupe" or step.params.get("strategy") == "drop_rows"):
                continue
            if state is not None or not (step.fitted or step.op == "clip"):
                df = _function(step.op)(df, step.params, state) if _runnable(step, df, False) else df
        return df


    def save(self, spark: SparkSession, path: str) -> None:
        """What was learned as JSON, and a table for each target-encoded column, as that may be as wide as the data."""
        states = []
        for i, state in enumerate(self.states):
            if state and "sums" in state:
                for k, table in enumerate(state["sums"].values()):
                    table.write.mode("overwrite").parquet(f"{path}/sums-{i}-{k}")
                state = state | {"sums": list(state["sums"])}
            states.append(state)
        text = json.dumps({"recipe": self.recipe.as_dict(), "states": states}, default=_plain)
        spark.createDataFrame([(text,)], "fitted string").write.mode("overwrite").parquet(f"{path}/states")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedRecipe:
        data = json.loads(spark.read.parquet(f"{path}/states").first()["fitted"], object_hook=_typed)
        for i, state in enumerate(data["states"]):
            if state and "sums" in state:
                state["sums"] = {n: spark.read.parquet(f"{path}/sums-{i}-{k}") for k, n in enumerate(state["sums"])}
        return cls(Recipe.from_dict(data["recipe"]), data["states"])


def fit(recipe: Recipe, df: DataFrame, strict: bool = False) -> tuple[FittedRecipe, DataFrame]:
    """Fit step by step on ``df``; returns the fitted recipe and ``df`` transformed (target encoding out of fold)."""
    states = []
    for step in recipe.steps:
        if not _runnable(step, df, strict):
            states.append(None)
            continue
        state = fit_step(step, df)
        states.append(state)
        df = ops.target_encode_oof(df, step.params) if step.op == "target-encode" else _function(step.op)(df, step.params, state)
    return FittedRecipe(recipe, states), df


@dataclass(frozen=True)
class Applied:
    frame: DataFrame
    notes: tuple[str, ...]


def apply(recipe: Recipe, df: DataFrame, strict: bool = False) -> Applied:
    notes = check_schema(recipe, df, strict)
    _, out = fit(recipe, df, strict)
    learned = [s.op for s in recipe.steps if s.fitted or s.op == "clip"]
    if learned:
        notes.append(f"learned from all rows: {', '.join(learned)}; split first if the result is used to judge a model")
    return Applied(out, tuple(notes))


def apply_deterministic(recipe: Recipe, df: DataFrame) -> DataFrame:
    return fit(Recipe(tuple(s for s in recipe.steps if not s.fitted)), df)[1]


def export(recipe: Recipe) -> str:
    """A standalone module: ``prepare(df)`` runs all steps, ``fit(df)`` returns a function for other rows."""
    used = {s.op.replace("-", "_") for s in recipe.steps}
    wanted = [f for f in vars(ops).values() if inspect.isfunction(f) and f.__module__ == ops.__name__]
    names = {f.__name__ for f in wanted}
    keep, todo = set(), [n for u in used for n in (u, f"fit_{u}", f"{u}_oof") if n in names]
    while todo:
        n = todo.pop()
        if n not in keep:
            keep.add(n)
            todo += [x for x in getattr(ops, n).__code__.co_names if x in names and x not in keep]
            for const in getattr(ops, n).__code__.co_consts:
                todo += [x for x in getattr(const, "co_names", ()) if x in names and x not in keep]
    body = "\n\n".join(inspect.getsource(f) for f in wanted if f.__name__ in keep)
    steps = ",\n    ".join(repr((s.op.replace("-", "_"), s.params)) for s in recipe.steps)
    return f'''"""Generated from a recipe."""

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

STEPS = [
    {steps}
]


{body}

def fit(df):
    """The prepared rows, and a function that prepares other rows by what these taught."""
    done = []
    for op, p in STEPS:
        learn, run = globals().get("fit_" + op), globals()[op]
        state = learn(df, p) if learn else None
        done.append((run, p, state))
        df = target_encode_oof(df, p) if op == "target_encode" else run(df, p, state)

    def transform(other):
        for run, p, state in done:
            other = run(other, p, state)
        return other

    return df, transform


def prepare(df):
    return fit(df)[0]
'''
