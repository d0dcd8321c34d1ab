"""Recipes from decisions: questions that findings raise, what a table's columns allow, and flags of the command line.

Everything here reads a profile, whose size is that of the columns, and no rows.
"""

from __future__ import annotations

import json
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from quern.operators.artifacts import DatasetProfile
from quern.operators.findings import RANKS
from quern.operators.recipe import Recipe, RecipeError, Step

#: The order in which the steps of an authored recipe run.
ORDER = (
    "drop", "dedupe", "cast", "datepart", "impute", "clip", "log", "binarize", "bin", "text-length", "lag", "rolling", "interact",
    "encode", "target-encode", "tfidf", "scale",
)
#: Skew from which a logarithm is offered; levels above which a column is too wide to encode by level; parts of dates.
SKEWED, WIDE, DATE_PARTS = 1.0, 15, ("year", "month", "day", "dayofweek")

#: Flags that name columns alone, in one step.
TOGETHER = ("drop", "interact", "target-encode", "text-length")
#: Flags ``column=a:b``: what stands after the column, with its type and what it is where it is left out.
FORMS: dict[str, tuple[tuple[str, Callable, object], ...]] = {
    "cast": (("to", str, "numeric"),), "impute": (("strategy", str, "median"),), "clip": (("lower_quantile", float, 0.01), ("upper_quantile", float, 0.99)),
    "encode": (("method", str, "onehot"),), "scale": (("method", str, "standard"),), "datepart": (("parts", lambda x: x.split("+"), list(DATE_PARTS)),),
    "log": (("method", str, "log1p"),), "binarize": (("threshold", float, 0.0),), "bin": (("bins", int, 5), ("method", str, "quantile")), "tfidf": (("max_features", int, 50),),
    "lag": (("periods", int, 1),), "rolling": (("window", int, 3), ("stat", str, "mean")),
}
ORDERED = ("lag", "rolling")


def ordered(steps: list[Step]) -> tuple[Step, ...]:
    return tuple(sorted(steps, key=lambda s: ORDER.index(s.op)))


def recipe_of(profile: DatasetProfile | None, steps: list[Step], target: str | None = None) -> Recipe:
    kinds = {c.name: c.kind for c in profile.columns} if profile else {}
    return Recipe(ordered(steps), kinds, target or (profile.target if profile else None))


@dataclass(frozen=True)
class Question:
    """A decision on all columns that have one kind of finding; ``choices`` name the steps, none of them for leaving it be."""

    kind: str
    columns: tuple[str, ...]
    choices: dict[str, tuple[Step, ...]]

    def answer(self, choice: str) -> tuple[Step, ...]:
        if choice not in self.choices:
            raise RecipeError(f"{self.kind}: no choice {choice!r}; there are {', '.join(self.choices)}")
        return self.choices[choice]


def _step(op: str, columns: list[str], **params) -> tuple[Step, ...]:
    return (Step(op, {"columns": list(columns), **params}),) if columns else ()


def _choices(kind: str, columns: list[str], kinds: dict[str, str], target: str | None) -> dict[str, tuple[Step, ...]]:
    """What can be done about a kind of finding; first what is usual."""
    numeric = [c for c in columns if kinds.get(c) == "numeric"]
    other = [c for c in columns if c not in numeric]
    drop = {"drop": _step("drop", [c for c in columns if c != target])}
    found = {
        "empty-column": drop, "constant-column": drop, "identifier-like": drop, "leakage-suspect": drop,
        "high-missing": drop | {"median": _step("impute", numeric, strategy="median"), "constant": _step("impute", numeric, strategy="constant", value=0)},
        "missing": {
            "median": _step("impute", numeric, strategy="median"), "mean": _step("impute", numeric, strategy="mean"),
            "most_frequent": _step("impute", other, strategy="most_frequent"), "drop_rows": _step("impute", columns, strategy="drop_rows"),
        } | drop,
        "numeric-stored-as-text": {"cast": _step("cast", columns, to="numeric")}, "datetime-stored-as-text": {"cast": _step("cast", columns, to="datetime")},
        "outliers": {"clip": _step("clip", numeric, lower_quantile=0.01, upper_quantile=0.99)},
        "high-cardinality": {"ordinal": _step("encode", columns, method="ordinal")} | drop,
    }.get(kind, {})
    return {name: steps for name, steps in found.items() if steps}


def questions(profile: DatasetProfile) -> list[Question]:
    """One question for each kind of finding that a step can mend, worst kinds first; "keep" is always a choice.

    Notes alone (severity ``info``) raise none, but for columns like identifiers.
    """
    kinds, target = {c.name: c.kind for c in profile.columns}, profile.target
    found: dict[str, list[list[str]]] = {}
    for f in sorted(profile.findings, key=lambda f: RANKS[f["severity"]]):
        if f["severity"] != "info" or f["kind"] == "identifier-like":
            found.setdefault(f["kind"], []).append(list(f["columns"]))
    out = []
    for kind, groups in found.items():
        if kind == "duplicate-rows":
            out.append(Question(kind, (), {"dedupe": (Step("dedupe", {}),), "keep": ()}))
            continue
        columns = list(dict.fromkeys(c for g in groups for c in g))
        if kind in ("duplicate-columns", "highly-correlated"):  # of columns that say the same, the first stays
            stays: list[str] = []
            for g in groups:
                stays += [c for c in g if c not in stays][: 0 if set(g) & set(stays) else 1]
            choices = {"drop": _step("drop", [c for c in columns if c not in stays and c != target])}
        else:
            choices = _choices(kind, columns, kinds, target)
        if choices := {name: steps for name, steps in choices.items() if steps}:
            out.append(Question(kind, tuple(columns), choices | {"keep": ()}))
    return out


def recipe_from_answers(profile: DatasetProfile, answers: dict[str, str], target: str | None = None) -> Recipe:
    """The recipe that ``answers`` (kind of finding to choice) make; a kind without a question is an error."""
    asked = {q.kind: q for q in questions(profile)}
    if unknown := sorted(set(answers) - set(asked)):
        raise RecipeError(f"nothing to decide on {', '.join(unknown)}; questions are {', '.join(asked) or 'none'}")
    return recipe_of(profile, [s for kind, choice in answers.items() for s in asked[kind].answer(choice)], target)


@dataclass(frozen=True)
class Opportunity:
    """An operation that the shape of some columns allows; whether it is of use is for the user to say."""

    op: str
    columns: tuple[str, ...]
    summary: str
    params: dict = field(default_factory=dict)

    def step(self, chosen: list[str]) -> Step:
        if unfit := sorted(set(chosen) - set(self.columns)):
            raise RecipeError(f"{self.op} does not suit {', '.join(unfit)}")
        return Step(self.op, {"columns": list(chosen), **self.params}, self.summary)


def opportunities(profile: DatasetProfile) -> list[Opportunity]:
    features = [c for c in profile.columns if c.name != profile.target]
    of = lambda test: tuple(c.name for c in features if test(c))
    numeric = of(lambda c: c.kind == "numeric")
    offers = [
        Opportunity("datepart", of(lambda c: c.kind == "datetime"), "parts of a date say more than the date as a number", {"parts": list(DATE_PARTS)}),
        Opportunity("log", of(lambda c: c.kind == "numeric" and abs(c.stats.get("skew") or 0.0) >= SKEWED), "a long tail, pulled in", {"method": "log1p"}),
        Opportunity("interact", numeric if len(numeric) > 1 else (), "products, which a sum of columns cannot express", {"method": "product"}),
        Opportunity("bin", numeric, "ranks in place of values", {"bins": 5, "method": "quantile"}),
    ]
    if profile.target:
        wide = of(lambda c: c.kind == "categorical" and c.unique > WIDE)
        offers.append(Opportunity("target-encode", wide, "many levels as means of the target, out of fold", {"target": profile.target}))
    return [o for o in offers if o.columns]


def step_of_flag(op: str, text: str, target: str | None = None, order_by: str | None = None) -> Step:
    """The step that a flag's text names: ``a,b`` or ``column=value:value``."""
    if op in TOGETHER:
        columns = [c for c in text.split(",") if c]
        if op != "target-encode":
            return Step(op, {"columns": columns, **({"method": "product"} if op == "interact" else {})})
        if not target:
            raise RecipeError("target-encode needs a target")
        if target in columns:
            raise RecipeError(f"the target {target} can't be encoded by itself")
        return Step(op, {"columns": columns, "target": target})
    name, _, rest = text.partition("=")
    given = rest.split(":") if rest else []
    if len(given) > len(FORMS[op]):
        raise RecipeError(f"{op}: {text!r} has more parts than {', '.join(n for n, _, _ in FORMS[op])}")
    try:
        params = {n: kind(given[i]) if i < len(given) and given[i] else usual for i, (n, kind, usual) in enumerate(FORMS[op])}
    except ValueError as error:
        raise RecipeError(f"{op}: {error}") from error
    if op in ORDERED:
        if not order_by:
            raise RecipeError(f"{op} needs a column that orders the rows")
        params["by"] = order_by
    return Step(op, ({"column": name} if op == "tfidf" else {"columns": [name]}) | params)


def steps_from_flags(flags: dict[str, list[str]], dedupe: bool = False, target: str | None = None, order_by: str | None = None) -> list[Step]:
    steps = [step_of_flag(op, text, target, order_by) for op, texts in flags.items() for text in texts]
    return steps + ([Step("dedupe", {})] if dedupe else [])


def _flags_of(step: Step, target: str | None) -> list[str] | None:
    """The flags that stand for a step, or None where reading them back would not give what it says."""
    rest = {k: v for k, v in step.params.items() if k not in ("columns", "column")}
    columns, form = step.columns(), FORMS.get(step.op, ())
    if step.op == "dedupe":
        return None if step.params else ["--dedupe"]
    if step.op in TOGETHER:
        flags = [f"--{step.op}", ",".join(columns)]
    else:
        show = lambda x: "+".join(x) if isinstance(x, list) else str(x)
        flags = [x for c in columns for x in (f"--{step.op}", f"{c}={':'.join(show(rest.get(n, usual)) for n, _, usual in form)}")]
    said = {n: usual for n, _, usual in form} | ({"method": "product"} if step.op == "interact" else {}) | rest
    try:
        back = [step_of_flag(step.op, text, target, rest.get("by")) for text in flags[1::2]]
    except RecipeError:
        return None
    same = all({k: v for k, v in b.params.items() if k not in ("columns", "column")} == said for b in back)
    return flags if same and [c for b in back for c in b.columns()] == columns else None


def command(recipe: Recipe, data: str) -> str:
    """The command that writes the recipe; what flags can't say stands as ``--step``."""
    parts, orders = ["quern", "clean", data], []
    for s in recipe.steps:
        flags = _flags_of(s, recipe.target)
        by = s.params.get("by")
        if flags and by and orders and by not in orders:  # one column orders the rows of all flags
            flags = None
        if flags and by:
            orders = [by]
        parts += flags or ["--step", f"{s.op}:{json.dumps(s.params, default=str)}"]
    parts += [x for by in orders for x in ("--order-by", by)]
    return shlex.join(parts + (["--target", recipe.target] if recipe.target else []))
