"""Models, metrics and model readers of other packages, found by their entry points.

An entry point of ``quern.models`` gives a ``ModelEntry``; one of ``quern.metrics`` a function from the columns of truth
and prediction to an aggregate column; one of ``quern.adapters`` a function from the session and a path to a fitted
model, or None where it does not know the path.  One that cannot be loaded is reported and left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ("models", "metrics", "adapters")


@dataclass(frozen=True)
class Plugin:
    group: str
    name: str
    source: str
    error: str | None = None


METRICS: dict[str, Callable[[Column, Column], Column]] = {}
ADAPTERS: dict[str, Callable] = {}


def register_metric(name: str, aggregate: Callable[[Column, Column], Column]) -> None:
    if not callable(aggregate):
        raise ValueError(f"metric {name} is no function")
    METRICS[name] = aggregate


def register_adapter(name: str, read: Callable) -> None:
    if not callable(read):
        raise ValueError(f"adapter {name} is no function")
    ADAPTERS[name] = read


def _take(group: str, name: str, found) -> None:
    from quern.operators import modelling

    if group == "models":
        if not isinstance(found, modelling.ModelEntry):
            raise ValueError(f"model {name} is no ModelEntry")
        if modelling.CATALOGUE.get(found.name) is not found:
            modelling.register(found)
    else:
        {"metrics": register_metric, "adapters": register_adapter}[group](name, found)


def load() -> list[Plugin]:
    """Take in what is installed; loading again changes nothing."""
    out = []
    for group in GROUPS:
        for point in metadata.entry_points(group=f"quern.{group}"):
            error = None
            try:
                _take(group, point.name, point.load())
            except Exception as problem:  # noqa: BLE001 - a broken package must not stop the others
                error = f"{type(problem).__name__}: {problem}"
            out.append(Plugin(group, point.name, point.value, error))
    return out


def extra_metrics(predicted: DataFrame, target: str) -> dict[str, float]:
    """Registered metrics of a table with truth and ``prediction``, in one aggregate."""
    if not METRICS:
        return {}
    row = predicted.agg(*[f(F.col(f"`{target}`"), F.col("prediction")).cast("double").alias(name) for name, f in METRICS.items()]).first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def read_model(spark: SparkSession, path: str):
    """The first adapter's model that knows the path, or None."""
    for read in ADAPTERS.values():
        if (found := read(spark, path)) is not None:
            return found
    return None
