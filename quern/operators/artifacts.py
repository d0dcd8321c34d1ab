"""Durable results: the profile of a table, and the evaluation of a model."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import findings, metrics, modelling, profile
from quern.operators.explain import EXPLANATIONS

SCHEMA_VERSION = "1.0"


@dataclass
class ColumnProfile:
    name: str
    kind: str
    dtype: str
    count: int
    missing: int
    unique: int
    stats: dict[str, float] = field(default_factory=dict)
    top_values: list[list] = field(default_factory=list)
    histogram: list[list] = field(default_factory=list)

    def __post_init__(self):
        if min(self.count, self.missing, self.unique) < 0 or self.unique > self.count:
            raise ValueError(f"{self.name}: counts can't be {self.count}, {self.missing}, {self.unique}")

    @property
    def missing_pct(self) -> float:
        n = self.count + self.missing
        return 100.0 * self.missing / n if n else 0.0


@dataclass
class DatasetProfile:
    n_rows: int
    duplicate_rows: int
    columns: list[ColumnProfile]
    findings: list[dict]
    target: str | None = None
    source: dict = field(default_factory=dict)
    created_at: str = ""
    schema_version: str = SCHEMA_VERSION

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"n_columns": len(self.columns)}, indent=1, default=str)

    @classmethod
    def from_json(cls, text: str) -> DatasetProfile:
        data = json.loads(text)
        if str(data.get("schema_version")).split(".")[0] != "1":
            raise ValueError(f"profiles of version {data.get('schema_version')} are not known")
        data.pop("n_columns", None)
        data["columns"] = [ColumnProfile(**c) for c in data["columns"]]
        return cls(**data)


def profile_table(df: DataFrame, target: str | None = None, source: dict | None = None, thresholds=findings.DEFAULT) -> DatasetProfile:
    """Everything known of each column, duplicates and findings; a fixed number of jobs, whatever the columns."""
    if target and target not in df.columns:
        raise ValueError(f"no column {target}")
    kinds = {r["column"]: r for r in profile.column_kinds(df).join(F.broadcast(profile.unique_missing(df).select("column", "missing")), "column").collect()}
    of = lambda test: profile.columns_of(df, test)
    numeric, dates = of(profile.is_numeric), of(lambda t: isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)))
    texts = [n for n, k in kinds.items() if k["kind"] == "text"]
    stats: dict[str, dict] = {}
    for names, f in ((numeric, profile.numeric_profile), (dates, profile.datetime_profile), (texts, profile.text_lengths)):
        if names:
            for r in f(df, names).collect():
                stats[r["column"]] = {k: float(v) for k, v in r.asDict().items() if k not in ("column", "count", "missing", "unique") and v is not None}
    top: dict[str, list] = {}
    for r in profile.top_values(df).orderBy("column", "rank").collect():
        top.setdefault(r["column"], []).append([r["value"], r["count"]])
    bins: dict[str, list] = {}
    if numeric:
        for r in profile.histogram(df, numeric).orderBy("column", "bin").collect():
            bins.setdefault(r["column"], []).append([r["low"], r["high"], r["count"]])
    dup = profile.duplicate_rows(df).first()
    found = [
        {"kind": r["kind"], "severity": r["severity"], "columns": list(r["columns"]), "summary": EXPLANATIONS.get(r["kind"], ""), "metrics": {"value": r["metric"]}}
        for r in findings.detect_findings(df, target, thresholds).collect()
    ]
    dtypes = dict(df.dtypes)
    columns = [
        ColumnProfile(n, kinds[n]["kind"], dtypes[n], kinds[n]["count"], kinds[n]["missing"], kinds[n]["unique"], stats.get(n, {}), top.get(n, []), bins.get(n, []))
        for n in df.columns if n in kinds
    ]
    return DatasetProfile(dup["rows"], dup["duplicate_rows"], columns, found, target, source or {}, datetime.now(UTC).isoformat())


@dataclass
class Evaluation:
    task: str
    rows: int
    metrics: dict[str, float]
    interval: tuple[float, float] | None
    baselines: list[dict]
    confusion: list[tuple]
    slices: list[dict]
    calibration: list[dict]
    checks: list[tuple[str, str]]


def evaluate_model(model: modelling.Fitted, df: DataFrame, target: str, slice_by: list[str] | None = None, resamples: int = metrics.RESAMPLES) -> Evaluation:
    """Metrics with an interval, baselines, slices, calibration and checks of a fitted model on rows with a target."""
    scored = model.predict(df.where(F.col(target).isNotNull()))
    found = modelling.score(scored, target, model.task)
    rows = int(found.pop("rows", 0))
    if model.task == "regression":
        base = [r.asDict() for r in metrics.regression_baselines(df, target).collect()]
        best = min((b["rmse"] for b in base if b["rmse"] is not None), default=None)
        return Evaluation(model.task, rows, found, None, base, [], [], [], modelling.evaluation_checks(model.task, found, best, rows))
    text = scored.withColumn("_t", F.col(target).cast("string"))
    cells = [tuple(r) for r in metrics.confusion(text, "_t", "prediction").collect()]
    interval = metrics.bootstrap_label_metric(cells, metrics.balanced_accuracy_of, resamples)
    base = [r.asDict() for r in metrics.classification_baselines(df, target).collect()]
    names = slice_by if slice_by is not None else metrics.slice_columns(df, target)
    parts = [r.asDict() for r in metrics.slices(text, "_t", "prediction", names).collect()] if names else []
    bins, ece = [], None
    if len(model.labels) == 2 and "probability" in scored.columns and len({t for t, _, _ in cells}) == 2:
        curve = metrics.calibration(text, (F.col("_t") == model.labels[1]).cast("int"), F.col("probability")[1]).cache()
        bins, ece = [r.asDict() for r in curve.orderBy("bin").collect()], metrics.calibration_error(curve).first()[0]
        found |= {k: v for k, v in metrics.score_metrics(text, (F.col("_t") == model.labels[1]).cast("int"), F.col("probability")[1]).first().asDict().items() if k != "rows"}
    checks = modelling.evaluation_checks(
        model.task, found, max((b["balanced_accuracy"] for b in base), default=None), rows, interval, len({p for _, p, _ in cells}), ece, [p["balanced_accuracy"] for p in parts]
    )
    return Evaluation(model.task, rows, found, interval, base, cells, parts, bins, checks)
