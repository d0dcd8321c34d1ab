"""Run manifests, content-addressed sweeps and reports."""

from __future__ import annotations

import html
import itertools
import json
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import modelling
from quern.sources.io import hash_payload

SCHEMA_VERSION = "1.0"


def manifest(kind: str, dataset_sha: str, target: str, task: str, model: str, scores: dict, seed: int = 0, rows: int = 0, seconds: float = 0.0, details: dict | None = None) -> dict:
    name, up = modelling.HEADLINE[task]
    values = [{"name": k, "value": v, "ci_low": None, "ci_high": None, "greater_is_better": up if k == name else None} for k, v in scores.items()]
    return {
        "schema_version": SCHEMA_VERSION, "run_id": uuid.uuid4().hex[:12], "kind": kind, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "dataset": {"sha256": dataset_sha}, "target": target, "task": task, "model": {"reference": model, "params": {}}, "metrics": values, "headline": name,
        "checks": [], "details": details or {}, "seed": seed, "n_rows": rows, "duration_s": seconds,
    }


def save_manifest(data: dict, folder: str) -> str:
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    path = at / f"{data['run_id']}.json"
    path.write_text(json.dumps(data, indent=1, sort_keys=True))
    return str(path)


def load_manifests(folder: str) -> list[dict]:
    """Readable manifests of a folder; an error if there is none."""
    found = []
    for p in sorted(Path(folder).glob("*.json")):
        try:
            data = json.loads(p.read_text())
        except ValueError:
            continue
        if isinstance(data, dict) and "run_id" in data:
            found.append(data)
    if not found:
        raise ValueError(f"no runs in {folder}")
    return found


def rank_runs(runs: DataFrame) -> DataFrame:
    """``runs(run_id, dataset, target, value, greater_is_better)`` with ``rank`` within (dataset, target), best first."""
    order = F.when(F.col("greater_is_better"), -F.col("value")).otherwise(F.col("value"))
    return runs.withColumn("rank", F.rank().over(Window.partitionBy("dataset", "target").orderBy(order)))


def runs_table(spark: SparkSession, manifests: list[dict]) -> DataFrame:
    rows = []
    for m in manifests:
        head = next((x for x in m["metrics"] if x["name"] == m.get("headline")), m["metrics"][0] if m["metrics"] else None)
        if head:
            rows.append((m["run_id"], m["dataset"]["sha256"], m["target"], m["model"]["reference"], float(head["value"]), bool(head["greater_is_better"])))
    return spark.createDataFrame(rows, "run_id string, dataset string, target string, model string, value double, greater_is_better boolean")


@dataclass(frozen=True)
class SweepPlan:
    recipes: tuple
    models: tuple[str, ...]
    seeds: tuple[int, ...]
    folds: int = 5

    def cells(self):
        return list(itertools.product(range(len(self.recipes)), self.models, self.seeds))


def cell_key(data_sha: str, recipe: dict | None, model: str, seed: int, folds: int, target: str, task: str | None) -> str:
    return hash_payload([data_sha, recipe, model, seed, folds, target, task])[:16]


def run_sweep(df: DataFrame, data_sha: str, target: str, key: list[str], plan: SweepPlan, folder: str, task: str | None = None, force: bool = False) -> list[dict]:
    """Every cell of the grid once: found by its key, or run and saved, or failed."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    out = []
    for r, model, seed in plan.cells():
        steps = plan.recipes[r]
        k = cell_key(data_sha, steps.as_dict() if steps else None, model, seed, plan.folds, target, task)
        path = at / f"{k}.json"
        if path.exists() and not force:
            out.append(json.loads(path.read_text()) | {"status": "cached"})
            continue
        cell = {"key": k, "recipe": r, "model": model, "seed": seed}
        try:
            result = modelling.run_benchmark(df, target, [model], key, plan.folds, task, None, steps, seed=seed)
            own = next(x for x in result.results if x.name == model)
            if own.failed:
                raise ValueError(own.failed)
            cell |= {"metric": result.metric, "value": own.mean, "greater_is_better": result.greater_is_better}
            path.write_text(json.dumps(cell))
            out.append(cell | {"status": "ran"})
        except Exception as error:  # noqa: BLE001 - a cell's failure is a result
            out.append(cell | {"status": "failed", "error": str(error).splitlines()[0]})
    good = [c for c in out if c["status"] != "failed"]
    good.sort(key=lambda c: -c["value"] if c["greater_is_better"] else c["value"])
    return good + [c for c in out if c["status"] == "failed"]


def render(rows: list[dict], columns: list[str], kind: str = "markdown") -> str:
    """A table as Markdown, HTML or LaTeX; names are escaped."""
    text = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
    if kind == "markdown":
        esc = lambda s: s.replace("|", "\\|")
        lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        return "\n".join(lines + ["| " + " | ".join(esc(text(r.get(c))) for c in columns) + " |" for r in rows]) + "\n"
    if kind == "html":
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(text(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows)
        return f"<!doctype html><meta charset=utf-8><table><tr>{head}</tr>{body}</table>\n"
    if kind == "latex":
        esc = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
        body = " \\\\\n".join(" & ".join(esc(text(r.get(c))) for c in columns) for r in rows)
        return f"\\begin{{tabular}}{{{'l' * len(columns)}}}\n{' & '.join(map(esc, columns))} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}\n"
    raise ValueError(f"unknown format {kind!r}")
