"""Tests between models scored on the same folds."""

from __future__ import annotations

import math

from quern.functions.stats import t_quantile, t_two_sided


def corrected_paired_t_test(a: list[float], b: list[float], n_train: int, n_test: int) -> tuple[float, float, float]:
    """Mean difference, t and p of the corrected resampled t-test (Nadeau and Bengio, 2003)."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    k, mean = len(d), sum(d) / len(d) if d else 0.0
    if k < 2 or mean == 0:
        return mean, 0.0, 1.0
    var = sum((x - mean) ** 2 for x in d) / (k - 1)
    if var == 0:
        return mean, math.inf, 0.0
    t = mean / math.sqrt((1 / k + n_test / n_train) * var)
    return mean, t, t_two_sided(t, k - 1)


def holm(p_values: dict[str, float]) -> dict[str, float]:
    """Step-down adjusted p-values: a running maximum of p times the number of tests left."""
    out, worst = {}, 0.0
    for k, (name, p) in enumerate(sorted(p_values.items(), key=lambda x: (x[1], x[0]))):
        worst = max(worst, min(1.0, p * (len(p_values) - k)))
        out[name] = worst
    return {name: out[name] for name in p_values}


def fold_interval(scores: list[float], level: float = 0.95) -> tuple[float, float] | None:
    k = len(scores)
    if k < 2:
        return None
    mean = sum(scores) / k
    sem = math.sqrt(sum((x - mean) ** 2 for x in scores) / (k - 1) / k)
    half = t_quantile(0.5 + level / 2, k - 1) * sem
    return mean - half, mean + half


def compare_to_leader(scores: dict[str, list[float]], n_train: int, n_test: int, greater_is_better: bool = True, alpha: float = 0.05) -> list[dict]:
    """The best model by mean against each other one, Holm-adjusted."""
    order = sorted(scores, key=lambda m: (-1 if greater_is_better else 1) * sum(scores[m]) / len(scores[m]))
    tests = {m: corrected_paired_t_test(scores[order[0]], scores[m], n_train, n_test) for m in order[1:]}
    adjusted = holm({m: t[2] for m, t in tests.items()})
    return [{"leader": order[0], "other": m, "difference": t[0], "t": t[1], "p": t[2], "adjusted": adjusted[m], "distinct": adjusted[m] < alpha} for m, t in tests.items()]
