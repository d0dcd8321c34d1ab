"""Metrics of scored rows: aggregates over confusion cells, scores and errors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.quantiles import exact_quantiles
from quern.operators import profile as P

#: Limits of slices, calibration, bootstrap and error patterns.
SLICE_COLUMNS, SLICE_VALUES, SLICE_ROWS, CALIBRATION_BINS = 6, 10, 20, 10
RESAMPLES, BOOTSTRAP_LEAST = 1000, 20


def detect_task(df: DataFrame, target: str) -> str:
    if not P.is_numeric(df.schema[target].dataType):
        return "classification"
    y = F.col(target).cast("double")
    n, k, whole = df.where(y.isNotNull()).agg(F.count(y), F.count_distinct(y), F.bool_and(y == F.round(y))).first()
    if not n or k > 50 or not whole:
        return "regression"
    if k <= 2:
        return "classification"
    return "regression" if k / n > 0.05 else "classification"


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``truth, predicted, n``; rows without truth are skipped; labels are compared as text if their types differ."""
    kinds = dict(df.dtypes)
    cols = [F.col(truth), F.col(predicted)]
    if kinds[truth] != kinds[predicted]:
        cols = [c.cast("string") for c in cols]
    return df.where(F.col(truth).isNotNull()).groupBy(cols[0].alias("truth"), cols[1].alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def label_metrics(cells: DataFrame) -> DataFrame:
    """One row of metrics from the confusion cells: macro averages over labels, or the largest label of two.

    A label without rows or predictions scores 0; balanced accuracy is over labels that occur in truth.
    """
    truths = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    guesses = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("p"))
    each = truths.join(guesses, "label", "full").fillna(0, ["t", "hit", "p"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    each = each.select("label", "t", "p", "hit", ratio(F.col("hit"), F.col("p")).alias("precision"), ratio(F.col("hit"), F.col("t")).alias("recall"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.sum("t").cast("double")
    hits, tp = F.sum("hit").cast("double"), F.sum(F.col("t").cast("double") * F.col("p"))
    tt, pp = F.sum(F.col("t").cast("double") * F.col("t")), F.sum(F.col("p").cast("double") * F.col("p"))
    pick = lambda c: F.when(F.count("label") <= 2, F.max_by(c, "label")).otherwise(F.avg(c))
    return each.agg(
        F.sum("t").alias("rows"), F.count("label").alias("labels"), (hits / n).alias("accuracy"), F.avg(F.when(F.col("t") > 0, F.col("recall"))).alias("balanced_accuracy"),
        pick("precision").alias("precision"), pick("recall").alias("recall"), pick("f1").alias("f1"),
        F.coalesce(F.try_divide(hits * n - tp, F.sqrt((n * n - tt) * (n * n - pp))), F.lit(0.0)).alias("mcc"),
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    e = y - p
    floor = lambda c: F.log1p(F.greatest(c, F.lit(0.0)))
    total = F.var_pop(y) * F.count(y)
    known = df.where(y.isNotNull())
    middle = exact_quantiles(known.select(F.lit(0).alias("k"), F.abs(e).alias("e")), "k", "e", [0.5]).agg(F.max(F.col("q")[0]).alias("median_ae"))
    means = known.agg(
        F.count(y).alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2"),
        (100 * F.avg(F.when(y != 0, F.abs(e / F.when(y != 0, y))))).alias("mape_percent"),
        F.sqrt(F.avg((floor(y) - floor(p)) * (floor(y) - floor(p)))).alias("rmsle"),
    )
    return means.crossJoin(F.broadcast(middle)).select("rows", "rmse", "mae", "r2", "median_ae", "mape_percent", "rmsle")  # one row each


def _bucket(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """Add how many of the sorted ``cuts`` a number reaches, by binary search; NaN reaches all."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
    return placed.withColumn(name, F.least(F.col(name), F.lit(float(len(cuts)))).cast("int"))


def _running(scores: DataFrame) -> DataFrame:
    """``score, pos, neg`` with sums over higher scores ``pos_above, neg_above``.

    Two levels: sums per bucket of scores (few rows) and sums within a bucket, so no task sees all scores.
    """
    buckets = min(4096, max(64, 4 * int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = scores.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    placed = _bucket(scores, "score", sorted({c for c in cuts if c == c and abs(c) < float("inf")}), "b")
    higher = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    sums = sums.select("b", F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("bn"))
    own = Window.partitionBy("b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(sums), "b").select(
        "score", "pos", "neg", (F.col("bp") + F.coalesce(F.sum("pos").over(own), F.lit(0))).alias("pos_above"),
        (F.col("bn") + F.coalesce(F.sum("neg").over(own), F.lit(0))).alias("neg_above"),
    )


def score_metrics(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """``roc_auc`` (ties count half), ``pr_auc`` (average precision over distinct scores), ``brier``, ``log_loss`` of a 0/1 truth."""
    rows = df.select(truth.cast("int").alias("y"), score.cast("double").alias("score")).where("y is not null and score is not null")
    points = _running(rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    wins = F.sum((F.col("pos_above") + F.col("pos") / 2) * F.col("neg"))
    ap = F.sum(F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")))
    curves = points.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"), F.try_divide(ap, F.sum("pos")).alias("pr_auc"))
    eps = 1e-15
    s = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    means = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"),
        (-F.avg(F.when(F.col("y") == 1, F.log(s)).otherwise(F.log(1 - s)))).alias("log_loss"),
    )
    return means.crossJoin(curves)  # one row each


def roc_auc_ovr(df: DataFrame, truth: str, scores: dict[str, Column]) -> DataFrame:
    """Macro one-vs-rest area: the mean over classes."""
    parts = [score_metrics(df, (F.col(truth).cast("string") == label).cast("int"), s).select("roc_auc") for label, s in scores.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def classification_baselines(df: DataFrame, truth: str) -> DataFrame:
    """``strategy, accuracy, balanced_accuracy`` of always guessing the most frequent label (the smallest of equals), and of
    guessing by class shares (in expectation)."""
    counts = df.where(F.col(truth).isNotNull()).groupBy(truth).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg((F.max("n") / F.sum("n")).alias("most"), (F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("random"), F.count(F.lit(1)).alias("k"))
    return facts.select(F.inline(F.array(
        F.struct(F.lit("most_frequent").alias("strategy"), F.col("most").alias("accuracy"), (1 / F.col("k")).alias("balanced_accuracy")),
        F.struct(F.lit("stratified").alias("strategy"), F.col("random").alias("accuracy"), (1 / F.col("k")).alias("balanced_accuracy")),
    )))


def regression_baselines(df: DataFrame, truth: str) -> DataFrame:
    y = F.col(truth).cast("double")
    centre = df.where(y.isNotNull()).agg(F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"))
    rows = df.where(y.isNotNull()).select(y.alias("y")).crossJoin(F.broadcast(centre))  # one row
    parts = F.array(*[F.struct(F.lit(s).alias("strategy"), (F.col("y") - F.col(s)).alias("e")) for s in ("mean", "median")])
    return rows.select(F.inline(parts)).groupBy("strategy").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))


def slice_columns(df: DataFrame, target: str) -> list[str]:
    names = [n for n in df.columns if n != target]
    facts = {r["column"]: r["unique"] for r in P.unique_missing(df, names).collect()}
    return [n for n in names if 2 <= facts.get(n, 0) <= 10][:SLICE_COLUMNS]


def slices(df: DataFrame, truth: str, predicted: str, columns: list[str], least: int = SLICE_ROWS) -> DataFrame:
    """``column, value, rows, balanced_accuracy`` of all slices in one melted aggregate, from cells per slice."""
    cells = P.melt(df.where(F.col(truth).isNotNull()), columns, "string", [truth, predicted]).where("value is not null")
    cells = cells.groupBy("column", "value", truth).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("hit"))
    out = cells.groupBy("column", "value").agg(F.sum("t").alias("rows"), F.avg(F.coalesce(F.col("hit"), F.lit(0)) / F.col("t")).alias("balanced_accuracy"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return out.withColumn("k", rank).where((F.col("k") <= SLICE_VALUES) & (F.col("rows") >= least)).drop("k")


def calibration(df: DataFrame, truth: Column, score: Column, bins: int = CALIBRATION_BINS) -> DataFrame:
    """``bin, rows, mean_score, mean_truth`` of equal bins on [0, 1], the last one closed; empty bins are left out."""
    rows = df.select(truth.cast("double").alias("y"), score.cast("double").alias("s")).where("y is not null and s is not null")
    return rows.groupBy(F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("s").alias("mean_score"), F.avg("y").alias("mean_truth")
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.round(F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("mean_truth"))) / F.sum("rows"), 4).alias("ece"))


def threshold_curve(df: DataFrame, truth: Column, score: Column, steps: int = 19, miss_cost: float = 1.0, alarm_cost: float = 1.0) -> DataFrame:
    """Cells and rates at cutoffs from 0.05 to 0.95, in one aggregate: a row adds to the last cutoff it reaches, and
    sums run over the few cutoffs."""
    steps = max(steps, 2)
    cuts = [round(0.05 + 0.9 * i / (steps - 1), 10) for i in range(steps)]
    rows = df.select(truth.cast("int").alias("y"), score.cast("double").alias("s")).where("y is not null and s is not null")
    counts = _bucket(rows, "s", cuts, "k").groupBy("k").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)] + [(0, None)], "k int, cutoff double")
    full = F.broadcast(grid).join(counts, "k", "left").fillna(0, ["pos", "neg"])
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = full.select(
        "cutoff", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(up)).alias("fn"), (F.sum("neg").over(whole) - F.sum("neg").over(up)).alias("tn"),
    ).where("cutoff is not null")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "cutoff", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), (tp + fp).alias("flagged"),
        (fn * F.lit(float(miss_cost)) + fp * F.lit(float(alarm_cost))).alias("cost"),
    )


def best_cutoff(curve: DataFrame, objective: str = "f1") -> DataFrame:
    order = F.col("cost").asc() if objective == "cost" else F.col(objective).desc()
    return curve.orderBy(order, "cutoff").limit(1)


def error_rows(df: DataFrame, truth: str, predicted: str, confidence: Column | None = None) -> DataFrame:
    """Wrong rows, the most confident first."""
    wrong = df.where(F.col(truth).isNotNull() & ~F.col(truth).eqNullSafe(F.col(predicted)))
    return wrong.withColumn("confidence", confidence if confidence is not None else F.lit(None).cast("double")).orderBy(F.desc_nulls_last("confidence"))


def residual_rows(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull()).withColumn("residual", F.col(truth) - F.col(predicted)).orderBy(F.desc_nulls_last(F.abs("residual")))


def error_patterns(df: DataFrame, wrong: Column, columns: list[str], least: int = 10, lift: float = 1.5) -> DataFrame:
    """``column, value, rows, error_rate, lift`` of groups with many more errors than the whole."""
    overall = df.agg(F.avg(wrong.cast("double")).alias("overall"))
    cells = P.melt(df.withColumn("_wrong", wrong.cast("double")), columns, "string", ["_wrong"]).where("value is not null")
    rates = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"), F.avg("_wrong").alias("error_rate"))
    joined = rates.crossJoin(F.broadcast(overall))  # one row
    return joined.withColumn("lift", F.try_divide(F.col("error_rate"), F.col("overall"))).where((F.col("rows") >= least) & (F.col("lift") >= lift)).drop("overall")


def bootstrap_label_metric(cells: list[tuple], metric, resamples: int = RESAMPLES, seed: int = 0) -> tuple[float, float] | None:
    """Percentile interval of ``metric(cells)``: rows drawn with replacement are a multinomial over the confusion
    cells, so no resample touches the data; None with few rows."""
    counts = np.array([c[2] for c in cells], float)
    n = int(counts.sum())
    if n < BOOTSTRAP_LEAST or resamples <= 0:
        return None
    draws = np.random.default_rng(seed).multinomial(n, counts / n, resamples)
    values = np.array([metric([(t, p, int(k)) for (t, p, _), k in zip(cells, d, strict=True)]) for d in draws], float)
    values = values[np.isfinite(values)]
    return tuple(np.percentile(values, [2.5, 97.5]).tolist()) if len(values) >= resamples / 2 else None


def balanced_accuracy_of(cells: list[tuple]) -> float:
    total, hit = {}, {}
    for t, p, n in cells:
        total[t] = total.get(t, 0) + n
        hit[t] = hit.get(t, 0) + (n if t == p else 0)
    return float(np.mean([hit[t] / n for t, n in total.items() if n])) if any(total.values()) else float("nan")


def bootstrap_rows(df: DataFrame, metric: dict[str, Column], key: list[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """``metric, ci_low, ci_high`` of means: Poisson weights of a hash of key and replicate stand for drawing rows.

    Every row enters every replicate, whatever the table's size.  All replicates and metrics share one pass; a row is
    expanded to its replicates only within its task.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", *key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cdf, term, weight = 0.0, float(np.exp(-1.0)), F.lit(0)
    for k in range(8):
        cdf += term
        weight = weight + (u > F.lit(cdf)).cast("int")
        term /= k + 1
    cells = df.select(*key, *[c.cast("double").alias(f"m_{m}") for m, c in metric.items()], F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep")).withColumn("w", weight)
    reps = cells.groupBy("rep").agg(*[F.try_divide(F.sum(F.col("w") * F.col(f"m_{m}")), F.sum(F.when(F.col(f"m_{m}").isNotNull(), F.col("w")))).alias(m) for m in metric])
    parts = [F.struct(F.lit(m).alias("metric"), F.percentile(F.col(m), F.array(F.lit(0.025), F.lit(0.975))).alias("q")) for m in metric]
    out = reps.agg(F.array(*parts).alias("x")).select(F.inline("x"))
    return out.select("metric", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
