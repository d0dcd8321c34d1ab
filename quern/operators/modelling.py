"""Models, cross-validated comparison, search, ensembles, importance.

Every fit and prediction is a distributed Spark ML job on a table that carries its fold; predictions keep the row's
key, so nothing is aligned by position.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import metrics, plugins, profile, recipe, significance, splits
from quern.operators.neighbours import NearestNeighbours

LEAST_ROWS_PER_FOLD = 5


@dataclass(frozen=True)
class ModelEntry:
    """A model of the catalogue: how to make it for a task, and whether it wants standardised features."""

    name: str
    tasks: tuple[str, ...]
    make: Callable
    scaled: bool = False
    summary: str = ""
    needs: str | None = None


def _missing(package: str) -> Callable:
    def make(task, n):
        raise ImportError(f"this model needs the package {package}, which is not installed")

    return make


BOTH = ("classification", "regression")
CATALOGUE: dict[str, ModelEntry] = {}


def register(entry: ModelEntry) -> None:
    """Add a model; also the door for plugins."""
    if entry.name in CATALOGUE:
        raise ValueError(f"there is a model named {entry.name} already")
    if not set(entry.tasks) <= set(BOTH):
        raise ValueError(f"tasks are {', '.join(BOTH)}")
    CATALOGUE[entry.name] = entry


def _pick(clf, reg):
    return lambda task, n: clf(n) if task == "classification" else reg(n)


for _e in (
    ModelEntry("dummy", BOTH, lambda task, n: None, summary="most frequent label or mean"),
    ModelEntry("linear", BOTH, _pick(lambda n: mc.LogisticRegression(maxIter=100), lambda n: mr.LinearRegression()), True, "logistic or least-squares regression"),
    ModelEntry("ridge", BOTH, _pick(lambda n: mc.LogisticRegression(maxIter=100, regParam=1.0 / max(n, 1), elasticNetParam=0.0), lambda n: mr.LinearRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False)), True, "squared penalty"),
    ModelEntry("lasso", ("regression",), lambda task, n: mr.LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False), True, "absolute penalty"),
    ModelEntry("tree", BOTH, _pick(lambda n: mc.DecisionTreeClassifier(seed=0), lambda n: mr.DecisionTreeRegressor(seed=0)), summary="one decision tree"),
    ModelEntry("rf", BOTH, _pick(lambda n: mc.RandomForestClassifier(numTrees=300, seed=0), lambda n: mr.RandomForestRegressor(numTrees=300, seed=0)), summary="random forest"),
    ModelEntry("extra-trees", BOTH, _pick(lambda n: mc.RandomForestClassifier(numTrees=300, seed=0, featureSubsetStrategy="onethird", maxBins=16), lambda n: mr.RandomForestRegressor(numTrees=300, seed=0, featureSubsetStrategy="onethird", maxBins=16)), summary="forest with coarse splits, an approximation"),
    ModelEntry("hist-gbm", BOTH, _pick(lambda n: mc.GBTClassifier(maxIter=40, seed=0), lambda n: mr.GBTRegressor(maxIter=40, seed=0)), summary="gradient-boosted trees"),
    ModelEntry("svm", ("classification",), lambda task, n: mc.LinearSVC(maxIter=100), True, "linear support vectors"),
    ModelEntry("naive-bayes", ("classification",), lambda task, n: mc.NaiveBayes(modelType="gaussian"), summary="Gaussian naive Bayes"),
    ModelEntry("knn", BOTH, _pick(lambda n: NearestNeighbours(k=5, classify=True), lambda n: NearestNeighbours(k=5, classify=False)), True, "five nearest neighbours of a bounded sample"),
    ModelEntry("fm", BOTH, _pick(lambda n: mc.FMClassifier(seed=0), lambda n: mr.FMRegressor(seed=0)), True, "factorisation machine"),
    ModelEntry("mlp", ("classification",), lambda task, n: mc.MultilayerPerceptronClassifier(maxIter=100, seed=0), True, "two-layer perceptron"),
    *(ModelEntry(n, BOTH, _missing(p), summary="optional", needs=p) for n, p in (("xgb", "xgboost"), ("lgbm", "synapseml"), ("catboost", "catboost-spark"), ("torch-mlp", "torch"))),
):
    register(_e)


def available_models(task: str | None = None) -> list[str]:
    return [e.name for e in CATALOGUE.values() if task is None or task in e.tasks]


def apply_params(estimator, params: dict):
    for name in params:
        if estimator is None or not estimator.hasParam(name):
            raise ValueError(f"the model takes no parameter {name!r}")
    return estimator.copy({estimator.getParam(k): v for k, v in params.items()}) if params else estimator


def feature_columns(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    numeric = [n for n in profile.columns_of(df, profile.is_numeric) if n not in exclude]
    labels = [n for n, t in df.dtypes if t in ("string", "boolean") and n not in exclude]
    return numeric, labels


def preparation(df: DataFrame, target: str, exclude: list[str], scaled: bool, one_hot: bool = True) -> list:
    """Stages: median for gaps, indices by frequency (unseen and missing kept apart), one-hot, one vector."""
    numeric, labels = feature_columns(df, [target, *exclude])
    stages: list = []
    parts = []
    if numeric:
        stages.append(Imputer(strategy="median", relativeError=0.001, inputCols=numeric, outputCols=[f"_n_{c}" for c in numeric]))
        parts += [f"_n_{c}" for c in numeric]
    if labels:
        stages.append(StringIndexer(inputCols=labels, outputCols=[f"_i_{c}" for c in labels], handleInvalid="keep"))
        ins = [f"_i_{c}" for c in labels]
        if one_hot:
            stages.append(OneHotEncoder(inputCols=ins, outputCols=[f"_o_{c}" for c in labels], handleInvalid="keep"))
            ins = [f"_o_{c}" for c in labels]
        parts += ins
    if not parts:
        raise ValueError("no usable feature columns")
    stages.append(VectorAssembler(inputCols=parts, outputCol="_raw" if scaled else "features", handleInvalid="keep"))
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return stages


def _typed(df: DataFrame, target: str, exclude: list[str]) -> DataFrame:
    numeric, labels = feature_columns(df, [target, *exclude])
    out = [F.col(c).cast("double").alias(c) if c in numeric else F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias(c) if c in labels else F.col(c) for c in df.columns]
    return df.select(*out)


@dataclass
class Fitted:
    """A fitted model: ``predict`` adds ``prediction`` and, for classes, an array ``probability`` in order of ``labels``."""

    task: str
    target: str
    model: PipelineModel | None
    labels: list[str] = field(default_factory=list)
    constant: object = None
    exclude: list[str] = field(default_factory=list)
    calibrators: object = None

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            if self.task == "regression":
                return df.withColumn("prediction", F.lit(float(self.constant)))
            shares = [1.0 if x == self.constant else 0.0 for x in self.labels]
            return df.withColumn("prediction", F.lit(self.constant)).withColumn("probability", F.array(*map(F.lit, shares)))
        names = df.columns
        out = self.model.transform(_typed(df, self.target, self.exclude) if self.target in df.columns else _typed(df.withColumn(self.target, F.lit(None).cast("string")), self.target, self.exclude))
        if self.task == "regression":
            return out.select(*names, "prediction")
        found = F.element_at(F.array(*map(F.lit, self.labels)), (F.col("prediction") + 1).cast("int")).alias("prediction")
        if "probability" in out.columns:
            share = vector_to_array("probability")
        else:
            share = F.transform(F.sequence(F.lit(0), F.lit(len(self.labels) - 1)), lambda i: (i == F.col("prediction")).cast("double"))
        return out.select(*names, found, share.alias("probability"))


def fit_model(df: DataFrame, target: str, name: str, task: str | None = None, params: dict | None = None, exclude: list[str] | None = None, balance: bool = False) -> Fitted:
    """Fit one model of the catalogue on the rows with a target."""
    exclude = exclude or []
    rows = df.where(F.col(target).isNotNull())
    task = task or metrics.detect_task(rows, target)
    entry = CATALOGUE.get(name)
    if entry is None:
        raise ValueError(f"no model {name!r}; there are {', '.join(CATALOGUE)}")
    if task not in entry.tasks:
        raise ValueError(f"{name} does not do {task}")
    labels: list[str] = []
    if task == "classification":
        counts = rows.groupBy(F.col(target).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")).orderBy("y").limit(1001).collect()
        if len(counts) > 1000:
            raise ValueError(f"{target} has more than 1000 classes")
        labels = [r["y"] for r in counts]
        most = max(counts, key=lambda r: r["n"])["y"] if counts else None
    n = rows.count()
    if name == "dummy" or (task == "classification" and len(labels) < 2):
        constant = most if task == "classification" else rows.agg(F.avg(F.col(target).cast("double"))).first()[0]
        return Fitted(task, target, None, labels, constant, exclude)
    estimator = apply_params(entry.make(task, n), params or {})
    if task == "classification":
        code = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        rows = rows.withColumn("_label", F.try_element_at(code, F.col(target).cast("string")))
    else:
        rows = rows.withColumn("_label", F.col(target).cast("double"))
    if balance and task == "classification" and estimator.hasParam("weightCol"):
        weight = F.create_map(*[x for r in counts for x in (F.lit(r["y"]), F.lit(n / (len(labels) * r["n"])))])
        rows = rows.withColumn("_weight", F.try_element_at(weight, F.col(target).cast("string")))
        estimator = estimator.copy({estimator.weightCol: "_weight"})
    skip = [*exclude, "_label", "_weight"]
    typed = _typed(rows, target, skip)
    stages = preparation(typed, target, skip, entry.scaled)
    estimator = estimator.copy({estimator.labelCol: "_label", estimator.featuresCol: "features"})
    if isinstance(estimator, mc.MultilayerPerceptronClassifier) and not estimator.isSet("layers"):
        prep = Pipeline(stages=stages).fit(typed)
        width = prep.transform(typed.limit(1)).select("features").first()[0].size
        estimator = estimator.copy({estimator.layers: [width, 32, len(labels)]})
    if isinstance(estimator, (mc.GBTClassifier, mc.LinearSVC, mc.FMClassifier)) and len(labels) > 2:
        estimator = mc.OneVsRest(classifier=estimator, labelCol="_label", featuresCol="features")
    return Fitted(task, target, Pipeline(stages=[*stages, estimator]).fit(typed), labels, None, exclude)


def score(predicted: DataFrame, target: str, task: str) -> dict[str, float]:
    if task == "regression":
        return {k: v for k, v in metrics.regression_metrics(predicted, target, "prediction").first().asDict().items() if v is not None} | plugins.extra_metrics(predicted, target)
    cells = metrics.confusion(predicted.withColumn("_t", F.col(target).cast("string")), "_t", "prediction")
    return {k: float(v) for k, v in metrics.label_metrics(cells).first().asDict().items() if v is not None} | plugins.extra_metrics(predicted, target)


HEADLINE = {"classification": ("balanced_accuracy", True), "regression": ("rmse", False)}


@dataclass
class ModelResult:
    name: str
    scores: list[float]
    details: list[dict]
    seconds: float
    failed: str | None = None

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else float("nan")

    @property
    def interval(self):
        return significance.fold_interval(self.scores)


@dataclass
class BenchResult:
    task: str
    metric: str
    greater_is_better: bool
    results: list[ModelResult]
    comparisons: list[dict]
    checks: list[tuple[str, str]]
    oof: DataFrame | None = None


def run_benchmark(
    df: DataFrame, target: str, models: list[str], key: list[str], folds: int = 5, task: str | None = None, group: str | None = None,
    steps: recipe.Recipe | None = None, params: dict[str, dict] | None = None, metric: str | None = None, seed: int = 0, balance: bool = False,
) -> BenchResult:
    """Cross-validate models (and always ``dummy``) on the same folds; a model that fails does not stop the others.

    Steps of a recipe that learn from rows are fitted on each fold's training rows and applied in their order.
    """
    rows = df.where(F.col(target).isNotNull())
    if group and group not in df.columns:
        raise ValueError(f"no column {group}")
    if steps:
        plain = recipe.Recipe(tuple(s for s in steps.steps if not s.fitted))
        learned = recipe.Recipe(tuple(s for s in steps.steps if s.fitted))
        rows = recipe.apply_deterministic(plain, rows)
    task = task or metrics.detect_task(rows, target)
    headline, up = (metric, HEADLINE[task][1] if metric is None else metric not in ("rmse", "mae", "median_ae", "rmsle", "mape_percent")) if metric else HEADLINE[task]
    rows = splits.make_folds(rows, key, target if task == "classification" else None, group, folds, seed).cache()
    n = rows.count()
    if n < folds * LEAST_ROWS_PER_FOLD:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    results, oof = [], None
    exclude = [*key, "fold", *([group] if group else [])]
    try:
        for name in dict.fromkeys([*models, "dummy"]):
            began, scores, details, failed = time.time(), [], [], None
            try:
                for k in range(folds):
                    train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
                    if steps and learned.steps:
                        fitted_recipe, train = recipe.fit(learned, train)
                        test = fitted_recipe.transform(test)
                    model = fit_model(train, target, name, task, (params or {}).get(name), exclude, balance)
                    predicted = model.predict(test)
                    found = score(predicted, target, task)
                    scores.append(found[headline])
                    details.append(found)
                    part = predicted.select(*key, F.col(target).cast("string").alias("truth"), F.lit(name).alias("model"), F.col("prediction").cast("string").alias("prediction"))
                    oof = part if oof is None else oof.unionByName(part)
            except Exception as error:  # noqa: BLE001 - a model's failure is a result
                failed = str(error).splitlines()[0]
            results.append(ModelResult(name, [] if failed else scores, details, time.time() - began, failed))
    finally:
        rows.unpersist()
    good = {r.name: r.scores for r in results if not r.failed}
    results.sort(key=lambda r: (bool(r.failed), (-1 if up else 1) * r.mean if not r.failed else 0))
    comparisons = significance.compare_to_leader(good, n * (folds - 1) // folds, n // folds, up) if len(good) > 1 else []
    return BenchResult(task, headline, up, results, comparisons, bench_checks(results, comparisons, up), oof)


def bench_checks(results: list[ModelResult], comparisons: list[dict], up: bool) -> list[tuple[str, str]]:
    """(kind, severity) of what stands out."""
    out = [("model-failed", "warn") for r in results if r.failed]
    good = [r for r in results if not r.failed]
    base = next((r for r in good if r.name == "dummy"), None)
    if base and good and good[0].name == "dummy":
        out.append(("below-baseline", "high"))
    rivals = [c for c in comparisons if c["other"] != "dummy"]
    if rivals and not rivals[0]["distinct"]:
        out.append(("no-clear-winner", "warn"))
    del up
    return out


#: Limits of the evaluation checks.
MARGIN, PERFECT, WIDE, MISCALIBRATED, SLICE_GAP, SMALL = 0.01, 0.999, 0.1, 0.1, 0.15, 100


def evaluation_checks(task: str, scores: dict, baseline: float | None, rows: int, interval=None, predicted_classes: int | None = None, ece: float | None = None, slice_scores: list[float] | None = None) -> list[tuple[str, str]]:
    name, up = HEADLINE[task]
    value, out = scores.get(name), []
    if value is not None and baseline is not None:
        better = value - baseline if up else baseline - value
        out.append(("beats-baseline", "info") if better > MARGIN else ("below-baseline", "high"))
    if (scores.get("r2") if task == "regression" else value or 0) is not None and (scores.get("r2", 0) if task == "regression" else value or 0) >= PERFECT:
        out.append(("suspiciously-perfect", "high"))
    if task == "classification" and interval and interval[1] - interval[0] >= WIDE:
        out.append(("wide-interval", "warn"))
    if predicted_classes == 1:
        out.append(("single-class-predictions", "high"))
    if ece is not None and ece >= MISCALIBRATED:
        out.append(("miscalibrated", "warn"))
    if task == "classification" and slice_scores and max(slice_scores) - min(slice_scores) >= SLICE_GAP:
        out.append(("slice-gap", "warn"))
    if rows < SMALL:
        out.append(("small-evaluation-set", "warn"))
    return out


#: Search spaces: parameters of the Spark ML estimators.
SPACES = {
    "linear": {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "ridge": {"regParam": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0]}, "lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "tree": {"maxDepth": [2, 3, 5, 8, 12], "minInstancesPerNode": [1, 5, 20]},
    "rf": {"numTrees": [50, 100, 300], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5, 20]},
    "hist-gbm": {"maxIter": [20, 40, 80], "maxDepth": [2, 3, 5], "stepSize": [0.03, 0.1, 0.3]}, "svm": {"regParam": [0.001, 0.01, 0.1, 1.0]},
}


def candidates(space: dict[str, list], strategy: str, n: int, seed: int) -> list[dict]:
    grid = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    if strategy == "grid":
        return grid
    if strategy == "bayes":
        raise ImportError("the bayes strategy needs the package optuna, which is not installed")
    return random.Random(seed).sample(grid, min(n, len(grid)))


def tune_model(
    df: DataFrame, target: str, name: str, key: list[str], strategy: str = "random", n: int = 30, folds: int = 3, inner: int = 3,
    task: str | None = None, group: str | None = None, seed: int = 0, space: dict | None = None,
) -> dict:
    """Nested cross-validation: parameters chosen on inner folds, judged on outer ones, and the choice most folds make.

    ``halving`` drops the worse half of the candidates on growing hash samples of the training rows.
    """
    if group and group not in df.columns:
        raise ValueError(f"no column {group}")
    rows = df.where(F.col(target).isNotNull())
    task = task or metrics.detect_task(rows, target)
    headline, up = HEADLINE[task]
    better = max if up else min
    options = candidates(space or SPACES[name], "random" if strategy == "halving" else strategy, n, seed)
    rows = splits.make_folds(rows, key, target if task == "classification" else None, group, folds, seed).withColumnRenamed("fold", "outer").cache()
    skip = [*key, "outer", "fold", *([group] if group else [])]

    def inner_score(train: DataFrame, p: dict) -> float:
        folded = splits.make_folds(train, key, target if task == "classification" else None, group, inner, seed + 1)
        return sum(score(fit_model(folded.where(F.col("fold") != k), target, name, task, p, skip).predict(folded.where(F.col("fold") == k)), target, task)[headline] for k in range(inner)) / inner

    chosen, outer, plain, best_inner = [], [], [], []
    for k in range(folds):
        train, test = rows.where(F.col("outer") != k), rows.where(F.col("outer") == k)
        left, share = options, 1.0 if strategy != "halving" else max(0.1, 1 / max(1, len(options)))
        while True:
            part = train if share >= 1 else train.where(F.pmod(F.xxhash64(*key), F.lit(1000)) < 1000 * share)
            found = [(inner_score(part, p), i) for i, p in enumerate(left)]
            found.sort(reverse=up)
            if share >= 1:
                break
            left, share = [left[i] for _, i in found[: max(1, len(left) // 2)]], min(1.0, share * 2)
        value, at = better(found)
        chosen.append(left[at])
        best_inner.append(value)
        outer.append(score(fit_model(train, target, name, task, left[at], skip).predict(test), target, task)[headline])
        plain.append(score(fit_model(train, target, name, task, None, skip).predict(test), target, task)[headline])
    rows.unpersist()
    modal = max(chosen, key=chosen.count)
    mean = lambda x: sum(x) / len(x)
    return {"params": modal, "metric": headline, "inner": mean(best_inner), "outer": mean(outer), "defaults": mean(plain), "optimism": (mean(best_inner) - mean(outer)) * (1 if up else -1)}


@dataclass
class Ensemble:
    """Fitted members and how they are joined."""

    members: list[Fitted]
    method: str
    task: str
    target: str
    final: object = None

    def predict(self, df: DataFrame) -> DataFrame:
        names, out = df.columns, df
        for i, m in enumerate(self.members):
            out = m.predict(out).withColumnRenamed("prediction", f"_p{i}")
            if self.task == "classification":
                out = out.withColumnRenamed("probability", f"_q{i}")
        cols = range(len(self.members))
        if self.task == "regression" and self.method == "vote":
            return out.select(*names, (sum((F.col(f"_p{i}") for i in cols), F.lit(0.0)) / len(self.members)).alias("prediction"))
        if self.task == "classification" and self.method == "vote":
            k = len(self.members[0].labels)
            mean = F.array(*[sum((F.col(f"_q{i}")[j] for i in cols), F.lit(0.0)) / len(self.members) for j in range(k)])
            out = out.withColumn("probability", mean)
            best = F.array_position("probability", F.array_max("probability"))
            return out.select(*names, F.element_at(F.array(*map(F.lit, self.members[0].labels)), best.cast("int")).alias("prediction"), "probability")
        done = self.final.transform(out.withColumn("meta", meta_features(self)))
        if self.task == "regression":
            return done.select(*names, "prediction")
        label = F.element_at(F.array(*map(F.lit, self.members[0].labels)), (F.col("prediction") + 1).cast("int"))
        return done.select(*names, label.alias("prediction"), vector_to_array("probability").alias("probability"))


def meta_features(e: Ensemble):
    if e.task == "regression":
        return array_to_vector(F.array(*[F.col(f"_p{i}") for i in range(len(e.members))]))
    return array_to_vector(F.concat(*[F.col(f"_q{i}") for i in range(len(e.members))]))


def fit_ensemble(df: DataFrame, target: str, models: list[str], key: list[str], method: str = "vote", folds: int = 5, task: str | None = None, exclude: list[str] | None = None, seed: int = 0) -> Ensemble:
    """Vote: mean of members' probabilities or values.  Stack: a linear model on out-of-fold member outputs."""
    rows = df.where(F.col(target).isNotNull())
    task = task or metrics.detect_task(rows, target)
    skip = [*key, *(exclude or []), "fold"]
    whole = Ensemble([fit_model(rows, target, m, task, None, skip) for m in models], method, task, target)
    if method == "vote":
        return whole
    folded = splits.make_folds(rows, key, target if task == "classification" else None, None, folds, seed)
    parts = None
    for k in range(folds):
        part = folded.where(F.col("fold") == k)
        names = part.columns
        members = [fit_model(folded.where(F.col("fold") != k), target, m, task, None, skip) for m in models]
        for i, m in enumerate(members):
            part = m.predict(part).withColumnRenamed("prediction", f"_p{i}")
            part = part.withColumnRenamed("probability", f"_q{i}") if task == "classification" else part
        part = part.withColumn("meta", meta_features(Ensemble(members, method, task, target))).select(*names, "meta")
        parts = part if parts is None else parts.unionByName(part)
    if task == "classification":
        code = F.create_map(*[x for i, v in enumerate(whole.members[0].labels) for x in (F.lit(v), F.lit(float(i)))])
        parts = parts.withColumn("_label", F.try_element_at(code, F.col(target).cast("string")))
        whole.final = mc.LogisticRegression(featuresCol="meta", labelCol="_label", regParam=0.01).fit(parts)
    else:
        whole.final = mr.LinearRegression(featuresCol="meta", labelCol="_label").fit(parts.withColumn("_label", F.col(target).cast("double")))
    return whole


def calibrate(model: Fitted, oof: DataFrame, method: str = "sigmoid"):
    """A function of the positive score, learned on out-of-fold scores ``(y, score)``: logistic, or isotonic."""
    if method == "isotonic":
        fitted = mr.IsotonicRegression(labelCol="y", featuresCol="score").fit(oof.withColumn("y", F.col("y").cast("double")))
        return lambda df: fitted.transform(df)
    logit = mc.LogisticRegression(labelCol="y", featuresCol="_s")
    vec = lambda df: df.withColumn("_s", array_to_vector(F.array("score")))
    fitted = logit.fit(vec(oof.withColumn("y", F.col("y").cast("double"))))
    return lambda df: fitted.transform(vec(df)).withColumn("prediction", vector_to_array("probability")[1])


def permutation_importance(model: Fitted, df: DataFrame, key: list[str], columns: list[str], repeats: int = 5) -> DataFrame:
    """``column, drop, spread``: what the headline loses when a column is dealt anew.

    Values move between rows by joining the rows' ranks in hash order within buckets of the key's hash, so no
    task holds a whole column.
    """
    headline, up = HEADLINE[model.task]
    base = score(model.predict(df), model.target, model.task)[headline]
    out = []
    from pyspark.sql import Window

    keys = [F.col(k) for k in key]
    for c in columns:
        drops = []
        for r in range(repeats):
            bucket = F.pmod(F.xxhash64(F.lit(r), *keys), F.lit(16))
            here = df.withColumn("_b", bucket).withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)))
            there = here.select("_b", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(r + 1), *keys))).alias("_k"), F.col(c).alias("_v"))
            mixed = here.join(there, ["_b", "_k"]).withColumn(c, F.col("_v")).select(*df.columns)
            value = score(model.predict(mixed), model.target, model.task)[headline]
            drops.append((base - value) if up else (value - base))
        mean = sum(drops) / len(drops)
        spread = (sum((d - mean) ** 2 for d in drops) / max(1, len(drops) - 1)) ** 0.5
        out.append((c, mean, spread))
    return df.sparkSession.createDataFrame(out, "column string, drop double, spread double").orderBy(F.desc("drop"))
