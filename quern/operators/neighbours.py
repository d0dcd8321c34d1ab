"""Nearest neighbours as a Spark ML estimator: a bounded hash sample of the training rows is the model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import functions as F

#: Training rows kept at most.
MOST_ROWS = 20_000


class NearestNeighbours(Estimator, HasLabelCol, HasFeaturesCol):
    """``k`` nearest by Euclidean distance; labels are 0, 1, ... if ``classify``."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    classify = Param(Params._dummy(), "classify", "classes or values", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, k=5, classify=True, labelCol="label", featuresCol="features"):
        super().__init__()
        self._setDefault(k=5, classify=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(self.getFeaturesCol()).alias("x")).where("y is not null")
        n = rows.count()
        if n > MOST_ROWS:
            rows = rows.where(F.pmod(F.xxhash64("x", "y"), F.lit(1_000_000)) < 1e6 * MOST_ROWS / n)
        found = rows.collect()
        model = NearestNeighboursModel(np.array([r["x"] for r in found], float), np.array([r["y"] for r in found], float), self.getOrDefault(self.k), self.getOrDefault(self.classify))
        return self._copyValues(model)


class NearestNeighboursModel(Model, HasFeaturesCol, HasLabelCol):
    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, classify: bool):
        super().__init__()
        self.x, self.y, self.neighbours, self.classes = x, y, k, int(y.max()) + 1 if classify and len(y) else 0

    def _transform(self, dataset):
        x, y, k, classes = self.x, self.y, min(self.neighbours, len(self.x)), self.classes
        norms = (x * x).sum(axis=1)

        @F.pandas_udf("array<double>")
        def near(features: pd.Series) -> pd.Series:
            out = []
            values = np.array(features.tolist(), float).reshape(len(features), -1)
            for at in range(0, len(values), 256):
                part = values[at : at + 256]
                nearest = np.argpartition(norms - 2 * part @ x.T, k - 1, axis=1)[:, :k]
                got = y[nearest]
                out += [np.bincount(r.astype(int), minlength=classes) / k for r in got] if classes else [[r.mean()] for r in got]
            return pd.Series(out)

        found = dataset.withColumn("_near", near(vector_to_array(self.getFeaturesCol())))
        if not classes:
            return found.withColumn("prediction", F.col("_near")[0]).drop("_near")
        best = (F.array_position("_near", F.array_max("_near")) - 1).cast("double")
        return found.withColumn("prediction", best).withColumn("probability", array_to_vector("_near")).drop("_near")
