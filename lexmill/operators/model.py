"""A supervised classifier of document pairs on their n-gram features.

Features are normalised to zero mean and unit variance, expanded to products of two so the boundary
may curve, and classified by a logistic regression whose strength of regularisation three-fold cross
validation chooses. A pair counts as similar from a probability of one half.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from itertools import accumulate

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.score import confusion, precision_recall
from lexmill.session import cut

FEATURES = ["n_first", "n_second", "n_shared", "n_request", "n_shared_request"]


def in_training(key: Column, share: int = 90) -> Column:
    """A lasting split: whether a row's key falls into the first `share` hundredths."""
    return F.pmod(F.xxhash64(key), F.lit(100)) < share


def random_picks(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn with replacement; the driver draws places, of which each partition has its share."""
    rows = cut(df).withColumn("_at", F.monotonically_increasing_id())
    sizes = sorted(rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())  # a row per partition
    ends = list(accumulate(r["count"] for r in sizes))
    if not ends:
        return df.limit(0)
    drawn = [random.Random(seed + k).randrange(ends[-1]) for k in range(n)]
    places = [((p := bisect_right(ends, r)), r - (ends[p - 1] if p else 0)) for r in drawn]
    wanted = df.sparkSession.createDataFrame([((sizes[p]["part"] << 33) + i,) for p, i in places], "_at long")
    return rows.join(F.broadcast(wanted), "_at").select(df.columns)


def estimator() -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="scaled"),
        PolynomialExpansion(degree=2, inputCol="scaled", outputCol="features"),
        LogisticRegression(labelCol="y", maxIter=50),
    ])


def examples(features: DataFrame) -> DataFrame:
    """Valid pairs with the label y of 0 or 1."""
    return features.where("valid").withColumn("y", (F.col("label") > 0).cast("double"))


def train(features: DataFrame, folds: int = 3, regularisations: tuple[float, ...] = (0.001, 0.1)) -> PipelineModel:
    """The model of the best regularisation."""
    pipeline = estimator()
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, list(regularisations)).build()
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=folds, seed=7)
    return search.fit(examples(features)).bestModel


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Valid pairs with the predicted class."""
    return model.transform(examples(features)).withColumn("similar", F.col("prediction") == 1.0)


def evaluate(model: PipelineModel, features: DataFrame) -> DataFrame:
    """One row: precision, recall and f1 on the pairs."""
    return precision_recall(confusion(predict(model, features), F.col("y") == 1, F.col("similar")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
