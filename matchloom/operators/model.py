"""Training, calibrating and evaluating a matcher on pair features."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import deleted, shared_folder, stored
from .boosting import BINS, boosted_trees
from .curves import brier, by_score, class_weight, max_f1, metrics
from .features import FEATURE_NAMES

#: Stands for a missing feature; the has_* features tell it from a value.
MISSING = -1.0

#: Not used any more: trees beyond the patience that were grown at first, when growth went in increments.
FIRST = 30


def to_vectors(features: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """``features`` with a ``features`` vector and the label as ``y``."""
    filled = features.select("*", *[F.coalesce(F.col(n), F.lit(MISSING)).alias(f"_{n}") for n in names])
    out = VectorAssembler(inputCols=[f"_{n}" for n in names], outputCol="features").transform(filled).drop(*[f"_{n}" for n in names])
    return out.withColumn("y", F.col("label").cast("double"))


def train_model(train: DataFrame, valid: DataFrame, rounds: int = 1000, patience: int = 50, rate: float = 0.05, depth: int = 5, seed: int = 42, weight: float | None = None) -> GBTClassificationModel:
    """Boosted trees on ``features``/``y`` with early stopping.

    Positives weigh ``weight``, by default the number of negatives per positive; without positives ``ValueError``.
    Trees are grown in one job until the loss on ``valid`` has not improved for ``patience`` trees or there are ``rounds``, and the
    model is cut at its best tree.  Nothing is drawn at random; ``seed`` is only noted in the model.
    """
    if weight is None:
        weight = class_weight(train).head().weight
        if weight is None:
            raise ValueError("no positive examples in the training data")
    nodes = stored(boosted_trees(train, valid, float(weight), rounds, patience, rate, depth))
    losses = [r.loss for r in nodes.groupBy("tree").agg(F.max("loss").alias("loss")).orderBy("tree").collect()]
    size = best_round(losses, patience)[0] + 1
    params = {"featuresCol": "features", "labelCol": "y", "weightCol": "w", "maxIter": size, "stepSize": rate, "maxDepth": depth, "maxBins": BINS, "minInstancesPerNode": 20, "seed": seed, "featureSubsetStrategy": "all", "impurity": "variance"}
    return as_model(nodes.where(F.col("tree") < size), size, params, len(train.select("features").head().features))


def as_model(nodes: DataFrame, trees: int, params: dict, features: int) -> GBTClassificationModel:
    """The model of ``nodes`` (see ``boosting.NODES``), written as MLlib stores one and loaded."""
    spark = nodes.sparkSession
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"

    def about(kind: str, uid: str, own: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": own, "defaultParamMap": {}} | more)

    node = F.struct(
        F.col("node").alias("id"), "prediction", "impurity", F.array("weight", "total", "squares").alias("impurityStats"), F.col("rows").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"),
    )
    try:
        spark.createDataFrame([(about("classification.GBTClassificationModel", f"GBTClassifier_{uuid.uuid4().hex[:12]}", params, numFeatures=features, numTrees=trees),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
        each = [(t, about("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", {"maxDepth": params["maxDepth"], "impurity": "variance"}), params["stepSize"] if t else 1.0) for t in range(trees)]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
        nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{folder}/data")
        return GBTClassificationModel.load(folder)
    finally:
        deleted(spark, folder)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """Index of the least loss before ``patience`` rounds without a lower one, and whether these were reached."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


@dataclass
class CalibratedModel:
    """A raw scorer and the map from its scores to probabilities."""

    model: GBTClassificationModel
    isotonic: IsotonicRegressionModel

    def predict_raw(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with the uncalibrated probability ``raw``."""
        scored = self.model.transform(vectors)
        return scored.withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def predict_proba(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with ``raw`` and the calibrated ``probability``."""
        scored = self.isotonic.transform(self.predict_raw(vectors))
        return scored.withColumn("probability", F.least(F.greatest("_fit", F.lit(0.0)), F.lit(1.0))).drop("_fit")


def calibrate(model: GBTClassificationModel, valid: DataFrame) -> tuple[CalibratedModel, float]:
    """The calibrated model and its threshold with the best F1, both fitted on the validation split."""
    raw = CalibratedModel(model, None).predict_raw(valid)
    points = by_score(raw.select("y", F.col("raw").alias("s"))).select(F.col("s").alias("raw"), (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("y"), (F.col("pos") + F.col("neg")).cast("double").alias("w"))
    fitted = IsotonicRegression(featuresCol="raw", labelCol="y", weightCol="w", predictionCol="_fit", isotonic=True).fit(points)
    calibrated = CalibratedModel(model, fitted)
    scored = calibrated.predict_proba(valid).select("y", F.col("probability").alias("s"))
    return calibrated, max_f1(scored).head().threshold


def evaluate(calibrated: CalibratedModel, test: DataFrame, threshold: float) -> dict:
    """The ten figures on the calibrated score, and the raw score's Brier."""
    scored = calibrated.predict_proba(test).select("y", "raw", F.col("probability").alias("s")).persist()
    out = metrics(scored.select("y", "s"), threshold).head().asDict()
    raw = scored.select("y", F.col("raw").alias("s"))
    out["brier_score_raw"] = raw.agg(brier(raw).alias("b")).head().b
    scored.unpersist()
    return out


def evaluate_naive_baseline(test: DataFrame, valid: DataFrame, feature: str = "token_sort_ratio") -> dict:
    """One feature as the score: threshold from ``valid``, figures on ``test``."""
    pick = [F.col("label").cast("double").alias("y"), F.col(feature).alias("s")]
    threshold = max_f1(valid.select(*pick)).head().threshold
    return metrics(test.select(*pick), threshold).head().asDict() | {"baseline_feature": feature, "baseline_type": "single_feature_threshold"}


def feature_importance(model: GBTClassificationModel, spark, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """``(feature, gain)`` in ascending order of gain; gains sum to one."""
    rows = [(n, float(g)) for n, g in zip(names, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy("gain", "feature")
