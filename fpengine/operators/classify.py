"""Classifier training, scoring and retraining (ML10-ML15) on pyspark.ml.

The original's kernel SVM with grid search is re-aimed to a linear one-vs-rest SVM with
balanced class weights, chosen by stratified k-fold cross-validation on macro-F1 (the
average over the union of true and predicted classes, computed with DataFrame ops)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import MaxAbsScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import per_class


class MacroF1Evaluator(Evaluator):
    """Macro-F1 over the union of true and predicted classes (zero division -> 0)."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol = labelCol
        self.predictionCol = predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        pc = per_class(dataset.select(F.col(self.labelCol).alias("t"), F.col(self.predictionCol).alias("p")), "t", "p")
        return float(pc.agg(F.avg("f1")).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def to_vector(df: DataFrame, array_col: str = "x", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def build_estimator(reg_params: Sequence[float] = (0.01, 0.1), max_iter: int = 15, weight_col: str | None = "weight",
                    class_parallelism: int = 4) -> tuple[Pipeline, list]:
    scaler = MaxAbsScaler(inputCol="features", outputCol="scaled")                         # ML10
    svc = LinearSVC(featuresCol="scaled", labelCol="label", maxIter=max_iter)
    if weight_col:
        svc.setWeightCol(weight_col)
    ovr = OneVsRest(classifier=svc, featuresCol="scaled", labelCol="label", parallelism=class_parallelism)
    if weight_col:
        ovr.setWeightCol(weight_col)
    pipe = Pipeline(stages=[scaler, ovr])
    grid = ParamGridBuilder().addGrid(svc.regParam, list(reg_params)).build()
    return pipe, grid


def cross_validate(train: DataFrame, *, fold_col: str = "fold", reg_params: Sequence[float] = (0.01, 0.1),
                   max_iter: int = 15, parallelism: int = 2, weight_col: str | None = "weight"):
    """ML12: CrossValidator with a precomputed stratified fold column (WIN3) and macro-F1.
    Returns the fitted CrossValidatorModel (bestModel is a PipelineModel)."""
    pipe, grid = build_estimator(reg_params, max_iter, weight_col)
    n_folds = train.select(fold_col).distinct().count()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MacroF1Evaluator(),
                        foldCol=fold_col, numFolds=n_folds, parallelism=parallelism)
    return cv.fit(train)


def save_and_load(model: PipelineModel, path: str) -> PipelineModel:
    """ML14 persistence: write the fitted pipeline and read it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions plus the decision margin (largest raw score)."""
    out = model.transform(df)
    return out.withColumn("margin", F.array_max(vector_to_array("rawPrediction")))
