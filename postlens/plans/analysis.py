"""End-to-end engagement analysis: wide table -> features -> tuned models ->
held-out predictions and metrics, returned per task as one object."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame

from ..operators.features import assemble_features
from ..session import cut_lineage
from . import ml as ML


@dataclass
class TaskResult:
    task: str
    train: DataFrame
    test: DataFrame
    feature_model: PipelineModel
    models: dict[str, CrossValidatorModel]
    best_params: list = field(default_factory=list)
    metrics: list = field(default_factory=list)
    labels: list = field(default_factory=list)

    def predictions(self) -> DataFrame:
        return ML.predictions(self.models, self.test)


def run_task(wide: DataFrame, task: str = "classification", feature_set: str = "features",
             grids: Mapping[str, Mapping[str, list]] | None = None, folds: int = 5,
             parallelism: int = 8, checkpoint: bool = True) -> TaskResult:
    """Fit the feature pipeline on the training split, tune every model of the
    task by k-fold CV on ``feature_set`` ('features' or 'features_wtext'), and
    evaluate on the held-out split.  ``checkpoint``: not needed for a wide table
    that is one already (``shared_wide``)."""
    with_text = feature_set == "features_wtext" or "vector_lemma" in wide.columns
    train, test, feat = ML.prepare(wide, task, with_text=with_text, checkpoint=checkpoint)
    if feature_set != "features":
        train = train.withColumn("features", train[feature_set])
        test = test.withColumn("features", test[feature_set])
    models = ML.fit_cv(train, task, folds=folds, parallelism=parallelism, grids=grids)
    metrics = (ML.classifier_metrics(models, test) if task == "classification"
               else ML.regressor_metrics(models, test))
    return TaskResult(task, train, test, feat, models, ML.best_params(models), metrics,
                      ML.fitted_labels(feat) if task == "classification" else [])


def shared_wide(posts: DataFrame, comments: DataFrame, tasks=("classification", "regression")) -> DataFrame:
    """The wide table that all tasks' feature pipelines read, check-pointed once: comments are scored
    and posts tokenised one time, whatever the number of tasks."""
    wide = assemble_features(posts, comments, keep_tokens=True)
    return cut_lineage(wide.select(*ML.needed_columns([ML.default_outcome(t) for t in tasks])))


def run_analysis(posts: DataFrame, comments: DataFrame, tasks=("classification", "regression"),
                 **kwargs) -> dict[str, TaskResult]:
    """Both outcomes (comment positivity, number of likes) from the raw tables."""
    wide = shared_wide(posts, comments, tasks)
    return {t: run_task(wide, t, checkpoint=False, **kwargs) for t in tasks}
