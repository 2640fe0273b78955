"""Grid searches of linear regression and naive Bayes from one scan.

Both models are functions of sums over rows: linear regression of the moments of
(1, features, label), naive Bayes of feature sums by class.  So one aggregate per fold
holds all that a k-fold search needs: the sums that a model is fitted on are the sums of all
folds less those of the fold left out, and every grid point is solved on the driver
from tables whose size depends on the number of features only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import auc_by
from .ml import SEED, split_bucket


def fold_column(folds: int, id_col: str = "post_id", seed: int = SEED) -> Column:
    """The fold of a row, as ``fit_cv`` deals them."""
    return F.pmod(split_bucket(id_col, seed + 1), F.lit(folds)).cast("int")


def as_array(df: DataFrame, features: str | Sequence[str]) -> Column:
    """The features of a row as array<double>: of a vector or array column, or of several columns."""
    if not isinstance(features, str):
        return F.array(*[F.col(c).cast("double") for c in features])
    vector = isinstance(df.schema[features].dataType, VectorUDT)
    return vector_to_array(features) if vector else F.col(features).cast("array<double>")


def fold_moments(df: DataFrame, features: str | Sequence[str], label: str = "label", fold: str = "fold") -> dict[int, np.ndarray]:
    """fold -> sums of z z' over its rows, z = (1, features, label).

    Each task adds up its rows' products and sends one matrix a fold, row by row; the rows are
    added map-side and then over all tasks.  What reaches the driver is folds x (features + 2)^2
    numbers.  Rows without a label are left out.
    """
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(fold).cast("int").alias("fold"), as_array(df, features).alias("x"), F.col(label).cast("double").alias("y"))

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = np.column_stack([np.ones(batch.num_rows), x, batch.column("y").to_numpy(zero_copy_only=False)])
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(of).tolist():
                own = z[of == f]
                sums[f] = sums.get(f, 0.0) + own.T @ own
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()),
                                              pa.array(m.tolist(), pa.list_(pa.float64()))], names=["fold", "i", "v"])

    parts = rows.mapInArrow(products, "fold int, i int, v array<double>") \
        .groupBy("fold", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for f, i, v in parts.collect():
        out.setdefault(f, {})[i] = v.toArray()
    return {f: np.array([m[i] for i in range(len(m))]) for f, m in sorted(out.items())}


def soft(x: float, cut: float) -> float:
    return math.copysign(max(abs(x) - cut, 0.0), x)


def elastic_net(moments: np.ndarray, reg_param: float, elastic_net_param: float, tol: float = 1e-14,
                max_sweeps: int = 20_000) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, coefficients, standardised coefficients) of the least squares fit with an elastic
    net penalty, by coordinate descent on the correlations.

    Features and label are standardised by their population deviations and the penalty is
    divided by the label's, as Spark ML's LinearRegression does.  Constant features get 0.
    """
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # what rounding leaves of a constant is no variance
    sd[sd <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 0.0
    live = np.flatnonzero(sd[:-1] > 0)
    w = np.zeros(len(sd) - 1)
    if sd[-1] > 0 and len(live):
        c = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        cy = cov[live, -1] / (sd[live] * sd[-1])
        l1, l2 = (reg_param / sd[-1] * a for a in (elastic_net_param, 1.0 - elastic_net_param))
        own = np.zeros(len(live))
        for _ in range(max_sweeps):
            moved = 0.0
            for k in range(len(live)):
                new = soft(cy[k] - c[k] @ own + c[k, k] * own[k], l1) / (c[k, k] + l2)
                moved = max(moved, abs(new - own[k]))
                own[k] = new
            if moved <= tol:
                break
        w[live] = own
    b = np.divide(w * sd[-1], sd[:-1], out=np.zeros_like(w), where=sd[:-1] > 0)
    return float(mean[-1] - mean[:-1] @ b), b, w


def squared_error(moments: np.ndarray, intercept: float, b: np.ndarray) -> float:
    """Mean squared error of a fit on the rows behind the moments."""
    v = np.concatenate([[-intercept], -b, [1.0]])
    return float(v @ moments @ v / moments[0, 0])


def linear_path(moments: Mapping[int, np.ndarray], reg_params: Iterable[float], elastic_net_params: Iterable[float]) -> list[tuple]:
    """(fold, reg_param, elastic_net, n_train, n_test, mse, n_nonzero, l1_norm) of every fold and grid
    point: fitted on the other folds' moments, mse on the fold's own.  n_nonzero and l1_norm are
    of the standardised coefficients.  A fold that holds all rows has nothing to be fitted on and is left out."""
    total = sum(moments.values())
    out = []
    for f, own in moments.items():
        rest = total - own
        if rest[0, 0] < 0.5:
            continue
        for reg in reg_params:
            for mix in elastic_net_params:
                a, b, w = elastic_net(rest, reg, mix)
                out.append((f, float(reg), float(mix), round(rest[0, 0]), round(own[0, 0]), squared_error(own, a, b),
                            int((np.abs(w) > 1e-9).sum()), float(np.abs(w).sum())))
    return out


PATH_SCHEMA = ("fold int, reg_param double, elastic_net double, n_train long, n_test long, mse double, "
               "n_nonzero int, l1_norm double")


def lr_cv_path(train: DataFrame, features: str | Sequence[str], label: str = "label",
               reg_params: Sequence[float] = (0.2, 0.8), elastic_net_params: Sequence[float] = (0.0, 0.5, 1.0),
               folds: int = 5, id_col: str = "post_id", seed: int = SEED) -> DataFrame:
    """Held-out error of linear regression for every fold and grid point, from one job over the rows
    (folds x grid + 1 fits otherwise).  An empty table gives no rows."""
    data = train.withColumn("fold", fold_column(folds, id_col, seed))
    return train.sparkSession.createDataFrame(
        linear_path(fold_moments(data, features, label), reg_params, elastic_net_params), PATH_SCHEMA)


# --- naive Bayes ------------------------------------------------------------------------

def class_sums(df: DataFrame, features: str | Sequence[str], label: str = "label", fold: str = "fold") -> dict[int, np.ndarray]:
    """fold -> one row a class (0, 1, ...): (rows, sums of the features).  One aggregate, combined
    map-side; folds x classes x features numbers reach the driver."""
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("c"),
        array_to_vector(F.concat(F.array(F.lit(1.0)), as_array(df, features))).alias("v"))
    got = rows.groupBy("fold", "c").agg(Summarizer.sum(F.col("v")).alias("v")).collect()
    classes = 1 + max((r.c for r in got), default=-1)
    out: dict[int, np.ndarray] = {}
    for f, c, v in got:
        out.setdefault(f, np.zeros((classes, v.size)))[c] = v.toArray()
    return dict(sorted(out.items()))


def naive_bayes_logs(sums: np.ndarray, smoothing: float) -> np.ndarray:
    """One row a class: (log prior, log likelihood of each feature) of multinomial naive Bayes, priors
    and likelihoods smoothed as Spark ML's NaiveBayes does."""
    n, x = sums[:, 0], sums[:, 1:]
    prior = np.log(n + smoothing) - math.log(n.sum() + smoothing * len(n))
    return np.column_stack([prior, np.log(x + smoothing) - np.log(x.sum(axis=1, keepdims=True) + smoothing * x.shape[1])])


def nb_cv_scores(train: DataFrame, features: str | Sequence[str], label: str = "label", smoothing: Sequence[float] = (0.3, 0.8, 1.0),
                 folds: int = 5, id_col: str = "post_id", seed: int = SEED, digits: int = 9) -> DataFrame:
    """Held-out areas under the ROC curve of naive Bayes for every fold and smoothing value:
    fold, smoothing, n_test, auc_raw (rows ranked by the joint log likelihood of class 1, which is
    what Spark's evaluator takes from a model's raw predictions) and auc_margin (ranked by the log
    odds of class 1).  Two classes; scores equal in ``digits`` decimals are ties.

    One aggregate for the counts of all folds, then one scan that scores each row under its
    fold's models: a table of folds x smoothing values, broadcast, holds their weights.
    """
    return nb_fold_scores(train.withColumn("fold", fold_column(folds, id_col, seed)), features, label, smoothing, digits)


def nb_fold_scores(data: DataFrame, features: str | Sequence[str], label: str, smoothing: Sequence[float],
                   digits: int = 9) -> DataFrame:
    """``nb_cv_scores`` of rows that have their ``fold`` already."""
    data = data.where(F.col(label).isNotNull())
    sums = class_sums(data, features, label)
    total = sum(sums.values()) if sums else np.zeros((0, 0))
    weights = []
    for f, own in sums.items():
        rest = total - own
        if len(rest) != 2 or not rest[:, 0].all():
            continue
        for s in smoothing:
            logs = naive_bayes_logs(rest, s)
            weights.append((f, float(s), logs[1].tolist(), (logs[1] - logs[0]).tolist()))
    models = data.sparkSession.createDataFrame(weights, "fold int, smoothing double, raw array<double>, margin array<double>")
    x = F.concat(F.array(F.lit(1.0)), as_array(data, features))
    rows = data.select("fold", F.col(label).cast("int").alias("label"), x.alias("x")).join(F.broadcast(models), "fold")

    def dot(w: str) -> Column:
        products = F.zip_with("x", w, lambda a, b: a * b)
        return F.round(F.aggregate(products, F.lit(0.0), lambda s, v: s + v), digits)

    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), dot(k).alias("score")) for k in ("raw", "margin")]))
    areas = auc_by(rows.select("fold", "smoothing", "label", kinds.alias("s")).select("fold", "smoothing", "label", "s.*"),
                   ["fold", "smoothing", "kind"])
    return areas.groupBy("fold", "smoothing").agg(
        F.max("n").alias("n_test"), *[F.max(F.when(F.col("kind") == k, F.col("auc"))).alias(f"auc_{k}") for k in ("raw", "margin")])
