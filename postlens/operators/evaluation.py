"""Model evaluation as aggregates over a (label, prediction) frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, mse, rmse, mae, r2 — a single aggregate pass.
    r2 = 1 - SS_res / SS_tot with SS_tot around the label mean."""
    err = F.col(label) - F.col(prediction)
    one = pred.agg(F.count(F.lit(1)).alias("n"),
                   F.avg(err * err).alias("mse"),
                   F.avg(F.abs(err)).alias("mae"),
                   F.sum(err * err).alias("_ssr"),
                   (F.var_pop(label) * F.count(F.lit(1))).alias("_sst"))
    return one.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (F.lit(1.0) - F.col("_ssr") / F.col("_sst")).alias("r2"))


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label - prediction as ``residual``."""
    return pred.withColumn("residual", F.col(label) - F.col(prediction))


#: More classes than this are no classes.
MAX_CLASSES = 1000


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     max_classes: int = MAX_CLASSES) -> DataFrame:
    """(label, prediction, n) for every pair of classes, zero-filled: a class is any
    value that occurs as a label or as a prediction.  One aggregate over the rows;
    the class set is taken from its result.  Columns that hold no classes (more than
    ``max_classes`` values) are an error; nothing is left out."""
    n = pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))
    classes = n.select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.collect_set("c").alias("cs"))
    few = F.when(F.size("cs") <= max_classes, F.col("cs")).otherwise(F.raise_error(F.lit(f"more than {max_classes} classes")))
    pairs = classes.select(few.alias("cs")).select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("prediction"))
    return (pairs.join(n, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def confusion_matrix(pred: DataFrame, classes: Sequence[float] | None = None, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Rows = true label, one column per predicted class (pred_<k>), zero-filled.
    The classes are those that occur, and ``classes`` besides; none is left out."""
    long = confusion_counts(pred, label, prediction)
    seen = {float(r[0]) for r in long.select("label").distinct().collect()}
    every = sorted(seen | {float(c) for c in classes or ()})
    aggs = [F.sum(F.when(F.col("prediction") == F.lit(c), F.col("n")).otherwise(F.lit(0))).cast("bigint")
            .alias(f"pred_{c:g}") for c in every]
    rows = long.groupBy("label").agg(*aggs)
    unseen = [(c, *[0] * len(every)) for c in every if c not in seen]
    return rows.unionByName(pred.sparkSession.createDataFrame(unseen, rows.schema)) if unseen else rows


def prediction_counts(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(prediction).agg(F.count(F.lit(1)).alias("n"))


REPORT_SCHEMA = "class_name string, precision double, recall double, f1 double, support bigint"


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          max_pairs: int = 1_000_000) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and
    support-weighted averages — long form (class_name, precision, recall,
    f1, support).

    One aggregation job: the (label, prediction) count table has at most
    classes^2 rows whatever the input size, so it is brought back and the
    handful of report rows is computed from it.  Columns that hold no classes
    (more than ``max_pairs`` pairs) are an error; nothing is left out."""
    counts = (pred.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p"))
              .agg(F.count(F.lit(1)).alias("n")).limit(max_pairs + 1).collect())
    if len(counts) > max_pairs:
        raise ValueError(f"more than {max_pairs} (label, prediction) pairs: these columns hold no classes")
    pairs = [(float(r["l"]), float(r["p"]), int(r["n"])) for r in counts]
    return pred.sparkSession.createDataFrame(report_rows(pairs), REPORT_SCHEMA)


def report_rows(pairs: Sequence[tuple[float, float, int]]) -> list[tuple]:
    """Report rows from (label, prediction, count) triples."""
    classes = sorted({l for l, _, _ in pairs} | {p for _, p, _ in pairs})
    support = {c: sum(n for l, _, n in pairs if l == c) for c in classes}
    predicted = {c: sum(n for _, p, n in pairs if p == c) for c in classes}
    tp = {c: sum(n for l, p, n in pairs if l == c and p == c) for c in classes}
    rows = []
    for c in classes:
        prec = tp[c] / predicted[c] if predicted[c] else 0.0
        rec = tp[c] / support[c] if support[c] else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0
        rows.append((str(c), prec, rec, f1, support[c]))
    total = sum(support.values())
    k = len(rows)
    if k:
        rows.append(("accuracy", None, None, sum(tp.values()) / total, total))
        rows.append(("macro avg", sum(r[1] for r in rows[:k]) / k, sum(r[2] for r in rows[:k]) / k,
                     sum(r[3] for r in rows[:k]) / k, total))
        rows.append(("weighted avg", sum(r[1] * r[4] for r in rows[:k]) / total,
                     sum(r[2] * r[4] for r in rows[:k]) / total, sum(r[3] * r[4] for r in rows[:k]) / total,
                     total))
    return rows




def auc_by(scored: DataFrame, by: Sequence[str], label: str = "label", score: str = "score", bins: int = 1024) -> DataFrame:
    """Exact area under the ROC curve of each group: (by..., n, n_positive, auc); ties count
    half, and a group of one class only has a null area.  Label 1 is positive, null labels and
    scores are left out.

    Rows of one score become one row (combined map-side).  Scores are dealt into bins
    between their quantiles; what lies below inside a bin is a window over that bin, what lies in
    lower bins a window over at most ``bins`` rows a group, so no group is sorted in one task.
    """
    counts = cut_lineage(
        scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("_s"))
        .agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q")))
    edges = sorted(set(counts.approxQuantile("_s", [k / bins for k in range(1, bins)], 1e-4)))
    if edges:
        counts = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_s", outputCol="_bin").transform(counts)
    else:
        counts = counts.withColumn("_bin", F.lit(0.0))

    def below(*within):
        return F.coalesce(F.sum("_q").over(Window.partitionBy(*by, *within[:-1]).orderBy(within[-1])
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inside = counts.withColumn("_below", below("_bin", "_s")) \
        .withColumn("_area", F.col("_p") * (F.col("_below") + F.col("_q") / 2)) \
        .groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in ("_area", "_p", "_q")])
    return inside.withColumn("_below", below("_bin")).groupBy(*by).agg(
        F.sum(F.col("_p") + F.col("_q")).alias("n"), F.sum("_p").alias("n_positive"),
        F.try_divide(F.sum(F.col("_area") + F.col("_p") * F.col("_below")), F.sum("_p").cast("double") * F.sum("_q")).alias("auc"))
