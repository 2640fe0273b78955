"""Grid searches from one scan against Spark ML's own fits."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from postlens.operators.evaluation import auc_by
from postlens.plans import ml as ML
from postlens.plans import onescan as OS

COLS = ["a", "b", "c", "k", "n"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(3)
    out = []
    for i in range(700):
        a, b, n = rnd.normal(), rnd.normal(), int(rnd.poisson(3))
        c = a * 0.9 + 0.2 * rnd.normal()
        out.append((str(i), abs(float(a)), abs(float(b)), abs(float(c)), 5.0, n,
                    float(3 * a - 2 * b + 0.3 * n + rnd.normal() + 40), float(rnd.random() < 1 / (1 + np.exp(-a - 0.5 * n + 1.5)))))
    schema = "post_id string, a double, b double, c double, k double, n int, y double, high double"
    return spark.createDataFrame(out, schema).withColumn("fold", OS.fold_column(3)).repartition(5).cache()


@pytest.fixture(scope="module", autouse=True)
def release(rows):
    yield
    rows.unpersist()


def test_linear_path_equals_spark_fits(spark, rows):
    """Every fold and grid point, a constant feature included."""
    got = {(r.fold, r.reg_param, r.elastic_net): r for r in
           OS.lr_cv_path(rows, COLS, "y", (0.0, 0.05, 0.4), (0.0, 0.5, 1.0), folds=3).collect()}
    assert len(got) == 27
    data = VectorAssembler(inputCols=COLS, outputCol="features").transform(rows).cache()
    ev = RegressionEvaluator(labelCol="y", metricName="mse")
    for (f, reg, mix), r in got.items():
        model = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=mix, maxIter=5000, tol=1e-13).fit(data.where(F.col("fold") != f))
        assert ev.evaluate(model.transform(data.where(F.col("fold") == f))) == pytest.approx(r.mse, rel=1e-6)
        assert r.n_nonzero == sum(abs(x) > 1e-7 for x in model.coefficients)
    data.unpersist()


def test_moments_do_not_depend_on_the_column_kind(rows):
    data = VectorAssembler(inputCols=COLS, outputCol="v").transform(rows).withColumn("arr", F.array(*[F.col(c).cast("double") for c in COLS]))
    one = OS.fold_moments(data, COLS, "y")
    for features in ("v", "arr"):
        for f, m in OS.fold_moments(data, features, "y").items():
            assert np.allclose(m, one[f], rtol=1e-12)
    nulls = data.withColumn("y", F.when(F.col("fold") != 1, F.col("y")))
    assert set(OS.fold_moments(nulls, COLS, "y")) == {0, 2}


def test_constant_label_and_single_row():
    m = np.ones((3, 3)) * 1.0
    a, b, w = OS.elastic_net(m, 0.1, 0.5)
    assert (a, b.tolist(), w.tolist()) == (1.0, [0.0], [0.0])
    assert OS.linear_path({0: m}, [0.1], [0.5]) == []


def test_naive_bayes_scores_equal_spark_fits(rows):
    got = {(r.fold, r.smoothing): r for r in OS.nb_cv_scores(rows, COLS, "high", (0.3, 1.0), folds=3).collect()}
    assert len(got) == 6
    data = VectorAssembler(inputCols=COLS, outputCol="features").transform(rows).cache()
    ev = BinaryClassificationEvaluator(labelCol="high", numBins=0)
    for (f, s), r in got.items():
        pred = NaiveBayes(labelCol="high", smoothing=s).fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))
        assert r.n_test == pred.count()
        assert ev.evaluate(pred) == pytest.approx(r.auc_raw, abs=1e-9)
        assert ev.copy({ev.rawPredictionCol: "probability"}).evaluate(pred) == pytest.approx(r.auc_margin, abs=2e-3)
    data.unpersist()


def test_search_of_nothing_and_of_one_class(spark, rows):
    assert OS.lr_cv_path(rows.limit(0), COLS, "y").count() == 0
    assert OS.nb_cv_scores(rows.limit(0), COLS, "high").count() == 0
    assert OS.nb_cv_scores(rows.withColumn("high", F.lit(1.0)), COLS, "high").count() == 0


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_areas_of_groups(spark, bins):
    rnd = np.random.default_rng(bins)
    data = [(g, int(rnd.random() < 0.4), float(round(rnd.normal(), 1 + g))) for g in (0, 1, 2) for _ in range(400)]
    data += [(3, 1, 0.5), (3, 1, 0.1), (4, None, 0.1), (4, 0, None), (0, 1, None)]
    got = {r.g: r for r in auc_by(spark.createDataFrame(data, "g int, label int, score double"), ["g"], bins=bins).collect()}
    assert set(got) == {0, 1, 2, 3} and got[3].auc is None and got[3].n == 2
    for g in (0, 1, 2):
        pos, neg = ([s for k, lab, s in data if k == g and lab == want and s is not None] for want in (1, 0))
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        assert got[g].auc == pytest.approx(want, abs=1e-12) and got[g].n_positive == len(pos)


def test_cross_validation_reports_the_same_grid(rows):
    """The one-scan search gives fit_cv's metrics and best values."""
    data = VectorAssembler(inputCols=COLS, outputCol="features").transform(rows).withColumn("label", F.col("y")).cache()
    grids = {"lr": {"regParam": [0.05, 0.4], "elasticNetParam": [0.0, 1.0]}}
    slow, fast = (ML.fit_cv(data, "regression", folds=3, grids=grids, models=["lr"], one_scan=x)["lr"] for x in (False, True))
    assert fast.avgMetrics == pytest.approx(slow.avgMetrics, rel=1e-4)
    assert [r[:3] for r in ML.best_params({"lr": fast})] == [r[:3] for r in ML.best_params({"lr": slow})]
    assert list(fast.bestModel.coefficients) == pytest.approx(list(slow.bestModel.coefficients), rel=1e-6)
    data = data.withColumn("label", F.col("high"))
    slow, fast = (ML.fit_cv(data, "classification", folds=3, models=["nb"], one_scan=x)["nb"] for x in (False, True))
    assert fast.avgMetrics == pytest.approx(slow.avgMetrics, abs=1e-3)
    data.unpersist()
