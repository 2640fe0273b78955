"""Model preparation, tuning and evaluation with Spark ML.

Deviations from a straight notebook run, on purpose:
* the train/test split is a hash of post_id (md5 bucket), so it does not
  depend on partitioning and is reproducible in SQL;
* every fitted feature step (indexers, imputer, IDF, scaler) is fitted on
  the training rows only;
* cross-validation folds come from a second hash bucket (``foldCol``), and
  the training frame is check-pointed first so the k x grid fits rescan it
  instead of recomputing the joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (IDF, CountVectorizer, HashingTF, Imputer, OneHotEncoder, StandardScaler,
                                StringIndexer, VectorAssembler, Word2Vec)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SEED = 72584
CAT_STR = ("year", "month", "dayofweek")
CAT_NUM = ("is_weekend", "has_mention", "has_hashtag")
CONT = ("nbr_words", "comments_nbr_mentions")
HASH_WIDTH, IDF_MIN_DOC_FREQ = 1000, 100


def split_bucket(id_col: str, seed: int = SEED, buckets: int = 100) -> Column:
    """Deterministic bucket in [0, buckets) from md5(seed:id)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split_label(id_col: str = "post_id", train_pct: int = 70, seed: int = SEED) -> Column:
    """'train' / 'test' by the same bucket rule as hash_split."""
    return F.when(split_bucket(id_col, seed) < train_pct, F.lit("train")).otherwise(F.lit("test"))


def hash_split(df: DataFrame, id_col: str = "post_id", train_pct: int = 70,
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, independent of partitioning."""
    b = split_bucket(id_col, seed)
    return df.where(b < train_pct), df.where(b >= train_pct)


def text_vector_stages(tokens: str = "vector_lemma", out: str = "text_features",
                       with_bow: bool = False, with_w2v: bool = False, vocab_size: int = 1 << 18,
                       w2v_partitions: int = 8, w2v_size: int = 100, w2v_min_count: int = 5) -> list:
    """Hashed term frequencies (1000 features) + IDF (min doc freq 100);
    optional bag-of-words and Word2Vec outputs (their fits cost a full pass
    each and are unused downstream, so they are opt-in).

    The bag of words keeps the ``vocab_size`` most frequent words: the vocabulary is
    held by the driver (``fit_bag_of_words`` tells how many others there are, and
    ``operators.text.tfidf_table`` counts all words without a bound).  Word2Vec trains in
    ``w2v_partitions`` tasks and keeps words found ``w2v_min_count`` times."""
    stages = []
    if with_bow:
        stages.append(CountVectorizer(inputCol=tokens, outputCol="features_bow", vocabSize=vocab_size))
    stages += [HashingTF(inputCol=tokens, outputCol="featuresTF", numFeatures=HASH_WIDTH),
               IDF(inputCol="featuresTF", outputCol=out, minDocFreq=IDF_MIN_DOC_FREQ)]
    if with_w2v:
        stages.append(Word2Vec(inputCol=tokens, outputCol="features_w2v", seed=SEED, numPartitions=w2v_partitions,
                               vectorSize=w2v_size, minCount=w2v_min_count))
    return stages


def words_outside(df: DataFrame, tokens: str, vocabulary_size: int) -> int:
    """How many distinct words a bag of words of that vocabulary leaves out."""
    n = df.select(F.explode_outer(tokens).alias("w")).agg(F.count_distinct("w")).first()[0]
    return max(0, n - vocabulary_size)


def fit_bag_of_words(df: DataFrame, tokens: str = "vector_lemma", vocab_size: int = 1 << 18) -> tuple:
    """(fitted bag of words over the ``vocab_size`` most frequent words, how many words it leaves out)."""
    model = text_vector_stages(tokens, with_bow=True, vocab_size=vocab_size)[0].fit(df)
    return model, words_outside(df, tokens, len(model.vocabulary))


def text_feature_table(posts: DataFrame, id_col: str = "post_id", text_col: str = "post_text") -> DataFrame:
    """Per post: has_mention, has_hashtag, nbr_words and the TF-IDF vector
    ``text_features`` (1000 hashed features, min doc freq 100), fitted on the
    given rows.  The IDF fit is one aggregation of fixed-width vectors."""
    from ..operators.text import text_features
    tf = cut_lineage(text_features(posts, id_col, text_col).select(
        id_col, "has_mention", "has_hashtag", "nbr_words", "vector_lemma"))
    model = Pipeline(stages=text_vector_stages()).fit(tf)
    return model.transform(tf).select(id_col, "has_mention", "has_hashtag", "nbr_words", "featuresTF", "text_features")


def prepare_stages(task: str = "classification", outcome: str | None = None,
                   cat_str: Sequence[str] = CAT_STR, cat_num: Sequence[str] = CAT_NUM,
                   cont: Sequence[str] = CONT, with_text: bool = True) -> list:
    """Index string categories (frequency order, unseen/null kept as an extra
    index), one-hot all categories, mean-impute continuous columns, assemble
    ``catfeats`` and ``contfeats``; index the label for classification."""
    ind = [f"{c}_ind" for c in cat_str]
    ohe_in = ind + list(cat_num)
    ohe_out = [f"{c}_ohe" for c in list(cat_str) + list(cat_num)]
    stages = [
        StringIndexer(inputCols=list(cat_str), outputCols=ind, handleInvalid="keep"),
        OneHotEncoder(inputCols=ohe_in, outputCols=ohe_out, handleInvalid="keep"),
        Imputer(inputCols=list(cont), outputCols=list(cont), strategy="mean"),
        VectorAssembler(inputCols=list(cont), outputCol="contfeats", handleInvalid="keep"),
        VectorAssembler(inputCols=ohe_out, outputCol="catfeats", handleInvalid="keep"),
    ]
    if with_text:
        stages += text_vector_stages()
    if task == "classification":
        stages.append(StringIndexer(inputCol=outcome or "comment_positivity", outputCol="label"))
    return stages


def needed_columns(outcomes: Sequence[str], with_text: bool = True) -> list[str]:
    """The columns of the wide table that the feature pipelines of these outcomes read."""
    return list(dict.fromkeys(["post_id", *CAT_STR, *CAT_NUM, *CONT, *outcomes, *(["vector_lemma"] if with_text else [])]))


def default_outcome(task: str) -> str:
    return "comment_positivity" if task == "classification" else "nbr_likes"


def prepare(wide: DataFrame, task: str = "classification", outcome: str | None = None,
            with_text: bool = True, train_pct: int = 70, seed: int = SEED, checkpoint: bool = True):
    """Split, fit the feature pipeline on train, and return
    (train, test, fitted feature model).  Both frames hold post_id,
    features, features_wtext (with_text) and label.

    The input is check-pointed once (``checkpoint``): each estimator in the
    pipeline makes its own pass, and without the cut every pass would redo
    the joins and aggregates behind the wide table."""
    outcome = outcome or default_outcome(task)
    df = prepare_input(wide, task, outcome)
    # only what the feature pipeline reads is kept (not the post text), so
    # the checkpoint is a narrow table
    needed = needed_columns([outcome], with_text) + (["label"] if task != "classification" else [])
    df = df.select(*dict.fromkeys(needed))
    if checkpoint:
        df = cut_lineage(df)
    train, test = hash_split(df, "post_id", train_pct, seed)
    stages = prepare_stages(task, outcome, with_text=with_text)
    stages += [StandardScaler(inputCol="contfeats", outputCol="scaled_contfeats", withStd=True, withMean=False),
               VectorAssembler(inputCols=["catfeats", "scaled_contfeats"], outputCol="features")]
    if with_text:
        stages.append(VectorAssembler(inputCols=["features", "text_features"], outputCol="features_wtext"))
    model = Pipeline(stages=stages).fit(train)
    keep = ["post_id", "features", "label"] + (["features_wtext"] if with_text else [])
    return model.transform(train).select(*keep), model.transform(test).select(*keep), model


def prepare_input(wide: DataFrame, task: str = "classification", outcome: str | None = None) -> DataFrame:
    """Numeric category flags as double (null -> 0.0, which one-hot encoding
    requires), continuous columns as double, regression label."""
    outcome = outcome or default_outcome(task)
    df = wide
    for c in CAT_NUM:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    for c in CONT:
        df = df.withColumn(c, F.col(c).cast("double"))
    if task != "classification":
        df = df.withColumn("label", F.col(outcome).cast("double"))
    return df


def estimators(task: str, grids: Mapping[str, Mapping[str, list]] | None = None,
               feature_col: str = "features", original_nb_grid: bool = False) -> dict:
    """name -> (estimator, param grid, evaluator).  Default grids:
    regression  lr regParam {.2,.8} x elasticNetParam {0,.5,1}; rfreg maxDepth
    {3,5,7} x maxBins {32,100,200}; classification dt maxBins {32,80};
    rf maxDepth {3,7} x maxBins {32,80}; nb smoothing {.3,.8,1}, or the original
    {0,.3,.8} with ``original_nb_grid`` (0 gives -inf scores for a feature unseen
    in a class, so a tiny smoothing stands in for it)."""
    if task == "regression":
        ev = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mse")
        cands = {
            "lr": (LinearRegression(labelCol="label", featuresCol=feature_col, maxIter=40),
                   {"regParam": [0.2, 0.8], "elasticNetParam": [0.0, 0.5, 1.0]}),
            "rfreg": (RandomForestRegressor(labelCol="label", featuresCol=feature_col,
                                            minInstancesPerNode=20, seed=SEED),
                      {"maxDepth": [3, 5, 7], "maxBins": [32, 100, 200]}),
        }
    else:
        ev = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
        cands = {
            "dt": (DecisionTreeClassifier(labelCol="label", featuresCol=feature_col, seed=SEED),
                   {"maxBins": [32, 80]}),
            "rf": (RandomForestClassifier(labelCol="label", featuresCol=feature_col, numTrees=50, seed=SEED),
                   {"maxDepth": [3, 7], "maxBins": [32, 80]}),
            "nb": (NaiveBayes(labelCol="label", featuresCol=feature_col),
                   {"smoothing": [1e-10, 0.3, 0.8] if original_nb_grid else [0.3, 0.8, 1.0]}),
        }
    out = {}
    for name, (est, grid) in cands.items():
        grid = dict((grids or {}).get(name, grid))
        b = ParamGridBuilder()
        for p, vals in grid.items():
            b = b.addGrid(est.getParam(p), vals)
        out[name] = (est, b.build(), ev)
    return out


def fit_cv(train: DataFrame, task: str, folds: int = 5, parallelism: int = 8,
           grids: Mapping[str, Mapping[str, list]] | None = None, feature_col: str = "features",
           models: Sequence[str] | None = None, seed: int = SEED, one_scan: bool = True) -> dict[str, CrossValidatorModel]:
    """k-fold grid search per model.  Folds are hash buckets of post_id; the
    training frame is check-pointed once so every fit rescans it.  Up to
    ``parallelism`` fits run at once (each fit is itself a distributed job, the
    concurrency only hides per-job overhead and changes no result).

    ``one_scan``: the grids of linear regression and naive Bayes are searched from sums by fold
    (``onescan``), so only their best model is fitted."""
    data = train.withColumn("fold", F.pmod(split_bucket("post_id", seed + 1), F.lit(folds)).cast("int"))
    data = cut_lineage(data.select("post_id", F.col(feature_col).alias("features"), "label", "fold"))
    out = {}
    for name, (est, grid, ev) in estimators(task, grids).items():
        if models and name not in models:
            continue
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                            foldCol="fold", parallelism=parallelism, seed=seed)
        searched = one_scan and _one_scan_metrics(name, grid, data)
        out[name] = _refit(cv, data, searched) if searched else cv.fit(data)
    return out


def _one_scan_metrics(name: str, grid: list, data: DataFrame) -> list[list[float]] | None:
    """Held-out metric of every fold, per grid point; None for what sums by fold cannot tell: other
    models, other parameters, or (naive Bayes) labels other than two classes."""
    from . import onescan as OS
    points = [{p.name: v for p, v in g.items()} for g in grid]
    if name == "lr" and all(set(p) <= {"regParam", "elasticNetParam"} for p in points):
        moments = OS.fold_moments(data, "features")
        return [[row[5] for row in OS.linear_path(moments, [p.get("regParam", 0.0)], [p.get("elasticNetParam", 0.0)])]
                for p in points]
    if name == "nb" and all(set(p) == {"smoothing"} for p in points):
        scores = OS.nb_fold_scores(data, "features", "label", [p["smoothing"] for p in points]).collect()
        found = {(r.smoothing, r.fold): r.auc_raw for r in scores}
        folds = sorted({f for _, f in found})
        metrics = [[found.get((float(p["smoothing"]), f)) for f in folds] for p in points]
        if folds and all(m is not None for row in metrics for m in row):
            return metrics
    return None


def _refit(cv: CrossValidator, data: DataFrame, metrics: list[list[float]]) -> CrossValidatorModel:
    """The cross-validation result of known metrics: the best grid point, fitted on all rows."""
    mean = [sum(m) / len(m) for m in metrics]
    spread = [(sum((x - a) ** 2 for x in m) / len(m)) ** 0.5 for m, a in zip(metrics, mean)]
    best = (max if cv.getEvaluator().isLargerBetter() else min)(range(len(mean)), key=mean.__getitem__)
    model = cv.getEstimator().fit(data, cv.getEstimatorParamMaps()[best])
    return cv._copyValues(CrossValidatorModel(model, mean, [], spread))


def best_params(cv_models: Mapping[str, CrossValidatorModel]) -> list[tuple[str, str, str, float]]:
    """(model, param, best value, best mean CV metric) for every tuned param."""
    rows = []
    for name, m in cv_models.items():
        best = max(range(len(m.avgMetrics)), key=lambda i: m.avgMetrics[i]) \
            if m.getEvaluator().isLargerBetter() else \
            min(range(len(m.avgMetrics)), key=lambda i: m.avgMetrics[i])
        for p, v in m.getEstimatorParamMaps()[best].items():
            rows.append((name, p.name, str(v), float(m.avgMetrics[best])))
    return rows


def predictions(cv_models: Mapping[str, CrossValidatorModel], test: DataFrame,
                feature_col: str = "features") -> DataFrame:
    """(model, post_id, label, prediction, score) for every model, where
    score is P(class 1) for classifiers and the prediction for regressors."""
    frames = []
    for name, m in cv_models.items():
        p = m.transform(test.select("post_id", F.col(feature_col).alias("features"), "label"))
        score = (vector_to_array("probability")[1] if "probability" in p.columns else F.col("prediction"))
        frames.append(p.select(F.lit(name).alias("model"), "post_id", "label", "prediction",
                               score.cast("double").alias("score")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def classifier_metrics(cv_models: Mapping[str, CrossValidatorModel], test: DataFrame) -> list[tuple[str, str, float]]:
    rows = []
    for name, m in cv_models.items():
        p = m.transform(test.select("post_id", "features", "label"))
        for metric in ("areaUnderROC", "areaUnderPR"):
            ev = BinaryClassificationEvaluator(labelCol="label", metricName=metric)
            rows.append((name, metric, float(ev.evaluate(p))))
    return rows


def regressor_metrics(cv_models: Mapping[str, CrossValidatorModel], test: DataFrame) -> list[tuple[str, str, float]]:
    rows = []
    for name, m in cv_models.items():
        p = m.transform(test.select("post_id", "features", "label"))
        for metric in ("r2", "mae", "rmse"):
            ev = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName=metric)
            rows.append((name, metric, float(ev.evaluate(p))))
    return rows


def ranking_metrics(pred: DataFrame, label: str = "label", score: str = "score") -> list[tuple[str, float]]:
    """Exact areas under the ROC and the precision-recall curve of a score (ties are one
    threshold; the curves are not down-sampled)."""
    df = pred.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("rawPrediction"))
    return [(m, float(BinaryClassificationEvaluator(metricName=m, numBins=0).evaluate(df)))
            for m in ("areaUnderROC", "areaUnderPR")]


def naive_bayes_tables(df: DataFrame, features: Sequence[str], label: str, smoothing: float = 1.0):
    """(class, feature, log_value): the class log priors (feature ``prior``) and feature
    log likelihoods of a fitted multinomial naive Bayes model, with the model."""
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.select(*features, F.col(label).cast("double").alias("label")))
    model = NaiveBayes(smoothing=smoothing).fit(data)
    theta = model.theta.toArray()
    rows = [(c, "prior", float(p)) for c, p in enumerate(model.pi.toArray())]
    rows += [(c, f, float(theta[c, j])) for c in range(theta.shape[0]) for j, f in enumerate(features)]
    return rows, model


def shallow_tree_rules(dummy_frame: DataFrame, label: str = "nbr_likes", max_depth: int = 3):
    """Explanatory regression tree on every row (no split): returns the fitted
    model and its rules as (line_no, rule) with feature indices replaced by
    column names."""
    feats = [c for c in dummy_frame.columns if c != label]
    va = VectorAssembler(inputCols=feats, outputCol="features")
    dt = DecisionTreeRegressor(labelCol=label, featuresCol="features", maxDepth=max_depth, seed=SEED)
    model = Pipeline(stages=[va, dt]).fit(dummy_frame.withColumn(label, F.col(label).cast("double")))
    text = model.stages[-1].toDebugString
    for i in sorted(range(len(feats)), reverse=True):  # longest index first
        text = text.replace(f"feature {i} ", f"{feats[i]} ")
    rules = [(n, line.rstrip()) for n, line in enumerate(text.splitlines()[1:]) if line.strip()]
    return model, rules


def fitted_labels(model: PipelineModel) -> list[str]:
    """Label names in index order, read from the fitted label indexer."""
    for st in reversed(model.stages):
        if getattr(st, "getOutputCol", None) and st.getOutputCol() == "label" and hasattr(st, "labels"):
            return list(st.labels)
    return []
