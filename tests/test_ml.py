"""Spark ML path on the smallest tables with small grids: shapes and
invariants, not scores (fits are not bit-stable across partitionings)."""

from pyspark.sql import functions as F

from postlens.operators.features import assemble_features
from postlens.plans import ml as ML
from postlens.sources.testviews import comments_view, posts_view

SF = "/root/testdata/sf0.001"


def test_classification_pipeline(spark):
    wide = assemble_features(posts_view(spark, SF), comments_view(spark, SF), keep_tokens=True)
    train, test, feat = ML.prepare(wide, "classification", with_text=True)
    n_tr, n_te = train.count(), test.count()
    assert n_tr + n_te == wide.count() and n_tr > n_te > 0
    assert set(ML.fitted_labels(feat)) <= {"low", "high"}
    grids = {"dt": {"maxBins": [32]}, "rf": {"maxDepth": [3], "maxBins": [32]}, "nb": {"smoothing": [1.0]}}
    models = ML.fit_cv(train, "classification", folds=3, parallelism=2, grids=grids)
    pred = ML.predictions(models, test)
    assert pred.count() == 3 * n_te
    assert pred.where(F.col("score").isNull()).count() == 0
    rows = ML.best_params(models)
    assert {r[0] for r in rows} == {"dt", "rf", "nb"}
    assert len(ML.classifier_metrics(models, test)) == 6


def test_regression_pipeline_and_tree_rules(spark):
    from postlens.operators.features import dummies
    wide = assemble_features(posts_view(spark, SF), comments_view(spark, SF))
    train, test, _ = ML.prepare(wide, "regression", with_text=False)
    grids = {"lr": {"regParam": [0.2], "elasticNetParam": [0.0]},
             "rfreg": {"maxDepth": [3], "maxBins": [32]}}
    models = ML.fit_cv(train, "regression", folds=2, parallelism=2, grids=grids)
    assert {m for m, _, _ in ML.regressor_metrics(models, test)} == {"lr", "rfreg"}
    d = dummies(wide, keep=["nbr_words", "has_mention", "nbr_likes"])
    _, rules = ML.shallow_tree_rules(d, "nbr_likes", 3)
    assert rules and any("If (" in r for _, r in rules)


def test_bag_of_words_has_every_word_whatever_the_vocabulary_cap(spark, monkeypatch):
    from functools import partial

    from postlens.plans.catalog import q_text_vectors
    monkeypatch.setattr(ML, "text_vector_stages", partial(ML.text_vector_stages, vocab_size=20))
    rows = q_text_vectors(spark, SF).collect()
    assert len(rows) == posts_view(spark, SF).count() and max(r.bow_nnz for r in rows) > 20
    assert all(r.bow_nnz == r.tf_sum for r in rows)


def test_capped_bag_of_words_tells_what_it_leaves_out(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["d"],), ([],)], "vector_lemma array<string>")
    model, outside = ML.fit_bag_of_words(df, vocab_size=2)
    assert set(model.vocabulary) == {"a", "b"} and outside == 2
    assert ML.fit_bag_of_words(df)[1] == 0


def test_both_tasks_read_one_wide_table(spark, monkeypatch):
    from postlens.plans import analysis as AN
    post = "post_id string, profile_name string, post_timestamp string, post_text string, nbr_pictures int, " \
           "is_multiple_pictures boolean, google_maps_url string, location string, nbr_likes long, nbr_comments long, is_video string"
    posts = spark.createDataFrame(
        [(str(i % 5), "p", f"2024-03-0{i + 1} 10:00:00", t, 1, False, None, None, 10 * i, i, "True\r")
         for i, t in enumerate(["going home @you", None, "", "nice #day words words", "walked", "again"])], post) \
        .withColumn("post_timestamp", F.to_timestamp("post_timestamp"))
    comments = spark.createDataFrame([(1, 7, "True", "1", "great @a"), (2, 7, None, "1", "awful"), (3, 8, "1.0", None, "x"),
                                      (4, 8, "pending", "3", None)],
                                     "comment_id long, commenter_id long, commenter_verified string, post_id string, comment_text string")
    seen = []
    monkeypatch.setattr(AN, "run_task", lambda wide, task, **kw: seen.append(wide))
    AN.run_analysis(posts, comments)
    assert len(seen) == 2 and all("Join" not in w._jdf.queryExecution().optimizedPlan().toString() for w in seen)
    wide = assemble_features(posts, comments, keep_tokens=True)
    # a post id that two posts share keeps both rows
    assert sorted(map(repr, seen[0].collect())) == sorted(map(repr, wide.select(*seen[0].columns).collect()))
    assert {"nbr_likes", "comment_positivity", "vector_lemma"} <= set(seen[0].columns) and seen[0].count() == 6
