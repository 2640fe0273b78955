"""Operators: invariants and literal-row checks."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.operators import cleaning as CL
from postlens.operators import evaluation as EV
from postlens.operators import profiling as PR
from postlens.operators import sentiment as SE
from postlens.operators import text as TX
from postlens.plans import ml as ML


def test_quantiles_all_null_and_empty(spark):  # Q13
    df = spark.createDataFrame([(None,), (None,)], "x int")
    assert CL.quantiles(df, "x", [0.5]) == []
    assert CL.quantiles(df, "x", [0.5], rel_err=0.05) == []
    assert CL.exact_quantiles(df, "x", [0.3]).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60),
       st.lists(st.sampled_from([0.0, 0.05, 0.3, 0.5, 0.6, 0.99, 1.0]), min_size=1, max_size=3, unique=True))
def test_exact_quantiles_match_duckdb(spark, xs, probs):  # Q14
    import duckdb
    df = spark.createDataFrame([(x,) for x in xs], "x int").repartition(3)
    got = CL.quantiles(df, "x", probs)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(x INTEGER)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in xs])
    want = [con.execute(f"SELECT quantile_disc(x, {p}) FROM t").fetchone()[0] for p in probs]
    assert got == want


def test_word_frequency_counts_sum_to_tokens(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", ""]), (2, ["b", "c"]), (3, [])], "id int, w array<string>")
    tf = TX.word_frequency(df, "w")
    assert [tuple(r) for r in tf.collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert sum(r["count"] for r in tf.collect()) == 5
    dfreq = TX.word_frequency(df, "w", distinct_per_row=True)
    assert dict((r[0], r[1]) for r in dfreq.collect()) == {"a": 1, "b": 2, "c": 1}
    assert TX.word_frequency(df, "w", top_k=1).count() == 1


def test_normalise_vocabulary_keeps_order(spark):
    df = spark.createDataFrame([(1, ["was", "x", "went", "x"]), (2, [])], "id int, w array<string>")
    dic = spark.createDataFrame([("was", "be"), ("went", "go")], "surface string, base string")
    out = {r.id: r.normalised for r in TX.normalise_vocabulary(df, "id", "w", dic).collect()}
    assert out == {1: ["be", "x", "go", "x"], 2: []}
    d = {r.id: r.normalised for r in TX.normalise_vocabulary(df, "id", "w", dic, distinct=True).collect()}
    assert d[1] == ["be", "go", "x"]


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, ["c"])], "id int, w array<string>")
    rows = {(r.id, r.word): r for r in TX.tfidf_table(df, "id", "w").collect()}
    assert rows[(1, "a")].tf == 2 and rows[(1, "a")].df == 2
    assert math.isclose(rows[(1, "a")].tfidf, 2 * math.log(4 / 3))
    low = {(r.id, r.word): r.idf for r in TX.tfidf_table(df, "id", "w", min_doc_freq=2).collect()}
    assert low[(3, "c")] == 0.0 and low[(2, "a")] > 0


def test_polarity_join_equals_expression(spark):
    lex = {"good": 0.7, "bad": -0.7, "great": 0.8}
    df = spark.createDataFrame([(1, ["good", "bad", "great"]), (2, ["none"]), (3, [])], "id int, t array<string>")
    a = {r.id: r.p for r in df.select("id", SE.polarity_expr("t", lex).alias("p")).collect()}
    lexdf = spark.createDataFrame(list(lex.items()), "word string, polarity double")
    b = {r.id: r.polarity for r in SE.polarity_by_join(df, "id", "t", lexdf).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)
    assert a[2] == 0.0 and a[3] == 0.0 and math.isclose(a[1], 0.8 / 3)


def test_histogram_and_kde(spark):
    df = spark.createDataFrame([(float(x) / 10,) for x in range(-20, 21)] + [(None,)], "x double")
    h = PR.histogram(df, "x", 0.5, lo=-2.0)
    assert sum(r.n for r in h.collect()) == 41
    hb = {r.bin: r.n for r in PR.histogram(df, "x", bins=4).collect()}
    assert sorted(hb) == [0, 1, 2, 3] and sum(hb.values()) == 41 and hb[3] == 11
    k = PR.kde(df, "x", bandwidth=0.3, step=0.05, lo=0.0).collect()
    mass = sum(r.density for r in k) * 0.05
    assert abs(mass - 1.0) < 0.01


def test_summary_stats_matches_describe(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c"), (8, None)], "x int, s string")
    st_ = {r.column_name: r for r in PR.summary_stats(df).collect()}
    d = {r.summary: r for r in df.describe().collect()}
    assert st_["x"].n == int(d["count"].x) and math.isclose(st_["x"].mean, float(d["mean"].x))
    assert math.isclose(st_["x"].stddev, float(d["stddev"].x))
    assert (st_["x"].min_value, st_["x"].max_value) == ("1", "8")
    assert (st_["s"].n, st_["s"].min_value, st_["s"].max_value, st_["s"].mean) == (3, "a", "c", None)


def test_null_counts_and_distinct(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "x int, s string")
    assert PR.null_counts(df).first().asDict() == {"x": 0, "s": 2}
    assert PR.distinct_count(df, "x").first()[0] == 2
    g = {r.s: r.n_distinct for r in PR.group_distinct_count(df, "s", "x").collect()}
    assert g == {None: 2, "a": 1}


def test_mean_by_long_form(spark):
    df = spark.createDataFrame([(1, 10, 5.0), (1, 11, 7.0), (2, 10, 9.0)], "a int, b int, y double")
    out = {(r.dimension, r.value): r for r in PR.mean_by(df, ["a", "b"], "y").collect()}
    assert out[("a", 1)].n == 2 and out[("a", 1)].mean == 6.0
    assert math.isclose(out[("a", 1)].ci_hi - out[("a", 1)].mean, 1.96 * math.sqrt(2) / math.sqrt(2))
    assert out[("b", 10)].mean == 7.0 and out[("a", 2)].sd is None


def test_regression_metrics_match_evaluator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    rows = [(3.0, 2.5), (1.0, 1.5), (4.0, 4.0), (0.0, 1.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    m = EV.regression_metrics(df).first()
    for name in ("mse", "rmse", "mae", "r2"):
        assert math.isclose(m[name], RegressionEvaluator(metricName=name).evaluate(df), rel_tol=1e-9)
    assert EV.residuals(df).select(F.sum("residual")).first()[0] == -1.0


def test_classification_report_and_confusion(spark):
    rows = [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    cm = {r.label: (r.pred_0, r.pred_1) for r in EV.confusion_matrix(df).collect()}
    assert cm == {0.0: (2, 1), 1.0: (1, 1)}
    assert sum(a + b for a, b in cm.values()) == len(rows)
    rep = {r.class_name: r for r in EV.classification_report(df).collect()}
    assert math.isclose(rep["0.0"].precision, 2 / 3) and math.isclose(rep["0.0"].recall, 2 / 3)
    assert math.isclose(rep["1.0"].precision, 0.5) and rep["1.0"].support == 2
    assert math.isclose(rep["accuracy"].f1, 0.6)
    assert math.isclose(rep["weighted avg"].recall, 0.6)
    assert {r.prediction: r.n for r in EV.prediction_counts(df).collect()} == {0.0: 3, 1.0: 2}


def test_hash_split_disjoint_complete_partition_free(spark):  # X7, Q9
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("post_id"))
    a_tr, a_te = ML.hash_split(df.repartition(1))
    b_tr, b_te = ML.hash_split(df.repartition(7))
    ta = {r[0] for r in a_tr.collect()}
    assert ta == {r[0] for r in b_tr.collect()}
    te = {r[0] for r in a_te.collect()}
    assert not (ta & te) and len(ta | te) == 2000
    assert 0.65 < len(ta) / 2000 < 0.75


@pytest.mark.parametrize("rel_err", [0.0, 0.05])
def test_clean_posts_bands_cover_rows(spark, rel_err):
    from postlens.sources.testviews import posts_view
    posts = posts_view(spark, "/root/testdata/sf0.001")
    clean = CL.clean_posts(posts, rel_err=rel_err)
    assert "profile_name" in clean.columns  # C6: dropping a missing column is a no-op
    assert not {"nbr_pictures", "google_maps_url", "location"} & set(clean.columns)
    n = clean.where(F.col("nbr_likes").isNotNull()).count()
    assert clean.where(F.col("likes_level").isNotNull()).count() == n


def test_confusion_keeps_every_class(spark):
    """A class that is only predicted and one that is only a label both have their place."""
    rows = [(0.0, 2.0), (0.0, 0.0), (2.0, 2.0), (3.0, 0.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    long = {(r.label, r.prediction): r.n for r in EV.confusion_counts(df).collect()}
    assert long == {(a, b): rows.count((a, b)) for a in (0.0, 2.0, 3.0) for b in (0.0, 2.0, 3.0)}
    wide = {r.label: (r.pred_0, r.pred_1, r.pred_2, r.pred_3) for r in EV.confusion_matrix(df, classes=[1.0]).collect()}
    assert wide == {0.0: (1, 0, 1, 0), 1.0: (0, 0, 0, 0), 2.0: (0, 0, 1, 0), 3.0: (1, 0, 0, 0)}


@pytest.mark.parametrize("turn", [1, -1])
def test_duplicate_dictionary_words(spark, turn):
    """Several rows for one word: the mean polarity, the smallest base, in any order."""
    df = spark.createDataFrame([(1, ["good", "ran"])], "id int, t array<string>")
    lex = spark.createDataFrame([("good", 1.0), ("good", -0.5)][::turn], "word string, polarity double")
    assert SE.polarity_by_join(df, "id", "t", lex).first().polarity == 0.25
    dic = spark.createDataFrame([("ran", "run"), ("ran", "flee")][::turn], "surface string, base string")
    assert TX.normalise_vocabulary(df, "id", "t", dic).first().normalised == ["good", "flee"]


def test_exact_quantiles_beyond_the_small_case(spark):
    """Brackets: more distinct values than may come back, hot values, negative values."""
    import duckdb
    xs = [((i * 7919) % 10007) - 3000 for i in range(9000)] + [42] * 3000
    df = spark.createDataFrame([(x,) for x in xs], "x long").repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::BIGINT[]) AS x", [xs])
    probs = [0.0, 0.01, 0.3, 0.5, 0.777, 1.0]
    want = [con.execute(f"SELECT quantile_disc(x, {p}) FROM t").fetchone()[0] for p in probs]
    assert [v for _, v in CL.quantile_rows(df, "x", probs, few=50)] == want


def test_kde_is_not_cut(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    at = {r.grid: r.density for r in PR.kde(df, "x", bandwidth=1.0, step=1.0, lo=0.0).collect()}
    want = (math.exp(-0.5 * 36) + math.exp(-0.5 * 16)) / (2 * math.sqrt(2 * math.pi))
    assert math.isclose(at[6], want, rel_tol=1e-12)  # both values reach it, six and four bandwidths away
    assert PR.kde(df.where("x < 0"), "x").count() == 0


def test_onehot_drops_the_rarest_category(spark):
    from postlens.operators.features import dummy_rows, onehot_rows
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, None, 1), (5, "c", 0)], "id int, s string, f int")
    got = sorted((r.id, r.feature, r.place) for r in onehot_rows(df, "id", ["s", "f"]).collect())
    assert got == [(1, "s_a", 0), (2, "f_1", 0), (2, "s_a", 0), (3, "f_1", 0), (3, "s_b", 1), (4, "f_1", 0)]
    assert dummy_rows(df, "id", ["s", "f"]).count() == 9


def test_verb_base_literals(spark):
    from postlens.functions.text import verb_base
    words = ["went", "playing", "stopped", "tries", "studied", "watches", "runs", "bus", "boss", "sing", "red", "bring",
             "falling", "liked", "is", "thing"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(verb_base("w", {"went": "go", "is": "be"})).collect()]
    assert got == ["go", "play", "stop", "try", "study", "watch", "run", "bus", "boss", "sing", "red", "bring",
                   "fall", "lik", "be", "thing"]


def test_stem_rules_literals(spark):
    """One word per rule: changing a rule turns this red."""
    pairs = {"glasses": "glass", "skies": "ski", "dogs": "dog", "agreed": "agree", "jumped": "jump", "jumping": "jump",
             "silly": "silli", "relational": "relate", "conditional": "condition", "organization": "organize",
             "decisiveness": "decisive", "hopefulness": "hopeful", "callousness": "callous", "triplicate": "triplic",
             "formalize": "formal", "goodness": "good"}
    from postlens.functions.text import stem_tokens
    df = spark.createDataFrame([(list(pairs),)], "w array<string>")
    assert df.select(stem_tokens("w")).first()[0] == list(pairs.values())


def test_word_ids_are_gapless_and_ordered(spark):
    from postlens.operators.text import bag_of_words, word_ids
    rows = [(str(i), [f"w{j}" for j in range(300) if i % (j + 1) == 0] + ["all", "all"]) for i in range(200)] + [("x", []), ("y", None)]
    df = spark.createDataFrame(rows, "post_id string, words array<string>").repartition(4)
    got = sorted(word_ids(df, "words", partitions=7).collect(), key=lambda r: r.word_id)
    assert [r.word_id for r in got] == list(range(301)) and got[0].word == "all" and got[0].n == 400
    assert [(-r.n, r.word) for r in got] == sorted((-r.n, r.word) for r in got)
    ids = {r.word: r.word_id for r in got}
    bow = {(r.post_id, r.word_id): r.n for r in bag_of_words(df, "post_id", "words", word_ids(df, "words", partitions=3)).collect()}
    assert bow == {(i, ids[w]): ws.count(w) for i, ws in rows for w in ws or ()}


def test_top_words_by_sketch_or_by_all_counts(spark):
    from postlens.operators.text import top_words, word_frequency
    rows = [(str(i), [f"w{j}" for j in range(400) if i % (j + 1) == 0] + ["Ab ", "", "ab"]) for i in range(300)] + [("n", None)]
    df = spark.createDataFrame(rows, "id string, words array<string>").repartition(5)
    want = [tuple(r) for r in word_frequency(df, "words", distinct_per_row=True, top_k=6).collect()]
    for settings in ({}, {"tracked": 20, "candidates": 6}, {"tracked": 1000, "candidates": 10}):
        assert [tuple(r) for r in top_words(df, "words", 6, **settings).collect()] == want
    assert top_words(df.limit(0), "words", 6).count() == 0


def test_bucketed_tables_join_without_an_exchange(spark, tmp_dir):
    from postlens.operators.features import assemble_features, comment_features
    from postlens.operators.sentiment import score_comments
    from postlens.sources.sinks import write_bucketed
    from postlens.sources.testviews import comments_view, posts_view
    sf = "/root/testdata/sf0.001"
    posts, comments = posts_view(spark, sf), comments_view(spark, sf)
    kept = [write_bucketed(df, f"t_{k}", f"{tmp_dir}/{k}", "post_id", 8) for k, df in
            (("posts", posts), ("rollup", comment_features(score_comments(comments))))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = assemble_features(kept[0], None, rollup=kept[1])
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert wide.count() == posts.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for k in ("posts", "rollup"):
            spark.sql(f"DROP TABLE t_{k}")


def test_confusion_counts_refuse_what_holds_no_classes(spark):
    import pytest as pt

    from postlens.operators.evaluation import confusion_counts
    df = spark.range(30).selectExpr("CAST(id AS DOUBLE) AS label", "CAST(id % 3 AS DOUBLE) AS prediction")
    assert confusion_counts(df).count() == 900
    with pt.raises(Exception, match="more than 10 classes"):
        confusion_counts(df, max_classes=10).collect()
