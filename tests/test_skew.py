"""Results stay whole and exact when one key holds a third of all rows."""

import random

from pyspark.sql import functions as F

from postlens.operators import cleaning as CL
from postlens.operators import text as TX
from postlens.operators.features import comment_features
from postlens.operators.sentiment import score_comments


def test_comment_rollup_with_hot_post(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        post = "hot" if i % 3 == 0 else f"p{rnd.randrange(200)}"
        text = rnd.choice(["great 😍", "awful 😭", "meh", "@a @b ok", "10:30 fine"])
        rows.append((i, i % 50, rnd.choice(["True", "False", None, "1.0"]), post, text, None))
    df = spark.createDataFrame(rows, "comment_id long, commenter_id long, commenter_verified string, "
                                     "post_id string, comment_text string, comment_timestamp timestamp")
    got = {r.post_id: r for r in comment_features(score_comments(df.repartition(8))).collect()}
    scored = {r.comment_id: r for r in score_comments(df).select(
        "comment_id", "post_id", "overall_sentiment", "nbr_mentions", "is_verified_author").collect()}
    hot = [r for r in scored.values() if r.post_id == "hot"]
    assert len(hot) == 1000
    assert got["hot"].comments_nbr_mentions == sum(r.nbr_mentions for r in hot)
    assert abs(got["hot"].comments_sentiment - sum(r.overall_sentiment for r in hot) / 1000) < 1e-12
    assert sum(r.comments_nbr_mentions for r in got.values()) == sum(r.nbr_mentions for r in scored.values())


def test_exact_quantiles_with_hot_value(spark):
    import duckdb
    xs = [5] * 1000 + list(range(2000))
    df = spark.createDataFrame([(x,) for x in xs], "x long").repartition(8)
    probs = [0.1, 0.3, 0.5, 0.6, 0.9]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(x BIGINT)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in xs])
    want = [con.execute(f"SELECT quantile_disc(x, {p}) FROM t").fetchone()[0] for p in probs]
    assert CL.quantiles(df, "x", probs) == want


def test_word_frequency_and_dictionary_join_with_hot_word(spark):
    docs = [(i, ["the"] * 5 + [f"w{i % 7}", "was"]) for i in range(600)]
    df = spark.createDataFrame(docs, "id int, w array<string>").repartition(8)
    wf = {r.word: r["count"] for r in TX.word_frequency(df, "w").collect()}
    assert wf["the"] == 3000 and sum(wf.values()) == 600 * 7
    dic = spark.createDataFrame([("was", "be"), ("the", "the")], "surface string, base string")
    out = TX.normalise_vocabulary(df, "id", "w", dic)
    assert out.count() == 600
    assert out.where(F.array_contains("normalised", "was")).count() == 0
    assert out.select(F.sum(F.size("normalised"))).first()[0] == 600 * 7


def test_hot_word_is_dealt_over_the_join(spark):
    """With broadcasts off and one word in every row, no part of the salted word join
    holds more than twice the median's rows of that word."""
    docs = [(i, ["the", f"w{i % 11}"]) for i in range(8000)]
    df = spark.createDataFrame(docs, "id int, w array<string>").select("id", F.explode("w").alias("word"))
    words = df.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = TX.join_by_word(df, words, "word", "id")
        assert joined.count() == 16000
        parts = df.where("word = 'the'").groupBy(F.pmod(F.xxhash64("id"), F.lit(TX.WORD_SALTS))).count()
        sizes = sorted(r["count"] for r in parts.collect())
        assert len(sizes) == TX.WORD_SALTS and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
