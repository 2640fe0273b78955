"""The polarity scan on literal texts, the induced lexicon and the resampled intervals."""

import math
from hashlib import md5

import numpy as np
import pytest

from postlens.operators import polarity as PO
from postlens.operators import profiling as PR

#: text -> polarity, worked out by hand: good 0.7, bad -0.7, awful -1.0, great 0.8, best 1.0; very and really 1.3, so 1.2
LITERAL = {
    "good": 0.7, "not good": -0.35, "very bad": -0.91, "not very good": -0.5 * 0.7 / 1.3, "very very good": 1.0,
    "isn't good": -0.35, "It ISN’T really awful!": 0.5 / 1.3, "not not good": 0.7, "not a day out good": 0.7, "not a day good": -0.35,
    "not bad, very good": (0.35 + 0.91) / 2, "very, the good": 0.7, "so great and so awful": (0.96 - 1.0) / 2,
    "not the best best": (-0.5 + 1.0) / 2, "": 0.0, "nothing here": 0.0, "not": 0.0, "cannot be good": -0.35,
    "without a very good day": -0.5 * 0.7 / 1.3, "knot good": 0.7,
}


def test_literal_texts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*LITERAL, None])], "id long, t string")
    got = [r.p for r in df.select("id", PO.polarity_scan(PO.scan_tokens("t")).alias("p")).orderBy("id").collect()]
    assert got == pytest.approx([*LITERAL.values(), 0.0], abs=1e-12)


def test_scan_with_a_lexicon_table_equals_the_literal_one(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*LITERAL, None])], "id long, t string")
    tokens = df.select("id", PO.scan_tokens("t").alias("w"))
    table = spark.createDataFrame([*PO.POLARITY_LEXICON.items(), ("nice", 0.6), (None, 1.0)], "word string, polarity double")
    got = [r.polarity for r in PO.polarity_scan_by_join(tokens, "id", "w", table).orderBy("id").collect()]
    assert got == pytest.approx([*LITERAL.values(), 0.0], abs=1e-12)


def test_induced_lexicon(spark):
    rows = [(1, ["sun", "day", "sun"])] * 30 + [(-1, ["rain", "day"])] * 20 + [(0, ["day", "rain", "sun"])] * 10 \
        + [(1, ["rare"])] * 2 + [(None, ["day"]), (1, []), (1, None), (-1, [None])]
    df = spark.createDataFrame(rows, "sentiment_emoji int, comment_words_f array<string>")
    got = {r.word: r for r in PO.induced_lexicon(df, prior=10.0).collect()}
    assert set(got) == {"sun", "rain"} and got["sun"].polarity > 0.5 and got["rain"].polarity < -0.5
    # by hand: 40 rows hold sun, 30 rain, 61 day and 2 rare
    total, pos, neg = 133, 62, 40
    a = 10 * 40 / total
    odds = math.log((30 + a) / (pos + 10 - 30 - a)) - math.log(a / (neg + 10 - a))
    assert got["sun"].log_odds == pytest.approx(odds) and got["sun"].polarity == pytest.approx(math.tanh(odds / 2))
    assert got["sun"].z == pytest.approx(odds / math.sqrt(1 / (30 + a) + 1 / a))
    assert PO.induced_lexicon(df.limit(0)).count() == 0
    assert PO.induced_lexicon(df.where("sentiment_emoji = 1")).where("polarity IS NULL OR isnan(polarity)").count() == 0


def weights(post_id, replicates):
    cum = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    digits = [md5(f"0:{b // 6}:{post_id}".encode()).hexdigest()[5 * (b % 6):5 * (b % 6) + 5] for b in range(replicates)]
    return [int((int(d, 16) >= np.floor(cum * 2 ** 20)[:8]).sum()) for d in digits]


def test_weights_are_poisson(spark):
    rows = spark.range(3000).select(PR.poisson_weights("id", 20).alias("w"), "id").collect()
    w = np.array([r.w for r in rows])
    assert w[:50].tolist() == [weights(r.id, 20) for r in rows[:50]]
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and w.max() >= 6
    assert abs(np.corrcoef(w.T)[np.triu_indices(20, 1)]).max() < 0.1


def test_bootstrap_intervals(spark):
    rnd = np.random.default_rng(0)
    rows = [(f"p{i}", i % 2, None if i == 5 else float(rnd.normal(10 * (i % 2), 3))) for i in range(400)] + [("x", None, 4.0), (None, 7, 1.0)]
    df = spark.createDataFrame(rows, "post_id string, g int, y double")
    got = {r.value: r for r in PR.bootstrap_mean_by(df, ["g"], "y", "post_id", replicates=100).collect()}
    assert set(got) == {0, 1, 7, None}
    w = {i: np.array(weights(i, 100)) for i, _, _ in rows if i}
    for g in (0, 1, None):
        own = [(w[i], y) for i, k, y in rows if k == g and y is not None]
        n, s = sum(a for a, _ in own), sum(a * y for a, y in own)
        means = (s[n > 0] / n[n > 0])
        want = np.percentile(means, [2.5, 97.5])
        assert [got[g].ci_lo, got[g].ci_hi] == pytest.approx(want.tolist(), rel=1e-12) and got[g].n == len(own)
    assert got[0].ci_lo < got[0].mean < got[0].ci_hi
    assert PR.bootstrap_mean_by(df.limit(0), ["g"], "y", "post_id").count() == 0


def test_bootstrap_is_one_aggregate(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "post_id string, g int, y double").repartition(3)
    plan = PR.bootstrap_mean_by(df, ["g"], "y", "post_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "partial_" in plan and "Python" not in plan
