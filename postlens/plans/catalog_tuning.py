"""Registered queries of the one-scan grid searches (L1, L5, L7), with DuckDB oracles that
compute moments, coordinate descent and ranks on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ml as ML
from . import onescan as OS
from . import sqlgen as S
from .catalog import CL, TX, _clean_cte, _posts, _r, recursive, register

FEATURES = ("nbr_comments", "is_video", "is_multiple_pictures", "has_mention", "has_hashtag")
#: The original grid, with milder penalties that leave some coefficients standing.
REG_PARAMS, ELASTIC_NETS = (0.0, 0.001, 0.01, 0.2, 0.8), (0.0, 0.5, 1.0)
SMOOTHING = (0.3, 0.8, 1.0)
FOLDS = 5


def _train_frame(spark, sf_dir):
    """Training rows: post_id, the features, likes in 100,000 and whether they are high."""
    clean = CL.clean_posts(_posts(spark, sf_dir)).withColumns(
        {"has_mention": TX.T.has_mention("post_text"), "has_hashtag": TX.T.has_hashtag("post_text")})
    rows = clean.where("likes_level IS NOT NULL AND nbr_comments IS NOT NULL").select(
        "post_id", *FEATURES, (F.col("nbr_likes") / 100000.0).alias("likes"),
        (F.col("likes_level") == "high").cast("int").alias("high"))
    return ML.hash_split(rows)[0]


_TRAIN_CTES = f"""fl AS (SELECT post_id, nbr_comments, is_video, is_multiple_pictures,
  {S.has_sub('post_text', '@')} AS has_mention, {S.has_sub('post_text', '#')} AS has_hashtag,
  nbr_likes / 100000.0 AS likes, CAST(likes_level = 'high' AS INTEGER) AS high
  FROM posts_clean WHERE likes_level IS NOT NULL AND nbr_comments IS NOT NULL),
tr AS (SELECT *, CAST({S.split_bucket('post_id', ML.SEED + 1)} % {FOLDS} AS INTEGER) AS fold FROM fl
       WHERE {S.split_bucket('post_id')} < 70)"""
_D = len(FEATURES)


@register("lr_cv_path", recursive(_clean_cte(f"""WITH {_TRAIN_CTES},
z AS (SELECT fold, [1.0, {', '.join(FEATURES)}, likes]::DOUBLE[] AS z FROM tr),
mom AS (SELECT fold, i, j, sum(z[i] * z[j]) AS s FROM z, range(1, {_D + 3}) a(i), range(1, {_D + 3}) b(j) GROUP BY ALL),
rest AS (SELECT mom.fold, mom.i, mom.j, t.s - mom.s AS s FROM mom
         JOIN (SELECT i, j, sum(s) AS s FROM mom GROUP BY i, j) t USING (i, j)),
size AS (SELECT fold, s AS n FROM rest WHERE i = 1 AND j = 1),
mean AS (SELECT fold, i, s / n AS m FROM rest JOIN size USING (fold) WHERE j = 1),
cov AS (SELECT rest.fold, rest.i, rest.j, s / n - x.m * y.m AS v FROM rest JOIN size USING (fold)
        JOIN mean x ON x.fold = rest.fold AND x.i = rest.i JOIN mean y ON y.fold = rest.fold AND y.i = rest.j),
sd AS (SELECT fold, i, sqrt(v) AS sd FROM cov WHERE i = j AND i > 1),
cor AS (SELECT cov.fold, cov.i, cov.j, v / (x.sd * y.sd) AS r FROM cov JOIN sd x ON x.fold = cov.fold AND x.i = cov.i
        JOIN sd y ON y.fold = cov.fold AND y.i = cov.j WHERE cov.i > 1 AND cov.j > 1),
corow AS (SELECT fold, i, list(r ORDER BY j) AS r FROM cor WHERE j < {_D + 2} GROUP BY fold, i),
cmat AS (SELECT fold, list(r ORDER BY i) AS c FROM corow WHERE i < {_D + 2} GROUP BY fold),
cy AS (SELECT fold, r AS cy FROM corow WHERE i = {_D + 2}),
start AS (SELECT cmat.fold, reg, mix, c, cy, reg / sd.sd * mix AS l1, reg / sd.sd * (1 - mix) AS l2
          FROM cmat JOIN cy USING (fold) JOIN sd ON sd.fold = cmat.fold AND sd.i = {_D + 2},
               (SELECT unnest({list(REG_PARAMS)}) AS reg), (SELECT unnest({list(ELASTIC_NETS)}) AS mix)),
it(fold, reg, mix, c, cy, l1, l2, step, w) AS (
  SELECT fold, reg, mix, c, cy, l1, l2, 0, {[0.0] * _D}::DOUBLE[] FROM start
  UNION ALL
  SELECT fold, reg, mix, c, cy, l1, l2, step + 1, list_transform(w, lambda v, k: CASE WHEN k <> step % {_D} + 1 THEN v
    ELSE sign(cy[k] - list_dot_product(c[k], w) + v) * greatest(abs(cy[k] - list_dot_product(c[k], w) + v) - l1, 0) / (1 + l2) END)
  FROM it WHERE step < {60 * _D}),
fit AS (SELECT * FROM it WHERE step = {60 * _D}),
co AS (SELECT fit.fold, reg, mix, k + 1 AS i, w[k] * y.sd / x.sd AS b FROM fit, range(1, {_D + 1}) t(k)
       JOIN sd x ON x.fold = fit.fold AND x.i = k + 1 JOIN sd y ON y.fold = fit.fold AND y.i = {_D + 2}),
v AS (SELECT fold, reg, mix, i, -b AS v FROM co
      UNION ALL SELECT fold, reg, mix, {_D + 2}, 1.0 FROM fit
      UNION ALL SELECT co.fold, reg, mix, 1, sum(b * mean.m) - max(my) FROM co JOIN mean ON mean.fold = co.fold AND mean.i = co.i
                JOIN (SELECT fold, m AS my FROM mean WHERE i = {_D + 2}) y ON y.fold = co.fold GROUP BY co.fold, reg, mix),
err AS (SELECT v.fold, v.reg, v.mix, sum(v.v * u.v * mom.s) AS sse FROM v
        JOIN v u ON u.fold = v.fold AND u.reg = v.reg AND u.mix = v.mix
        JOIN mom ON mom.fold = v.fold AND mom.i = v.i AND mom.j = u.i GROUP BY ALL)
SELECT fit.fold, CAST(fit.reg AS DOUBLE) AS reg_param, CAST(fit.mix AS DOUBLE) AS elastic_net, CAST(round(size.n) AS BIGINT) AS n_train,
       CAST(round(own.s) AS BIGINT) AS n_test, round(sse / own.s, 6) AS mse,
       CAST(len(list_filter(w, lambda x: abs(x) > 1e-9)) AS INTEGER) AS n_nonzero,
       round(list_sum(list_transform(w, lambda x: abs(x))), 6) AS l1_norm
FROM fit JOIN err ON err.fold = fit.fold AND err.reg = fit.reg AND err.mix = fit.mix
JOIN size ON size.fold = fit.fold JOIN mom own ON own.fold = fit.fold AND own.i = 1 AND own.j = 1""")))
def q_lr_cv_path(spark, sf_dir):
    """Held-out error of every fold and penalty of linear regression, from one scan."""
    path = OS.lr_cv_path(_train_frame(spark, sf_dir), FEATURES, "likes", REG_PARAMS, ELASTIC_NETS, FOLDS)
    return path.withColumns({"mse": _r("mse"), "l1_norm": _r("l1_norm")})


@register("nb_cv_scores", _clean_cte(f"""WITH {_TRAIN_CTES},
long AS (SELECT post_id, fold, high, unnest({list(FEATURES)}) AS f, unnest([{', '.join(FEATURES)}]) AS x FROM tr),
sums AS (SELECT fold, high, f, sum(x) AS s FROM long GROUP BY ALL),
n AS (SELECT fold, high, count(*) AS n FROM tr GROUP BY ALL),
rest AS (SELECT k.fold, high, f, sum(s) FILTER (sums.fold <> k.fold) AS s FROM sums, (SELECT DISTINCT fold FROM tr) k GROUP BY ALL),
nrest AS (SELECT k.fold, high, sum(n) FILTER (n.fold <> k.fold) AS n FROM n, (SELECT DISTINCT fold FROM tr) k GROUP BY ALL),
sm AS (SELECT unnest({list(SMOOTHING)}) AS a),
pri AS (SELECT fold, a, high, ln(n + a) - ln(sum(n) OVER (PARTITION BY fold, a) + 2 * a) AS p FROM nrest, sm),
lik AS (SELECT fold, a, high, f, ln(s + a) - ln(sum(s) OVER (PARTITION BY fold, a, high) + {_D} * a) AS l FROM rest, sm),
w AS (SELECT one.fold, one.a, one.f, one.l AS raw, one.l - nul.l AS margin FROM lik one
      JOIN lik nul ON nul.fold = one.fold AND nul.a = one.a AND nul.f = one.f WHERE one.high = 1 AND nul.high = 0),
p AS (SELECT one.fold, one.a, one.p AS raw, one.p - nul.p AS margin FROM pri one
      JOIN pri nul ON nul.fold = one.fold AND nul.a = one.a WHERE one.high = 1 AND nul.high = 0),
sc AS (SELECT long.post_id, long.fold, w.a, long.high, round(sum(x * w.raw) + max(p.raw), 9) AS raw,
              round(sum(x * w.margin) + max(p.margin), 9) AS margin
       FROM long JOIN w ON w.fold = long.fold AND w.f = long.f JOIN p ON p.fold = long.fold AND p.a = w.a GROUP BY ALL),
rk AS (SELECT fold, a, high,
       rank() OVER (PARTITION BY fold, a ORDER BY raw) + (count(*) OVER (PARTITION BY fold, a, raw) - 1) / 2.0 AS r1,
       rank() OVER (PARTITION BY fold, a ORDER BY margin) + (count(*) OVER (PARTITION BY fold, a, margin) - 1) / 2.0 AS r2 FROM sc),
t AS (SELECT fold, a, count(*) AS n, sum(high) AS np, sum(r1) FILTER (high = 1) AS s1, sum(r2) FILTER (high = 1) AS s2
      FROM rk GROUP BY fold, a)
SELECT fold, CAST(a AS DOUBLE) AS smoothing, n AS n_test, round((s1 - np * (np + 1) / 2.0) / (np * (n - np)), 6) AS auc_raw,
       round((s2 - np * (np + 1) / 2.0) / (np * (n - np)), 6) AS auc_margin FROM t"""))
def q_nb_cv_scores(spark, sf_dir):
    """Held-out ROC areas of every fold and smoothing value of naive Bayes, from fold count tables."""
    scores = OS.nb_cv_scores(_train_frame(spark, sf_dir), FEATURES, "high", SMOOTHING, FOLDS)
    return scores.withColumns({"auc_raw": _r("auc_raw"), "auc_margin": _r("auc_margin")})
