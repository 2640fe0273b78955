"""op2, op4, op6 and op8 against brute force on whole small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import TEXTS

from postlens.llm import common, lm, quality, sharding, toxicity
from postlens.llm.common import read

SF = "/root/testdata/sf0.001"


# -- op2 ----------------------------------------------------------------------
def check_shards(rows, texts, n):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for s in {r.shard for r in rows}:
        assert 0 <= s < n
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}


def test_shard_odd_rows(odd, nothing):
    check_shards(sharding.shard(odd, 3, 64).collect(), TEXTS, 3)
    assert sharding.shard(nothing, 3, 64).count() == 0


def test_shards_are_even_and_copies_spread(spark):
    docs = spark.range(3000).selectExpr("case when id < 1000 then 7 else id end as doc_id",
                                        "case when id < 1000 then 'copy' else repeat('ab', cast(id % 50 as int)) end as text")
    rows = sharding.shard(docs, 8, 512).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.05 * min(load.values())


def test_map_is_versioned_and_edited_little(spark, tmp_dir):
    docs = read(spark, SF, "documents")
    rows = sharding.sized_rows(docs, 256)
    totals = sharding.slot_totals(rows, 256)
    first = sharding.place(totals, 4)
    sharding.save_map(first, tmp_dir + "/map")
    same = sharding.rebalance(sharding.load_map(spark, tmp_dir + "/map"), totals, 4, tolerance=0.3)
    before = {r.virtual_slot: r.shard for r in first.collect()}
    assert {r.virtual_slot: r.shard for r in same.collect()} == before
    grown = sharding.rebalance(sharding.load_map(spark, tmp_dir + "/map"), totals, 5)
    sharding.save_map(grown, tmp_dir + "/map")
    after = sharding.load_map(spark, tmp_dir + "/map").collect()
    assert {r.version for r in after} == {2} and sharding.load_map(spark, tmp_dir + "/map", 1).count() == 256
    moved = [r for r in after if before[r.virtual_slot] != r.shard]
    assert moved and sum(r.shard == 4 for r in moved) > 0.8 * len(moved) and len(moved) < 0.4 * 256


def test_sharding_is_native(spark):
    plan = sharding.op2_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- op8 ----------------------------------------------------------------------
def brute_base(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if __import__("re").search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    win = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if win[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside), failed)


def test_quality_base_figures(odd, nothing, labels, spark):
    for docs, labs in ((odd, labels), (read(spark, SF, "documents"), read(spark, SF, "labels"))):
        got = quality.rate(docs, labs).collect()
        want = [(r.doc_id, *brute_base(r.text)) for r in docs.collect()]
        assert sorted([tuple(r)[:7] for r in got], key=str) == sorted(want, key=str)
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.rate(nothing, labels).count() == 0


def test_quality_verdict_follows_labels(spark):
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labs = [r for r in read(spark, "/root/testdata/sf0.01", "labels").collect() if not got[r.doc_id].base_failed]
    good, bad = [r for r in labs if r.quality], [r for r in labs if not r.quality]
    assert sum(got[r.doc_id].kept for r in good) >= 0.98 * len(good)
    assert sum(got[r.doc_id].kept for r in bad) <= 0.15 * len(bad)


# -- op4 ----------------------------------------------------------------------
def test_toxicity_odd_rows(odd, nothing, labels):
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    want = Counter((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, _ in TEXTS)
    assert Counter((r.doc_id, r.held_out) for r in got) == want
    assert toxicity.score_toxicity(nothing, labels).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    held = [r for r in read(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    hits = sum(got[r.doc_id].predicted == r.toxic for r in held)
    caught = sum(got[r.doc_id].predicted for r in held if r.toxic)
    assert hits >= 0.97 * len(held) and caught >= 0.8 * sum(r.toxic for r in held)


def test_counterfactuals_spare_neutral_mentions(spark):
    """A name that stands in toxic texts mostly does not make a neutral text toxic."""
    rows, labs = [], []
    for i in range(400):
        bad = i % 4 == 0
        name = "muslim" if bad or i % 40 == 1 else "christian" if i % 3 else "plain"
        rows.append((i, f"the {name} person is {'an idiot' if bad and i % 8 else 'a baker'} of town {i % 17}"))
        labs.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labs, "doc_id long, y int")
    neutral = "the muslim baker of town"
    with_penalty = toxicity.score_text(neutral, *toxicity.train(docs, known, penalty=50.0))
    without = toxicity.score_text(neutral, *toxicity.train(docs, known, penalty=0.0))
    assert with_penalty < 0.5 < without
    assert toxicity.score_text("an idiot", *toxicity.train(docs, known, penalty=50.0)) > with_penalty


# -- op6 ----------------------------------------------------------------------
def brute_base_scores(texts):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n,
             round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4))
            for (i, _), h, t in zip(texts, held, tokens)]


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_lm_base_and_model(which, odd, spark):
    docs = odd if which == "odd" else read(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score_texts(docs).collect()
    assert sorted([(*tuple(r)[:5], round(r.base_score, 4)) for r in got], key=str) == \
        sorted(brute_base_scores(texts), key=str)
    assert all(r.score < 0 for r in got)
    if which == "sf":
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one():
    import numpy as np
    pairs = np.zeros((lm.CLASSES, lm.CLASSES), int)
    pairs[0, 1] = pairs[1, 0] = 500
    pairs[2, 2] = 50
    logp = lm.log_probabilities(lm.train(pairs, rounds=60))
    assert np.allclose((10 ** logp).sum(axis=1), 1.0)
    assert logp[0, 1] > logp[0, 0] and logp[1, 0] > logp[1, 1]


def test_lm_empty_table(nothing):
    assert lm.score_texts(nothing).count() == 0


def brute_quality(rows, trusted):
    """Scores by plain counting of hashed words and pairs."""
    n = quality.BUCKETS
    target, raw = (np.full(2 * n, quality.PRIOR) for _ in range(2))
    buckets = []
    for doc_id, text in rows:
        h = [zlib.crc32(w) for w in (text or "").encode().split()]
        pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2 ** 64 >> 40) % n + n for a, b in zip(h, h[1:])]
        buckets.append([x % n for x in h] + pairs)
        np.add.at(raw, buckets[-1], 1)
        if doc_id in trusted:
            np.add.at(target, buckets[-1], 1)
    ratio = np.concatenate([np.log(target[s] / target[s].sum()) - np.log(raw[s] / raw[s].sum()) for s in (slice(0, n), slice(n, None))])
    return [float(ratio[b].mean()) if b else 0.0 for b in buckets]


def test_quality_score_equals_brute_force(spark, odd, labels):
    sf = "/root/testdata/sf0.001"
    for docs, labs in ((spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")), (odd, labels)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        trusted = {r.doc_id for r in labs.collect() if r.quality == 1 and r.doc_id is not None}
        want = {}
        for (doc_id, text), score in zip(rows, brute_quality(rows, trusted)):
            want.setdefault(doc_id, []).append(score)
        got = {}
        for r in quality.rate(docs, labs).collect():
            got.setdefault(r.doc_id, []).append(r.score)
            assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
        assert set(got) == set(want) and all(sorted(got[k]) == pytest.approx(sorted(want[k]), abs=1e-9) for k in want)


def test_quality_filter_lets_all_trusted_texts_through(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CAST(concat('text ', id) AS BINARY) AS text")
    labs = spark.range(0, 3000, 7).selectExpr("id AS doc_id", "1 AS quality")
    want = sorted(f"text {k}" for k in range(0, 3000, 7))
    for bits in (64, 1 << 23):  # a full filter lets everything through; the join decides
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        assert sorted(bytes(r.text).decode() for r in quality.trusted_texts(docs, labs).collect()) == want


def test_quality_moves_no_untrusted_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labs = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = quality.trusted_texts(quality.as_bytes(quality.id_and_text(docs)), labs)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
