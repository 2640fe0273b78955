"""Tokens looked up by block of rows: whole results against plain Python, and no token shuffled by itself."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.operators import blocks as B
from postlens.operators import cleaning as CL
from postlens.operators import text as TX
from postlens.operators import wordvec as WV


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = [(None if i == 7 else f"p{i % 190}", [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(rnd.randrange(40))]) for i in range(200)]
    rows += [("empty", []), ("none", None)]
    return rows, spark.createDataFrame(rows, "id string, w array<string>").repartition(5).cache()


def test_counts_by_row_and_word(docs):
    """no copies of the vocabulary are broadcast, and no row compares all its words with each other."""
    rows, df = docs
    ids = TX.word_ids(df, "w", partitions=4)
    code = {r.word: r.word_id for r in ids.collect()}
    got = TX.bag_of_words(df, "id", "w", ids)
    assert "BroadcastHashJoin [word" not in plan_of(got)
    want = Counter((i, code[w], n) for i, ws in rows for w, n in Counter(ws or []).items())
    assert Counter(map(tuple, got.collect())) == want


def test_tfidf_reads_its_rows_once(spark):
    """the plan behind the table runs once for its three passes."""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x
    df = spark.range(50, numPartitions=2).select("id", F.udf(note, "array<string>").asNondeterministic()(F.array(F.lit("a"), F.col("id").cast("string"))).alias("w"))
    rows = TX.tfidf_table(df, "id", "w", distinct_words=True).collect()
    assert len(rows) == 100 and {r.df for r in rows if r.word == "a"} == {50}
    assert seen.value == 50


def test_tfidf_join_sorts_nothing(docs, monkeypatch):
    """the words' counts are met by hash, in partitions that their copies bound; whole rows."""
    rows, df = docs
    monkeypatch.setattr(TX, "HASHED_ROWS", 100)
    unique = df.where("id IS NOT NULL").dropDuplicates(["id"]).cache()
    out = TX.tfidf_table(unique, "id", "w")
    plan = plan_of(out)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    texts = {r.id: r.w or [] for r in unique.collect()}
    times, holds = Counter(w for ws in texts.values() for w in ws), Counter(w for ws in texts.values() for w in set(ws))
    want = {(i, w, n, holds[w], times[w]) for i, ws in texts.items() for w, n in Counter(ws).items()}
    got = [(r.id, r.word, r.tf, r.df, r.cf) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary_over_ids_that_repeat(spark, docs, broadcast):
    """F8: no regroup by id across tasks; one row an id, as before."""
    rows, df = docs
    base = {f"w{k}": f"v{k % 9}" for k in range(0, 300, 2)}
    dic = spark.createDataFrame(sorted(base.items()), "surface string, base string")
    out = TX.normalise_vocabulary(df, "id", "w", dic, broadcast_dictionary=broadcast)
    plan = plan_of(out)
    if broadcast:  # one exchange of whole rows; behind the join the tokens stay where they are
        assert plan.count("Exchange hashpartitioning(id") == 1
    want = defaultdict(list)
    for i, ws in rows:
        want[i] += [(p, base.get(w, w)) for p, w in enumerate(ws or [])]
    got = out.collect()
    assert len(got) == len(want)
    assert {r.id: r.normalised for r in got} == {i: [w for _, w in sorted(ps)] for i, ps in want.items()}


def test_cooccurrences_form_no_pairs_of_rare_words(docs, monkeypatch):
    """the pairs are counted over the ids of frequent words only."""
    rows, df = docs
    monkeypatch.setattr(B.in_blocks, "__defaults__", (150, False))
    times = Counter(w for _, ws in rows for w in ws or [])
    want = Counter()
    for _, ws in rows:
        for i, a in enumerate(ws or []):
            for b in ws[i + 1:i + 4]:
                if times[a] >= 10 and times[b] >= 10:
                    want[a, b] += 1
                    want[b, a] += 1
    counts, ids = WV.cooccurrence_ids(df, "w", 3, 10)
    assert {r.word for r in ids.collect()} == {w for w, n in times.items() if n >= 10}
    assert dict(counts.dtypes) == {"word": "int", "context": "int", "n": "bigint"}
    assert {(r.word, r.context): r.n for r in WV.cooccurrences(df, "w", 3, 10).collect()} == want


def test_quantiles_run_the_plan_behind_them_once(spark):
    """The values are read once however many steps the quantiles take."""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x
    df = spark.range(3000, numPartitions=3).select(F.udf(note, "long").asNondeterministic()("id").alias("x"))
    assert [v for _, v in CL.quantile_rows(df, "x", [0.3, 0.6], few=50)] == [899, 1799]
    assert seen.value == 3000


def test_text_feature_vectors_trains_word_vectors(spark):
    """bag of words, hashed counts and Word2Vec."""
    from postlens.plans.catalog import CATALOG
    rows = CATALOG["text_feature_vectors"][0](spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.w2v_size for r in rows} == {100}
