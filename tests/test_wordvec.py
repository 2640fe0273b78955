"""Co-occurrence counts by hand, and the eigenvectors' reconstruction of the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import wordvec as WV


def test_counts_and_information(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],), (["x"],), ([],), (None,)], "w array<string>")
    got = {(r.word, r.context): r.n for r in WV.cooccurrences(df, "w", window=2, min_count=1).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("b", "c"): 1, ("c", "b"): 1}
    assert {(r.word, r.context) for r in WV.cooccurrences(df, "w", window=2, min_count=2).collect()} == {("a", "b"), ("b", "a"), ("a", "a")}
    values = {(r.word, r.context): r.value for r in WV.ppmi(WV.cooccurrences(df, "w", 2, 1)).collect()}
    # 8 places in all: a 4, b 3, c 1
    assert values == pytest.approx({("a", "b"): np.log(2 * 8 / 12), ("b", "a"): np.log(2 * 8 / 12), ("b", "c"): np.log(8 / 3),
                                    ("c", "b"): np.log(8 / 3)})


def test_vectors_reconstruct_the_table(spark):
    rnd = np.random.default_rng(1)
    n, size = 40, 6
    q, _ = np.linalg.qr(rnd.normal(size=(n, n)))
    values = np.array([9.0, -7.0, 5.0, 4.0, 3.0, 2.5, *np.linspace(0.3, 0.01, n - 6)])
    m = (q * values) @ q.T
    table = spark.createDataFrame([(f"w{i}", f"w{j}", float(m[i, j])) for i in range(n) for j in range(n)],
                                  "word string, context string, value double").repartition(5)
    vectors, found = WV.word_vectors(table, size, rounds=6)
    assert found == pytest.approx(values[:size], abs=0.02)
    v = np.array([r.vector for r in vectors.orderBy(F.expr("int(substr(word, 2))")).collect()])
    best = (q[:, :size] * values[:size]) @ q[:, :size].T
    assert np.abs((v * np.sign(found)) @ v.T - best).max() < 0.05
    none, zero = WV.word_vectors(table.limit(0), 3)
    assert none.count() == 0 and not zero.any()


def test_a_table_of_lower_rank(spark):
    table = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], "word string, context string, value double")
    vectors, values = WV.word_vectors(table, 3)
    got = {r.word: np.array(r.vector) for r in vectors.collect()}
    assert sorted(np.round(values, 9).tolist()) == [-2.0, 0.0, 2.0]
    assert (got["a"] * np.sign(values)) @ got["b"] == pytest.approx(2.0) and (got["a"] * np.sign(values)) @ got["a"] == pytest.approx(0.0)


def test_vectors_by_tiles_over_ids(spark, monkeypatch):
    """a product multiplies tiles where they lie; words of many deals, sums in two steps, ids without entries."""
    monkeypatch.setattr(WV, "PIECE_NUMBERS", 12)
    rnd = np.random.default_rng(2)
    n, size = 40, 6
    q, _ = np.linalg.qr(rnd.normal(size=(n, n)))
    values = np.array([9.0, -7.0, 5.0, 4.0, 3.0, 2.5, *np.linspace(0.3, 0.01, n - 6)])
    m = (q * values) @ q.T
    table = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n)], "word int, context int, value double").repartition(5)
    ids = spark.createDataFrame([(f"w{i}", i) for i in range(n + 3)], "word string, word_id long")
    vectors, found = WV.word_vectors(table, size, rounds=6, ids=ids)
    assert found == pytest.approx(values[:size], abs=0.02)
    rows = {r.word: r.vector for r in vectors.collect()}
    assert set(rows) == {f"w{i}" for i in range(n)}
    v = np.array([rows[f"w{i}"] for i in range(n)])
    best = (q[:, :size] * values[:size]) @ q[:, :size].T
    assert np.abs((v * np.sign(found)) @ v.T - best).max() < 0.05


def test_pairs_are_counted_before_they_move(spark):
    """a pair that a block holds often is one row of the exchange, not one for each time."""
    from postlens.operators import blocks as B
    df = spark.createDataFrame([(["a", "b"] * 50, i) for i in range(40)], "w array<string>, i int").repartition(3)
    blocked = B.in_blocks(df, "i", "w", 1000)
    part = spark.createDataFrame([("a", 0), ("b", 1)], "word string, at int")
    rows = B.neighbour_counts(blocked, "w", B.parts(B.block_words(blocked, "w"), part), 1).collect()
    assert len(rows) <= 8 and {(r.a, r.b) for r in rows} == {(0, 1)} and sum(r.n for r in rows) == 40 * 99
