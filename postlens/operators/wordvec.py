"""Word vectors from co-occurrence, without the vocabulary on the driver.

The positive pointwise mutual information of words that stand near each other is a symmetric
table (word, context, value), counted by Spark.  Its leading eigenvectors come from a
randomised block power iteration.  Words are numbered and dealt by their number into ``deals`` groups, so
the table falls into deals x deals tiles of like size and the iterated vectors (``size`` a word) into deals
pieces.  A product multiplies each tile with one piece where the tile lies and adds up the results of
a row of tiles; the vectors are made orthonormal with the one size x size matrix of their inner
products, the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import block_words, in_blocks, neighbour_counts, parts
from .text import numbered

#: Entries that a tile of the table holds on average, numbers that a piece of the vectors holds at most, and
#: results of tiles that one task adds up.
TILE_ENTRIES, PIECE_NUMBERS, ADDED_AT_ONCE = 1 << 20, 1 << 20, 16


def cooccurrence_ids(df: DataFrame, words_col: str, window: int = 5, min_count: int = 5) -> tuple[DataFrame, DataFrame]:
    """((word, context, n) by word id, both ways of each pair; (word, n, word_id) of the words found at
    least ``min_count`` times).  Other words keep their places, but their pairs are never formed."""
    blocked = in_blocks(df.select(F.col(words_col).alias("_tokens")), None, "_tokens")
    words = block_words(blocked, "_tokens")
    ids = cut_lineage(numbered(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)))
    known = parts(words, ids.select("word", F.col("word_id").cast("int").alias("_at")))
    one_way = neighbour_counts(blocked, "_tokens", known, window).groupBy("a", "b").agg(F.sum("n").alias("n"))
    ways = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context"),
                                                                       (2 * F.col("n")).alias("n"))))
                     .otherwise(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context"), "n"),
                                        F.struct(F.col("b").alias("word"), F.col("a").alias("context"), "n")))).alias("w")
    return one_way.select(ways).select("w.*"), ids


def cooccurrences(df: DataFrame, words_col: str, window: int = 5, min_count: int = 5) -> DataFrame:
    """(word, context, n): how often words stand at most ``window`` places apart in a row, both ways.
    Words found less than ``min_count`` times are left out (the places stay)."""
    counts, ids = cooccurrence_ids(df, words_col, window, min_count)
    return named(counts, ids)


def named(table: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("word", "context")) -> DataFrame:
    """A table over word ids (``columns``, ...) over words.  A word has at most one row for each
    other word, so no join needs salt."""
    rest = [c for c in table.columns if c not in columns]
    out = table
    for c in columns:
        out = out.join(ids.select(F.col("word_id").alias(c), F.col("word").alias(f"_{c}")), c)
    return out.select(*(F.col(f"_{c}").alias(c) for c in columns), *rest)


def coded(table: DataFrame, ids: DataFrame) -> DataFrame:
    """A table over words (word, context, value) over their ids."""
    out = table
    for c in ("word", "context"):
        out = out.join(ids.select(F.col("word").alias(c), F.col("word_id").alias(f"_{c}")), c)
    return out.select(F.col("_word").alias("word"), F.col("_context").alias("context"), "value")


def ppmi(counts: DataFrame) -> DataFrame:
    """(word, context, value): ln(n N / (n_word n_context)) where it is positive; ``counts`` holds
    both ways of each pair.  The words' sums are written, so that the planner knows how small they are."""
    of = cut_lineage(counts.groupBy("word").agg(F.sum("n").alias("_nw")))
    total = of.agg(F.sum("_nw")).first()[0] or 1
    both = counts.join(of, "word").join(of.select(F.col("word").alias("context"), F.col("_nw").alias("_nc")), "context")
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("_nw").cast("double") * F.col("_nc")))
    return both.select("word", "context", value.alias("value")).where("value > 0")


def _numbers(data: bytes, size: int) -> np.ndarray:
    """A piece: row k holds number k of the vectors of the piece's words."""
    return np.frombuffer(data, dtype=np.float64).reshape(size, -1)


def _piece_rows(data: list[bytes], **keys: list[int]) -> pa.Table:
    return pa.table({**{k: pa.array(v, pa.int32()) for k, v in keys.items()}, "data": pa.array(data, pa.binary())})


def tiles(table: DataFrame, deals: int) -> DataFrame:
    """(_i, _j, word, context, value): the table (word, context, value) over ids, one row for the entries of
    words dealt to ``_i`` with contexts dealt to ``_j``, as packed arrays ordered by place."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        word, context, value = (rows.column(c).to_numpy() for c in ("word", "context", "value"))
        order = np.lexsort((context, word))
        packed = [word[order].astype(np.int32), context[order].astype(np.int32), value[order].astype(np.float64)]
        return pa.table({"_i": pa.array([key[0].as_py()], pa.int32()), "_j": pa.array([key[1].as_py()], pa.int32()),
                         **{c: pa.array([a.tobytes()], pa.binary()) for c, a in zip(("word", "context", "value"), packed, strict=True)}})

    dealt = [F.pmod(c, F.lit(deals)).cast("int").alias(k) for c, k in (("word", "_i"), ("context", "_j"))]
    placed = [F.floor(F.col(c) / deals).cast("int").alias(c) for c in ("word", "context")]
    return table.select(*dealt, *placed, "value").groupBy("_i", "_j") \
        .applyInArrow(pack, "_i int, _j int, word binary, context binary, value binary")


def pieces(vectors: DataFrame, deals: int, n_words: int, size: int) -> DataFrame:
    """(_b, data): vectors (word, v) over ids as one array for each deal; words without a row count as 0."""

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        b = key[0].as_py()
        out = np.zeros((size, (n_words - b + deals - 1) // deals))
        out[:, rows.column("_p").to_numpy()] = pa.concat_arrays(rows.column("v").chunks).flatten().to_numpy().reshape(-1, size).T
        return _piece_rows([out.tobytes()], _b=[b])

    return vectors.select(F.pmod("word", F.lit(deals)).cast("int").alias("_b"), F.floor(F.col("word") / deals).cast("int").alias("_p"), "v") \
        .groupBy("_b").applyInArrow(fill, "_b int, data binary")


def added(results: DataFrame, *keys: str) -> DataFrame:
    """The sums of the ``data`` of equal keys, taken in the order of ``_j``."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_j")
        total = np.frombuffer(rows.column("data")[0].as_py()).copy()
        for at in range(1, rows.num_rows):
            total += np.frombuffer(rows.column("data")[at].as_py())
        return _piece_rows([total.tobytes()], **{k: [v.as_py()] for k, v in zip(keys, key, strict=True)})

    return results.groupBy(*keys).applyInArrow(add, ", ".join(f"{k} int" for k in keys) + ", data binary")


def times(tiled: DataFrame, block: DataFrame, deals: int, n_words: int, size: int) -> DataFrame:
    """The symmetric table, as ``tiles``, times the vectors, as ``pieces``."""

    def multiply(key: tuple, tile: pa.Table, piece: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        if not tile.num_rows or not piece.num_rows:
            return _piece_rows([], _i=[], _j=[])
        vectors = _numbers(piece.column("data")[0].as_py(), size)
        word, context, value = (np.frombuffer(tile.column(c)[0].as_py(), t) for c, t in (("word", np.int32), ("context", np.int32), ("value", np.float64)))
        n = (n_words - i + deals - 1) // deals
        return _piece_rows([np.concatenate([np.bincount(word, value * v[context], n) for v in vectors]).tobytes()], _i=[i], _j=[j])

    for_tiles = block.select(F.col("_b").alias("_j"), "data", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("_i"))
    out = tiled.groupBy("_i", "_j").cogroup(for_tiles.groupBy("_i", "_j")).applyInArrow(multiply, "_i int, _j int, data binary")
    if deals > ADDED_AT_ONCE:
        strips = out.select("_i", "_j", "data", F.floor(F.col("_j") / ADDED_AT_ONCE).cast("int").alias("_s"))
        out = added(strips, "_i", "_s").withColumnRenamed("_s", "_j")
    return added(out, "_i").withColumnRenamed("_i", "_b")


def inner(a: DataFrame, size: int, right: str = "data") -> np.ndarray:
    """Sum over words of the outer products of their vectors in ``data`` and ``right``: size^2 numbers a piece."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = [(_numbers(x.as_py(), size) @ _numbers(y.as_py(), size).T).ravel() for x, y in zip(batch["data"], batch[right], strict=True)]
            yield pa.record_batch({"_b": batch["_b"], "o": pa.array(outer, pa.list_(pa.float64()))})

    rows = a.select("_b", *dict.fromkeys(["data", right])).mapInArrow(products, "_b int, o array<double>").collect()
    return sum((np.array(r.o) for r in sorted(rows, key=lambda r: r["_b"])), np.zeros(size * size)).reshape(size, size)


def turned(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each word's vector times a small matrix."""
    size = len(matrix)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(matrix.T @ _numbers(x.as_py(), size)).tobytes() for x in batch["data"]]
            yield pa.record_batch({"_b": batch["_b"], "data": pa.array(out, pa.binary())})

    return block.select("_b", "data").mapInArrow(turn, "_b int, data binary")


def orthonormal(block: DataFrame, size: int) -> DataFrame:
    """The block with orthonormal columns; columns that add nothing become 0."""
    values, vectors = np.linalg.eigh(inner(block, size))
    live = values > 1e-12 * max(values.max(), 1e-300)
    return turned(block, vectors * np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0))


def unpacked(block: DataFrame, deals: int, size: int) -> DataFrame:
    """(word, v) of ``pieces``, for every place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in zip(batch["_b"].to_pylist(), batch["data"], strict=True):
                v = np.ascontiguousarray(_numbers(data.as_py(), size).T)
                for at in range(0, len(v), 10_000):
                    some = v[at:at + 10_000]
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * size)
                    yield pa.record_batch({"word": pa.array((np.arange(len(some), dtype=np.int64) + at) * deals + b),
                                           "v": pa.ListArray.from_arrays(ends, pa.array(some.ravel()))})

    return block.mapInArrow(rows, "word long, v array<double>")


def word_vectors(table: DataFrame, size: int = 20, rounds: int = 4, seed: int = 0,
                 ids: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """((word, vector), eigenvalues) of a symmetric table (word, context, value): the ``size`` leading
    eigenpairs by absolute value, vector = eigenvector entries times the root of |eigenvalue|.  The
    start is drawn from a hash of the word, so results do not depend on partitioning; a sign is
    free.  With ``ids`` (word, word_id), numbered from 0, the table is over word ids.  An empty table gives no words."""
    table = cut_lineage(table)
    if ids is None:
        ids = cut_lineage(numbered(table.groupBy("word").agg(F.count(F.lit(1)).alias("n"))))
        entries = coded(table, ids)
    else:
        entries = table
    present = cut_lineage(named(entries.select("word").distinct().withColumn("word_id", F.col("word")), ids, ("word",)))
    if present.isEmpty():
        return present.select("word", F.array().cast("array<double>").alias("vector")), np.zeros(size)
    n_words = ids.agg(F.max("word_id")).first()[0] + 1
    deals = max(-(-n_words // max(1, PIECE_NUMBERS // size)), int(np.ceil(np.sqrt(table.count() / TILE_ENTRIES))))
    tiled = cut_lineage(tiles(entries, deals))
    draw = [(F.pmod(F.xxhash64("word", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 29) - 1.0) for k in range(size)]
    block = cut_lineage(pieces(present.select(F.col("word_id").alias("word"), F.array(*draw).alias("v")), deals, n_words, size))
    for _ in range(rounds):
        block = orthonormal(cut_lineage(times(tiled, orthonormal(block, size), deals, n_words, size)), size)
    block = cut_lineage(block)
    moved = cut_lineage(block.join(times(tiled, block, deals, n_words, size).withColumnRenamed("data", "w"), "_b"))
    values, vectors = np.linalg.eigh(inner(moved, size, "w"))
    order = np.argsort(-np.abs(values), kind="stable")
    values, vectors = values[order], vectors[:, order]
    found = cut_lineage(unpacked(turned(block, vectors * np.sqrt(np.abs(values))), deals, size))
    return named(found.withColumnRenamed("v", "vector"), present, ("word",)), values
