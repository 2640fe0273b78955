"""Looking every token of a table up in a vocabulary table, without a shuffle of the tokens.

Rows are dealt into blocks by a hash of their id.  A block has few distinct words beside its tokens,
so only the pairs (block, word) are joined with the vocabulary; each block's rows and its part of
the vocabulary then meet in one group, where Arrow looks the tokens up.  Neither side passes
through the driver, and no task holds more than a block.  ``looked_up`` does the same with native
expressions only, over blocks of rows that were written next to each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..session import cut_lineage

#: Tokens that a block holds on average.
BLOCK_TOKENS = 500_000
#: Rows that ``looked_up`` takes at once, and slots that a block's words are dealt into by a hash.
BATCH_ROWS, SLOTS = 32, 16_384
SEPARATOR = "\u0001"


def in_blocks(df: DataFrame, id_col: str | None, words_col: str, block_tokens: int = BLOCK_TOKENS,
              kept: bool = False) -> DataFrame:
    """The table, written once (``kept``: it is already), with the row's block in ``_block``.  Rows of
    one id share a block; without an id the written rows are numbered."""
    if id_col is None:
        df, id_col, kept = df.withColumn("_row", F.monotonically_increasing_id()), "_row", False
    df = df if kept else cut_lineage(df)
    tokens = df.agg(F.sum(F.greatest(F.size(words_col), F.lit(0)))).first()[0] or 0
    return df.withColumn("_block", F.pmod(F.xxhash64(id_col), F.lit(max(8, tokens // block_tokens + 1))).cast("int"))


def block_words(blocked: DataFrame, words: Column | str) -> DataFrame:
    """(_block, word, n): the distinct words of each block and how often it holds them; written, since
    it is narrow and read for the vocabulary and for the blocks' parts of it."""
    gen, keep = T.explode_values(words, "word")
    return cut_lineage(blocked.select("_block", gen).where(keep).groupBy("_block", "word").agg(F.count(F.lit(1)).alias("n")))


def parts(words: DataFrame, vocabulary: DataFrame, how: str = "inner") -> DataFrame:
    """(_block, word, values): the rows of ``vocabulary`` (word, values) that each block needs."""
    return words.select("_block", "word").join(vocabulary, "word", how)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _flat(words: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(lengths, tokens) of a list column; null lists are empty."""
    lists = _whole(words)
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _found(tokens: pa.Array, words: pa.Table) -> pa.Array:
    """Each token's row of the words, null for others."""
    return pc.index_in(tokens, value_set=_whole(words.column("word")).cast(tokens.type), skip_nulls=True)


def _met(blocked: DataFrame, part: DataFrame, fn: Callable, schema: StructType) -> DataFrame:
    return blocked.groupBy("_block").cogroup(part.groupBy("_block")).applyInArrow(fn, schema)


def _values(part: DataFrame) -> list[StructField]:
    return [f for f in part.schema.fields if f.name not in ("_block", "word")]


def neighbour_counts(blocked: DataFrame, words_col: str, part: DataFrame, window: int) -> DataFrame:
    """(a, b, n): how often the values a <= b of two tokens stand at most ``window`` places apart in a row of
    ``in_blocks``, counted by block, so a pair comes back once for each block that has it.  ``part`` has
    one integer column, 0 or more; tokens without a value keep their places."""
    value, = _values(part)

    def fn(rows: pa.Table, words: pa.Table) -> pa.Table:
        lengths, tokens = _flat(rows.column(words_col))
        at = pc.fill_null(_whole(words.column(value.name)).take(_found(tokens, words)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        keys = [np.empty(0, np.int64)]
        for k in range(1, window + 1):
            a, b = at[:-k], at[k:]
            both = (a >= 0) & (b >= 0) & (row[:-k] == row[k:])
            a, b = a[both], b[both]
            keys.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        pairs, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.table({"a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "n": n.astype(np.int64)})

    return _met(blocked, part, fn, StructType([StructField("a", value.dataType), StructField("b", value.dataType), StructField("n", LongType())]))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def looked_up(rows: DataFrame, words_col: str, forms: Callable[[DataFrame], DataFrame], values: list[str],
              out_col: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows with ``words_col`` replaced by ``out_col``, one struct of ``values`` (of ``forms``, or the word) for each token, in order, without Python
    and without an exchange of tokens.  ``forms`` adds the values to the distinct words (word, ...), each there once.
    ``rows`` is written and has ``_row`` = monotonically_increasing_id() from then; tokens are not null and hold no U+0001.

    Rows that follow each other make a block, so its distinct words are found where the rows are read.
    A word carries the list of its blocks; every block gets the forms of its words as one array ordered by
    slot, with the slots' first places, and its rows, a few at a time, read their tokens' forms there."""
    n, tokens = rows.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size(words_col), F.lit(0)))).first()
    of_block = max(1, block_tokens * n // max(tokens or 0, 1) // BATCH_ROWS) * BATCH_ROWS
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    blocked = rows.withColumns({"_block": F.col("_row") - place % of_block, "_batch": F.col("_row") - place % BATCH_ROWS})
    gen, keep = T.explode_values(words_col, "word")
    vocabulary = forms(blocked.select("_block", gen).where(keep).distinct().groupBy("word").agg(F.collect_list("_block").alias("_blocks")))
    block, keep = T.explode_values("_blocks", "_block")
    others = [v for v in values if v != "word"]
    # the slot is worked out behind the exchange
    tables = vocabulary.select(block, "word", *others).where(keep).groupBy("_block").agg(F.collect_list(F.struct("word", *others)).alias("_words"))
    tables = tables.select("_block", F.sort_array(F.transform("_words", lambda e: F.struct(
        _slot(e["word"]).alias("slot"), e["word"].alias("word"), *(e[v].alias(v) for v in others)))).alias("_table"))
    # place of the first entry of each slot or, where a slot has none, of a later one
    tables = tables.withColumn("_starts", F.flatten(F.transform("_table", lambda e, i: F.array_repeat(
        i, e["slot"] - F.when(i == 0, F.lit(-1)).otherwise(F.get("_table", i - 1)["slot"])))))

    def form(word: Column) -> Column:
        first = F.get("_starts", _slot(word))
        end = F.coalesce(F.get("_starts", _slot(word) + 1), F.size("_table"))
        return F.get(F.filter(F.slice("_table", first + 1, end - first), lambda e: e["word"] == word), F.lit(0))

    kept = [c for c in rows.columns if c not in ("_row", words_col)]
    # dealt first: a task gathers the batches of its blocks, not those of a whole file
    # tokens move as one string a row, which takes half the bytes of an array
    batches = blocked.select("_block", "_batch", *kept, F.array_join(words_col, SEPARATOR).alias("_joined"), (F.size(words_col) > 0).alias("_any")) \
        .repartition("_block").groupBy("_block", "_batch").agg(F.collect_list(F.struct(*kept, "_joined", "_any")).alias("_rows"))

    def tokens_of(r: Column) -> Column:
        return F.when(r["_any"], F.split(r["_joined"], SEPARATOR, -1)).otherwise(F.array().cast("array<string>"))

    found = F.transform("_rows", lambda r: F.struct(*(r[c].alias(c) for c in kept), F.transform(
        F.transform(tokens_of(r), form), lambda e: F.struct(*(e[v].alias(v) for v in values))).alias(out_col)))
    # outer: a plain inline would have the lookup run once more for a filter
    return batches.join(tables, "_block", "left").select(F.inline_outer(found))
