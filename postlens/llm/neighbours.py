"""Approximate nearest neighbours with cross-polytope hashing.

A table turns a unit vector with fast Hadamard pseudo-rotations (three rounds of
random signs and a Walsh-Hadamard transform) and files it under the nearest
signed axis.  A query probes, in every table, the axes nearest to its own
rotation.  What a probe meets is reranked with exact cosines right where the
bucket lies, by blocked matrix products, so candidates never become rows: only
the best few per query and block leave a task.

Buckets are dealt into blocks of bounded size (a block is one group), and a probe
goes to all blocks of its bucket, so large buckets are split, not capped.
Identical vectors are one entry that carries its smallest ids, as many as an
answer can need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlens.llm.common import keep, read

#: Chosen by recall on random vectors, the hardest case (see README for the figures).
TABLES, PROBES, BLOCK_ROWS = 10, 14, 8192


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Three pseudo-rotations of the rows, padded with zeros to a power of two."""
    n, dim = x.shape
    size = 1 << max(0, dim - 1).bit_length()
    y = np.zeros((n, size))
    y[:, :dim] = x
    for turn in range(3):
        y *= np.random.default_rng([table, turn, size]).integers(0, 2, size) * 2.0 - 1.0
        h = 1
        while h < size:
            z = y.reshape(n, size // (2 * h), 2, h)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(n, size)
            h *= 2
        y /= np.sqrt(size)
    return y


def nearest_axes(x: np.ndarray, table: int, probes: int | None) -> np.ndarray:
    """For each row the ids of the signed axes nearest to its rotation, nearest first."""
    y = rotate(x, table)
    both = np.concatenate([y, -y], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array<double>) without null ids and without vectors that are
    null, empty, zero, or hold null or non-finite components."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where("vec_id is not null and v is not null").where(~bad & F.exists(v, lambda c: c != 0)))


def file_rows(rows: DataFrame, tables: int, probes: int | None) -> DataFrame:
    """(class_id, dim, table, axis, v): each row under ``probes`` axes (None: all) of each table."""

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf.v.map(len)):
                x = np.stack(part.v.to_numpy())
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for table in range(tables):
                    axes = nearest_axes(x, table, probes)
                    m = axes.shape[1]
                    yield pd.DataFrame({"class_id": np.repeat(part.class_id.to_numpy(), m), "dim": np.int32(dim),
                                        "table": np.int32(table), "axis": axes.ravel().astype(np.int32),
                                        "v": np.repeat(part.v.to_numpy(), m)})

    return rows.select("class_id", "v").mapInPandas(run, "class_id long, dim int, table int, axis int, v array<double>")


def neighbours(vectors: DataFrame, query_every: int = 50, k: int = 5, tables: int = TABLES, probes: int = PROBES,
               block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score
    (cosine in double precision of the original vectors), nearest first, ties to
    the smaller vec_id.

    Queries are the rows whose id is divisible by ``query_every``; candidates are
    all rows but the query's own.  Vectors that are null, empty or zero or hold
    null or non-finite components take no part, nor do null ids; vectors of
    different lengths are never compared.  Rows that repeat an id and its vector
    are one; an id with several vectors counts with each of them.  A query that met fewer than
    k candidates is compared with all of them, so there are fewer answers only
    where there are fewer candidates; an empty table gives none.
    """
    rows = usable(vectors, id_col, vector_col)
    # identical vectors: one class, known by its smallest id, with the k + 1 smallest ids
    ids = rows.select("v", "vec_id").distinct()
    ranked = ids.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = (ranked.groupBy("v", "salt").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
           .groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")))
    classes = keep(few.select(F.col("ids")[0].alias("class_id"), "v", "ids"), "classes")
    queries = (ids.where(F.col("vec_id") % query_every == 0)
               .groupBy("v").agg(F.min("vec_id").alias("class_id")))
    # a bucket (at most 2 * dim * tables rows of counts) in blocks of about block_rows
    filed = keep(file_rows(classes, tables, 1), "index")
    sizes = keep(filed.groupBy("dim", "table", "axis").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
                                                            .alias("blocks")), "sizes")
    key = ["dim", "table", "axis", "block"]
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks").cast("long")).cast("int")
    index = filed.join(F.broadcast(sizes), key[:3]).select(*key[:3], block.alias("block"), "class_id", "v")
    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """The best k + 1 classes of one block for each query that probes it."""
        found = []
        if len(q) and len(x):
            a, b = np.stack(q.v.to_numpy()), np.stack(x.v.to_numpy())
            na, nb, cid = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), x.class_id.to_numpy()
            for lo in range(0, len(a), 256):
                s = (a[lo:lo + 256] @ b.T) / (na[lo:lo + 256, None] * nb[None, :])
                top = np.argsort(-s, axis=1, kind="stable")[:, :k + 1] if s.shape[1] <= 4 * k else \
                    np.argpartition(-s, k, axis=1)[:, :k + 1]
                for i, row in enumerate(top):
                    # ties with the last one are kept too, the merge settles them by id
                    row = np.flatnonzero(s[i] >= s[i][row].min()) if len(row) == k + 1 else row
                    row = row[np.lexsort((cid[row], -s[i][row]))][:k + 1]
                    found.append(pd.DataFrame({"q": q.class_id.iloc[lo + i], "class_id": cid[row], "score": s[i][row]}))
        return pd.concat(found) if found else pd.DataFrame({"q": [], "class_id": [], "score": []})

    # every query of a class has its answers
    wanted = ids.where(F.col("vec_id") % query_every == 0).join(queries.withColumnRenamed("class_id", "q"), "v") \
        .select(F.col("vec_id").alias("query_id"), "q")

    def answered(asked: DataFrame, tables: int, probes: int | None) -> DataFrame:
        """(query_id, vec_id, score) of the nearest met by the classes asked for."""
        probed = (file_rows(asked, tables, probes).join(F.broadcast(sizes), key[:3])
                  .select(*key[:3], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "class_id", "v"))
        hits = (probed.groupBy(key).cogroup(index.groupBy(key))
                .applyInPandas(best, "q long, class_id long, score double"))
        near = (hits.groupBy("q", "class_id").agg(F.max("score").alias("score"))
                .withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "class_id")))
                .where(F.col("r") <= k + 1))
        # the score of a class holds for each of its ids
        members = near.join(classes.select("class_id", "ids"), "class_id")
        return keep(wanted.join(members, "q").select("query_id", "q", "score", F.explode("ids").alias("vec_id"))
                    .where("vec_id <> query_id").groupBy("query_id", "q", "vec_id").agg(F.max("score").alias("score")), "answers")

    answers = answered(queries, tables, probes)
    # queries that met too few look through all axes of one table, which hold every candidate
    met = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("query_id", "met_id")
    short = keep(wanted.join(met, F.col("query_id") == F.col("met_id"), "left").where(F.coalesce("n", F.lit(0)) < k)
                 .select("q").distinct(), "short")
    if not short.isEmpty():
        asked = queries.join(short, F.col("class_id") == F.col("q")).select("class_id", "v")
        answers = answers.join(short, "q", "left_anti").unionByName(answered(asked, 1, None))
    # an id with several vectors has the best of their answers
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (answers.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
