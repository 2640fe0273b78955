"""Quality rules: hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets.  Two multinomials
are counted over whole tables: the trusted target (documents labelled good) and
the raw corpus (all documents).  A document's score is the mean over its n-grams
of log p_target - log p_raw, and it is kept if the score reaches the threshold
(and no base rule fails); the same score always gives the same verdict.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import as_bytes, id_and_text, may_hold, read

#: Buckets of each order (words, pairs): what is counted and broadcast has this many numbers.
BUCKETS = 1 << 16
#: Buckets of one vector that a task sends.
SLICE = 2048
#: Pseudo-count of a bucket.
PRIOR = 1.0
#: A document whose mean log ratio is below this is less like the target than the
#: corpus is, by a margin that short clean texts do not reach.
THRESHOLD = -0.2
SYMBOLS = "#*$%&|<>"
SCORE_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                "n_repeat_words long, base_failed boolean, kept boolean, score double")


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the neighbouring pairs."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return (h % np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket is met in column ``text`` (binary); pairs follow the words'
    buckets.  A task sends its counts as ``2 * BUCKETS / SLICE`` vectors, which Spark adds up slice
    by slice; 2 * BUCKETS numbers reach the driver."""

    def count(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            parts = [x for text in batch.column("text") for one, two in (hashed(text.as_py().split()),) for x in (one, two + BUCKETS)]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=2 * BUCKETS)
        if total.any():
            slices = total.astype(np.float64).reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()),
                                              pa.array(list(slices), pa.list_(pa.float64()))], names=["slice", "v"])

    parts = texts.select("text").mapInArrow(count, "slice int, v array<double>") \
        .groupBy("slice").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out = np.zeros((2 * BUCKETS // SLICE, SLICE))
    for at, v in parts.collect():
        out[at] = v.toArray()
    return out.ravel()


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket; the raw corpus holds all documents, the target's
    included."""
    target, raw = target + PRIOR, raw + PRIOR
    out = np.empty(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        out[part] = np.log(target[part] / target[part].sum()) - np.log(raw[part] / raw[part].sum())
    return out


def trusted_texts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text) of the documents labelled 1 in any row of ``labels`` (doc_id, quality).

    A filter of a fixed size, whatever the number of labels, lets through all rows with a trusted id
    and few others, where the rows lie; an exact join on the id follows.  So only about as many
    texts are moved as are trusted, in the same plan at every size.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("label_id")) \
        .where("label_id is not null").distinct()
    return may_hold(texts.select("doc_id", "text"), "doc_id", trusted) \
        .join(trusted.hint("shuffle_hash"), F.col("doc_id") == F.col("label_id")).select("text")


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that are found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = h[:n].copy()
    for i in range(1, size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    # equal words always give equal keys; the words themselves settle the rest
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():
        seen.setdefault(tuple(words[i:i + size]), []).append(i)
    mark = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            mark[places] += 1
            np.add.at(mark, [p + size for p in places], -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def base_figures(raw: bytes) -> tuple[list[bytes], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = raw.split()
    chars = len(raw) if raw.isascii() else len(raw.decode())
    white = sum(raw.count(b) for b in b"\x20\x09\x0a\x0b\x0c\x0d")
    lines = [x for x in raw.split(b"\n") if x.strip(b"\x20\x09\x0b\x0c\x0d")]
    return (words, chars - white, sum(raw.count(s.encode()) for s in SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Base figures, log-likelihood-ratio score and verdict of every whole text:
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score.

    ``labels``: (doc_id, quality); documents labelled 1 in any row are the trusted
    target.  Null labels and ids trust nothing.  A null or empty text has no words,
    fails the base rules and scores 0; repeated rows are counted and returned each;
    without trusted documents all scores are near 0; an empty table gives an empty
    result.  Only texts that may be trusted are moved (``trusted_texts``); all else is row-local.
    """
    texts = as_bytes(id_and_text(docs, id_col, text_col))
    ratios = docs.sparkSession.sparkContext.broadcast(
        log_ratios(bucket_counts(trusted_texts(texts, labels)), bucket_counts(texts)))

    def score(batches):
        ratio = ratios.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, chars, symbols, dup, repeat = base_figures(text.as_py())
                n = len(words)
                value = 0.0
                if n:
                    one, two = hashed(words)
                    value = math.fsum((ratio[one].sum(), ratio[two + BUCKETS].sum())) / (len(one) + len(two))
                failed = n < 10 or 100 * repeat > 20 * n
                out.append((doc_id, n, chars, symbols, dup, repeat, failed, not failed and value >= threshold, value))
            cols = list(zip(*out)) or [()] * 9
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")])

    return texts.mapInArrow(score, SCORE_SCHEMA)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
