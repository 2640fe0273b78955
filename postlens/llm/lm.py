"""Language-model scoring with a log-bilinear model.

Vocabulary.  ``TOP`` frequent words and the end mark are classes of their own; all
other words fall into ``TAIL`` classes by their last two bytes.  The model predicts
the next class from the class before it: with r the class embeddings, C a matrix and
b the biases, s(w | h) = (r_h C) . r_w + b_w.  It is trained in numpy by
noise-contrastive estimation against the class frequencies, on the class pairs of
the whole training corpus, and one batched matrix product and a softmax then give
normalised log-probabilities.  Within a tail class a seen word has its share of the
class's training tokens, and the share of words seen once is left to unseen words.

Counts cover all training text.  Words of the head (found by what is frequent in
some partition; at most ``HEAD`` of them) are counted in fixed-size vectors; all
others are counted by a shuffle on the word, where no word can be hot.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlens.llm.common import as_bytes, fold, id_and_text, keep, read

HEAD, TOP, TAIL = 1 << 16, 767, 192
CLASSES = TOP + 1 + TAIL
END = TOP
LONGEST_HEAD_WORD = 64
BLOCK = 4096
WIDTH, NOISE, ROUNDS, RATE = 24, 20, 150, 0.05
L10 = math.log(10.0)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def heavy_words(texts: DataFrame) -> tuple[list[bytes], int]:
    """(head words by falling count, training tokens).  A partition sends the words
    that make up a 1/HEAD share of its tokens; a word that frequent overall is so in
    some partition."""

    def run(batches):
        count: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py())
                n += len(words) + 1
                count.update(words)
        least = max(2, n / HEAD)
        out = [(w, c) for w, c in count.items() if c >= least and len(w) <= LONGEST_HEAD_WORD]
        yield pa.RecordBatch.from_arrays([pa.array([b"", *(w for w, _ in out)], pa.binary()),
                                          pa.array([n, *(c for _, c in out)], pa.int64())], names=["word", "n"])

    sums = texts.where("not held_out").select("text").mapInArrow(run, "word binary, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))
    rows = sums.orderBy((F.length("word") == 0).desc(), F.desc("n"), "word").limit(HEAD + 1).collect()
    total = int(rows[0].n) if rows else 0
    return [bytes(r.word) for r in rows[1:]], total


class Tails(dict):
    """Tail class of a word's last two bytes; at most 65,792 entries."""

    def __missing__(self, end: bytes) -> int:
        self[end] = TOP + 1 + crc32(end) % TAIL
        return self[end]


class Classes:
    """Class and head place of words."""

    def __init__(self, head: list[bytes]):
        self.place = {w: i for i, w in enumerate(head)}
        self.tails = Tails()
        self.of_head = np.array([i if i < TOP else self.tail(w) for i, w in enumerate(head)] or [0], np.int64)

    @staticmethod
    def tail(word: bytes) -> int:
        return TOP + 1 + crc32(word[-2:]) % TAIL

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(head place or -1, class) of each word."""
        get = self.place.get
        at = np.array([get(w, -1) for w in words], np.int64)
        cls = self.of_head[at]
        low, tails = np.flatnonzero(at < 0), self.tails
        cls[low] = [tails[words[i][-2:]] for i in low.tolist()]
        return at, cls


def add_up(parts: DataFrame) -> DataFrame:
    """Sum the vectors (payload) of each (kind, at), in two steps so that no task
    reads the vectors of all partitions."""

    def total(key, pdf):
        out = np.zeros(len(pdf.payload.iloc[0]) // 8, np.int64)
        for p in pdf.payload:
            out += np.frombuffer(p, np.int64)
        return pd.DataFrame([[*key, out.tobytes()]])

    first = parts.groupBy("kind", "at", "salt").applyInPandas(total, "kind int, at int, salt int, payload binary")
    return first.groupBy("kind", "at").applyInPandas(total, "kind int, at int, payload binary")


def corpus_counts(texts: DataFrame, head: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(class pairs, head counts) of all training text; the fetched tables have a
    fixed size (CLASSES squared and HEAD numbers)."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        classes = Classes(shared.value)
        pairs, heads = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(HEAD, np.int64)
        for batch in batches:
            codes, places = [], []
            for text in batch.column("text"):
                at, cls = classes.split(words_of(text.as_py()))
                cls = np.concatenate([[END], cls, [END]])
                codes.append(cls[:-1] * CLASSES + cls[1:])
                places.append(at[at >= 0])
            if codes:
                pairs += np.bincount(np.concatenate(codes), minlength=len(pairs))
                heads += np.bincount(np.concatenate(places), minlength=HEAD)
        salt = TaskContext.get().partitionId() % 64
        rows = [(0, i, salt, r.tobytes()) for i, r in enumerate(pairs.reshape(CLASSES, CLASSES)) if r.any()]
        rows += [(1, i, salt, r.tobytes()) for i, r in enumerate(heads.reshape(-1, BLOCK)) if r.any()]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(),
                                                                                 pa.binary()))],
                                         names=["kind", "at", "salt", "payload"])

    parts = texts.where("not held_out").select("text").mapInArrow(run, "kind int, at int, salt int, payload binary")
    pairs, heads = np.zeros((CLASSES, CLASSES), np.int64), np.zeros((HEAD // BLOCK, BLOCK), np.int64)
    for kind, at, payload in add_up(parts).collect():
        (heads if kind else pairs)[at] = np.frombuffer(payload, np.int64)
    return pairs, heads.ravel()[:len(head)]


def train(pairs: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation on class-pair counts (rows: class before).

    The noise is the class distribution; its expectation is taken exactly, ``NOISE``
    noise draws for each pair.  Batches are all pairs, steps are Adam's.
    """
    n = pairs.astype(np.float64)
    total = max(n.sum(), 1.0)
    noise = (n.sum(axis=0) + 0.1) / (total + 0.1 * CLASSES)
    here = n.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    par = {"r": rng.normal(0, 0.1, (CLASSES, WIDTH)), "c": np.eye(WIDTH) * 0.5, "b": np.log(noise)}
    m = {k: np.zeros_like(x) for k, x in par.items()}
    v = {k: np.zeros_like(x) for k, x in par.items()}
    log_kn = np.log(NOISE * noise)
    for t in range(1, rounds + 1):
        u = par["r"] @ par["c"]
        s = 1.0 / (1.0 + np.exp(-np.clip(u @ par["r"].T + par["b"] - log_kn, -40, 40)))
        # of the negative objective, per training pair; rare contexts take full steps under Adam
        g = (here * NOISE * noise * s - n * (1.0 - s)) / total
        du = g @ par["r"]
        grads = {"r": g.T @ u + du @ par["c"].T + 1e-8 * par["r"], "c": par["r"].T @ du, "b": g.sum(axis=0)}
        for k, x in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            par[k] -= RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-10)
    return par


def log_probabilities(par: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised log10 P(class | class before), all at once."""
    s = par["r"] @ par["c"] @ par["r"].T + par["b"]
    s -= s.max(axis=1, keepdims=True)
    return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / L10


def tail_figures(texts: DataFrame, head: list[bytes], class_tokens: np.ndarray) -> DataFrame:
    """Of the words outside the head, per (doc_id, text hash): tail_base (sum of
    log10(c + 0.1)), tail_share (sum over seen tokens of log10 of the word's share of
    its class), tail_seen, tail_unseen (tokens), and words_first, once_first (distinct
    words, and words counted once, that this text comes first with)."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        known = set(shared.value)
        for batch in batches:
            rows = []
            for doc_id, h, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "held_out", "text"))):
                count = Counter([w for w in words_of(text) if w not in known])
                rows += [(doc_id, h, w, n, 0 if held else n, Classes.tail(w)) for w, n in count.items()]
            for lo in range(0, len(rows), 50_000):
                cols = list(zip(*rows[lo:lo + 50_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                                                           pa.int32()))], names=["doc_id", "h", "word", "n", "t", "cls"])

    rows = texts.mapInArrow(run, "doc_id long, h long, word binary, n long, t long, cls int")
    word = W.partitionBy("word")
    ordered = word.orderBy("doc_id", "h")
    counted = rows.select(
        "doc_id", "h", "n", "cls", F.sum("t").over(word).alias("c"), F.row_number().over(ordered).alias("at"),
        # a repeated row gives the same figures again: they count once for its key
        F.coalesce((F.lag("h").over(ordered) == F.col("h"))
                   & F.lag("doc_id").over(ordered).eqNullSafe(F.col("doc_id")), F.lit(False)).alias("again"))
    tokens = F.element_at(F.array(*[F.lit(float(max(x, 1))) for x in class_tokens]), F.col("cls") - F.lit(TOP))
    seen, own = F.col("c") > 0, ~F.col("again")

    def total(value, when):
        return F.sum(F.when(when, value).otherwise(F.lit(0)))

    return counted.groupBy("doc_id", "h").agg(
        total(F.col("n") * F.log10(F.col("c") + 0.1), own).alias("tail_base"),
        total(F.col("n") * (F.log10(F.col("c")) - F.log10(tokens)), own & seen).alias("tail_share"),
        total(F.col("n"), own & seen).alias("tail_seen"), total(F.col("n"), own & ~seen).alias("tail_unseen"),
        total(F.lit(1), (F.col("at") == 1) & seen).alias("words_first"),
        total(F.lit(1), (F.col("at") == 1) & (F.col("c") == 1)).alias("once_first"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every
    whole text: the smoothed unigram score and the model's log10 probability.

    A null or empty text is its end mark alone.  Null ids are in the fold of the
    empty id; repeated rows count as often as they stand and give one row each; if
    nothing trains, every count is zero; an empty table gives an empty result.
    """
    texts = as_bytes(id_and_text(docs, id_col, text_col)).select(
        "doc_id", F.xxhash64("text").alias("h"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    head, total = heavy_words(texts)
    pairs, head_counts = corpus_counts(texts, head)
    ends = int(pairs[:, END].sum())
    tail = keep(tail_figures(texts, head, pairs.sum(axis=0)[TOP + 1:]), "tail")
    sums = tail.agg(F.sum("words_first"), F.sum("once_first")).first()
    distinct = int((head_counts > 0).sum()) + int(sums[0] or 0) + (ends > 0)
    tail_tokens = int(pairs[:, TOP + 1:].sum())
    # words seen once stand for what is still unseen
    unseen = (int(sums[1] or 0) + 1) / (tail_tokens + 2)
    log_total = math.log10(total + 0.1 * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast((head, head_counts, train(pairs), pairs.sum(axis=0)))

    def run(batches):
        names, counts, par, class_tokens = shared.value
        classes, logp = Classes(names), log_probabilities(par)
        c = np.append(counts, 0).astype(np.float64)
        base = np.log10(c + 0.1)
        # a head word inside a tail class: its share of the class
        place = np.arange(len(names))
        share = np.zeros(len(c))
        low = place[TOP:]
        share[low] = np.log10(np.maximum(c[low], 1) / np.maximum(class_tokens[classes.of_head[low]], 1)) if len(low) else 0
        end_base = math.log10(ends + 0.1)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                at, cls = classes.split(words)
                cls = np.concatenate([[END], cls, [END]])
                inside = at[at >= 0]
                out.append((len(words) + 1, int((c[inside] > 0).sum()) + (ends > 0), float(base[inside].sum()) + end_base,
                            float(logp[cls[:-1], cls[1:]].sum() + share[inside].sum()), int((inside >= TOP).sum())))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in ("doc_id", "h", "held_out")] + [pa.array(x, t) for x, t in zip(cols, types)],
                names=["doc_id", "h", "held_out", "n_tokens", "known", "base", "model", "low"])

    scored = texts.mapInArrow(run, "doc_id long, h long, held_out boolean, n_tokens long, known long, base double, "
                                   "model double, low long")
    t = tail.select(F.col("doc_id").alias("tail_id"), F.col("h").alias("tail_h"), "tail_base", "tail_share", "tail_seen",
                    "tail_unseen")
    both = scored.join(t, (F.col("h") == F.col("tail_h")) & F.col("doc_id").eqNullSafe(F.col("tail_id")), "left")

    def of(name):
        return F.coalesce(name, F.lit(0))

    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + of("tail_seen")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + of("tail_base") - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("model") + of("tail_share") + (F.col("low") + of("tail_seen")) * math.log10(1 - unseen)
         + of("tail_unseen") * math.log10(unseen)).alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
