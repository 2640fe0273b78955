"""Linear text classifiers on word-presence features, fitted in numpy on a
bounded labelled sample: shared by the toxicity and the mixing operator."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import keep, release_worker

WORD = re.compile(r"[^\W\d_]+")


def features(text: str, prefixes: tuple[int, ...] = ()) -> set[str]:
    """Distinct lower-case words, and their prefixes (marked by ``^``)."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in prefixes))


def bounded_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` labelled documents, those with the
    smallest hash of their id; one row per id (its smallest text, its largest label).

    ``labels``: (doc_id, y), without nulls.  The chosen ids are broadcast: at most
    ``rows`` of them.
    """
    chosen = (labels.groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")
    return keep(found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "sample")


def select_features(sample: DataFrame, n_classes: int, most: int, prefixes: tuple[int, ...] = (),
                    min_docs: int = 3, least_g2: float = 10.8) -> list[str]:
    """At most ``most`` features that tell the classes apart: found in ``min_docs``
    documents and with the largest likelihood-ratio statistic of presence against class."""

    def run(batches):
        release_worker()
        for pdf in batches:
            for y, text in zip(pdf.y, pdf.text):
                yield pd.DataFrame({"f": list(features(text, prefixes)), "y": int(y)})

    counts = sample.select("y", "text").mapInPandas(run, "f string, y int").groupBy("f").agg(
        *[F.sum((F.col("y") == c).cast("double")).alias(f"n{c}") for c in range(n_classes)])
    totals = [float(sample.where(F.col("y") == c).count()) for c in range(n_classes)]
    docs, here = sum(totals), sum(F.col(f"n{c}") for c in range(n_classes))
    g2 = F.lit(0.0)
    for c, total in enumerate(totals):
        for seen, row in ((F.col(f"n{c}"), here), (total - F.col(f"n{c}"), docs - here)):
            g2 = g2 + F.when(seen > 0, 2 * seen * F.log(seen * docs / (row * max(total, 1.0)))).otherwise(0.0)
    top = counts.withColumn("g2", g2).where((here >= min_docs) & (F.col("g2") >= least_g2))
    return [r.f for r in top.orderBy(F.desc("g2"), "f").limit(most).select("f").collect()]


class Rows:
    """Sparse 0/1 rows as one index array and the row of each index."""

    def __init__(self, lists: list, n_features: int, mean: bool):
        self.n, self.f = len(lists), n_features
        sizes = np.array([len(x) for x in lists], np.int64)
        self.at = np.repeat(np.arange(self.n), sizes)
        self.idx = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        self.w = (1.0 / np.maximum(sizes, 1))[self.at] if mean else np.ones(len(self.at))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.at, self.w * weights[self.idx, c], self.n)
                         for c in range(weights.shape[1])], axis=1)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.idx, self.w * g[self.at, c], self.f)
                         for c in range(g.shape[1])], axis=1)


def fit(x: Rows, y: np.ndarray, n_classes: int, l2: float, rounds: int, rate: float,
        pairs: tuple[Rows, Rows] | None = None, penalty: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch Adam; two classes use one column of weights
    (the other is zero).  ``pairs``: rows whose scores should agree; the mean square
    of their differences is added ``penalty`` times."""
    cols = 1 if n_classes == 2 else n_classes
    w, b = np.zeros((x.f, cols)), np.zeros(cols)
    onehot = np.eye(n_classes)[y][:, 1:] if cols == 1 else np.eye(n_classes)[y]
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        z = x.dot(w) + b
        if cols == 1:
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        else:
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) / max(x.n, 1)
        gw, gb = x.back(g) + l2 * w, g.sum(axis=0)
        if pairs and pairs[0].n:
            gap = (pairs[0].dot(w) - pairs[1].dot(w)) * (2 * penalty / pairs[0].n)
            gw += pairs[0].back(gap) - pairs[1].back(gap)
        for i, (par, grad) in enumerate(((w, gw), (b, gb))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            par -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-9)
    return w, b
