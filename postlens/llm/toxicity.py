"""Toxicity: a counterfactual-regularised classifier.

A logistic model on word presence and word prefixes is fitted on a bounded sample
of labelled documents.  Where a labelled text names a group of people, copies with
the name swapped for other groups' names are made, and the square of the score
change is penalised: a name alone then cannot carry the score, and neutral
mentions are not flagged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import fold, id_and_text, read, release_worker, text_hash
from postlens.llm.linear import Rows, bounded_sample, features, fit, select_features

#: Names of groups, by kind; a name is swapped for others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
PREFIXES = (4, 5)
#: Bound of the labelled sample and of the model's features.
TRAIN_ROWS, MODEL_FEATURES = 12000, 4096


def swaps(words: set[str], terms=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(name, other name) for every name in the words, two others of its kind each."""
    out = []
    for kind in terms:
        for i, term in enumerate(kind):
            if term in words:
                out += [(term, kind[(i + step) % len(kind)]) for step in (1, 2) if len(kind) > step]
    return out


def with_prefixes(words: set[str]) -> set[str]:
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, n_features: int = MODEL_FEATURES,
          penalty: float = 10.0, identity_terms=IDENTITY_TERMS) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias) from (doc_id, text) and (doc_id, y).

    Fetches at most ``train_rows`` index lists over at most ``n_features`` features.
    Without labelled documents, or with one class only, the model is a constant.
    """
    sample = bounded_sample(docs, labels, train_rows)
    names = sorted({t for kind in identity_terms for t in kind})
    vocab = select_features(sample, 2, n_features, PREFIXES)
    vocab += sorted(with_prefixes(set(names)) - set(vocab))
    at = {f: i for i, f in enumerate(vocab)}

    def index(batches):
        known = at.keys()
        for pdf in batches:
            for y, text in zip(pdf.y, pdf.text):
                words = features(text)
                variants = [with_prefixes(words), *(with_prefixes(words - {a} | {b})
                                                    for a, b in swaps(words, identity_terms))]
                yield pd.DataFrame({"y": int(y), "variant": range(len(variants)),
                                    "idx": [sorted(at[f] for f in known & v) for v in variants]})

    got = sample.select("doc_id", "y", "text").mapInPandas(index, "y int, variant int, idx array<int>").toPandas()
    own = (got.variant == 0).to_numpy() if len(got) else np.zeros(0, bool)
    y = got.y.to_numpy()[own].astype(int) if len(got) else np.zeros(0, int)
    if len(set(y)) < 2:
        share = (y.sum() + 0.1) / (len(y) + 1)
        return {}, math.log(share / (1 - share))
    lists = list(got.idx)
    base = np.maximum.accumulate(np.where(own, np.arange(len(lists)), 0))
    first, second = [lists[base[i]] for i in np.flatnonzero(~own)], [lists[i] for i in np.flatnonzero(~own)]
    rows = Rows([lists[i] for i in np.flatnonzero(own)], len(vocab), mean=False)
    pairs = (Rows(first, len(vocab), mean=False), Rows(second, len(vocab), mean=False))
    w, b = fit(rows, y, 2, l2=2e-4, rounds=400, rate=0.05, pairs=pairs, penalty=penalty)
    return {f: float(w[i, 0]) for f, i in at.items() if w[i, 0]}, float(b[0])


def score_text(text: str, weights: dict[str, float], bias: float) -> float:
    z = bias + math.fsum(weights[f] for f in weights.keys() & features(text, PREFIXES))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, label_col: str = "toxic",
                   id_col: str = "doc_id", text_col: str = "text", identity_terms=IDENTITY_TERMS,
                   text_source: DataFrame | None = None) -> DataFrame:
    """doc_id, h (text hash), held_out (crc32 of the id mod 5 is 0; such rows never train), score
    (0 to 1) and predicted (score >= 0.5) of every whole text.

    ``text_source``: where the labelled texts are looked up, the documents
    themselves by default.  Null labels and ids train nothing; an id with several
    labels counts as toxic if any says so.  Null and empty texts score as the bias;
    repeated rows give one row each; an empty table gives an empty result.
    """
    texts = id_and_text(docs, id_col, text_col)
    source = texts if text_source is None else id_and_text(text_source, id_col, text_col)
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where("doc_id is not null and y in (0, 1)").where(fold(F.col("doc_id"), 5) != 0))
    model = docs.sparkSession.sparkContext.broadcast(train(source, known, train_rows, identity_terms=identity_terms))

    def run(batches):
        release_worker()
        weights, bias = model.value
        for batch in batches:
            scores = [score_text(t or "", weights, bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "h", "held_out", "score", "predicted"])

    return (texts.select("doc_id", text_hash().alias("h"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, h long, held_out boolean, score double, predicted int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("h")
