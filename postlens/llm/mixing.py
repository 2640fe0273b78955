"""Mixing sources to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives every
document a posterior over the domains.  Document rates r >= min_rate are then fitted so that the
expected domain totals, the sums of r * tokens * posterior, match the targets, at the
least token-weighted square distance of the rates from 1.

Such rates are max(min_rate, 1 + posterior * weights) with one weight a domain.  The
weights are found by Newton steps on the dual, whose ridge is lowered until the
targets are met.  Nothing as long as the corpus is kept between steps: a step is one
aggregate over the thin table of (tokens, posterior), and rare domains take no more
steps than others.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import id_and_text, keep, read, release_worker, text_hash
from postlens.llm.linear import Rows, bounded_sample, features, fit, select_features

#: Bound of the labelled sample and of the model's features.
TRAIN_ROWS, MODEL_FEATURES = 6000, 2048
#: Share of the tokens that each domain shall have.
TARGET = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: Steps end when every domain is within TOLERANCE of all target tokens, or with a warning after MOST_STEPS.
MOST_STEPS, TOLERANCE = 80, 1e-4


def train_domains(texts: DataFrame, labelled: DataFrame, domains: list[str], train_rows: int = TRAIN_ROWS):
    """(index of each feature, weights, bias) of the domain classifier; ``labelled``:
    (doc_id, domain).  A document's features weigh 1 / their number, so long and short
    texts are alike."""
    number = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, i)]), F.col("domain"))
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("y"))
    sample = bounded_sample(texts, known, train_rows)
    vocab = select_features(sample, len(domains), MODEL_FEATURES, min_docs=5)
    at = {f: i for i, f in enumerate(vocab)}

    def index(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "idx": [sorted(at[f] for f in at.keys() & features(t)) for t in pdf.text]})

    got = sample.select("y", "text").mapInPandas(index, "y int, idx array<int>").toPandas()
    y = got.y.to_numpy().astype(int)
    if len(domains) == 2 or len(set(y)) < 2:
        # two columns also for two domains, so that posteriors look alike
        domains = domains + [""] if len(domains) == 2 else domains
    if len(set(y)) < 2:
        return at, np.zeros((max(len(at), 1), len(domains))), np.log(np.bincount(y, minlength=len(domains)) + 0.1)
    w, b = fit(Rows(list(got.idx), len(vocab), mean=True), y, len(domains), l2=1e-6, rounds=300, rate=0.2)
    return at, w, b


def posteriors(texts: DataFrame, model, n_domains: int) -> DataFrame:
    """(doc_id, h, n_tokens, p array<double>) of every row; tokens are words between
    white space.  A text without known features gets the classifier's bias."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release_worker()
        at, w, b = shared.value
        known = at.keys()
        for batch in batches:
            texts_, p = [t or "" for t in batch.column("text").to_pylist()], []
            for t in texts_:
                idx = sorted(at[f] for f in known & features(t))
                z = b + (w[idx].mean(axis=0) if idx else 0.0)
                e = np.exp(z - z.max())[:n_domains]
                p.append(e / e.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array([len(t.encode().split()) for t in texts_], pa.int64()),
                 pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "h", "n_tokens", "p"])

    return texts.withColumn("h", text_hash()) \
        .mapInArrow(run, "doc_id long, h long, n_tokens long, p array<double>")


def rates_of(p: np.ndarray, steps: list[np.ndarray], min_rate: float) -> np.ndarray:
    """Rates of documents with posteriors p after the steps: each moves a rate by its domains'
    gaps and projects it to ``min_rate`` or more."""
    r = np.full(len(p), max(1.0, min_rate))
    for gaps in steps:
        r = np.maximum(min_rate, r - p @ gaps)
    return r


def summed(thin: DataFrame, k: int, width: int, part) -> np.ndarray:
    """The sum of part(tokens, posteriors), a vector of ``width`` numbers, over all
    batches.  A task sends one vector."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            if len(n):
                total += part(n, np.array(batch.column("p").values.to_numpy()).reshape(-1, k))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "v"])

    got = thin.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in got:
        out[r.i] = r.v
    return out


def fit_rates(thin: DataFrame, target: np.ndarray, total: float | None, min_rate: float):
    """(steps, expected totals): the projected-gradient steps, as ``rates_of`` takes them, to rates
    whose domain totals are target * total in the sense of least squares.  ``total`` None: the fewest
    tokens for which no domain has to shrink below what it has.

    The squared gap of a domain is divided by its expected tokens at rate 1, the row sum of the
    Gram matrix of the documents' expected domain tokens, and a document's step by its tokens; so a
    step is never too long, and a rare domain gets its tokens as fast as a large one.  A step is one
    aggregate over the rows, which replay the steps so far.  Where the targets are not met, the totals
    come as near as the steps did, and a warning says so.
    """
    k = len(target)
    now = start = summed(thin, k, k, lambda n, p: n @ p)
    if total is None:
        total = float((start / np.maximum(target, 1e-12)).max())
    want = target * total
    steps: list[np.ndarray] = []
    if not start.sum():
        return steps, start
    if min_rate > 1.0:
        now = min_rate * start
    size = np.where(start > 0, start, np.inf)
    while np.abs(now - want).max() > TOLERANCE * want.sum() and len(steps) < MOST_STEPS:
        steps.append((now - want) / size)
        now = summed(thin, k, k, lambda n, p: (n * rates_of(p, steps, min_rate)) @ p)
    if np.abs(now - want).max() > TOLERANCE * want.sum():
        warnings.warn(f"targets not met: shares {(now / now.sum()).round(5).tolist()} of {now.sum():.0f} tokens, "
                      f"wanted {target.tolist()} of {want.sum():.0f}", stacklevel=2)
    return steps, now


def mix(docs: DataFrame, labelled: DataFrame, target: dict[str, float], total: float | None = None,
        min_rate: float = 0.0, train_rows: int = TRAIN_ROWS, train_docs: DataFrame | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (text hash), n_tokens, p (posteriors in the order of ``target``),
    rate and copies of every row: how often the document goes into the mix, rate
    rounded up or down by a hash of the row, so that copies are right on average and
    the same in every run.

    ``labelled``: (doc_id, domain); ``train_docs``: where their texts are, ``docs`` by
    default.  Null ids, labels and domains that are no target train nothing.  Empty
    and null texts have no tokens and a rate like others; repeated rows get one result
    each; without labelled documents posteriors are alike; an empty table gives an
    empty result.
    """
    domains = list(target)
    weights = np.array([target[d] for d in domains], float)
    texts = id_and_text(docs, id_col, text_col)
    source = texts if train_docs is None else id_and_text(train_docs, id_col, text_col)
    model = train_domains(source, labelled, domains, train_rows)
    thin = keep(posteriors(texts, model, len(domains)), "posteriors")
    steps, _ = fit_rates(thin, weights / weights.sum(), total, min_rate)
    k = len(domains)

    def run(batches):
        for batch in batches:
            p = np.array(batch.column("p").values.to_numpy()).reshape(-1, k) if batch.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "h", "n_tokens", "p")), pa.array(rates_of(p, steps, min_rate))],
                names=["doc_id", "h", "n_tokens", "p", "rate"])

    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return thin.mapInArrow(run, "doc_id long, h long, n_tokens long, p array<double>, rate double") \
        .withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents: their language."""
    labels = read(spark, sf_dir, "labels").select("doc_id").distinct()
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGET).drop("h")
