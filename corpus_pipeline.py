"""A corpus preparation pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of ``documents`` and drop others.  Rows are known by id and text
hash; null ids match each other.  Empty tables give empty tables at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.bpe import encode_decode
from postlens.llm.common import keep, read, text_hash
from postlens.llm.mixing import TARGET, labelled_domains, mix
from postlens.llm.similarity import similar_components
from postlens.llm.substrings import dedup_substrings
from postlens.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: words of a shingle, and the least similarity as a fraction.
NEAR_SHINGLE, NEAR_NUM, NEAR_DEN = 5, 80, 100


def matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined with rows of (found_id, found_h, ...) by id and text hash; null ids
    match each other."""
    keyed = docs.select(*COLUMNS).withColumn("h", text_hash())
    return keyed.join(found, (keyed["h"] == found["found_h"]) & keyed["doc_id"].eqNullSafe(found["found_id"]), how)


def keys(found: DataFrame) -> list:
    """The key columns of an operator's result under the names that ``matched`` joins by."""
    return [found["doc_id"].alias("found_id"), found["h"].alias("found_h")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts are scored as empty texts, and
    rows that repeat an id and text share their verdict."""
    scores = score_toxicity(docs, read(spark, sf_dir, "labels"), text_source=read(spark, sf_dir, "documents"))
    toxic = scores.where("predicted = 1").select(*keys(scores)).distinct()
    return matched(docs, toxic, "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of linked rows that
    repeat this id the one with the smallest text hash; groups in which no row has an id stay
    but for rows with the same text.  Null and empty texts link with nothing."""
    group = similar_components(docs, NEAR_NUM, NEAR_DEN, shingle=NEAR_SHINGLE)
    names = F.col("doc_id") == F.col("component_id")
    gone = group.where(~F.coalesce(names, F.col("component_id").isNull())).select(*keys(group))
    named = group.where(names & F.col("root").isNotNull()).select("doc_id", "h", "root").distinct()
    first = named.groupBy("root").agg(F.min("h").alias("first_h"))
    again = named.join(first, "root").where("h <> first_h").select(*keys(named))
    return matched(docs, gone.union(again).distinct(), "left_anti") \
        .select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; a document stays with what is left.  Null and empty
    texts stay as they are; rows without an id rank last."""
    found = dedup_substrings(docs).where("n_removed_words > 0")
    rest = found.select(*keys(found), F.col("text").alias("rest")).dropDuplicates(["found_id", "found_h"])
    return matched(docs, rest, "left").select(
        "doc_id", F.coalesce("rest", "text").alias("text"), "lang", "source",
        F.when(F.col("rest").isNull(), F.col("n_chars")).otherwise(F.char_length("rest")).cast("long").alias("n_chars"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages below their target share are repeated; every document
    stays at least once, those without words too."""
    rates = mix(docs, labelled_domains(spark, sf_dir), TARGET, min_rate=1.0, train_docs=read(spark, sf_dir, "documents"))
    copies = rates.groupBy(*keys(rates)).agg(F.max("copies").alias("copies"))
    return matched(docs, copies, "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what goes into training; null and empty texts have no tokens."""
    return encode_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: The stages train, link and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, one after the other; what a stage returns
    is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
