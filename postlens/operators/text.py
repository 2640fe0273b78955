"""Text operators over whole tables: per-post token features, word
frequencies, dictionary normalisation as a join, and long-form TF-IDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import BAD_TOKENS, VERB_LEMMAS
from ..functions.porter import with_stems
from ..session import cut_lineage
from .blocks import looked_up

#: Parts that the rows of one word are dealt into for a join; the word's side is repeated as often.
WORD_SALTS = 16
#: Rows of the words' side, copies included, that a task of a hashed word join holds on average.
HASHED_ROWS = 100_000


def join_by_word(tokens: DataFrame, words: DataFrame, word: str, salt_by: str, how: str = "inner",
                 salts: int = WORD_SALTS, merge: bool = False, hashed: int | None = None) -> DataFrame:
    """tokens JOIN words on ``word``, with the tokens of one word dealt into ``salts``
    parts by a hash of ``salt_by`` and each row of ``words`` (one per word) repeated
    for every part, so a frequent word is never one task's work.  ``merge`` keeps the
    planner from broadcasting the copies, whose size it judges by the table they come from.
    ``hashed``, the number of ``words``, has neither side sorted: both are dealt over so many partitions
    that a table of a partition's copies is small."""
    dealt = tokens.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if hashed is not None:
        n = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), hashed * salts // HASHED_ROWS + 1)
        dealt, copies = (side.repartition(n, word, "_salt") for side in (dealt, copies))
        copies = copies.hint("shuffle_hash")
    return dealt.join(copies.hint("merge") if merge else copies, [word, "_salt"], how).drop("_salt")


def text_features(posts: DataFrame, id_col: str = "post_id", text_col: str = "post_text",
                  unicode: bool = False) -> DataFrame:
    """Per post: mention/hashtag flags, cleaned text, tokens, tokens without
    stop words, light stems, sorted distinct lemmas and their count.

    One row-local projection: no shuffle, everything codegen'd.
    """
    stage1 = {"text_only_str": T.clean_text(text_col),
              "has_mention": T.has_mention(text_col),
              "has_hashtag": T.has_hashtag(text_col)}
    return (posts.select(id_col, text_col)
            .withColumns(stage1)
            .withColumn("text_words", T.tokenize("text_only_str", unicode))
            .withColumn("text_words_f", T.remove_stopwords("text_words"))
            .withColumns({"vector_stemmed": T.stem_tokens("text_words_f"),
                          "vector_lemma": T.lemmatise("text_words_f")})
            .withColumn("nbr_words", F.size("vector_lemma")))


def word_frequency(df: DataFrame, words_col: str, word_name: str = "word",
                   count_name: str = "count", distinct_per_row: bool = False,
                   top_k: int | None = None) -> DataFrame:
    """Count words over all rows, most frequent first (ties by word).

    ``distinct_per_row`` counts each word once per row (document frequency).
    The aggregate combines map-side, so a word holding a large share of all
    tokens costs one partial row per task, not a hot reducer.
    """
    words = F.array_distinct(words_col) if distinct_per_row else F.col(words_col)
    gen, keep = T.explode_values(words, word_name)
    out = (df.select(gen).where(keep)
           .where(F.length(word_name) > 0)
           .select(F.trim(F.lower(F.col(word_name))).alias(word_name))
           .groupBy(word_name).agg(F.count(word_name).alias(count_name))
           .orderBy(F.desc(count_name), F.asc(word_name)))
    return out.limit(top_k) if top_k else out


def normalise_vocabulary(df: DataFrame, id_col: str, tokens_col: str, dictionary: DataFrame,
                         surface_col: str = "surface", base_col: str = "base",
                         out_col: str = "normalised", distinct: bool = False,
                         broadcast_dictionary: bool = False) -> DataFrame:
    """Replace tokens by their dictionary base form, for dictionaries given as
    a table of any size.

    Rows are dealt by id once, whole; then posexplode -> left join (surface, base) on
    the token -> regroup per id in the original token order, which behind a broadcast
    needs no shuffle of tokens.  The join is salted by the id, so a frequent token
    is dealt over many tasks.  Of several entries for one surface form the smallest
    base (in binary order) holds.  ``broadcast_dictionary`` forces a broadcast:
    set it only for a dictionary of known bounded size whose statistics the
    planner lacks (e.g. built from a local list).  Groups are one document's
    tokens.  Tokens
    without an entry stay as they are.  Returns (id, out_col); ids with no
    tokens get an empty array.
    """
    toks = df.select(id_col, tokens_col).repartition(id_col).select(id_col, F.posexplode_outer(tokens_col).alias("pos", "tok"))
    dic = dictionary.select(F.col(surface_col).alias("tok"), F.col(base_col).alias("base")) \
                    .groupBy("tok").agg(F.min("base").alias("base"))
    j = toks.join(F.broadcast(dic), "tok", "left") if broadcast_dictionary else \
        join_by_word(toks, dic, "tok", id_col, "left")
    j = j.withColumn("w", F.coalesce("base", "tok"))
    entry = F.when(F.col("tok").isNotNull(), F.struct("pos", "w"))
    g = j.groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    words = F.transform("_e", lambda e: e["w"])
    if distinct:
        words = F.sort_array(F.array_distinct(words))
    return g.select(id_col, words.alias(out_col))


def tfidf_table(df: DataFrame, id_col: str, words_col: str, min_doc_freq: int = 0,
                distinct_words: bool = False) -> DataFrame:
    """Long-form TF-IDF with exact words: (id, word, tf, df, cf, idf, tfidf).

    idf = ln((N + 1) / (df + 1)), and 0 when df < min_doc_freq (the same
    formula as Spark ML's IDF over hashed term frequencies, without hash
    collisions).  N is a single count brought back to the driver.  Ids are unique,
    so tf is counted inside the row (it is 1 for ``distinct_words`` arrays) and the
    only shuffles are the map-side combined word counts and the salted join, which sorts nothing.  Ids and
    words are written once, narrow, and read by all three passes; so are the word counts.
    """
    df = cut_lineage(df.select(id_col, words_col))
    n_docs = df.count()
    words = F.col(words_col)
    pairs = F.transform(words if distinct_words else F.array_distinct(words), lambda w: F.struct(
        w.alias("word"), (F.lit(1) if distinct_words else F.size(F.filter(words, lambda x: x == w)))
        .cast("bigint").alias("tf")))
    gen, keep = T.explode_values(pairs, "_p")
    tf = df.select(id_col, gen).where(keep).select(id_col, "_p.word", "_p.tf")
    dfreq = cut_lineage(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    idf = F.when(F.col("df") < min_doc_freq, F.lit(0.0)).otherwise(
        F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1)))
    return (join_by_word(tf, dfreq, "word", id_col, hashed=dfreq.count())
            .withColumn("idf", idf)
            .withColumn("tfidf", F.col("tf") * F.col("idf"))
            .select(id_col, "word", "tf", "df", "cf", "idf", "tfidf"))


def vocabulary_bases(df: DataFrame, words_col: str, dictionary: Mapping[str, str] = VERB_LEMMAS) -> DataFrame:
    """(word, n_rows, base) of every distinct word: what the dictionary says, else the
    rule for regular verb endings, worked out once per word."""
    gen, keep = T.explode_values(F.array_distinct(words_col), "word")
    vocabulary = df.select(gen).where(keep).groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    return vocabulary.withColumn("base", T.verb_base("word", dictionary))


def vocabulary_stems(df: DataFrame, words_col: str) -> DataFrame:
    """(word, n_rows, stem) of every distinct word: Porter's stem, worked out once per word."""
    gen, keep = T.explode_values(F.array_distinct(words_col), "word")
    return with_stems(df.select(gen).where(keep).groupBy("word").agg(F.count(F.lit(1)).alias("n_rows")))


def text_features_normalised(posts: DataFrame, id_col: str = "post_id", text_col: str = "post_text",
                             dictionary: Mapping[str, str] = VERB_LEMMAS, min_stem: int = 3, unicode: bool = False) -> DataFrame:
    """``text_features`` with words normalised over the vocabulary: per post the flags, vector_stemmed
    (Porter stems of at least ``min_stem`` letters, in order), vector_lemma (sorted distinct base forms
    by the dictionary, else by the rule for regular verb endings) and nbr_words.

    Two phases: each distinct word is normalised once, then its forms go to the blocks of posts that hold
    it (``blocks.looked_up``), so no token moves by itself.  The tokens are written once, narrow, and read by
    both phases.  Posts without words get empty arrays.  Ids are meant to be unique: posts of one id
    share the words of all of them, in the order of their places, and posts without an id are left out.
    """
    tf = cut_lineage(text_features(posts, id_col, text_col, unicode).select(id_col, "has_mention", "has_hashtag", "text_words_f")
                     .where(F.col(id_col).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), compression="zstd")

    def forms(words: DataFrame) -> DataFrame:
        # null for the word itself, which most forms are, so that less moves
        return with_stems(words).withColumns({"stem": F.nullif(F.col("stem"), F.col("word")),
                                              "base": F.nullif(T.verb_base("word", dictionary), F.col("word"))})

    sets = looked_up(tf, "text_words_f", forms, ["word", "stem", "base"], "_e").withColumn("_e", F.transform("_e", lambda e: F.struct(
        F.coalesce(e["stem"], e["word"]).alias("stem"), F.coalesce(e["base"], e["word"]).alias("base"), e["word"].isin(*BAD_TOKENS).alias("bad"))))
    repeated = cut_lineage(tf.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col))
    if not repeated.isEmpty():
        several = sets.join(repeated, id_col, "left_semi")
        placed = F.transform("_e", lambda e, i: F.struct(i.alias("pos"), e["stem"].alias("stem"), e["base"].alias("base"), e["bad"].alias("bad")))
        shared = several.groupBy(id_col).agg(F.sort_array(F.flatten(F.collect_list(placed))).alias("_e"))
        sets = sets.join(repeated, id_col, "left_anti").select(id_col, "has_mention", "has_hashtag", "_e").unionByName(
            several.drop("_e").join(shared.withColumn("_e", F.transform("_e", lambda e: e.dropFields("pos"))), id_col))
    stems = F.filter(F.transform("_e", lambda e: e["stem"]), lambda s: F.length(s) >= min_stem)
    lemmas = F.sort_array(F.array_distinct(F.transform(F.filter("_e", lambda e: ~e["bad"]), lambda e: e["base"])))
    return sets.select(id_col, "has_mention", "has_hashtag", stems.alias("vector_stemmed"), lemmas.alias("vector_lemma")) \
        .withColumn("nbr_words", F.size("vector_lemma"))


def word_ids(df: DataFrame, words_col: str, partitions: int = 64) -> DataFrame:
    """Dictionary encoding without a vocabulary on the driver: (word, n, word_id) of every distinct
    word, n its occurrences, word_id 0, 1, ... by falling n, equal ones by word.

    The counted words are dealt by range of (n, word), written, and numbered inside their range;
    a range starts where the ranges before it end, which ``partitions`` row counts tell.  No
    window spans all words.
    """
    gen, keep = T.explode_values(words_col, "word")
    return numbered(df.select(gen).where(keep).groupBy("word").agg(F.count(F.lit(1)).alias("n")), partitions)


def numbered(counts: DataFrame, partitions: int = 64) -> DataFrame:
    """(word, n, word_id) of counted words (word, n), as ``word_ids`` numbers them."""
    ranged = cut_lineage(counts.repartitionByRange(partitions, F.desc("n"), F.asc("word"))
                         .withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # at most ``partitions`` rows
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_start")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("n"), F.asc("word")))
    return ranged.withColumn("_at", inside).join(F.broadcast(starts), "_range") \
        .select("word", "n", (F.col("_start") + F.col("_at") - 1).alias("word_id"))


def bag_of_words(df: DataFrame, id_col: str, words_col: str, ids: DataFrame) -> DataFrame:
    """Sparse vectors in long form: (id, word_id, n), n the occurrences of a word in the row; words that
    ``ids`` (word, word_id) does not know are left out.  Words are counted by row, in time linear in
    the row, and the copies of the vocabulary are dealt over the tasks, not broadcast."""
    gen, keep = T.explode_values(words_col, "word")
    rows = df.withColumn("_row", F.monotonically_increasing_id()).select("_row", id_col, gen).where(keep) \
        .groupBy("_row", id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    return join_by_word(rows, ids.select("word", "word_id"), "word", "_row", merge=True).select(id_col, "word_id", "n")


def top_words(df: DataFrame, words_col: str, k: int, word_name: str = "word", count_name: str = "count",
              candidates: int | None = None, tracked: int = 100_000) -> DataFrame:
    """The k words that most rows hold, as ``word_frequency(distinct_per_row=True, top_k=k)`` gives them,
    without a shuffle and sort of the vocabulary.

    A mergeable frequent-items sketch of ``tracked`` words names the candidates, and a second pass
    counts these exactly.  A word that is no candidate has at most the least candidate's estimate and the
    sketch's error, 3.5 / tracked of all words; where the k-th count is above that, no word was
    missed.  Else all words are counted.
    """
    gen, keep = T.explode_values(F.array_distinct(words_col), word_name)
    words = df.select(gen).where(keep).where(F.length(word_name) > 0).select(F.trim(F.lower(F.col(word_name))).alias(word_name))
    candidates = candidates or 20 * k
    items, total = words.agg(F.expr(f"approx_top_k(`{word_name}`, {candidates}, {tracked})"), F.count(F.lit(1))).first()
    bound = (min(i[1] for i in items) if len(items) == candidates else 0) + 3.5 / tracked * total
    order = [F.desc(count_name), F.asc(word_name)]
    exact = words.where(F.col(word_name).isin([i[0] for i in items])).groupBy(word_name) \
        .agg(F.count(F.lit(1)).alias(count_name)).orderBy(*order).limit(k).collect()
    whole = len(items) < candidates and total <= tracked / 3.5
    if not whole and (len(exact) < k or exact[-1][1] <= bound):
        return word_frequency(df, words_col, word_name, count_name, distinct_per_row=True, top_k=k)
    return df.sparkSession.createDataFrame(exact, f"{word_name} string, {count_name} long").orderBy(*order)
