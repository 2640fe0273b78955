"""Substring dedup by hashing lines, paragraphs and content-defined spans.

Units.  Whole lines and whole paragraphs are units.  So are spans between cuts: a cut
stands before the word whose hash, taken over GRAM words, is the least of WINDOW
neighbouring ones (the last of equal ones), so each window of words holds a cut and
cuts inside a passage are the same wherever it stands but for its first and last
window.  From each cut a span runs to the first cut at least half of ``min_words``
further on; a shared passage of ``least_passage(min_words)`` words holds one, whatever
its words and line breaks.

Units are normalised (lower case, single spaces) and hashed; digests are grouped over
all documents and each points at the row that ranks first of those that hold it (by doc_id, those
without one last, then by the text's hash).  A unit in a row that ranks later, or that stood
earlier in the same text, is a repeat.
Runs of neighbouring repeats are extended word by word as far as the words around the
earlier unit are the same; those of at least ``min_words`` words are removed.  The
rest stays byte for byte, and the removed spans keep their offsets in the original text.

Every text is cut into units once.  What follows works on the units' digests and places; texts are
read again only where a run of repeats needs its ends, and the others pass as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import forget, id_and_text, keep, may_hold, per_worker, read, release_worker, text_hash

#: Words of a window, which holds a cut, and of a hash; words of the shortest run that is removed.
MOST_WORDS, GRAM, MIN_WORDS = 12, 3, 25
#: Words on either side that a run may be extended by: more than lie between a passage's end and its outermost unit.
AROUND = 2 * MOST_WORDS + GRAM + MIN_WORDS
#: A digest is hot if it makes up this share of all units or more: at most 1 / HOT_SHARE of them, broadcast.
HOT_SHARE = 1e-4
MIX = np.uint64(0x9E3779B97F4A7C15)
word_spans = regex.compile(r"[^\x20\x09-\x0D]+").finditer


def least_passage(min_words: int = MIN_WORDS) -> int:
    """Words of a shared passage that surely holds a common span."""
    return min_words // 2 + 2 * MOST_WORDS + GRAM - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MIX and of its inverse, modulo 2 ** 64; kept by the worker."""
    store = per_worker("substring_powers", lambda: {"n": 0})
    if store["n"] < n:
        n = max(n, 2 * store["n"], 4096)
        both = [np.full(n, m, np.uint64) for m in (MIX, np.uint64(pow(int(MIX), -1, 1 << 64)))]
        for x in both:
            x[0] = 1
        store.update(n=n, p=[np.cumprod(x) for x in both])
    return store["p"]


def cuts(h: np.ndarray) -> np.ndarray:
    """Places of the cuts among words with these hashes."""
    if len(h) < MOST_WORDS + GRAM - 1:
        return np.zeros(0, np.int64)
    m = len(h) - GRAM + 1
    g = h[:m].copy()
    for i in range(1, GRAM):
        g = g * MIX + h[i:m + i]
    g = (g ^ (g >> np.uint64(29))) * MIX
    # read backwards, the first of equal ones is the last
    least = np.lib.stride_tricks.sliding_window_view(g[::-1], MOST_WORDS).argmin(axis=1)
    return m - 1 - np.unique(np.arange(len(least)) + least)[::-1]


def units(text: str, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, first words, ends) of the units, by place, and the hashes of all words."""
    words, bounds, blank = [], [0], [0]
    for line in text.lower().encode().split(b"\n"):
        words += line.split()
        if len(words) > bounds[-1]:
            bounds.append(len(words))
        elif blank[-1] < len(words):
            blank.append(len(words))
    if blank[-1] < len(words):
        blank.append(len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    at = cuts(h)
    to = np.searchsorted(at, at + (min_words // 2 + 1))
    inside = to < len(at)
    pairs = np.concatenate([np.stack([x[:-1], x[1:]], 1) for x in (np.array(bounds), np.array(blank))]
                           + [np.stack([at[inside], at[to[inside]]], 1)])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    start, end = pairs[:, 0], pairs[:, 1]
    p, inverse = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:len(h)], dtype=np.uint64)])
    d = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)
    d = (d ^ (d >> np.uint64(29))) * MIX
    return (d ^ (d >> np.uint64(32))).view(np.int64), start, end, h


def unit_rows(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, digests, starts, ends, n_words, own) of each text: its units by place, and whether
    one of them stood earlier in the text."""

    def run(batches):
        release_worker("substring_powers")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [units(t.as_py(), min_words) for t in part.column("text")]
                own = [bool(len(d) and (repeated(d, a, b) >= 0).any()) for d, a, b, _ in found]
                offsets = pa.array(np.cumsum([0, *[len(f[0]) for f in found]]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(kind)))
                         for k, kind in ((0, np.int64), (1, np.int32), (2, np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), *lists, pa.array([len(f[3]) for f in found], pa.int32()),
                     pa.array(own, pa.bool_())], names=["doc_id", "h", "digests", "starts", "ends", "n_words", "own"])

    return texts.mapInArrow(run, "doc_id long, h long, digests array<long>, starts array<int>, ends array<int>, n_words int, own boolean")


def rank(doc_id: str, h: str) -> Column:
    """Order of rows: by id, those without one last, then by the text's hash."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(h).alias("h"))


def by_digest(rows: DataFrame, found: DataFrame, hot_digests: DataFrame, value: str) -> DataFrame:
    """rows (doc_id, h, digest) with the ``value`` that ``found`` (digest, value) holds for
    their digest.  Digests in many texts are few, whatever the size of the corpus; they
    are broadcast, and no key of the shuffled join holds more than the share."""
    hot = hot_digests.select(F.col("digest").alias("hot_digest"))
    hot_found = F.broadcast(found.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"))
                            .select("hot_digest", F.col(value).alias("hot_value")))
    cold_found = found.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left_anti") \
        .select(F.col("digest").alias("cold_digest"), F.col(value).alias("cold_value"))
    marked = rows.join(hot_found, F.col("digest") == F.col("hot_digest"), "left") \
        .withColumn("key", F.when(F.col("hot_value").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "h")))
    return marked.join(cold_found, (F.col("key") == F.col("cold_digest")) & F.col("hot_value").isNull(), "left") \
        .select("doc_id", "h", "digest", F.coalesce("hot_value", "cold_value").alias(value)).where(F.col(value).isNotNull())


def repeats(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, later): the digests of a text that a row of an earlier rank holds too (texts
    without any have no row); (digest, first) of digests in several rows; the digests in many."""
    rows = found.select("doc_id", "h", F.explode(F.array_distinct("digests")).alias("digest"))
    firsts = keep(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank("doc_id", "h")).alias("first"))
                  .where("n > 1"), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = firsts.where(F.col("n") >= max(total * HOT_SHARE, 1000.0)).select("digest")
    met = by_digest(rows, firsts, hot, "first").where(rank("doc_id", "h") > F.col("first"))
    return keep(met.groupBy("doc_id", "h").agg(F.collect_set("digest").alias("later")), "later"), firsts, hot


def repeated(digests, start, end) -> np.ndarray:
    """Of each unit the unit of the same text that it repeats, or -1."""
    _, first, which = np.unique(digests, return_index=True, return_inverse=True)
    own = first[which]
    return np.where(end[own] <= start, own, -1)


def runs_of(found, later, min_words: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(runs of neighbouring repeats that hold half of ``min_words``, whether each unit is a
    repeat of another text's unit, the unit of the same text that each unit repeats, or -1)."""
    digests, start, end, h = found
    own = repeated(digests, start, end)
    other = np.isin(digests, np.array(list(later), np.int64)) if len(later) else np.zeros(len(digests), bool)
    mark = other | (own >= 0)
    if not mark.any():
        return [], other, own
    depth = np.bincount(start[mark], minlength=len(h) + 1) - np.bincount(end[mark], minlength=len(h) + 1)
    covered = np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8)])
    edge = np.diff(covered)
    runs = [(a, b) for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())
            if b - a > min_words // 2]
    return runs, other, own


def same(x: np.ndarray, y: np.ndarray) -> int:
    """How many words two sequences begin with alike."""
    n = min(len(x), len(y))
    unlike = np.flatnonzero(x[:n] != y[:n])
    return int(unlike[0]) if len(unlike) else n


def extend(found, runs, other, own, around) -> list[tuple[int, int]]:
    """The runs with the words before and after them that also stand around the unit
    that their first or last unit repeats; ``around``: digest to (words before it, from
    its start backwards, words after it).  Runs that meet are one."""
    digests, start, end, h = found
    out = []
    for i, (a, b) in enumerate(runs):
        low = out[-1][1] if out else 0
        high = runs[i + 1][0] if i + 1 < len(runs) else len(h)
        left = right = 0
        for u in range(*np.searchsorted(start, [a, a + 1])):
            if other[u] and int(digests[u]) in around:
                left = max(left, same(h[low:a][::-1], around[int(digests[u])][0]))
            if own[u] >= 0:
                left = max(left, same(h[max(low, end[own[u]]):a][::-1], h[:start[own[u]]][::-1]))
        for u in np.flatnonzero(end == b):
            if other[u] and int(digests[u]) in around:
                right = max(right, same(h[b:high], around[int(digests[u])][1]))
            if own[u] >= 0:
                right = max(right, same(h[b:high], h[end[own[u]]:a - left]))
        a, b = a - left, b + right
        if out and out[-1][1] == a:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def words_around(texts: DataFrame, found: DataFrame, later: DataFrame, firsts: DataFrame, hot: DataFrame,
                 min_words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, later) of the texts in which runs of repeats are long enough to look at their ends,
    and (doc_id, h, around): for the first and last units of their runs, the words around the unit in
    the row that holds it first."""

    def outermost(batches):
        for batch in batches:
            ids, hs, edges, laters = [], [], [], []
            for doc_id, h, d, a, b, n, own_later in zip(*(batch.column(c) for c in (
                    "doc_id", "h", "digests", "starts", "ends", "n_words", "later"))):
                d, a, b = (x.values.to_numpy() for x in (d, a, b))
                own_later = own_later.values.to_numpy() if own_later.is_valid else np.zeros(0, np.int64)
                runs, other, _ = runs_of((d, a, b, range(n.as_py())), own_later, min_words)
                if runs:
                    first, last = zip(*runs)
                    ids.append(doc_id.as_py())
                    hs.append(h.as_py())
                    edges.append(np.unique(d[other & (np.isin(a, first) | np.isin(b, last))]))
                    laters.append(own_later)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(edges, pa.list_(pa.int64())),
                 pa.array(laters, pa.list_(pa.int64()))], names=["doc_id", "h", "edges", "later"])

    l = later.select(F.col("doc_id").alias("later_id"), F.col("h").alias("later_h"), "later")
    runs = keep(found.join(l, (F.col("h") == F.col("later_h")) & F.col("doc_id").eqNullSafe(F.col("later_id")), "left")
                .where("own or later is not null").select("doc_id", "h", "digests", "starts", "ends", "n_words", "later")
                .mapInArrow(outermost, "doc_id long, h long, edges array<long>, later array<long>"), "runs")
    wanted = runs.select("doc_id", "h", F.explode("edges").alias("digest")).distinct()

    def surroundings(batches):
        for batch in batches:
            out, before, after = [], [], []
            for text, digest, start, end in zip(*(batch.column(c) for c in ("text", "digest", "start", "end"))):
                words = text.as_py().lower().encode().split()
                for d, a, b in zip(digest.as_py(), start.as_py(), end.as_py()):
                    out.append(d)
                    for part, into in ((words[max(0, a - AROUND):a][::-1], before), (words[b:b + AROUND], after)):
                        into.append(np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)).view(np.int64))
            words = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(before, words), pa.array(after, words)],
                                             names=["digest", "before", "after"])

    # where the wanted units stand first: in the rows that rank first, by their units' places
    source = firsts.join(wanted.select("digest").distinct(), "digest") \
        .groupBy(F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h")).agg(F.collect_set("digest").alias("want"))
    places = found.join(source, (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first_id"))) \
        .select("first_id", "first_h", "want", F.explode(F.arrays_zip("digests", "starts", "ends")).alias("u")) \
        .where(F.array_contains("want", F.col("u.digests"))) \
        .groupBy("first_id", "first_h", F.col("u.digests").alias("digest")).agg(F.min(F.struct("u.starts", "u.ends")).alias("at")) \
        .groupBy("first_id", "first_h").agg(F.collect_list("digest").alias("digest"), F.collect_list("at.starts").alias("start"),
                                            F.collect_list("at.ends").alias("end"))
    places = keep(places, "places")
    held = (may_hold(texts, "h", places.select("first_h"))
            .join(places, (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
            .select("text", "digest", "start", "end").mapInArrow(surroundings, "digest long, before array<long>, after array<long>")
            .dropDuplicates(["digest"]))
    held = keep(held.select("digest", F.struct("digest", "before", "after").alias("around")), "around")
    forget(places)
    return runs.select("doc_id", "h", "later"), \
        by_digest(wanted, held, hot, "around").groupBy("doc_id", "h").agg(F.collect_list("around").alias("around"))


def cut(text: str, later, around, min_words: int) -> tuple[str, list[tuple[int, int]], int, int]:
    """(kept text, removed spans, words removed, words).  A unit is a repeat if another text
    holds it earlier, or if the text itself does; white space around a removed run stays."""
    found = units(text, min_words)
    n_words = len(found[3])
    runs, other, own = runs_of(found, later, min_words)
    runs = [(a, b) for a, b in extend(found, runs, other, own, around) if b - a >= min_words]
    if not runs:
        return text, [], 0, n_words
    places = [hit.span() for hit in word_spans(text)]
    spans = [(places[a][0], places[b - 1][1]) for a, b in runs]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), spans, sum(b - a for a, b in runs), n_words


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the original text), text (what is kept), removed (array of start, end in code points of the
    original text), n_removed_words, n_words of every document.

    Earliest is the smallest doc_id (rows without one last), then the smallest text hash, then the
    place in the text.  Rows that repeat an id and its text are one row here, and each gets its result.
    A null text stays null and an empty one empty, with nothing removed; an empty
    table gives an empty result.  Units of texts that no other text shares never
    meet the texts again; a text's own units are one group.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("h", text_hash())
    known = texts.where("text is not null")
    found = keep(unit_rows(known, min_words), "units")
    later, firsts, hot = repeats(found)
    runs, around = words_around(known, found, later, firsts, hot, min_words)
    near = around.select(F.col("doc_id").alias("near_id"), F.col("h").alias("near_h"), "around")
    marked = runs.join(near, (F.col("h") == F.col("near_h")) & F.col("doc_id").eqNullSafe(F.col("near_id")), "left") \
        .select(F.col("doc_id").alias("later_id"), F.col("h").alias("later_h"), "later", "around") \
        .dropDuplicates(["later_id", "later_h"])
    forget(found, later)
    both = texts.join(marked, (F.col("h") == F.col("later_h")) & F.col("doc_id").eqNullSafe(F.col("later_id")), "left")

    def run(batches):
        for batch in batches:
            out = []
            for text, later, around in zip(*(batch.column(c).to_pylist() for c in ("text", "later", "around"))):
                if text is None or later is None:
                    out.append((text, [], 0, len((text or "").encode().split())))
                    continue
                kept, spans, words, n_words = cut(text, later, {
                    x["digest"]: [np.array(x[c], np.int64).view(np.uint64) for c in ("before", "after")]
                    for x in around or ()}, min_words)
                out.append((kept, [{"start": a, "end": b} for a, b in spans], words, n_words))
            cols = list(zip(*out)) or [()] * 4
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), span, pa.int64(), pa.int64())))],
                names=["doc_id", "h", "text", "removed", "n_removed_words", "n_words"])

    return both.select("doc_id", "h", "text", "later", "around").mapInArrow(
        run, "doc_id long, h long, text string, removed array<struct<start:int,end:int>>, n_removed_words long, n_words long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).drop("h")
