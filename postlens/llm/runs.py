"""Periodic runs of words: difference-cover longest common extensions and a harmonic grid.

A run is a longest stretch of words that keeps a period p (words p apart are
equal) over at least two periods and at least ``least`` words.

* Grid.  A run of period p and length L holds L - p neighbouring places x with
  word x = word x+p.  Among the multiples of step(p) = max(p, least - p) at least
  one is such a place, so only these are looked at: n/step(p) places a period, a
  harmonic sum over all periods, and only those with equal words go on.
* Extension.  Forwards and backwards from such a place both words run on equally as
  far as their longest common extension (LCE) says; a stretch of at least step(p)
  places is a run.  The same stretch found under a multiple of its period is
  dropped, so the smallest period stays.
* LCE.  Of each residue class modulo 13 some are in the difference cover
  {0, 1, 3, 9}: any two places reach two covered places with the same shift of at most
  12 words.  Those words are compared one by one; if all are equal, the covered
  suffixes' ranks and a sparse table of minima over neighbouring common prefixes
  give the rest.  Only covered suffixes are sorted, and only of documents in which
  some comparison gets that far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import as_bytes, id_and_text, read

#: A difference cover: every residue modulo 13 is a difference of two of these numbers.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words of the documents that are worked on together, and grid places looked at together.
CHUNK_WORDS, CHUNK_PLACES = 200_000, 2_000_000
SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
          "collapsed string")


def shifts() -> np.ndarray:
    """shift[i, j]: the least number of words after which places with residues i and j
    are both covered."""
    covered = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    i, j, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(covered[i + d] & covered[j + d], axis=2)


class CommonExtensions:
    """Longest common extensions between places of one integer sequence.

    ``words`` must be positive and end with a value that is found nowhere else.
    """

    def __init__(self, words: np.ndarray):
        self.shift = shifts()
        self.words = words
        n = len(words)
        # covered places, class by class, so that the place one block further is the next entry
        sizes = [len(range(c, n, MODULUS)) for c in COVER]
        self.base = np.zeros(MODULUS, np.int64)
        self.base[list(COVER)] = np.cumsum([0, *sizes[:-1]])
        self.places = np.concatenate([np.arange(c, n, MODULUS) for c in COVER])
        self.last = np.repeat(np.cumsum(sizes), sizes)  # where an entry's class ends
        self.levels = self.sort()
        order = np.argsort(self.levels[-1], kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = self.minima(self.prefixes(order[:-1], order[1:]))

    def sort(self) -> list[np.ndarray]:
        """Ranks of the covered suffixes by their first 1, 2, 4, ... blocks of 13 words;
        two ranks of a level are equal if those blocks are.  Only suffixes that still
        share a rank are sorted again."""
        n = len(self.words)
        padded = np.concatenate([self.words.astype(np.int64), np.zeros(MODULUS, np.int64)])
        bits = max(1, int(padded.max()).bit_length())
        per = max(1, 63 // bits)
        keys = []
        for first in range(0, MODULUS, per):
            key = np.zeros(len(self.places), np.int64)
            for k in range(first, min(first + per, MODULUS)):
                key = (key << bits) | padded[np.minimum(self.places + k, n)]
            keys.append(key)
        count = len(self.places)
        order = np.lexsort(keys[::-1])
        new = np.zeros(count, bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(count, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(count), 0))
        levels, step = [rank], 1
        while True:
            sizes = np.bincount(rank, minlength=count)
            open_ = np.flatnonzero(sizes[rank] > 1)
            if not len(open_):
                return levels
            at = open_ + step
            follow = np.where(at < self.last[open_], rank[np.minimum(at, count - 1)], -1)
            order = np.lexsort((follow, rank[open_]))
            group, follow = rank[open_][order], follow[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = group[1:] != group[:-1]
            inside = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            fresh[1:] |= follow[1:] != follow[:-1]
            rank = rank.copy()
            rank[open_[order]] = (group + inside)[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            levels.append(rank)
            step *= 2

    def prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of pairs of covered suffixes (given as entries): whole blocks by the
        ranks of the levels, then words."""
        a, b = a.copy(), b.copy()
        found = np.zeros(len(a), np.int64)
        count = len(self.places)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            same = (a >= 0) & (b >= 0)
            same[same] = rank[a[same]] == rank[b[same]]
            found[same] += MODULUS << k
            for x in (a, b):
                x[same] += 1 << k
                gone = same & ((x >= count) | (self.last[np.maximum(x - (1 << k), 0)] <= x))
                x[gone] = -1
        i, j = self.places[np.maximum(a, 0)], self.places[np.maximum(b, 0)]
        live = (a >= 0) & (b >= 0)
        extra = np.zeros(len(a), np.int64)
        extra[live] = equal_words(self.words, i[live], j[live], np.full(live.sum(), MODULUS))
        return found + extra

    @staticmethod
    def minima(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from places i and j (i != j)."""
        shift = self.shift[i % MODULUS, j % MODULUS]
        out = equal_words(self.words, i, j, shift)
        far = np.flatnonzero(out == shift)
        x, y = i[far] + shift[far], j[far] + shift[far]
        # a place behind the last word is reached by no equal words: the last word is unique
        a = self.rank[self.base[x % MODULUS] + x // MODULUS]
        b = self.rank[self.base[y % MODULUS] + y // MODULUS]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[far[at]] += np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def equal_words(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many words, ``most`` at the most, agree from places i and j on, going by ``step``."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    t = 0
    while len(live):
        live = live[words[i[live] + t * step] == words[j[live] + t * step]]
        t += 1
        out[live] = t
        live = live[most[live] > t]
    return out


def joined(documents: list[np.ndarray], free: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one sequence, each between values that are found nowhere else
    (from ``free`` on), and where each starts."""
    parts = []
    for d, words in enumerate(documents):
        parts += [np.array([free + d], np.int64), words]
    parts.append(np.array([free + len(documents)], np.int64))
    sizes = np.array([len(w) + 1 for w in documents], np.int64)
    return np.concatenate(parts), np.cumsum(sizes) - sizes + 1


def grid(sizes: np.ndarray, least: int, block: int):
    """(document, period, place) of the grid, in blocks of about ``block`` places."""
    periods = np.maximum(sizes // 2, 0) * (sizes >= least)
    doc = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(p, least - p)
    places = -(-(sizes[doc] - p) // step)
    ends = np.cumsum(places)
    lo = 0
    while lo < len(doc):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + block, "right")))
        k = places[lo:hi]
        at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(doc[lo:hi], k), np.repeat(p[lo:hi], k), at * np.repeat(step[lo:hi], k)
        lo = hi


def runs_of(documents: list[np.ndarray], least: int = 12, block: int = CHUNK_PLACES) -> np.ndarray:
    """All runs of documents given as positive word numbers: rows (document, start,
    length, period) by document, start and period."""
    free = max((int(w.max()) for w in documents if len(w)), default=0) + 1
    words, starts = joined(documents, free)
    sizes = np.array([len(w) for w in documents], np.int64)
    hits = [(d[m], p[m], at[m]) for d, p, at in grid(sizes, least, block)
            for x in (starts[d] + at,) for m in (words[x] == words[x + p],)]
    if not hits:
        return np.zeros((0, 4), np.int64)
    doc, p, at = (np.concatenate(c) for c in zip(*hits))
    x = starts[doc] + at
    # a look at as many words as any two places may need to reach the cover
    look = np.full(len(x), MODULUS)
    ahead, back = equal_words(words, x, x + p, look), equal_words(words, x - 1, x + p - 1, look, -1)
    far = np.flatnonzero((ahead == MODULUS) | (back == MODULUS))
    if len(far):
        need = np.unique(doc[far])
        part, begin = joined([documents[d] for d in need], free)
        i = begin[np.searchsorted(need, doc[far])] + at[far]
        j = i + p[far]
        ahead[far] = CommonExtensions(part)(i, j)
        turned = CommonExtensions(part[::-1])
        back[far] = turned(len(part) - i, len(part) - j)
    start, length = at - back, ahead + back + p
    good = length >= np.maximum(least, 2 * p)
    rows = np.stack([doc, start, length, p], axis=1)[good]
    # of a stretch found under several periods the smallest stays
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run (start, length, period) holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of the words `[^\\x20\\x09-\\x0D]+` of every whole text: doc_id,
    n_words, runs (start, length, period, by start and period) and collapsed, the
    words outside of the runs' later periods, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text;
    repeated rows and null ids give one row each, an empty table an empty result.
    Row-local; documents are worked on in groups of about ``CHUNK_WORDS`` words, a
    longer one alone, with a bounded number of bytes a word.
    """

    def chunk(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        found = runs_of([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts], least)
        ends = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        collapsed = []
        for k, words in enumerate(texts):
            if ends[k] < ends[k + 1]:
                keep = kept_words(len(words), found[ends[k]:ends[k + 1], 1:])
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            collapsed.append(b" ".join(words).decode())
        runs = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(collapsed, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def work(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py().split())
                size += len(texts[-1])
                if size >= CHUNK_WORDS:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield chunk(ids, texts)

    return as_bytes(id_and_text(docs, id_col, text_col)).mapInArrow(work, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32(doc_id as text) is divisible by 10 get a
    periodic tail, the others stay as they are (a null id counts as the empty text)."""
    base = id_and_text(docs)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    chosen = base.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, words)) \
        .withColumn("n", F.size("w").cast("long")) \
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))) \
        .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.element_at(
        "w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    altered = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, altered).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.finer")).alias("period"),
        F.expr("(1000 * best.length) div (-best.finer)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
