"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the 64-bit hashes of its distinct shingles, 4 words by default;
equal sets are one class.  All sets are ordered alike (by hash).  With need(n) =
ceil(0.85 n), or another share, two sets that link share at least t + 1 tokens in their
prefixes of n - need(n) + 1 + t tokens, for every t.

Wanted are the components of the links, so pairs inside a component need no comparison.

* Stars.  In the list of each token the set with the fewest tokens of its own leads: an
  original leads its copies.  Each set is compared with the one set that leads most of its
  lists; this links most near copies with one comparison a set and only saves work.
* Cost.  The cost of a token is the number of components, known so far, whose sets post it;
  tokens of cost over ``hot`` are costly.  A set whose estimated candidates (the costs of its
  cheap tokens) are many lengthens its prefix by t tokens, any set by as many as it needs so
  that fewer than t + 1 of its tokens are costly.  Only cheap tokens are posted, and a partner has
  to share t + 1 less the costly ones of them before anything is verified.
* Counting.  Shared tokens are counted between a set and a component: a list gives a row for each
  of its sets and components, not for each pair of sets.  Where the count suffices, the set
  is compared with the component's member that leads it there; only if that does not link
  are the component's other members counted one by one.
* Dense sets.  Prefixes are stored with some room.  Sets that need more are posted again as a
  whole among themselves.  Those that stay among costly tokens even so also post the costly
  ones among their cheapest, and in rounds a growing number of leaders of each such list is
  compared with its members, until each list is one component or empty.
* Differences.  Sets near a leader L are not compared pair by pair.  With D(x) the tokens that only
  one of x and L has, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| tokens.  Of two sets that are
  not both in L's component one does not link with L, so two that link share more than half of
  either one's D (give or take the sizes), and D's tokens are rare where the sets' own are not.  A
  set so near to L that all it links with is near L too leaves the list.

Candidates are verified in two steps: from the stored prefixes, whose missing tokens
bound the overlap, and then on the whole sets.  Links feed connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postlens.llm.common import as_bytes, components, forget, id_and_text, keep, may_hold, read, release_worker, text_hash

SHINGLE, NUM, DEN, HOT = 4, 85, 100, 16
#: Leaders of a costly list in the first round, and growth from round to round.
LEADERS, GROWTH = 4, 4
#: A set with more estimated candidates than this lengthens its prefix by all the room there is.
FEW = 16
#: Sets within NEAR times the distance that links may have are compared by their differences from a leader.
NEAR = 3
#: Parts that a long list is dealt over when its leaders are looked for.
PARTS = 64
#: A prefix is stored with room for 4 + n / ROOM more tokens.
ROOM = 48
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; with fewer words, of the whole
    sequence; empty without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = min(size, len(words))
    out = h[:len(h) - m + 1].copy()
    for i in range(1, m):
        out = out * MIX + h[i:len(h) - m + 1 + i]
    out = (out ^ (out >> np.uint64(29))) * MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_sizes(n: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """(tokens of the 1-prefix, tokens it may be lengthened by)."""
    return n - (num * n + den - 1) // den + 1, 4 + n // ROOM


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_rows(texts: DataFrame, num: int, den: int, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, d, n, prefix) of every row: d is the set's digest, prefix the
    lengthened prefix; empty sets have d null."""

    def run(batches):
        release_worker()
        for batch in batches:
            d, n, prefix = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                d.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                prefix.append(_long(s[:sum(prefix_sizes(len(s), num, den))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(d, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "h", "d", "n", "prefix"])

    return texts.mapInArrow(run, "doc_id long, h long, d long, n int, prefix array<long>")


def least_overlap(na: int, nb: int, num: int, den: int) -> int:
    """Shared tokens that two linked sets have at least: den * o >= num * (na + nb - o)."""
    return -(-num * (na + nb) // (den + num))


def may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int, num: int, den: int) -> bool:
    """Whether two prefixes leave room for a link: tokens up to the end of the shorter
    reach that the other side lacks are missing for good."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    reach = min(a[-1] if len(a) < na else np.uint64(2 ** 64 - 1), b[-1] if len(b) < nb else np.uint64(2 ** 64 - 1))
    a, b = a[:np.searchsorted(a, reach, "right")], b[:np.searchsorted(b, reach, "right")]
    shared, o = len(np.intersect1d(a, b, assume_unique=True)), least_overlap(na, nb, num, den)
    return len(a) - shared <= na - o and len(b) - shared <= nb - o


class Join:
    """One run of the join over (doc_id, h, text)."""

    def __init__(self, texts: DataFrame, num: int = NUM, den: int = DEN, hot: int = HOT, shingle: int = SHINGLE):
        self.texts, self.num, self.den, self.hot, self.shingle = texts, num, den, hot, shingle
        self.rows = keep(set_rows(texts, num, den, shingle), "sets")
        # one row of each class of equal sets
        self.reps = keep(self.rows.where("d is not null").groupBy("d").agg(
            F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min(F.struct("doc_id", "h")).alias("r"),
            F.min("doc_id").alias("least")).select("d", "n", "prefix", F.col("r.doc_id").alias("rep_id"),
                                                   F.col("r.h").alias("rep_h"), "least"), "reps")
        spark = self.reps.sparkSession
        # (node, root) of every set in a link so far, the pairs compared, and whole sets fetched
        self.label = spark.createDataFrame([], "node long, root long")
        self.compared = spark.createDataFrame([], "a long, b long")
        self.whole = spark.createDataFrame([], "d long, s binary")
        self.used: list[DataFrame] = []

    def p1(self, n: Column) -> Column:
        """Tokens of the shortest prefix."""
        return n - F.ceil(F.lit(self.num) * n / self.den).cast("int") + 1

    def rooted(self, sets: DataFrame) -> DataFrame:
        """Rows of sets with the component that the set is in so far."""
        return sets.join(self.label.select(F.col("node").alias("d"), "root"), "d", "left") \
            .withColumn("root", F.coalesce("root", "d"))

    def sizes_fit(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num

    # -- verification ------------------------------------------------------------
    def verify(self, pairs: DataFrame, bound: bool) -> DataFrame:
        """The links among candidate pairs (a, b); ``bound``: look at the stored prefixes first."""
        num, den = self.num, self.den
        close = pairs
        if bound:
            def may(batches):
                for batch in batches:
                    a, b, na, nb, pa_, pb = (batch.column(c) for c in ("a", "b", "na", "nb", "pa", "pb"))
                    ok = [may_link(np.array(x.values, np.int64), np.array(y.values, np.int64), m.as_py(), n.as_py(), num, den)
                          for x, y, m, n in zip(pa_, pb, na, nb)]
                    yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

            x, y = (self.reps.select(F.col("d").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "ab")
            close = keep(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "pa", "pb")
                         .mapInArrow(may, "a long, b long"), "close")
            if close.isEmpty():
                return close
        ends = close.select(F.col("a").alias("cd")).union(close.select("b")).distinct()
        fetched = keep(self.whole_sets(ends.join(self.whole.select(F.col("d").alias("cd")), "cd", "left_anti")), "whole")
        self.whole = self.whole.union(fetched)
        self.used.append(fetched)

        def exact(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column("sa"), batch.column("sb")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    least = least_overlap(len(x), len(y), num, den)
                    ok.append(min(len(x), len(y)) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]) \
                    .filter(pa.array(ok, pa.bool_()))
            pa.default_memory_pool().release_unused()

        x, y = (self.whole.select(F.col("d").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        links = keep(close.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long"), "links")
        if bound:
            forget(close)
        return links

    def whole_sets(self, classes: DataFrame) -> DataFrame:
        """(d, s binary: the sorted hashes) of the classes in column ``cd``.  Their texts are read
        again; a filter of a fixed size keeps the others where they are."""
        need = keep(classes.join(self.reps.select(F.col("d").alias("cd"), "rep_id", F.col("rep_h").alias("nh")), "cd")
                    .select("cd", "rep_id", "nh"), "need")
        shingle = self.shingle
        texts = may_hold(self.texts, "h", need.select("nh"))

        def sets(batches):
            for batch in batches:
                out = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("cd"), pa.array(out, pa.binary())], names=["d", "s"])
            pa.default_memory_pool().release_unused()

        # rows that repeat an id and its text have one set: any of them does
        return (texts.join(need, (F.col("h") == F.col("nh")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
                .groupBy("cd").agg(F.first("text").alias("text")).mapInArrow(sets, "d long, s binary"))

    def whole_postings(self, classes: DataFrame) -> DataFrame:
        """(s, d, n, place) of every token of the classes in column ``cd``."""

        def explode(batches):
            for batch in batches:
                for d, raw in zip(batch.column("d").to_pylist(), batch.column("s")):
                    s = np.frombuffer(raw.as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s), pa.array(np.full(len(s), d, np.int64)), pa.array(np.full(len(s), len(s), np.int32)),
                         pa.array(np.arange(len(s), dtype=np.int32))], names=["s", "d", "n", "place"])

        return self.whole_sets(classes).mapInArrow(explode, "s long, d long, n int, place int")

    def compare(self, pairs: DataFrame, bound: bool = True) -> None:
        """Verify the candidates that were not compared yet, and join what links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = keep(pairs.join(self.compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        self.compared = self.compared.union(pairs)
        self.used.append(pairs)
        self.unite(self.verify(pairs, bound))

    def unite(self, links: DataFrame) -> None:
        """Join the components between which kept links (a, b) lead."""
        if links.isEmpty():
            return
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        nodes = keep(ends.join(self.label, "node", "left_anti").select("node", F.col("node").alias("root")).union(self.label), "nodes")
        of = nodes.withColumnRenamed("root", "r")
        between = (links.join(of.select(F.col("node").alias("a"), F.col("r").alias("ra")), "a")
                   .join(of.select(F.col("node").alias("b"), F.col("r").alias("rb")), "b")
                   .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        merged = components(between)
        new = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
        self.label, old = keep(nodes.join(new, nodes["root"] == new["old"], "left")
                               .select("node", F.coalesce("new", "root").alias("root")), "label"), self.label
        forget(old, nodes, merged, links)

    # -- candidates --------------------------------------------------------------
    def choose(self, sets: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
        """What sets post in the end, from (d, n, own, toks: place and token of the shared ones):
        (s, d, n, own, root, cost, need, dense), need being the cheap tokens that a partner has to
        share, and the dense sets (cd).  ``whole``: toks are of whole sets, not of stored prefixes;
        dense sets among them meet in one token at least of those that they post, by cost order."""
        num, den = self.num, self.den
        sets = self.rooted(sets)
        post = sets.select("d", "n", "own", "root", F.explode("toks").alias("k")).select("d", "n", "own", "root", "k.place", "k.s")
        cost = post.groupBy("s", "root").agg(F.lit(1)).groupBy("s").agg(F.count(F.lit(1)).alias("cost")).where("cost > 1")
        n, cheap = F.col("n"), F.col("cost") <= self.hot
        # a partner may be shorter, and so may its longest prefix
        shortest = F.floor(n * num / den)
        room = (F.ceil(F.lit(num) * shortest / den) - 1 if whole else F.lit(4) + F.floor(shortest / ROOM)).cast("int")
        by_set = post.join(cost, "s").groupBy("d").agg(
            F.first("n").alias("n"), F.first("own").alias("own"), F.first("root").alias("root"),
            F.array_sort(F.collect_list(F.struct("place", "s", "cost"))).alias("toks"))
        if whole:
            # a whole set shares no more with other components than its tokens of cost over 1
            by_set = by_set.where(F.size("toks") * den >= n * num)
        costly = F.transform(F.filter("toks", lambda k: k["cost"] > self.hot), lambda k: k["place"])
        by_set = by_set.withColumn("p1", self.p1(n)).withColumn("room", room).withColumn("costly", costly) \
            .withColumn("work", F.aggregate(F.filter("toks", lambda k: (k["cost"] <= self.hot) & (k["place"] < F.col("p1"))),
                                            F.lit(0).cast("long"), lambda a, k: a + k["cost"] - 1))

        def inside(t: Column) -> Column:
            return F.size(F.filter("costly", lambda r: r < F.col("p1") + t))

        # the i-th costly token is inside the lengthening prefix if fewer than p1 cheap ones stand before it
        least = F.size(F.filter("costly", lambda r, i: r - i < F.col("p1")))
        by_set = by_set.withColumn("least", least).withColumn("dense", F.col("least") > F.col("room")) \
            .withColumn("t", F.when((F.col("work") > FEW) & (F.col("room") + 1 - inside(F.col("room")) > 1), F.col("room"))
                        .otherwise(F.col("least"))) \
            .withColumn("need", F.when(~F.col("dense"), F.col("t") + 1 - inside(F.col("t"))).otherwise(F.lit(1 if whole else 1 << 30)))
        posted = F.filter("toks", lambda k: (k["cost"] <= self.hot) & (F.col("dense") | (k["place"] < F.col("p1") + F.col("t"))))
        if whole:
            # of sets that stay dense also the costly tokens among their p1 cheapest, unshared ones counted first
            rest = F.greatest(F.col("p1") - (n - F.size("toks")), F.lit(0))
            cheapest = F.slice(F.array_sort(F.transform("toks", lambda k: F.struct(k["cost"].alias("cost"), k["s"].alias("s"), k["place"].alias("place")))),
                               F.lit(1), rest)
            some = F.transform(F.filter(cheapest, lambda k: k["cost"] > self.hot),
                               lambda k: F.struct(k["place"].alias("place"), k["s"].alias("s"), k["cost"].alias("cost")))
            posted = F.when(F.col("dense"), F.concat(posted, some)).otherwise(posted)
        by_set = keep(by_set.select("d", "n", "own", "root", "need", "dense", posted.alias("toks")), "postings")
        return by_set.select("d", "n", "own", "root", "need", "dense", F.explode("toks").alias("k")) \
            .select("k.s", "d", "n", "own", "root", "k.cost", "need", "dense"), by_set.where("dense").select(F.col("d").alias("cd"))

    def counted(self, post: DataFrame) -> DataFrame:
        """(a, root_b, lead, need): sets and components that share enough cheap tokens, with the
        component's member that leads it in most of their lists."""
        of = post.groupBy("s", F.col("root").alias("root_b")).agg(
            F.min(F.struct("own", "d", "n")).alias("m"), F.min("need").alias("need_b"),
            F.min("n").alias("low"), F.max("n").alias("high"))
        fit = (F.col("high") * self.den >= F.col("n") * self.num) & (F.col("n") * self.den >= F.col("low") * self.num)
        rows = post.select("s", F.col("d").alias("a"), "n", "root", "need").join(of, "s") \
            .where((F.col("root") > F.col("root_b")) & fit)
        by_lead = rows.groupBy("a", "root_b", F.col("m.d").alias("lead")).agg(
            F.count(F.lit(1)).alias("k"), F.min(F.least("need", "need_b")).alias("need"))
        return keep(by_lead.groupBy("a", "root_b").agg(F.sum("k").alias("k"), F.min("need").alias("need"), F.max_by("lead", "k").alias("lead"))
                    .where("k >= need").select("a", "root_b", "lead"), "counted")

    def compare_cheap(self, post: DataFrame) -> None:
        """Sets against components over cheap lists, first with the leading members, then with the
        others of the components that did not join."""
        post = post.where(F.col("cost") <= self.hot)
        found = self.counted(post)
        self.compare(found.select("a", F.col("lead").alias("b")))
        now = self.label.select(F.col("node").alias("x"), F.col("root").alias("now"))
        left = found.join(now.select(F.col("x").alias("a"), F.col("now").alias("na")), "a", "left") \
            .join(now.select(F.col("x").alias("root_b"), F.col("now").alias("nb")), "root_b", "left") \
            .where(F.coalesce("na", "a") != F.coalesce("nb", "root_b")).select("a", "root_b")
        # a component of one set was compared in full
        several = post.select("root", "d").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("k")).where("k > 1") \
            .select(F.col("root").alias("root_b"))
        left = keep(left.join(several, "root_b"), "left")
        if not left.isEmpty():
            x = post.select("s", F.col("d").alias("a"), F.col("n").alias("na"), F.col("need").alias("need_a")).join(left, "a")
            y = post.select("s", F.col("d").alias("b"), F.col("n").alias("nb"), F.col("need").alias("need_b"), F.col("root").alias("root_b"))
            pairs = x.join(y, ["s", "root_b"]).where(self.sizes_fit(F.col("na"), F.col("nb"))).groupBy("a", "b").agg(
                F.count(F.lit(1)).alias("k"), F.min(F.least("need_a", "need_b")).alias("need")).where("k >= need")
            self.compare(pairs.select("a", "b"))
        forget(found, left)

    def run(self) -> DataFrame:
        """(node, root) of every class that has a link; nodes are set digests."""
        every = self.reps.select("d", "n", F.posexplode("prefix").alias("place", "s"))
        shared = every.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("s")
        sets = keep(self.gathered(every.join(shared, "s"), F.least(self.p1(F.col("n")) + 4 + F.floor(F.col("n") / ROOM), F.col("n"))), "shared")
        self.compare_stars(sets)
        post, dense = self.choose(sets, whole=False)
        self.compare_cheap(post)
        if dense.isEmpty():
            return self.label
        tokens = keep(self.whole_postings(dense), "whole-post")
        shared = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("s")
        among, _ = self.choose(self.gathered(tokens.join(shared, "s"), F.col("n")), whole=True)
        forget(sets, tokens)
        self.compare_cheap(among)
        self.compare_costly(among.where((F.col("cost") > self.hot) & F.col("dense")))
        return self.label

    @staticmethod
    def gathered(post: DataFrame, stored: Column) -> DataFrame:
        """(d, n, own, toks) of each set, from its shared tokens; own: how many of a million of its stored
        tokens no other set has."""
        return post.groupBy("d", "n").agg(F.collect_list(F.struct("place", "s")).alias("toks")) \
            .withColumn("own", F.floor((stored - F.size("toks")).cast("double") * 1_000_000 / stored).cast("int"))

    def compare_stars(self, sets: DataFrame) -> None:
        """Each set with the one that leads most of its lists, if it leads half a prefix."""
        post = sets.select("d", "n", "own", F.explode("toks").alias("k")).select("k.s", "d", "n", "own")
        lead = post.groupBy("s").agg(F.min(F.struct("own", "d", "n")).alias("m"))
        near = post.join(lead, "s").where(F.col("m.d") != F.col("d")).where(self.sizes_fit(F.col("n"), F.col("m.n"))) \
            .groupBy("d", "n", F.col("m.d").alias("lead")).agg(F.count(F.lit(1)).alias("k")).where(2 * F.col("k") >= self.p1(F.col("n")))
        self.compare(near.groupBy("d").agg(F.max_by("lead", "k").alias("lead")).select(F.col("d").alias("a"), F.col("lead").alias("b")),
                     bound=False)

    def compare_costly(self, post: DataFrame) -> None:
        """Costly lists, by rounds of leaders; members near a leader are compared around it and leave."""
        num, den, high = self.num, self.den, LEADERS
        costly = keep(post.select("s", "d", "n", F.struct("own", F.xxhash64("d").alias("x"), "d").alias("key")), "costly")
        if costly.isEmpty():
            return
        sets = keep(self.whole_sets(costly.select(F.col("d").alias("cd")).distinct()), "dense")
        while True:
            marked = self.rooted(costly)
            # lists that still hold several components
            still = marked.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("s")
            todo = keep(marked.join(still, "s", "left_semi").select(*costly.columns), "todo")
            forget(costly)
            if todo.isEmpty():
                forget(todo, sets)
                return
            # the first of each part of a list, then the first of all: no list is ordered in one task
            part = F.pmod(F.xxhash64("d"), F.lit(PARTS))
            some = todo.withColumn("place", F.row_number().over(W.partitionBy("s", part).orderBy("key"))).where(F.col("place") <= high)
            lead = some.withColumn("place", F.row_number().over(W.partitionBy("s").orderBy("key"))).where(F.col("place") <= high) \
                .select("s", F.col("d").alias("b"), F.col("n").alias("nb"), F.col("key").alias("first"))
            met = keep(todo.join(lead, "s").where(self.within(F.abs(F.col("n") - F.col("nb")), F.col("n"), F.col("nb"), NEAR))
                       .select("s", "d", "b", "first"), "met")
            near = keep(self.differences(met.select("d", "b").distinct(), sets), "near")
            self.unite(keep(near.where((F.col("d") != F.col("b")) & self.within(F.size("toks"), F.col("n"), F.col("nb")))
                            .select(F.col("d").alias("a"), "b"), "links"))
            # what links with d has den / num of its size at most and num / den at least, so it is near b too
            leaves = F.size("toks").cast("long") * den * (den + num) <= (den - num) * (NEAR * den * F.col("nb") + ((NEAR - 1) * num - den) * F.col("n"))
            home = keep(met.join(near.where(leaves).select("d", "b"), ["d", "b"]).groupBy("s", "d")
                        .agg(F.min_by("b", "first").alias("b")), "home")
            self.compare_around(near.join(home.where("b <> d").select("b").distinct(), "b", "left_semi"))
            # a leader is near itself, so every list gets shorter
            costly = keep(todo.join(home.select("s", "d"), ["s", "d"], "left_anti"), "costly")
            forget(todo, met, near, home)
            high *= GROWTH

    def within(self, x: Column, n: Column, m: Column, times: int = 1) -> Column:
        """Whether sets of n and m tokens that differ in x are within so many times the distance of links."""
        return x * (self.den + self.num) <= times * (self.den - self.num) * (n + m)

    def differences(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(d, b, n, nb, toks: the tokens that one of both has) of those pairs (d, b) that are near."""
        num, den = self.num, self.den

        def run(batches):
            for batch in batches:
                d, b, n, nb, toks = [], [], [], [], []
                for i, j, x, y in zip(batch.column("d").to_pylist(), batch.column("b").to_pylist(), batch.column("sd"), batch.column("sb")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    only = np.setxor1d(x, y, assume_unique=True)
                    if len(only) * (den + num) <= NEAR * (den - num) * (len(x) + len(y)):
                        for column, value in zip((d, b, n, nb, toks), (i, j, len(x), len(y), _long(only))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(nb, pa.int32()),
                     pa.array(toks, pa.list_(pa.int64()))], names=["d", "b", "n", "nb", "toks"])
            pa.default_memory_pool().release_unused()

        x, y = (sets.select(F.col("d").alias(c), F.col("s").alias(f"s{c}")) for c in "db")
        return pairs.join(x, "d").join(y, "b").select("d", "b", "sd", "sb") \
            .mapInArrow(run, "d long, b long, n int, nb int, toks array<long>")

    def compare_around(self, near: DataFrame) -> None:
        """Sets near the same leader b, where one of both is not in its component, by their differences from it."""
        num, den = self.num, self.den
        of = self.label.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        sets = self.rooted(near).join(of, "b", "left") \
            .withColumn("out", F.col("root") != F.coalesce("root_b", "b")).drop("root_b")
        sets = keep(sets.join(sets.where("out").select("b").distinct(), "b", "left_semi"), "around")
        post = sets.select("b", "d", "n", "nb", "root", "out", F.size("toks").cast("long").alias("x"),
                           F.explode("toks").alias("s"))
        shared = post.groupBy("b", "s").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("r0"), F.max("root").alias("r1")) \
            .where("r0 <> r1").select("b", "s", "k")
        # d shares more than (x + (nb - n) (den - num) / (den + num)) / 2 tokens with a set that is out and links with it
        share = F.floor((F.col("x") * (den + num) + (den - num) * (F.col("nb") - F.col("n"))) / (2 * (den + num))) + 1
        by_set = keep(post.join(shared, ["b", "s"]).groupBy("b", "d").agg(
            *[F.first(c).alias(c) for c in ("n", "nb", "root", "out", "x")], F.array_sort(F.collect_list(F.struct("k", "s"))).alias("toks"))
            .withColumn("few", F.size("toks") - share + 1).where("few > 0 or out"), "by-set")
        rows = by_set.select("b", "d", "n", "root", "out", "x", "few", F.size("toks").alias("size"), F.posexplode("toks").alias("place", "k")) \
            .select("b", "k.s", "d", "n", "root", "out", "x", "size", (F.col("place") < F.col("few")).alias("first"))
        x = rows.where("out").select("b", "s", "d", "n", "root", "x", "size", "first")
        y = rows.where("first").select("b", "s", "out", *[F.col(c).alias(f"{c}2") for c in ("d", "n", "root", "x", "size")])
        able = (F.col("root") != F.col("root2")) & self.sizes_fit(F.col("n"), F.col("n2")) \
            & ((F.col("x") + F.col("x2")) * (den + num) - (den - num) * (F.col("n") + F.col("n2"))
               <= 2 * (den + num) * F.least("size", "size2"))
        inner = x.join(y.where("not out"), ["b", "s"]).where(able)
        outer = x.where("first").join(y.where("out"), ["b", "s"]).where(able & (F.col("d") < F.col("d2")))
        self.compare(inner.select(F.col("d").alias("a"), F.col("d2").alias("b")).union(
            outer.select(F.col("d").alias("a"), F.col("d2").alias("b"))))
        forget(sets, by_set)


def similar_components(docs: DataFrame, num: int = NUM, den: int = DEN, hot: int = HOT, id_col: str = "doc_id",
                       text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h (text hash), n_shingles, component_id, root of every row: sets of distinct shingles of
    ``shingle`` words link when den * shared >= num * union; component_id is the smallest doc_id
    reachable by links, the row's own included.

    Null and empty texts and texts of white space have an empty set, link with
    nothing and are their own component.  Rows with equal sets are linked; a null id
    takes part but never names a component (null if no member has an id).  Rows that
    repeat an id with another text are linked by that id's name only; root, which rows without a set
    do not have, tells such components apart.  An empty table gives an empty result.
    """
    texts = as_bytes(id_and_text(docs, id_col, text_col)).withColumn("h", text_hash())
    join = Join(texts, num, den, hot, shingle)
    label = join.run()
    forget(*join.used)
    named = (join.reps.select("d", "least").join(label.withColumnRenamed("node", "d"), "d", "left")
             .withColumn("root", F.coalesce("root", "d")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = keep(named.join(least, "root").select(F.col("d").alias("cd"), "component_id", "root"), "component")
    # rows without a set are their own component
    rows = join.rows.select("doc_id", "h", "n", "d")
    linked = (rows.where("d is not null").join(of_class, F.col("d") == F.col("cd"))
              .select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"), "component_id", "root"))
    alone = rows.where("d is null").select("doc_id", "h", F.lit(0).cast("long").alias("n_shingles"),
                                           F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.union(alone)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents")).drop("h", "root")
