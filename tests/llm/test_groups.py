"""op3, op5, op9, op10 and the pipeline against brute force on small tables."""

import random

import numpy as np
import pytest
from odd_rows import TEXTS

import corpus_pipeline
from postlens.llm import common, mixing, neighbours, similarity, substrings
from postlens.llm.common import components, keep, read

SF = "/root/testdata/sf0.001"


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (129, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_first_round_of_components_takes_the_edges_as_they_are(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(common, "keep", lambda df, name: kept.append(name) or keep(df, name))
    rows = [(None, 4), (4, None), (5, 5), (9, 3), (3, 9), (9, 3), (9, 12)]
    got = sorted(map(tuple, components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert got == [(3, 3), (9, 3), (12, 3)] and kept.count("edges") <= 3
    kept.clear()
    star = spark.createDataFrame([(1, i) for i in range(2, 20)], "a long, b long")
    assert {r.root for r in components(star).collect()} == {1} and kept.count("edges") == 2
    assert components(star.where("a > 1")).isEmpty()


def test_driver_collects_its_garbage_now_and_then(spark, monkeypatch):
    done = []
    monkeypatch.setattr(common, "tidy", lambda s: done.append(s))
    for _ in range(2 * common.TIDY_EVERY):
        assert keep(spark.range(3), "t").count() == 3
    assert done == [spark, spark]
    monkeypatch.undo()
    common.tidy(spark)


# -- op9 ----------------------------------------------------------------------
def brute_components(texts, num=85, den=100):
    """(doc_id, n_shingles, component_id) of each row, by comparing all pairs of ids."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    rows = [(i, shingles(t)) for i, t in texts]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(rows)), key=str)


def family(n, seed, words=40):
    """Texts that share passages, near copies of a few bases, and groups of copies."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    bases = [[rnd.choice(vocab) for _ in range(words)] for _ in range(4)]
    out = []
    for i in range(n):
        kind = i % 3
        w = list(bases[rnd.randrange(4)]) if kind else [rnd.choice(vocab) for _ in range(rnd.randint(2, words))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4]) if kind else 0):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append((i, " ".join(w + (passage if kind == 2 else []))))
    return out


def test_similarity_odd_rows(odd, nothing):
    got = similarity.similar_components(odd)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == brute_components(TEXTS)
    assert similarity.similar_components(nothing).count() == 0


def test_similarity_of_large_groups(spark):
    """Costly tokens, dense sets and leader rounds: few sets make a token costly here."""
    texts = family(150, 3)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = similarity.similar_components(docs, hot=2)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == brute_components(texts)


def test_groups_of_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch, num=85):
    """Copies of one text, a little further from it than links reach, and copies of copies that chain them."""
    rnd = random.Random(num)
    base = [f"b{i}" for i in range(110)]
    texts = []
    for i in range(160):
        w = list(rnd.choice(texts)) if i > 100 and i % 4 == 0 else list(base)
        for k in rnd.sample(range(2, 108), rnd.choice([1, 2, 3, 3, 4])):
            w[k] = f"o{i}x{k}"
        texts.append(w)
    texts = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = brute_components(texts, num)
    join = similarity.Join(similarity.as_bytes(spark.createDataFrame(texts, "doc_id long, text string"))
                           .withColumn("h", similarity.text_hash()), num, hot=2)
    costly, before = join.compare_costly, []

    def counted(post):
        before.append(join.compared.count())
        costly(post)
    monkeypatch.setattr(join, "compare_costly", counted)
    join.run()
    label = {r.d: r.root for r in join.rooted(join.reps.select("d")).collect()}
    ids = {r.d: r.rep_id for r in join.reps.collect()}
    least = {}
    for d, root in label.items():
        least[root] = min(ids[d], least.get(root, ids[d]))
    assert {i: c for i, _, c in want} == {ids[d]: least[root] for d, root in label.items()}
    assert len(set(least.values())) > 50 and join.compared.count() - before[0] < 20 * len(texts)


def test_prefix_bound_loses_no_link():
    rnd = np.random.default_rng(4)
    for _ in range(400):
        n = int(rnd.integers(1, 60))
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.08], rnd.integers(0, 2 ** 63, 2).astype(np.uint64)]))
        o = len(np.intersect1d(a, b))
        links = 100 * o >= 85 * (len(a) + len(b) - o)
        pa, pb = (x[:sum(similarity.prefix_sizes(len(x)))].view(np.int64) for x in (a, b))
        assert not links or similarity.may_link(pa, pb, len(a), len(b), 85, 100)


# -- op5 ----------------------------------------------------------------------
def test_substrings_odd_rows(odd, nothing):
    got = substrings.dedup_substrings(odd).collect()
    assert sorted([r.doc_id for r in got], key=str) == sorted([i for i, _ in TEXTS], key=str)
    for i in (3, 4, 5):
        assert {r.text for r in got if r.doc_id == i} == {dict(TEXTS)[i]}
    # the second long text repeats the first but for its last words
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.n_removed_words > 17_900 and nine.text.endswith("tail")
    assert next(r for r in got if r.doc_id == 8).n_removed_words == 0
    assert substrings.dedup_substrings(nothing).count() == 0


def test_rows_without_or_with_repeated_ids_are_ranked(spark):
    """A passage stays in the row of the least (id, text hash), rows without an id last."""
    def words(tag, n):
        return " ".join(f"{tag}{k}" for k in range(n))
    shared, other = words("s", 60), words("t", 60)
    rows = [(None, f"{words('a', 9)} {shared} {words('b', 9)}"), (None, f"{words('c', 9)} {shared} {words('d', 9)}"),
            (5, f"{words('e', 9)} {other} {words('f', 9)}"), (5, f"{words('g', 9)} {other} {words('h', 9)}"), (5, None),
            (7, f"{words('i', 9)}"), (8, f"{words('j', 9)} {words('u', 60)} {words('u', 60)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.dedup_substrings(docs).collect()
    assert len(got) == len(rows) and sum(r.n_removed_words for r in got if r.doc_id == 8) == 60
    for doc_id, passage in ((None, shared), (5, other)):
        own = sorted([r for r in got if r.doc_id == doc_id and r.n_words], key=lambda r: r.h)
        assert [r.n_removed_words for r in own] == [0, 60] and passage in own[0].text and "0 " in own[1].text
        assert not any(w in own[1].text.split() for w in passage.split())


def brute_windows(texts, size):
    """Windows of words that several texts, or two places of one text, hold."""
    seen = {}
    for i, t in texts:
        w = t.lower().split()
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k:k + size]), []).append((i, k))
    return {w: at for w, at in seen.items() if len(at) > 1}


def test_no_long_window_is_left_twice(spark):
    """After dedup no window as long as the least passage stands in two places, and windows that stood
    in one place only are untouched unless they touch a removed run."""
    docs = read(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    size = substrings.least_passage() + substrings.MIN_WORDS
    assert brute_windows(texts, size)
    kept = [(i, part) for i, r in got.items() if r.text for part in pieces(r, dict(texts)[i])]
    assert not brute_windows(kept, size)
    # what was removed stands somewhere else
    short = brute_windows(texts, substrings.MIN_WORDS)
    for i, t in texts:
        for a, b in got[i].removed:
            w = t[a:b].lower().split()
            assert len(w) >= substrings.MIN_WORDS and any(tuple(w[k:k + substrings.MIN_WORDS]) in short for k in range(len(w) - substrings.MIN_WORDS + 1))


def pieces(row, text):
    """What is kept of a text, cut where something was removed."""
    at = 0
    for a, b in row.removed:
        yield text[at:a]
        at = b
    yield text[at:]


def test_planted_passages_go_and_the_rest_stays(spark):
    rnd = random.Random(8)

    def prose(n):
        return [f"{rnd.choice('bcdfgkl')}{rnd.randrange(10 ** 6)}" for _ in range(n)]
    passages = [" ".join(prose(55)) for _ in range(5)]
    texts, where = [], {}
    for i in range(60):
        words, p = [" ".join(prose(40)), " ".join(prose(30))], i % 6
        if p < 5:
            where[i] = p
            # in a line of its own, or inside a line, in other case and spacing
            words.insert(1, ("\n" + passages[p] + "\n") if i % 2 else passages[p].upper().replace(" ", "  "))
        texts.append((i, " ".join(words)))
    got = {r.doc_id: r for r in substrings.dedup_substrings(
        spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        r = got[i]
        if i not in where or i < 6:
            assert r.text == t and not r.removed
        else:
            assert r.n_removed_words >= 55 - 2 * substrings.MOST_WORDS
            assert passages[where[i]] not in " ".join(r.text.lower().split())
            assert len(r.text.split()) == r.n_words - r.n_removed_words
            for s in r.removed:
                assert " ".join(t[s.start:s.end].lower().split()) in passages[where[i]]


def test_passages_of_common_words_inside_lines_go_to_their_ends(spark):
    """51 words from a vocabulary of 2 to 40 words, at random places in lines, wrapped
    differently in the later document."""
    rnd = random.Random(6)
    texts, where = [], {}
    for i in range(150):
        vocab = [f"c{k}" for k in range(rnd.choice([2, 3, 5, 10, 40]))]
        passage = [rnd.choice(vocab) for _ in range(51)]
        for side in (0, 1):
            pre, post = ([f"u{i}s{side}e{end}n{k}" for k in range(rnd.randrange(1, 60))] for end in (0, 1))
            words = list(passage)
            if side:
                words[rnd.randrange(50)] += "\n"
            texts.append((2 * i + side, " ".join(pre + words + post)))
            where[2 * i + side] = " ".join(pre + post)
    got = substrings.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == 300
    for r in got:
        if r.doc_id % 2:
            assert r.n_removed_words == 51 and " ".join(r.text.split()) == where[r.doc_id]
        else:
            assert r.n_removed_words == 0


# -- op10 ---------------------------------------------------------------------
def brute_neighbours(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            best = sorted((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i)
                          for i, b in good if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in best[:k]]
    return out


def test_neighbours_odd_vectors(spark):
    """All axes are probed here, so the answers are exact: nulls, zeros, other lengths,
    many identical vectors, ties, fewer candidates than asked for."""
    rows = [(0, [1.0, 0.0, 0.5]), (1, [0.0, 1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]),
            (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (10, [2.0, 2.0])]
    rows += [(20 + i, [0.5, 0.5, 0.25]) for i in range(12)] + [(40 + i, [float(i), 1.0, 2.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.neighbours(df, query_every=10, tables=2, probes=8, block_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours(rows, 10, 5)
    assert set(got) == {q for q, w in want.items() if w}
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        assert [h[1] for h in hits] == [i for i, _ in want[q]]
        assert np.allclose([h[2] for h in hits], [s for _, s in want[q]], atol=1e-12)
    assert neighbours.neighbours(df.where("vec_id < 0")).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(20, 48))
    assert np.allclose(np.linalg.norm(neighbours.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_few_candidates_are_all_found(spark, n):
    """Fewer candidates than answers, opposite vectors among them, at the default settings."""
    rnd = np.random.default_rng(n)
    vectors = [rnd.normal(size=64) for _ in range(n - 1)]
    vectors.append(-vectors[0])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=1).collect()
    for i, v in rows:
        own = sorted([r for r in got if r.query_id == i], key=lambda r: r["rank"])
        cos = {j: float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))) for j, w in rows if j != i}
        assert [r.vec_id for r in own] == sorted(cos, key=lambda j: (-cos[j], j))[:5]


def test_columns_named_like_the_results(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 3)], i, "r", 0.5, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id long, rank string, score double, class_id int")
    got = neighbours.neighbours(docs, query_every=20).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1.0000001 for r in got)


def test_neighbours_recall(spark):
    df = read(spark, SF, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute_neighbours(rows, 50, 5)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in neighbours.op10_nearest_neighbours(spark, SF).collect())
    assert hits >= 0.9 * sum(map(len, want.values()))


# -- op3 ----------------------------------------------------------------------
def test_rates_meet_the_targets(spark):
    p = np.random.default_rng(2).dirichlet([0.4] * 3, 400)
    n = np.random.default_rng(3).integers(1, 500, 400)
    thin = spark.createDataFrame([(i, 0, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p))],
                                 "doc_id long, h long, n_tokens long, p array<double>")
    target = np.array([0.5, 0.3, 0.2])
    steps, _ = mixing.fit_rates(thin, target, total=50_000.0, min_rate=0.0)
    r = mixing.rates_of(p, steps, 0.0)
    assert (r >= 0).all() and np.allclose((n * r) @ p, target * 50_000, rtol=5e-3)


@pytest.mark.parametrize("min_rate", [0.0, 1.0])
def test_rates_meet_the_target_of_a_rare_domain(spark, min_rate):
    """The last domain holds 0.1% of the tokens and shall hold 14%."""
    p = np.eye(4)[np.repeat([0, 1, 2, 3], [1300, 398, 300, 2])]
    target = np.array([0.5, 0.18, 0.18, 0.14])
    thin = spark.createDataFrame([(i, 0, 100, [float(x) for x in q]) for i, q in enumerate(p)],
                                 "doc_id long, h long, n_tokens long, p array<double>")
    steps, now = mixing.fit_rates(thin, target, total=None, min_rate=min_rate)
    totals = (100 * mixing.rates_of(p, steps, min_rate)) @ p
    assert np.allclose(totals, now) and np.allclose(totals / totals.sum(), target, atol=5e-4)


def test_steps_end_at_the_constrained_least_squares(spark):
    """Where the targets cannot be met: no nonnegative rates come nearer, by the weights of the method."""
    p = np.array([[0.8, 0.2], [0.6, 0.4], [0.7, 0.3]])
    n = np.array([10, 20, 30])
    thin = spark.createDataFrame([(i, 0, int(k), q.tolist()) for i, (k, q) in enumerate(zip(n, p))],
                                 "doc_id long, h long, n_tokens long, p array<double>")
    want = np.array([0.3, 0.7]) * 60
    with pytest.warns(UserWarning, match="targets not met"):
        steps, now = mixing.fit_rates(thin, want / 60, total=60.0, min_rate=0.0)
    size = n @ p

    def loss(r):
        return ((((n * r) @ p - want) ** 2) / size).sum()
    r = mixing.rates_of(p, steps, 0.0)
    assert np.allclose((n * r) @ p, now) and (r >= 0).all()
    grid = np.linspace(0, 4, 41)
    assert loss(r) <= min(loss(np.array([a, b, c])) for a in grid for b in grid for c in grid) + 1e-3


def test_targets_out_of_reach_are_reported(spark):
    thin = spark.createDataFrame([(1, 0, 100, [0.5, 0.5])], "doc_id long, h long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="targets not met"):
        mixing.fit_rates(thin, np.array([0.9, 0.1]), total=100.0, min_rate=0.0)


def test_mixing_odd_rows(odd, nothing, spark):
    labelled = spark.createDataFrame([(1, "en"), (6, "de"), (None, "en"), (7, None), (8, "xx")], "doc_id long, domain string")
    got = mixing.mix(odd, labelled, {"en": 0.5, "de": 0.5}, min_rate=1.0).collect()
    assert len(got) == len(TEXTS) and all(r.copies >= 1 and abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert mixing.mix(nothing, labelled, {"en": 0.5, "de": 0.5}).count() == 0


def test_domains_are_recognised(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in mixing.op3_mixing(spark, sf).collect()}
    langs = list(mixing.TARGET)
    docs = read(spark, sf, "documents").select("doc_id", "lang").collect()
    assert sum(langs[int(np.argmax(got[r.doc_id].p))] == r.lang for r in docs) >= 0.97 * len(docs)
    totals = sum(got[r.doc_id].rate * got[r.doc_id].n_tokens * np.array(got[r.doc_id].p) for r in docs)
    assert np.allclose(totals / totals.sum(), list(mixing.TARGET.values()), atol=0.01)


# -- pipeline -----------------------------------------------------------------
def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = keep(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        a, b = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(b) <= set(a)
        if name == "near_copies":
            kept = brute_near([(r.doc_id, r.text) for r in a.values()])
            assert set(b) == kept and after.count() == len(kept)
        elif name in ("repeated_passages", "mixing"):
            assert set(b) == set(a)
        elif name == "toxicity":
            assert 0.8 * len(a) <= len(b) < len(a)
        before = after
    got = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert got.count() == before.count() and "ids_sha256" in got.columns


def brute_near(texts, size=5, num=80, den=100):
    """Ids that the near-copy stage keeps: the least of each group linked by shingles of ``size`` words."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def test_near_copies_link_from_five_words_and_80_percent(spark):
    """Links between 0.80 and 0.85, and pairs just below, in words that no other pair shares."""
    def words(i, n):
        return [f"v{i}x{k}" for k in range(n)]
    texts = [(0, words(0, 500)), (1, words(0, 500) + words(1, 100))]
    scattered = words(2, 200)
    for k in (30, 70, 110, 150):
        scattered[k] = f"other{k}"
    texts += [(2, words(2, 200)), (3, scattered), (4, words(4, 500)), (5, words(4, 500) + words(5, 130))]
    texts = [(i, " ".join(w)) for i, w in texts] + [(100 + i, t) for i, t in family(60, 5)]
    assert brute_near(texts[:6]) == {0, 2, 4, 5}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got) == sorted(brute_near(texts))


@pytest.mark.parametrize("stage", [1, 2])
def test_stages_keep_rows_without_ids_apart(odd, spark, stage):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    after = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert after.where("doc_id is null").count() == 2


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_nothing_and_on_odd_rows(odd, nothing, spark, stage):
    """Nulls, empty and very long texts, copies, repeated ids and clashing columns at every stage."""
    name, fn = corpus_pipeline.STAGES[stage]
    assert fn(spark, nothing, SF).count() == 0
    after = fn(spark, odd, SF)
    ids = [r.doc_id for r in after.select("doc_id").collect()]
    if stage < 4:
        assert after.columns == list(corpus_pipeline.COLUMNS)
    if name in ("repeated_passages", "bpe"):
        assert len(ids) == len(TEXTS)
    assert {3, 4, 5, 6}.issubset(ids)  # without words, or clean and alone
    if name == "mixing":
        assert set(ids) == {i for i, _ in TEXTS} and len(ids) >= len(TEXTS)


def test_near_copies_under_one_id_are_one(spark):
    words = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(5, words), (5, words + " tail"), (5, "something else altogether"), (9, "head " + words)],
                                 "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert [r.doc_id for r in got] == [5, 5] and sum(r.text.startswith("w0 w1") for r in got) == 1
