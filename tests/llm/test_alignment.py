"""op12: merge-path pieces, cached pieces and corpus counts against whole-text encodings and plain merging."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import TEXTS

from postlens.llm import alignment as al
from postlens.llm.common import read

SF = "/root/testdata/sf0.001"
ODD = ["the", " ", "  ", "\n", "\n\n", "é", "é", "日本語", "<|endoftext|>", "</s>", "<0x41>", "12", "!!!", "a" * 70, "\t",
       "𝔘", "'", "'re", "\x1c", "\xa0", "　", "क्षि", "naïve", " x", "▁", "\x00", "᠎"]


@pytest.fixture(scope="module")
def vocab():
    return al.Vocabularies(*al.paths(None, None))


def brute_overlaps(a, b):
    out, i, j = [], 0, 0
    while i < len(a):
        e = min(a[i], b[j])
        both = a[i] == b[j]
        out.append((e, i, j, int(both)))
        i, j = i + (a[i] == e), j + (b[j] == e)
    return out


@pytest.mark.parametrize("work", [1, 2, 3, 7, 50, 1 << 16])
def test_pieces_are_stitched(work):
    rnd = random.Random(work)
    for _ in range(60):
        n = rnd.randint(1, 150)
        a, b = (np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(1, n))})) for _ in range(2))
        i, j = al.crossings(a, b, work)
        assert set(np.diff(i + j)[:-1].tolist()) <= {work} and i[-1] == len(a) and j[-1] == len(b)
        assert [tuple(x) for x in al.overlaps(a, b, work).T.tolist()] == brute_overlaps(a.tolist(), b.tolist())
    assert al.overlaps(np.zeros(0, np.int64), np.zeros(0, np.int64), work).shape == (4, 0)


def whole(vocab, text):
    """(A ids, B ids, groups) by whole-text encodings and a plain merge."""
    if not text:
        return [], [], []
    a = vocab.a.encode(" " + text, add_special_tokens=False).ids
    b = vocab.b.encode(text, num_threads=1)
    want = b" " + text.encode()
    if b"".join(vocab.a_bytes[k] for k in a) != want or b"".join(vocab.b_bytes[k] for k in b) != want:
        return [], [], []
    ends = [np.cumsum([len(e[k]) for k in ids]).tolist() for e, ids in ((vocab.a_bytes, a), (vocab.b_bytes, b))]
    return a, b, [(i + 1, j + 1, e) for e, i, j, common in brute_overlaps(*ends) if common]


def brute(vocab, rows):
    docs = [(i, *whole(vocab, t)) for i, t in rows]
    n = Counter((a[i - 1], b[j - 1]) for _, a, b, g in docs for i, j, _ in g)
    top = Counter()
    for (_, y), k in n.items():
        top[y] = max(top[y], k)
    out = []
    for i, a, b, g in docs:
        text, x, y = [], 0, 0
        for p, q, _ in g:
            text.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        links = [(a[p - 1], b[q - 1]) for p, q, _ in g]
        out.append((i, len(a), len(b), len(g), len(links), sum(n[k] == top[k[1]] for k in links),
                    sum(n[k] for k in links), hashlib.sha256(";".join(text).encode()).hexdigest() if g else ""))
    return out


def strings(n, seed):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(0, 60)))
            for _ in range(n)]


def test_cached_pieces_equal_whole_texts(vocab):
    store = al.Pieces(vocab, room=900)
    texts = strings(400, 3) + [t.replace("▁", "") for t in strings(400, 4)]
    tokens = 0
    for k in range(0, len(texts), 40):
        part = texts[k:k + 40]
        got = al.Aligned(store, part, work=64)
        for side in (0, 1):
            bounds = np.append(0, np.cumsum(got.tokens[side]))
            for d, t in enumerate(part):
                assert got.ids[side][bounds[d]:bounds[d + 1]].tolist() == whole(vocab, t)[side], repr(t)
        tokens += len(got.ids[0])
    assert tokens > 5000


def test_pairs_hold_all_links(vocab):
    pairs = vocab.pairs()
    assert len(pairs) < 1_000_000 and (np.diff(pairs) > 0).all()


def same(df, rows, vocab):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in al.link_strength(df, work=500).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(brute(vocab, rows), key=str)
    return got


def test_documents(spark, vocab):
    docs = read(spark, SF, "documents")
    got = same(docs, [(r.doc_id, r.text) for r in docs.collect()], vocab)
    assert any(0 < r[5] < r[4] for r in got)


def test_odd_rows(spark, odd, nothing, vocab):
    same(odd, TEXTS, vocab)
    assert al.link_strength(nothing).count() == 0
    rows = [(k, t) for k, t in enumerate(strings(120, 8))]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows, vocab)


def test_groups_as_rows(odd, vocab):
    got = sorted([(r.doc_id, r.a_ids, r.b_ids, [tuple(g) for g in r.groups]) for r in al.align_tokens(odd).collect()], key=str)
    assert got == sorted([(i, *whole(vocab, t)) for i, t in TEXTS], key=str)


def test_links_are_counted_by_batch(spark, monkeypatch):
    """One pass over the totals for many documents: the counts of a batch are those of its documents."""
    docs = [[k % 7, 3, 3, k % 11] * (k % 3) for k in range(500)]
    rows = [(k, np.array(x, "<i4").tobytes()) for k, x in enumerate(docs)]
    want = Counter(x for own in docs for x in own)
    got = al.pair_counts(spark.createDataFrame(rows, "doc_id long, links binary").coalesce(1), 1000)
    assert {k: v for k, v in enumerate(got.tolist()) if v} == dict(want)

    table = pa.array([x for _, x in rows], pa.binary())
    for part in (table, table[123:400], table[5:5], pa.array([b""] * 3, pa.binary()), pa.array([], pa.binary())):
        own, at = al.numbers_of(part)
        assert [own[lo:hi].tolist() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())] \
            == [np.frombuffer(x.as_py(), "<i4").tolist() for x in part]

    calls, plain = [], np.bincount
    monkeypatch.setattr(al, "COUNTED", 100)
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(len(a[0])) or plain(*a, **b))
    out, = al.counted([pa.record_batch([table], ["links"])], 1000)
    assert dict(zip(*out.to_pydict().values())) == dict(want)
    assert len(calls) <= sum(want.values()) // 100 + 1
