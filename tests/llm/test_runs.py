"""op13: difference-cover extensions and runs against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from odd_rows import TEXTS

from postlens.llm import runs
from postlens.llm.common import read

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """All runs by checking every period from every start."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            y = x
            while y + p < n and words[y] == words[y + p]:
                y += 1
            if y > x and y + p - x >= max(least, 2 * p):
                out.setdefault((x, y + p - x), p)
            x = max(y, x) + 1
    return sorted((s, length, p) for (s, length), p in out.items())


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def expected(doc_id, text, found):
    words = planted(doc_id, text)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_cover():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


@pytest.mark.parametrize("letters,n", [(1, 90), (2, 200), (3, 400), (50, 300)])
def test_common_extensions(letters, n):
    rnd = np.random.default_rng(letters)
    words = rnd.integers(1, letters + 1, n)
    words[n // 2:] = words[:n - n // 2]
    words = np.append(words, 99)
    lce = runs.CommonExtensions(words)
    i, j = np.triu_indices(len(words), 1)
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while b + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        want.append(k)
    assert lce(i, j).tolist() == want


def test_runs_of_many_small_texts():
    rnd = random.Random(4)
    docs = []
    for k in range(600):
        n, letters = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 6])
        base = [rnd.randint(1, letters) for _ in range(n)]
        if k % 3 == 0 and n > 10:
            p = rnd.randint(1, n // 2)
            at = rnd.randint(0, n - 1)
            for i in range(at + p, n):
                base[i] = base[i - p]
        docs.append(base)
    for least, block in ((12, 1 << 20), (4, 37)):
        got = runs.runs_of([np.array(d, np.int64) for d in docs], least, block)
        want = [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d, least)]
        assert [tuple(r) for r in got.tolist()] == want
        assert any(r[3] > 20 for r in want)


def test_long_period_and_one_word_texts():
    rnd = random.Random(1)
    tail = [rnd.randint(1, 10 ** 6) for _ in range(2500)]
    docs = [tail * 3 + tail[:700], [7] * 9000]
    assert runs.runs_of([np.array(d, np.int64) for d in docs]).tolist() == [[0, 0, 8200, 2500], [1, 0, 9000, 1]]


def query(spark, docs, tmp):
    path = f"{tmp}/t"
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return [tuple(r) for r in runs.op13_periodic_runs(spark, path).select(*cols).collect()]


def test_query_on_documents(spark):
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, SF).select(*cols).collect()]
    want = []
    for r in read(spark, SF, "documents").collect():
        words = planted(r.doc_id, r.text)
        if len(words) > 3000:
            continue
        want.append(expected(r.doc_id, r.text, brute_runs(words)))
    ids = {w[0] for w in want}
    assert len(want) > 150 and sum(w[1] > 0 for w in want) > 10
    assert sorted(g for g in got if g[0] in ids) == sorted(want)


def test_odd_rows(spark, odd, nothing, tmp_dir):
    got = query(spark, odd, tmp_dir)
    assert len(got) == len(TEXTS)
    want = [expected(i, t, brute_runs(planted(i, t))) for i, t in TEXTS if len(t or "") < 5000]
    assert not [w for w in want if w not in got]
    empty = hashlib.sha256(b"").hexdigest()
    assert (3, 0, None, None, None, None, empty, empty) in got
    assert runs.periodic_runs(nothing).count() == 0
