"""op1 and op7 against the tokenizers library, and the parts of their methods."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from odd_rows import TEXTS

from postlens.llm import bpe, token_counts
from postlens.llm.common import read

SF = "/root/testdata/sf0.001"
PIECES = ["the", "'re", "'s", " ", "  ", "\n\n", "é", "é", "ñ", "日本語", "<|endoftext|>", "<|endof", "text|>", "12",
          "!!!", "a" * 70, "\t", "𝔘", "'", "r e", "Σ", "İ", "\x1c", "\xa0", "क्षि", "#$%"]


def strings(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 150))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_tok():
    return token_counts.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_tok():
    return token_counts.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_splices_equal_the_whole(byte_tok):
    margin, widened = token_counts.boundary_margin(byte_tok), 0
    for i, text in enumerate(strings(300)):
        text += "x" * (i % 7) * 40
        if len(text) > 64:
            n, chunks, w = token_counts.count_long(byte_tok, text, 64, 16, margin)
            widened += w
            assert n == len(byte_tok.encode(text, add_special_tokens=False).ids)
            assert chunks > 1
    assert widened > 0


def test_pieces_add_up(byte_tok):
    pieces = token_counts.Pieces(public_tokenizers.path("byte_bpe_50k.json"), size=200)
    for text in strings(600, seed=6):
        assert pieces.count(text) == len(byte_tok.encode(text, add_special_tokens=False).ids)


def test_count_tokens_odd_rows(odd, nothing, byte_tok):
    got = token_counts.count_tokens(odd, chunk_chars=4096, overlap_chars=64).collect()
    want = [(i, len((t or "").encode()), len(byte_tok.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and any(r.n_widened for r in got)
    assert token_counts.count_tokens(nothing).count() == 0


def test_lookahead_is_enough():
    """Tokens of a prefix that end before the lookahead never change, whatever follows."""
    m = bpe.MergeList(public_tokenizers.path("word_bpe_49k.json"))
    assert 0 < m.lookahead < 2000
    rnd = random.Random(2)
    for _ in range(30):
        text = "".join(rnd.choice("abcdeinthrso") for _ in range(m.lookahead + 300))
        symbols = [m.symbol[b] for b in text.encode()]
        at = len(symbols) - 100
        a, b = bpe.merge_all(symbols[:at], m), bpe.merge_all(symbols, m)
        same = size = 0
        while same < len(a) and size + len(m.text_of[a[same]]) <= at - m.lookahead:
            size += len(m.text_of[a[same]])
            same += 1
        assert a[:same] == b[:same]


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([("a", "b")]) == 2
    # what follows a b can free the a for the merge before it
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b"), ("x", "a")]) > bpe.sufficient_lookahead([("b", "c")])
    assert bpe.sufficient_lookahead([("ab", "c"), ("a", "b")]) is None


@pytest.mark.parametrize("block,window", [(5, 3), (16, 8), (1 << 16, 4096)])
def test_streaming_equals_library(word_tok, block, window):
    m = bpe.MergeList(public_tokenizers.path("word_bpe_49k.json"))
    enc = bpe.Encoder(m, block=block, window=window)
    rnd = random.Random(9)
    for k, text in enumerate(strings(150, seed=block)):
        if k % 5 == 0:
            text += "".join(rnd.choice("abcdeinthr") for _ in range(900))
        ids, pieces = [], []
        out = lambda a, b: (ids.append(a), pieces.append(b))
        enc.feed(text, out)
        enc.finish(out)
        want = word_tok.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(b"".join(ids), "<u4").tolist()
        assert got == want
        assert b"".join(pieces)[1:].decode() == word_tok.decode(want, skip_special_tokens=False)
        dec = bpe.Decoder(m)
        assert "".join(dec.push(got[i:i + 3]) for i in range(0, len(got), 3)) + dec.finish() \
            == word_tok.decode(want, skip_special_tokens=False)


def test_text_decoder_joins_split_characters(word_tok):
    m = bpe.MergeList(public_tokenizers.path("word_bpe_49k.json"))
    ids = word_tok.encode("日本語 𝔘 café", add_special_tokens=False).ids
    dec = bpe.Decoder(m, mode="text")
    assert "".join(dec.push([i]) for i in ids) + dec.finish() == "日本語 𝔘 café "


def test_encode_decode_rows(odd, nothing, spark, word_tok):
    for docs, texts in ((odd, TEXTS), (read(spark, SF, "documents"), None)):
        texts = texts or [(r.doc_id, r.text) for r in docs.collect()]
        want = []
        for i, t in texts:
            ids = word_tok.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(word_tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted([tuple(r) for r in bpe.encode_decode(docs).collect()], key=str) == sorted(want, key=str)
    assert bpe.encode_decode(nothing).count() == 0


def test_cache_keeps_what_is_in_use():
    made = []
    cache = bpe.Words(lambda w: made.append(w) or (w,), 8)
    for k in range(40):
        assert cache["often"] == ("often",) and cache[f"once{k}"] == (f"once{k}",)
    assert made.count("often") == 1 and len(cache) <= 4 and len(cache.older) <= 4
    assert cache["x" * 65] == ("x" * 65,) and "x" * 65 not in cache


def test_workers_let_go_of_what_other_operators_left(spark, odd):
    """The encoder's caches stay for its own tasks and go with another operator's."""
    from postlens.llm.bpe import encode_decode
    from postlens.llm.common import as_bytes, id_and_text, keep, text_hash
    from postlens.llm.similarity import set_rows

    def held(batches):
        import os
        import sys

        import pyarrow as pa
        for batch in batches:
            store = vars(sys.modules["_postlens_worker_store"]) if "_postlens_worker_store" in sys.modules else {}
            keys = [str(k) for k in store if isinstance(k, tuple) and k[0] == "encoder"]
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([len(keys)], pa.int64())], names=["pid", "n"])

    def holders():
        return {r.pid for r in spark.range(64).repartition(32).mapInArrow(held, "pid long, n long").collect() if r.n}

    def spread(df):
        return df.repartition(32)

    keep(encode_decode(spread(odd)), "encoded")
    keep(encode_decode(spread(odd)), "encoded")
    before = holders()
    assert before
    texts = as_bytes(id_and_text(spread(odd))).withColumn("h", text_hash())
    for _ in range(4):
        keep(set_rows(texts, 85, 100), "sets")
    assert len(holders()) < len(before)
