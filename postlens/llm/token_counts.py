"""Token counts by overlap resynchronisation.

Texts up to ``chunk_chars`` code points are one chunk; where a single space stands
between two characters that are no white space, a pre-token ends and one starts, so
the counts of the pieces between such places add up, and repeated pieces are
encoded once.  Longer texts are encoded as overlapping chunks with offsets, and neighbouring chunks are spliced
at a proven stable common boundary: a place where the left chunk starts a
pre-token whose end decision saw at least ``margin`` more characters, and the
right chunk starts a pre-token too.  Pre-tokens are matched left to right
without looking behind and merges never cross them, so from such a place on both
chunks agree with the encoding of the whole text.  Where an overlap holds no
such place it is widened (doubled), in the end over the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postlens.llm.common import id_and_text, per_worker, read

SCHEMA = ("doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int")


def load_tokenizer(path: str):
    """The tokenizer as its file gives it, but without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def boundary_margin(tok) -> int:
    """Characters that must follow a boundary in the left chunk: special strings
    are cut out of a text first, and the longest look-ahead of the pre-token
    pattern is three characters (``'re``)."""
    special = [len(t.content) for t in tok.get_added_tokens_decoder().values()]
    return max([4, *special]) + 1


between = re.compile(r"(?<=\S) (?=\S)").split
#: A space at an end, or beside other white space.
uneven = re.compile(r"^\s|\s$|\s\s").search


class Pieces:
    """Counts texts by pieces.  The counts of the first ``size`` pieces (of up to 64
    characters) are remembered; a text's other pieces are encoded together."""

    def __init__(self, path: str, size: int = 150_000):
        self.tok, self.size, self.known = load_tokenizer(path), size, {}
        self.apart = not any(" " in t.content for t in self.tok.get_added_tokens_decoder().values()) \
            and self.tok.normalizer is None

    def encoded(self, texts: list[str]) -> list[int]:
        return list(map(len, self.tok.encode_batch_fast(texts, add_special_tokens=False)))

    def count(self, text: str) -> int:
        if not self.apart:
            return self.encoded([text])[0]
        first, *rest = between(text) if uneven(text) else text.split(" ")
        pieces = [first, *[" " + p for p in rest]]
        counts = list(map(self.known.get, pieces))
        new = [p for p, c in zip(pieces, counts) if c is None]
        total = sum(c for c in counts if c is not None) if new else sum(counts)
        if new and len(self.known) < self.size:
            found = self.encoded(new)
            self.known.update((p, c) for p, c in zip(new, found) if len(p) <= 64)
            return total + sum(found)
        return total + (self.encoded(["".join(new)])[0] if new else 0)


class Chunk:
    """One encoded chunk: token count, and where its pre-tokens start (position
    in the whole text, index of the token)."""

    def __init__(self, tok, text: str, start: int, end: int):
        enc = tok.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.n = start, end, len(enc.ids)
        self.at, self.token = [], []
        last = None
        for i, (word, span) in enumerate(zip(enc.word_ids, enc.offsets)):
            if i == 0 or word != last or word is None:
                self.at.append(start + span[0])
                self.token.append(i)
            last = word

    def token_at(self, place: int) -> int | None:
        """Index of the token that starts a pre-token at this place."""
        i = bisect_left(self.at, place)
        return self.token[i] if i < len(self.at) and self.at[i] == place else None


def splice(left: Chunk, right: Chunk, low: int, margin: int) -> int | None:
    """The first proven common boundary of two neighbouring chunks."""
    i = bisect_left(left.at, max(low, right.start))
    while i < len(left.at) and left.at[i] <= left.end - margin:
        if right.token_at(left.at[i]) is not None:
            return left.at[i]
        i += 1
    return None


def count_long(tok, text: str, chunk_chars: int, overlap_chars: int, margin: int) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of a text longer than a chunk; at most two
    encoded chunks are held at a time."""
    n, step = len(text), chunk_chars - overlap_chars
    low = total = widened = 0
    left, chunks, start = Chunk(tok, text, 0, chunk_chars), 1, step
    while left.end < n:
        right = Chunk(tok, text, start, min(n, start + chunk_chars))
        chunks += 1
        place, extra = splice(left, right, low, margin), overlap_chars
        while place is None:
            # widen: the left chunk, from its last proven boundary, reaches further right
            extra *= 2
            widened += 1
            left = Chunk(tok, text, low, min(n, start + extra))
            if left.end >= right.end:
                break
            place = splice(left, right, low, margin)
        if place is None:
            # the left chunk has swallowed the right one
            start = max(start + step, left.end - overlap_chars)
            continue
        # what the right chunk holds before the boundary is taken off once it is the left one
        total += left.token_at(place) - (left.token_at(low) or 0)
        left, low, start = right, place, max(start + step, right.end - overlap_chars)
    return total + left.n - (left.token_at(low) or 0), chunks, widened


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, chunk_chars: int = 16384,
                 overlap_chars: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit
    (n_tokens > limit), n_chunks (1: encoded whole) and n_widened.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids
    give one row each; an empty table gives an empty result.  Row-local: no
    shuffle, one text and two encoded chunks in memory.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches):
        pieces = per_worker(("pieces", path), lambda: Pieces(path))
        tok = pieces.tok
        margin = boundary_margin(tok)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = [(pieces.count(t), 1, 0) if len(t) <= chunk_chars
                   else count_long(tok, t, chunk_chars, overlap_chars, margin) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([o[0] for o in out], pa.int64()), pa.array([o[0] > limit for o in out], pa.bool_()),
                 pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    return id_and_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
