"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenisations of the same bytes are two rising lists of token ends; aligning them
is merging the lists.  The path of that merge is cut where it crosses diagonals that
are ``work`` merge steps apart, found for all diagonals at once by binary search, so
every piece has the same number of steps and needs nothing of the others.  A piece emits
the overlaps of its A and B tokens: one for each distinct end in it.  An end that both
lists hold may fall on both sides of a cut; it is then the last of one piece and the
first of the next, and stitching joins the two.  Ends held by both lists close the
groups: the shortest spans that both tokenisations cut out of the text.

Texts are encoded by pieces between single spaces, which no token of either vocabulary
crosses, and a piece's ids are remembered in each worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.bpe import byte_alphabet
from postlens.llm.common import id_and_text, keep, per_worker, read
from postlens.llm.token_counts import load_tokenizer

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Merge steps of a piece, and characters of the documents that are aligned together.
WORK, CHUNK_CHARS = 1 << 16, 1 << 19
#: Links that a task counts at once.
COUNTED = 1 << 20
SPACE = "▁"
LINK_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted lists (equal values: a first) crosses every
    ``work``-th diagonal, both ends of the path included: how much of a and of b it has
    taken there."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, d - low
        mid = (low[open_] + high[open_]) // 2
        further = a[mid] <= b[d[open_] - 1 - mid]
        low[open_[further]] = mid[further] + 1
        high[open_[~further]] = mid[~further]


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
    """The overlaps of one piece of the merge: rows (end, A token, B token, is a common end)."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    ends = np.concatenate([own_a, own_b])
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    i, j = np.searchsorted(own_a, ends), np.searchsorted(own_b, ends)
    common = np.zeros(len(ends), bool)
    inside = np.flatnonzero((i < len(own_a)) & (j < len(own_b)))
    common[inside] = own_a[i[inside]] == own_b[j[inside]]
    return np.stack([ends, i + i0, j + j0, common])


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> np.ndarray:
    """All overlaps of two tokenisations given by their token ends (rising, the last ones
    equal): columns (end, A token, B token, is a common end), by end.  Piece by piece,
    then stitched."""
    i, j = crossings(a, b, work)
    parts = [piece(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    parts = [p for p in parts if p.shape[1]]
    for left, k in zip(parts, range(1, len(parts))):
        if left.shape[1] and left[0, -1] == parts[k][0, 0]:
            # the cut went between the two holders of one end
            left[3, -1] = 1
            parts[k] = parts[k][:, 1:]
    return np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size], one after the other."""
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


between = re.compile(r"(?<=\S) (?=\S)").split
uneven = re.compile(r"^\s|\s$|\s\s").search


def cut(text: str) -> list[str]:
    """Pieces of a text such that both tokenisations of space + text are those of space +
    piece, one after the other: cut at single spaces between two other characters.  Text
    that holds the space mark itself is one piece."""
    if SPACE in text:
        return [text]
    return between(text) if uneven(text) else text.split(" ")


class Vocabularies:
    """Both tokenizers, the bytes of their entries, and the id pairs that can end together."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = load_tokenizer(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: bytes([k]) for k, c in byte_alphabet().items()}
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = b"".join(byte.get(c, c.encode()) for c in entry)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode()
                        for k, p in enumerate(pieces)]
        # cutting at spaces is safe only if no entry holds a space behind another character
        if any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.b_bytes):
            raise ValueError("an entry of the second vocabulary crosses words")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def pairs(self) -> np.ndarray:
        """All id pairs (a * size of B + b, rising) whose entries can end together: then one's
        bytes end with the other's, so there are no more of them than bytes in both vocabularies
        (times the ids with equal bytes)."""
        n, found = len(self.b_bytes), set()
        for own, others, key in ((self.a_bytes, self.b_bytes, lambda x, y: x * n + y),
                                 (self.b_bytes, self.a_bytes, lambda x, y: y * n + x)):
            ids: dict[bytes, list[int]] = {}
            for y, entry in enumerate(others):
                ids.setdefault(entry, []).append(y)
            for x, entry in enumerate(own):
                for at in range(len(entry)):
                    found.update(key(x, y) for y in ids.get(entry[at:], ()))
        return np.array(sorted(found), np.int64)


class Pieces:
    """Ids of pieces under both tokenizers.  Up to ``room`` tokens are remembered; beyond,
    the pieces that were met most often stay."""

    def __init__(self, vocab: Vocabularies, room: int = 3_000_000):
        self.v, self.room = vocab, room
        self.pairs = vocab.pairs()
        self.number: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        # of each piece: where its ids start, how many they are, times met, whether the bytes come out equal
        self.ids, self.start, self.size = [none, none], [none, none], [none, none]
        self.met, self.equal = none, np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        v = self.v
        found = ([e.ids for e in v.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)],
                 v.b.encode(new, num_threads=1))
        for side, lists in enumerate(found):
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            self.start[side] = np.append(self.start[side], np.cumsum(size) - size + len(self.ids[side]))
            self.size[side] = np.append(self.size[side], size)
            self.ids[side] = np.append(self.ids[side], np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())))
        same = [b"".join([v.a_bytes[k] for k in a]) == want == b"".join([v.b_bytes[k] for k in b])
                for a, b, want in zip(*found, [b" " + p.encode() for p in new])]
        self.equal = np.append(self.equal, same)
        self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.number.update((p, k) for k, p in enumerate(new, len(self.number)))

    def forget(self) -> None:
        """Keep the pieces met most often, up to half of the room."""
        total = self.size[0] + self.size[1]
        order = np.argsort(-self.met, kind="stable")
        stay = np.sort(order[np.cumsum(total[order]) <= self.room // 2])
        place = np.full(len(total), -1)
        place[stay] = np.arange(len(stay))
        self.number = {p: int(place[k]) for p, k in self.number.items() if place[k] >= 0}
        for side in (0, 1):
            size = self.size[side][stay]
            self.ids[side] = ragged(self.ids[side], self.start[side][stay], size)
            self.start[side], self.size[side] = np.cumsum(size) - size, size
        self.met, self.equal = self.met[stay] // 2, self.equal[stay]

    def numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.ids[0]) + len(self.ids[1]) > self.room:
            self.forget()
        new = list(dict.fromkeys([p for p in pieces if p not in self.number]))
        if new:
            self.learn(new)
        out = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self.met += np.bincount(out, minlength=len(self.met))
        return out


class Aligned:
    """The alignment of some documents: ids (A, B) of all their tokens, how many tokens each
    document has, the last A and B token of each group, its end, and groups a document."""

    def __init__(self, store: Pieces, texts: list[str], work: int = WORK):
        v = store.v
        cuts = [cut(t) if t else [] for t in texts]
        numbers = store.numbers(list(chain.from_iterable(cuts)))
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        # documents that a tokenizer does not give back byte by byte have no tokens
        for d in np.unique(doc[~store.equal[numbers]]).tolist():
            own = numbers[doc == d]
            want = b" " + texts[d].encode()
            for side, entries in enumerate((v.a_bytes, v.b_bytes)):
                ids = ragged(store.ids[side], store.start[side][own], store.size[side][own])
                if b"".join([entries[k] for k in ids.tolist()]) != want:
                    numbers, doc = numbers[doc != d], doc[doc != d]
                    break
        self.ids, self.tokens, ends = [], [], []
        for side, sizes in enumerate((v.a_size, v.b_size)):
            size = store.size[side][numbers]
            ids = ragged(store.ids[side], store.start[side][numbers], size)
            self.ids.append(ids)
            self.tokens.append(np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64))
            ends.append(np.cumsum(sizes[ids]))
        self.overlaps = overlaps(*ends, work)
        self.end, self.a_last, self.b_last = self.overlaps[:3, self.overlaps[3] == 1]
        self.first_token = [np.cumsum(n) - n for n in self.tokens]
        bounds = np.searchsorted(self.a_last, np.append(self.first_token[0], len(self.ids[0])))
        self.group_bounds, self.groups = bounds, np.diff(bounds)

    def links(self, pairs: np.ndarray, n_b: int) -> np.ndarray:
        """Of each group the number of its linked id pair: the tokens that end it."""
        return np.searchsorted(pairs, self.ids[0][self.a_last] * n_b + self.ids[1][self.b_last])

    def group_texts(self) -> Iterator[memoryview]:
        """Of each document its groups as `a1,a2|b1;a3|b2,b3`."""
        n = [len(x) for x in self.ids]
        last = [np.zeros(k, bool) for k in n]
        last[0][self.a_last] = last[1][self.b_last] = True
        group = [np.cumsum(x) - x for x in last]
        # tokens by group, A before B
        ids, mark = np.empty(sum(n), np.int64), np.empty(sum(n), np.uint8)
        place = [np.arange(n[0]) + np.append(0, self.b_last + 1)[group[0]],
                 np.arange(n[1]) + (self.a_last + 1)[group[1]]]
        for side, close in enumerate(b"|;"):
            ids[place[side]] = self.ids[side]
            mark[place[side]] = np.where(last[side], close, ord(","))
        powers = 10 ** np.arange(10, dtype=np.int64)
        digits = np.ones(len(ids), np.int64)
        for power in powers[1:][powers[1:] <= ids.max(initial=0)]:
            digits += ids >= power
        start = np.cumsum(digits + 1) - digits - 1
        out = np.empty(int((digits + 1).sum()), np.uint8)
        out[start + digits] = mark
        for k in range(int(digits.max(initial=0))):
            some = np.flatnonzero(digits > k)
            out[start[some] + k] = ord("0") + ids[some] // powers[digits[some] - 1 - k] % 10
        bounds = np.append(start, len(out))[np.append(0, np.cumsum(self.tokens[0] + self.tokens[1]))]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield memoryview(out)[lo:max(lo, hi - 1)]


def chunks(batches, a_path: str, b_path: str, work: int):
    """(ids of the documents, store of pieces, alignment) of a task's documents, some together."""
    store = per_worker(("aligned pieces", a_path, b_path), lambda: Pieces(Vocabularies(a_path, b_path)))
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= CHUNK_CHARS:
                yield ids, store, Aligned(store, texts, work)
                ids, texts, size = [], [], 0
        if ids:
            yield ids, store, Aligned(store, texts, work)


def paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, work: int = WORK,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both tokenisations of space + text and the groups they share: doc_id, a_ids, b_ids, and
    groups (a_end, b_end: tokens up to the group's end; byte_end: bytes of space + text up to it).

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
    tokens and no groups; special strings inside texts are plain text.  Repeated rows and null
    ids give one row each, an empty table an empty result.  Row-local; memory holds about
    ``CHUNK_CHARS`` characters at a time (or one longer document) and a bounded store of pieces.
    """
    a_path, b_path = paths(a_path, b_path)

    def work_on(batches):
        for ids, _, al in chunks(batches, a_path, b_path, work):
            offsets = [pa.array(np.append(0, np.cumsum(n)), pa.int32()) for n in (*al.tokens, al.groups)]
            lists = [pa.ListArray.from_arrays(o, pa.array(x.astype(np.int32))) for o, x in zip(offsets, al.ids)]
            base = np.append(0, al.end)[al.group_bounds[:-1]]
            columns = [x - np.repeat(y, al.groups) for x, y in
                       ((al.a_last + 1, al.first_token[0]), (al.b_last + 1, al.first_token[1]), (al.end, base))]
            groups = pa.StructArray.from_arrays(list(map(pa.array, columns)), names=["a_end", "b_end", "byte_end"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *lists, pa.ListArray.from_arrays(offsets[2], groups)],
                names=["doc_id", "a_ids", "b_ids", "groups"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        work_on, "doc_id long, a_ids array<int>, b_ids array<int>, "
                 "groups array<struct<a_end: long, b_end: long, byte_end: long>>")


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, work: int = WORK,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token and group counts, the digest of its groups, and the links as numbers of
    id pairs (little-endian 32-bit).  Rows as in ``align_tokens``; without tokens the digest is ''."""
    a_path, b_path = paths(a_path, b_path)

    def work_on(batches):
        for ids, store, al in chunks(batches, a_path, b_path, work):
            numbers = al.links(store.pairs, len(store.v.b_bytes)).astype("<i4").tobytes()
            at = (4 * al.group_bounds).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *map(pa.array, (*al.tokens, al.groups)),
                 pa.array([hashlib.sha256(t).hexdigest() if len(t) else "" for t in al.group_texts()], pa.string()),
                 pa.array([numbers[lo:hi] for lo, hi in zip(at[:-1], at[1:])], pa.binary())],
                names=[c.split()[0] for c in LINK_SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(work_on, LINK_SCHEMA)


def numbers_of(links: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The pair numbers of some documents, one after the other, and where each document's begin and end."""
    _, offsets, data = links.buffers()
    at = np.frombuffer(offsets, np.int32)[links.offset:links.offset + len(links) + 1] if len(links) else np.zeros(1, np.int32)
    own = np.frombuffer(data or b"", "<i4", (at[-1] - at[0]) // 4, at[0]) if at[-1] > at[0] else np.zeros(0, "<i4")
    return own, (at - at[0]) // 4


def counted(batches, n_pairs: int) -> Iterator[pa.RecordBatch]:
    """A task's links by id pair.  It goes through its total once for about ``COUNTED`` links, not
    once for each document."""
    total = np.zeros(n_pairs, np.int64)
    for batch in batches:
        own, _ = numbers_of(batch.column("links"))
        for k in range(0, len(own), COUNTED):
            total += np.bincount(own[k:k + COUNTED], minlength=n_pairs)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])


def pair_counts(links: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of all documents hold each id pair.  Tasks send their counts, Spark adds them
    up; the result has at most one number for each pair that the vocabularies allow."""

    def count(batches):
        return counted(batches, n_pairs)

    out = np.zeros(n_pairs, np.int64)
    sums = links.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return out


def link_strength(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, work: int = WORK,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of every whole text and how it agrees with the corpus: doc_id, n_a, n_b,
    n_groups, n_links (A and B tokens that end together), n_best (links whose id pair is the
    most frequent one of its B id in all documents, ties included), count_sum (corpus-wide
    counts of the pairs, over links) and groups_sha256.

    Rows as in ``align_tokens``.  Texts are encoded once; the links are written as numbers of id
    pairs and read twice.  What is broadcast is one count for each pair that the two
    vocabularies allow, whatever the corpus.
    """
    a_path, b_path = paths(a_path, b_path)
    vocab = Vocabularies(a_path, b_path)
    pairs, n_b = vocab.pairs(), len(vocab.b_bytes)
    links = keep(linked(docs, a_path, b_path, work, id_col, text_col), "links")
    counts = pair_counts(links, len(pairs))
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pairs % n_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[pairs % n_b]))

    def look_up(batches):
        n, best = shared.value
        for batch in batches:
            own, at = numbers_of(batch.column("links"))
            sizes, sums, bests = np.diff(at), *(np.diff(np.append(0, np.cumsum(x[own], dtype=np.int64))[at]) for x in (n, best))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
                + [pa.array(x, pa.int64()) for x in (sizes, bests, sums)] + [batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return links.mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                     "count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_strength(read(spark, sf_dir, "documents"))
