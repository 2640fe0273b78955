"""BPE encoding and decoding as streaming transducers.

Encoder.  The merge list is read once and its *sufficient lookahead* computed:
the most symbols by which text still to come can change tokens that are already
known.  Two encodings of a prefix, with different text behind it, agree from the
left up to a place D that starts at the end of the prefix.  Applying merge t
moves D only if t joins a token c that ends at D with one that starts there; D
then moves left by len(c).  The next merge that moves D has a higher rank and its
right part starts, as a derivation, with c.  So the farthest move is the heaviest
chain of merges with rising ranks, found in one pass over the list
(``sufficient_lookahead``).  Tokens that end farther than that from the end of
what was read are stable and can be emitted.  Input is taken in blocks cut at
safe places, so besides the caller's text a bounded buffer is held.

Decoder.  ``Decoder`` takes ids piece by piece and turns bytes into text with an
incremental UTF-8 state machine, so a character split over tokens waits for its
rest and memory stays constant.
"""

from __future__ import annotations

import codecs
import heapq
import hashlib
import json
import struct
import unicodedata
from functools import cached_property, lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, normalizers, pre_tokenizers

from postlens.llm.common import id_and_text, per_worker, read, release_worker

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write it as:
    printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeList:
    """Vocabulary and ranked merges of a byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.letters = byte_alphabet()
        # pairs of ids packed into one integer -> rank, and the id that the merge of a rank makes
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(self.merges)}
        self.made = [self.vocab[a + b] for a, b in self.merges]
        self.symbol = {b: self.vocab[c] for b, c in self.letters.items()}
        self.final = {b: self.vocab[c + self.suffix] for b, c in self.letters.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = split["pattern"]["Regex"]
        self.text_of = {i: s for s, i in (self.vocab | self.special).items()}

    @cached_property
    def lookahead(self) -> int | None:
        return sufficient_lookahead(self.merges)


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int | None:
    """Most symbols before the end of a prefix whose tokens later text can still
    change, or None if a merge uses a token that only a later merge makes (then
    the argument of the module text does not hold and nothing is emitted early)."""
    made, reach = {}, {}
    far = 0
    for a, b in merges:
        # the tokens that b starts with, b itself included
        best, t = 0, b
        while t is not None:
            best = max(best, reach.get(t, 0))
            t = made[t][0] if t in made else None
        moved = best + len(a)
        reach[a] = max(reach.get(a, 0), moved)
        far = max(far, moved)
        made.setdefault(a + b, (a, b))
    later = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
    for i, (a, b) in enumerate(merges):
        if later.get(a, -1) > i or later.get(b, -1) > i:
            return None
    return far + 1


def merge_all(symbols: list[int], merges: MergeList) -> list[int]:
    """The token ids of a symbol sequence: lowest rank first, leftmost first."""
    rank, made, none = merges.rank.get, merges.made, len(merges.made)
    if len(symbols) <= 64:
        word = list(symbols)
        ranks = [rank(a << 32 | b, none) for a, b in zip(word, word[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            word[i] = made[low]
            del word[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(word[i - 1] << 32 | word[i], none)
            if i < len(ranks):
                ranks[i] = rank(word[i] << 32 | word[i + 1], none)
        return word
    sym, n = list(symbols), len(symbols)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (r := rank(a << 32 | b, none)) < none]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = nxt[i] if sym[i] >= 0 else -1
        if j < 0 or rank(sym[i] << 32 | sym[j], none) != r:
            continue
        sym[i], sym[j], nxt[i] = made[r], -1, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for a, b in ((prev[i], i), (i, nxt[i])):
            if a >= 0 and b >= 0 and (x := rank(sym[a] << 32 | sym[b], none)) < none:
                heapq.heappush(heap, (x, a))
    return [s for s in sym if s >= 0]


@lru_cache(maxsize=1)
def composing() -> frozenset[str]:
    """Characters that may join with what stands before them under NFC."""
    out = set()
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.combining(c):
            out.add(c)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            out.update(chr(int(x, 16)) for x in d.split()[1:])
    return frozenset(out | {chr(x) for x in (*range(0x1160, 0x1200), *range(0x11A8, 0x1200))})


controls = regex.compile("[\x1c-\x1f]").search


class Words(dict):
    """Bounded cache of what ``make`` gives for a key (of up to 64 code points),
    in two generations: when the younger one is full it becomes the older one, and what is
    asked for again moves back, so words in use stay and words not met again go."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, w: str) -> tuple[bytes, bytes]:
        hit = self.older.get(w)
        if hit is None:
            hit = self.make(w)
        if len(w) <= 64:
            if 2 * len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[w] = hit
        return hit


#: Characters whose classes every Unicode version of the last ten years agrees on;
#: text with others is normalised and split by the library's own tables.
COMMON = "\\x00-\u052f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bd\u2100-\u2bff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\ufe00-\uffef"


class Encoder:
    """Streaming encoder: ``feed`` text blocks, ``finish``; emits through ``out``,
    a function that gets (id bytes, decoded bytes, token count).

    What it holds: a carry of at most ``block`` code points, a run buffer of at
    most ``window + lookahead`` symbols, and caches of at most ``cache_size``
    words and as many pre-tokens, of at most 64 code points.
    """

    def __init__(self, merges: MergeList, block: int = 1 << 16, window: int = 4096, cache_size: int = 300_000):
        self.m, self.block, self.window = merges, block, window
        self.look = merges.lookahead
        self.find = regex.compile(merges.pattern, regex.V0).findall
        self.iterate = regex.compile(merges.pattern, regex.V0).finditer
        self.run_of = {"L": regex.compile(r"\p{L}+").match, "S": regex.compile(r"[^\s\p{L}\p{N}]+").match}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True))) \
            if merges.special else None
        self.hold = max([len(s) for s in merges.special], default=1) - 1
        self.cache = Words(self.spaced, cache_size)
        # pre-tokens are met in more places than the words they stand in
        self.heads = Words(self.word, cache_size)
        self.rare = regex.compile(f"[^{COMMON}]").search
        split = pre_tokenizers.Split(Regex(merges.pattern), "removed", invert=True)
        self.library_find = lambda text: [w for w, _ in split.pre_tokenize_str(text)]
        self.library_lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.reset()

    def reset(self) -> None:
        self.raw = ""        # read, not yet searched for special strings
        self.carry = ""      # plain text, not yet normalised
        self.run = None      # kind of an open long run, "L" or "S"
        self.symbols: list[int] = []  # of the open run, but for its newest character
        self.last = ""

    # -- output ---------------------------------------------------------------
    def tokens(self, ids: list[int]) -> tuple[bytes, bytes]:
        text_of = self.m.text_of
        return struct.pack(f"<{len(ids)}I", *ids), "".join([" " + text_of[i] for i in ids]).encode()

    def word(self, w: str) -> list[int]:
        """Ids of a whole pre-token: its letters, the last with the suffix, merged."""
        raw = w.encode()
        return merge_all([*map(self.m.symbol.__getitem__, raw[:-1]), self.m.final[raw[-1]]], self.m)

    def spaced(self, w: str) -> tuple[bytes, bytes]:
        """Ids and decoded pieces of what stands between two spaces: one or more whole pre-tokens."""
        find = self.find if w.isascii() or not self.rare(w) else self.library_find
        return self.tokens([i for part in find(w) for i in self.heads[part]])

    # -- input ----------------------------------------------------------------
    def feed(self, text: str, out) -> None:
        """Take the next part of the text."""
        for lo in range(0, len(text), self.block):
            self.raw += text[lo:lo + self.block]
            self.cut_specials(out, final=False)

    def finish(self, out) -> None:
        self.cut_specials(out, final=True)
        self.reset()

    def cut_specials(self, out, final: bool) -> None:
        at = 0
        if self.specials and "<" in self.raw:
            for hit in self.specials.finditer(self.raw):
                self.plain(self.raw[at:hit.start()], out, final=True)
                out(self.m.special[hit[0]].to_bytes(4, "little"), b" " + hit[0].encode())
                at = hit.end()
        rest = self.raw[at:]
        # a special string may have begun in what is held back
        held = 0
        if not final and self.specials:
            tail = rest[-self.hold:] if self.hold else ""
            cut = next((i for i in range(len(tail)) if any(s.startswith(tail[i:]) for s in self.m.special)), None)
            held = len(tail) - cut if cut is not None else 0
        self.raw = rest[len(rest) - held:] if held else ""
        self.plain(rest[:len(rest) - held], out, final)

    def plain(self, text: str, out, final: bool) -> None:
        """Text without special strings; final: nothing that could join follows.
        Otherwise the carry is cut at its last space, or else at its last place
        where NFC cannot join the two sides."""
        self.carry += text
        if final:
            block, self.carry = self.carry, ""
            self.normalised(self.lower(block), out, True)
        elif len(self.carry) > self.block:
            end = self.carry.rfind(" ", 1)
            spaced = end > 0
            if not spaced:
                end = next((i for i in range(len(self.carry) - 1, 0, -1) if self.carry[i] not in composing()), 0)
            if end > 0:
                block, self.carry = self.carry[:end], self.carry[end:]
                self.normalised(self.lower(block), out, spaced)

    def lower(self, text: str) -> str:
        """NFC, then each character's own lower case (no context rule for the final sigma)."""
        if text.isascii():
            return text.lower()
        if self.rare(text):
            return self.library_lower(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normalised(self, text: str, out, complete: bool) -> None:
        """Pre-tokens of normalised text; complete: none of them goes on behind it."""
        if self.run:
            hit = self.run_of[self.run](text)
            n = hit.end() if hit else 0
            self.push(text[:n], out)
            if n == len(text) and not complete:
                return
            self.close(out)
            text = text[n:]
        if complete:
            self.whole(text, out)
            return
        # the last pre-tokens may go on in the next block; those that end 4 characters before are fixed
        done, open_at = 0, None
        for hit in self.iterate(text):
            if hit.end() > len(text) - 4:
                open_at = hit.start()
                break
            done = hit.end()
        if open_at is None:
            self.whole(text, out)
            return
        self.whole(text[:done], out)
        tail = text[open_at:]
        kind = "L" if self.run_of["L"](tail) else "S" if self.run_of["S"](tail) else None
        if len(tail) > 64 and kind and self.run_of[kind](tail).end() == len(tail):
            self.run = kind
            self.push(tail, out)
        else:
            self.carry = tail + self.carry  # lower case and NFC already; both again change nothing

    def whole(self, text: str, out) -> None:
        # white space never lies inside a pre-token; str.split also cuts at four control characters, which are none
        parts = regex.findall(r"\S+", text) if controls(text) else text.split()
        got = list(map(self.cache.__getitem__, parts))
        if got:
            out(b"".join([g[0] for g in got]), b"".join([g[1] for g in got]))

    # -- a run longer than a block ---------------------------------------------
    def push(self, text: str, out) -> None:
        """More of the open run.  Its newest character is kept apart, as it may be
        the word's last one; tokens out of the lookahead's reach are emitted."""
        for lo in range(0, len(text), self.window):
            part = self.last + text[lo:lo + self.window]
            self.last = part[-1:]
            self.symbols += map(self.m.symbol.__getitem__, part[:-1].encode())
            if self.look is not None and len(self.symbols) >= self.window + self.look:
                tokens = merge_all(self.symbols, self.m)
                stable, size, at = 0, 0, len(self.symbols) - self.look
                for t in tokens:
                    if size + len(self.m.text_of[t]) > at:  # one character of the byte alphabet a symbol
                        break
                    size += len(self.m.text_of[t])
                    stable += 1
                if stable:
                    out(*self.tokens(tokens[:stable]))
                    self.symbols = self.symbols[size:]

    def close(self, out) -> None:
        """The open run ends: its last symbol gets the suffix."""
        if self.last:
            tail = self.last.encode()
            symbols = [*self.symbols, *map(self.m.symbol.__getitem__, tail[:-1]), self.m.final[tail[-1]]]
            out(*self.tokens(merge_all(symbols, self.m)))
        self.run, self.symbols, self.last = None, [], ""


class Decoder:
    """Incremental decoder.  ``mode="pieces"`` gives what the tokenizers library
    gives for a file without a decoder: the vocabulary strings joined by a space.
    ``mode="text"`` undoes the byte alphabet and turns the end-of-word suffix into
    a space; bytes that do not form a character become U+FFFD."""

    def __init__(self, merges: MergeList, mode: str = "pieces"):
        self.m, self.mode, self.first = merges, mode, True
        self.bytes_of = {c: b for b, c in merges.letters.items()}
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def push(self, ids) -> str:
        parts = []
        for i in ids:
            piece = self.m.text_of[int(i)]
            if self.mode == "pieces":
                parts.append((b"" if self.first else b" ") + piece.encode())
            elif piece in self.m.special:
                parts.append(piece.encode())
            else:
                end = bool(self.m.suffix) and piece.endswith(self.m.suffix)
                body = piece[:len(piece) - len(self.m.suffix)] if end else piece
                parts.append(bytes(self.bytes_of[c] for c in body) + (b" " if end else b""))
            self.first = False
        return self.state.decode(b"".join(parts))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


class Digest:
    """Running sha256 of ids and of the decoded text of one document."""

    def __init__(self):
        self.ids, self.text, self.n, self.first = hashlib.sha256(), hashlib.sha256(), 0, True

    def __call__(self, ids: bytes, decoded: bytes) -> None:
        if ids:
            self.ids.update(ids)
            self.n += len(ids) // 4
            self.text.update(decoded[1:] if self.first else decoded)
            self.first = False


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, block: int = 1 << 16,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids_sha256
    (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256.

    A null text counts as empty: no tokens, digests of nothing.  Repeated rows and
    null ids give one row each, an empty table an empty result.  Row-local, no
    shuffle; see ``Encoder`` for what is held.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        release_worker(("encoder", path, block))
        enc = per_worker(("encoder", path, block), lambda: Encoder(MergeList(path), block=block))
        enc.reset()
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                digest = Digest()
                enc.feed(text, digest)
                enc.finish(digest)
                rows.append(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d.n for d in rows], pa.int64()),
                 pa.array([d.ids.hexdigest() for d in rows], pa.string()),
                 pa.array([d.text.hexdigest() for d in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"))
