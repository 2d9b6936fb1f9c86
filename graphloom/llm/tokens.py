"""Token ids with a cache of words.

Both vocabularies split a text so that no token holds a space before a non-space character except
as its first character.  A text can therefore be cut before such spaces and its pieces encoded
apart; the pieces repeat, so most are found in a cache.  Unknown pieces of a text are joined with a
separator and encoded in one call.  Texts in which a space stands beside other white space are
encoded whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from graphloom.llm.textvec import LOWER, SLICE_BYTES, buffers, slices, span_hashes

#: Pieces kept (about 60 MB).  A full cache starts anew once too many pieces of late texts are missing.
CACHE_WORDS = 300_000
HOT_WORDS = 15_000
#: Pieces whose ids a batch encoder keeps (about 60 MB).
KNOWN_PIECES = 350_000
MISSING_SHARE = 0.3
#: Longer pieces are encoded but not kept.
CACHE_CHARS = 64
#: White space that may not stand after a space where a text is cut.
_SPACES = tuple(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_AFTER_SPACE = tuple(" " + c for c in _SPACES)
_ASCII_AFTER_SPACE = tuple(x for x in _AFTER_SPACE if x.isascii())


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _holds(text: str, hint: str, added: list[str]) -> bool:
    return hint in text and any(map(text.lower().__contains__, added))


class CachedTokenizer:
    def __init__(self, path: str, lead_space: bool):
        """lead_space: a piece keeps the space before it (byte-level vocabularies); else white space is dropped."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [x.content.lower() for x in self.lib.get_added_tokens_decoder().values()]
        self.hint = os.path.commonprefix(self.added)[:2]
        self.lead = " " if lead_space else ""
        self.mark, self.join = ("\n", "\n") if lead_space else ("\x00", " \x00 ")
        self.model = self.lib.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        ids = self.lib.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.marks = {c: self.whole(c) for c in ".,"}
        self.cache: dict[str, bytes] = {}
        self.hot: dict[str, bytes] = {}  # the pieces seen first, most of all that come: small enough for the processor's cache
        self.seen = self.missed = 0

    def holds_added(self, text: str) -> bool:
        """Whether a text may hold an added token; such a text isn't cut but goes to the library."""
        return _holds(text, self.hint, self.added)

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, p: str) -> bytes:
        """Ids of a word of lower-case Latin letters: already normal and one pre-token, so the library's model suffices."""
        if not p.isascii():
            p = p.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _many(self, pieces: list[str]) -> dict[str, bytes]:
        out = {}
        if not self.lead:
            out = {p: self._word(p) for p in pieces if p.isalpha() and p == p.lower() and _latin(p)}
            pieces = [p for p in pieces if p not in out]
        plain = [p for p in pieces if p.split() == [p] and self.mark not in p] if self.mark_id is not None else []
        if plain:
            text = self.join.join([self.lead + p for p in plain])
            ids = np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) == len(plain) - 1:
                raw = ids.tobytes()
                at = [-1, *cut.tolist(), len(ids)]
                out |= {p: raw[4 * a + 4 : 4 * b] for p, a, b in zip(plain, at[:-1], at[1:], strict=True)}
        for p in pieces:
            if p not in out:
                out[p] = self.whole(self.lead + p)
        return out

    def _learn(self, rest: list[str], body: list, lacking: list[int]) -> None:
        """Fill in the ids of pieces that the cache lacks, and keep them while there is room."""
        if not self.lead:  # an ASCII letter and the mark behind it are always apart
            left = []
            for i in lacking:
                p = rest[i]
                x = (self.hot.get(p[:-1]) or self.cache.get(p[:-1])) if p[-1:] in ".," and p[-2:-1].isascii() and p[-2:-1].isalpha() else None
                if x is None:
                    left.append(i)
                else:
                    body[i] = x + self.marks[p[-1]]
            lacking = left
        got = self._many(list({rest[i] for i in lacking}))
        for i in lacking:
            body[i] = got[rest[i]]
        if len(self.cache) + len(got) <= CACHE_WORDS:
            keep = {p: x for p, x in got.items() if len(p) <= CACHE_CHARS}
            (self.hot if len(self.hot) < HOT_WORDS else self.cache).update(keep)
            return
        self.seen, self.missed = self.seen + len(rest), self.missed + len(lacking)
        if self.seen > 1_000_000:
            if self.missed > MISSING_SHARE * self.seen:
                self.cache, self.hot = {}, {}
            self.seen = self.missed = 0

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.holds_added(text):
            return self.whole(text)
        if self.lead:
            if text[-1] == " " or any(x in text for x in (_ASCII_AFTER_SPACE if text.isascii() else _AFTER_SPACE)):
                return self.whole(text)
            first, *rest = text.split(" ")
        else:
            # white space and case are dropped anyway; Latin-1 texts are in normal form and lower-case within it
            if _latin(text):
                text = text.lower()
            first, rest = "", text.replace("\n", " ").split(" ")
        body = list(map(self.hot.get, rest))
        lacking = [i for i, x in enumerate(body) if x is None]
        if lacking:
            get, unknown = self.cache.get, []
            for i in lacking:
                x = body[i] = get(rest[i])
                if x is None:
                    unknown.append(i)
            if unknown:
                self._learn(rest, body, unknown)
        return (self.whole(first) if first else b"") + b"".join(body)


#: How the byte-level vocabulary splits texts (fixed value, as in its file's pre-tokenizer).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevelTokenizer:
    """The ids that the tokenizers library gives for a byte-level BPE file, by tiktoken's faster merge loop.

    Ids follow the order of merges there, so they serve as ranks; the file's pre-tokenizer is checked to be the one that
    BYTE_PATTERN spells out.  Texts that may hold an added token go to the library, which is loaded with the first of them.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec.get("normalizer") or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        letters, added = byte_alphabet(), {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.added = [x.lower() for x in added]
        self.hint = os.path.commonprefix(self.added)[:2]
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self) -> CachedTokenizer:
        if self.library is None:
            self.library = CachedTokenizer(self.path, lead_space=True)
        return self.library

    def encode(self, text: str) -> bytes:
        if _holds(text, self.hint, self.added):
            return self.slow.whole(text)
        if len(text) > LONG_CHARS:  # no Python object for each id
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


#: Texts of more characters are encoded without Python integers.
LONG_CHARS = 1_000_000
_made: dict[tuple[str, bool], CachedTokenizer | ByteLevelTokenizer] = {}


def tokenizer(path: str, byte_level: bool) -> CachedTokenizer | ByteLevelTokenizer:
    """One for each worker process."""
    key = (path, byte_level)
    if key not in _made:
        _made[key] = ByteLevelTokenizer(path) if byte_level else CachedTokenizer(path, lead_space=False)
    return _made[key]


class BatchEncoder:
    """Ids of whole Arrow batches for vocabularies that drop white space and case.

    Texts in Latin-1 are cut into words and runs of marks with array operations, at places where a token always ends; each
    distinct piece of a slice is looked up once, by its hash, and the ids are put together by a gather.  Other texts are
    encoded one by one.
    """

    def __init__(self, path: str):
        self.slow = CachedTokenizer(path, lead_space=False)
        self.known: dict[int, bytes] = {}

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        data, offsets = buffers(column)
        for a, b in slices(offsets):
            part = data[offsets[a] : offsets[b]]
            if len(part) > SLICE_BYTES:
                yield self._long(part)
            else:
                yield from self._slice(part, offsets[a : b + 1] - offsets[a])

    def _long(self, data: np.ndarray) -> bytes:
        """Ids of a text longer than a slice: of its parts between spaces or line feeds, unless it may hold an added token."""
        if self.slow.added and self.slow.hint.encode() in data.tobytes():
            return self.slow.encode(data.tobytes().decode())
        out, at = [], 0
        while at < len(data):
            end = at + SLICE_BYTES // 2
            gap = next((int(x[0]) + i for i in range(end, len(data), SLICE_BYTES) if len(x := np.flatnonzero((data[i : i + SLICE_BYTES] == 32) | (data[i : i + SLICE_BYTES] == 10)))), len(data))
            part = data[at:gap]
            out += self._slice(part, np.array([0, len(part)]))
            at = gap
        return b"".join(out)

    def _pieces(self, hashes: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of distinct pieces; `at` gives a place of each."""
        got = list(map(self.known.get, hashes.tolist()))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            words = [data[s:e].tobytes().decode() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            ids = self.slow._many(words)
            for i, w in zip(new, words, strict=True):
                got[i] = ids[w]
            if len(self.known) + len(new) <= KNOWN_PIECES:
                self.known.update(zip(hashes[new].tolist(), [got[i] for i in new], strict=True))
            elif len(new) > 0.7 * len(got):  # other texts than those learned from
                self.known = dict(zip(hashes.tolist(), got, strict=True))
        return got

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        rows, n = len(offsets) - 1, len(data)
        if n == 0:
            return [b""] * rows
        seen = np.concatenate([[0], np.cumsum(data > 0xC3)])
        latin = seen[offsets[1:]] == seen[offsets[:-1]]
        low = LOWER[data]
        lead = low == 0xC3
        trail = np.concatenate([[False], lead[:-1]])
        low[trail & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
        kind = _KIND[low]
        kind[lead | trail] = 1
        odd = np.flatnonzero(trail & ((low == 0x97) | (low == 0xB7)))  # signs of multiplication and division
        kind[odd] = kind[odd - 1] = 0
        word = (low != 32) & (low != 10)
        turn = np.zeros(n, bool)
        turn[1:] = kind[1:] * kind[:-1] == 2  # a letter beside a mark
        turn[offsets[(offsets > 0) & (offsets < n)]] = True
        starts = np.flatnonzero(word & (turn | ~np.concatenate([[False], word[:-1]])))
        ends = np.flatnonzero(word & (np.append(turn[1:], True) | ~np.append(word[1:], False))) + 1
        first = np.searchsorted(starts, offsets)
        hashes, at, where = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if not latin.all():  # pieces of other texts aren't looked up
            mine = np.zeros(len(hashes), bool)
            mine[where[np.repeat(latin, np.diff(first))]] = True
        else:
            mine = np.ones(len(hashes), bool)
        kept = np.flatnonzero(mine)
        # a place in a Latin text
        if len(kept) < len(hashes):
            ok = np.flatnonzero(np.repeat(latin, np.diff(first)))
            at[where[ok]] = ok
        got = self._pieces(hashes[kept], at[kept], low, starts, ends) if len(kept) else []
        size, begin = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        size[kept] = [len(x) // 4 for x in got]
        begin[kept] = np.cumsum(size[kept]) - size[kept]
        flat = np.frombuffer(b"".join(got), "<u4")
        count = size[where]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(begin[where] - total[:-1], count) + np.arange(total[-1])].tobytes()
        cut = (4 * total[first]).tolist()
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        alone, raw, hint = ~latin, data.tobytes(), self.slow.hint.encode()
        at = raw.find(hint) if self.slow.added else -1
        while 0 <= at < n:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            alone[d] = True
            at = raw.find(hint, int(offsets[d + 1]))
        for d in np.flatnonzero(alone):
            out[d] = self.slow.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode())
        return out


def _kinds() -> np.ndarray:
    """1: lower-case ASCII letters; 2: ASCII marks but the apostrophe, which may begin a token with letters; 0: others."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 2
    kind[[*range(48, 58), 39]] = 0
    kind[97:123] = 1
    return kind


_KIND = _kinds()
_batch: dict[str, BatchEncoder] = {}


def batch_encoder(path: str) -> BatchEncoder:
    """One for each worker process."""
    if path not in _batch:
        _batch[path] = BatchEncoder(path)
    return _batch[path]
