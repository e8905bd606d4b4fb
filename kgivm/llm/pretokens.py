"""Exact token ids through a cache of pre-tokens.

A BPE merges only inside a pre-token, so a text's ids are its pre-tokens' ids in
order. Pre-token borders are found for whole batches with array operations, and
pre-tokens looked up by fingerprint in a direct-mapped cache; only those not in
it go to the tokenizers library. Texts that hold an added token's string, and
for the lower-casing vocabulary texts with characters from U+0300 on, take the
library's own path (normaliser, or whole encoding), so results are the library's.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kgivm.llm.kernels import CHUNK, Prints, U, chunks, mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLOTS = 1 << 20
FLAT_LIMIT = 1 << 23
LETTER, NUMBER, OTHER, BLANK = 1, 2, 3, 4
SALT = U(0x5851F42D4C957F2D)
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level BPE writes each byte as one visible character: itself, or the next free one from U+0100 on.
VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


def string_prints(strings: list[str]) -> np.ndarray:
    """The fingerprints under which pre-tokens are looked up."""
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([0, *map(len, strings)])
    return Prints(mix(points.astype(U) + SALT)).of(ends[:-1], ends[1:])


class Encoder:
    """``style`` 'byte': white space joins the next pre-token, numbers run on. 'word': white space is dropped, every number character is alone."""

    def __init__(self, path: str, style: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.style = style
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.kinds = np.zeros(0x110000, np.uint8)
        self.proven = np.zeros(0, U)
        self.proven_ids = np.zeros(0, np.int32)
        self.clear()

    def clear(self) -> None:
        """Empty the cache of merged pre-tokens; proven ones stay."""
        self.keys = np.zeros(SLOTS, U)
        self.at = np.zeros(SLOTS, np.int64)
        self.count = np.zeros(SLOTS, np.int32)
        self.flat = np.concatenate([self.proven_ids, np.zeros(1 << 16, np.int32)])
        self.used = len(self.proven)
        self.misses = 0

    def learn(self, strings: list[str]) -> np.ndarray:
        """Offsets in ``flat`` (n + 1) of the ids of some pre-tokens."""
        merge = self.lib.model.tokenize
        got = [[t.id for t in merge(x.encode().decode("latin-1").translate(VISIBLE))] for x in strings]
        ends = self.used + np.cumsum([0, *map(len, got)])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[ends[0] : ends[-1]] = np.concatenate([np.asarray(g, np.int32) for g in got]) if got else []
        self.used = int(ends[-1])
        self.misses += len(strings)
        return ends

    def seed(self, prints: np.ndarray, ids: np.ndarray) -> None:
        """Enter the table of pre-tokens (ascending fingerprints) that are known to be one token each. It is read only and never evicted."""
        self.proven, self.proven_ids = prints, ids
        self.clear()

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Character classes, asked from the library's own pre-tokeniser once per character."""
        kinds = self.kinds[points]
        if not kinds.all():
            for c in np.unique(points[kinds == 0]):
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[points]
        return kinds

    def _kind(self, c: str) -> int:
        split = self.lib.pre_tokenizer.pre_tokenize_str
        if self.style == "byte" and (c == " " or len(split("a" + c + c + "b")) == 4):
            return BLANK
        if len(split("a" + c)) == 1 and (self.style == "byte" or split("a" + c)[0][1][1] == 2):
            return LETTER
        if self.style == "byte":
            return NUMBER if len(split("1" + c)) == 1 else OTHER
        pieces = split("?" + c)
        return NUMBER if len(pieces) == 2 else OTHER if pieces[0][1][1] == 2 else BLANK

    def starts(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of every pre-token."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classify(points)
        first = np.zeros(n + 1, bool)
        first[at] = True
        begin = first[:n].copy()
        inner = ~begin[1:]
        blank = kind == BLANK
        change = kind[1:] != kind[:-1]
        if self.style == "byte":
            space = points == 32
            start = begin.copy()
            start[1:] |= np.where(blank[1:], ~blank[:-1], np.where(blank[:-1], ~space[:-1], change))
            # the last of several blanks stands alone, or leads the next pre-token
            lone = np.zeros(n, bool)
            lone[1:-1] = blank[1:-1] & blank[:-2] & ~blank[2:] & inner[:-1] & ~first[2:n]
            start |= lone
        else:
            start = begin.copy()
            start[1:] |= change | (kind[1:] == NUMBER)
            start &= ~blank
        quote = np.flatnonzero(points == 39)
        if len(quote):
            before = np.where(quote > 0, kind[quote - 1], 0)
            spaced = np.zeros(len(quote), bool) if self.style == "word" else (quote > 0) & (points[quote - 1] == 32)
            quote = quote[begin[quote] | ((before != OTHER) & ~spaced)]
            ends = at[np.searchsorted(at, quote, "right")] if len(quote) else quote
            a = np.where(quote + 1 < ends, points[np.minimum(quote + 1, n - 1)], 0)
            b = np.where(quote + 2 < ends, points[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            for q, size in ((quote[one], 1), (quote[two], 2)):
                if len(q):
                    start[q] = True
                    start[q + 1] = False
                    after = q + 1 + size
                    after = after[(after < n)]
                    start[after] |= (kind[after] == LETTER) & ~first[after]
        s = np.flatnonzero(start)
        if self.style == "byte":
            return s, np.append(s[1:], n)
        stop = np.zeros(n + 1, bool)
        stop[s] = True
        stop[np.flatnonzero(blank)] = True
        stop[at] = True
        stops = np.flatnonzero(stop)
        return s, stops[np.searchsorted(stops, s, "right")] if len(s) else s

    def encode(self, data: np.ndarray, at: np.ndarray, special: np.ndarray | None, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some rows and their row bounds; ``special`` marks rows left to the library."""
        raw = data.tobytes()
        strings: dict[int, list[int]] = {}
        if special is not None and special.any():
            strings = {int(i): self.lib.encode(raw[at[i] : at[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids for i in np.flatnonzero(special)}
        text = raw.decode("utf-8", "replace")
        ascii_only = len(text) == len(raw)
        points = data.astype(np.uint32) if ascii_only else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if ascii_only:
            rows = at
        else:
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            rows = lead[at]
            if len(points) != lead[-1]:  # bytes that are not UTF-8: row by row
                parts = [self.lib.encode(raw[at[i] : at[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids for i in range(len(at) - 1)]
                bounds = np.cumsum([0, *map(len, parts)])
                return np.concatenate([np.asarray(p, np.int32) for p in parts]), bounds
        if self.style == "word":
            if ascii_only:
                points = points + ((points >= 65) & (points <= 90)) * np.uint32(32)
                text = text.lower()
            else:
                text, points, rows = self._normal(text, points, rows)
        s, e = self.starts(points, rows)
        want = ids or bool(strings)
        ids, bounds = self._lookup(text, points, s, e, rows, want)
        if strings:
            parts = [np.asarray(strings[i], np.int32) if i in strings else ids[bounds[i] : bounds[i + 1]] for i in range(len(at) - 1)]
            bounds = np.cumsum([0, *map(len, parts)])
            ids = np.concatenate(parts)
        return ids, bounds

    def _normal(self, text: str, points: np.ndarray, rows: np.ndarray):
        high = points >= 0x300
        odd = high | (points == 0x130)
        if not odd.any():
            low = text.lower()
            return low, np.frombuffer(low.encode("utf-32-le"), np.uint32), rows
        hard = np.flatnonzero(np.add.reduceat(np.append(odd, False), np.minimum(rows[:-1], len(odd)))[: len(rows) - 1] * (rows[1:] > rows[:-1]))
        hard = set(hard.tolist())
        parts = [self.lib.normalizer.normalize_str(text[rows[i] : rows[i + 1]]) if i in hard else text[rows[i] : rows[i + 1]].lower() for i in range(len(rows) - 1)]
        rows = np.cumsum([0, *map(len, parts)])
        text = "".join(parts)
        return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), rows

    def _lookup(self, text: str, points: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray]:
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        if self.used > FLAT_LIMIT:
            self.clear()
        prints = Prints(mix(points.astype(U) + SALT)).of(s, e)
        slot = (prints >> U(44)).astype(np.int64)
        at, count = self.at[slot], self.count[slot]
        miss = np.flatnonzero(self.keys[slot] != prints)
        if len(miss):
            found, where, back = np.unique(prints[miss], return_index=True, return_inverse=True)
            where = miss[where]
            new_at, new_count = np.searchsorted(self.proven, found), np.ones(len(found), np.int32)
            merge = self.proven[np.minimum(new_at, len(self.proven) - 1)] != found if len(self.proven) else np.ones(len(found), bool)
            ends = self.learn([text[a:b] for a, b in zip(s[where[merge]].tolist(), e[where[merge]].tolist())])
            new_at[merge], new_count[merge] = ends[:-1], np.diff(ends).astype(np.int32)
            at[miss], count[miss] = new_at[back], new_count[back]
            to = (found >> U(44)).astype(np.int64)
            self.keys[to], self.at[to], self.count[to] = found, new_at, new_count
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        if not want:
            return self.flat[:0], ends[np.searchsorted(s, rows)]
        ids = self.flat[np.repeat(at - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(s, rows)]

    def batches(self, column: pa.Array, limit: int = CHUNK, ids: bool = True):
        """First row, end row, ids, bounds of runs of rows of a column."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        special = None
        for a in self.added:
            hit = pc.fill_null(pc.match_substring(column, a), False)
            if pc.any(hit).as_py():
                hit = hit.to_numpy(zero_copy_only=False)
                special = hit if special is None else special | hit
        for lo, hi, data, at in chunks(column, limit):
            yield lo, hi, *self.encode(data, at, None if special is None else special[lo:hi], ids)


_cache: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """One per Python worker, so its cache outlives a task."""
    if (path, style) not in _cache:
        _cache[path, style] = Encoder(path, style)
    return _cache[path, style]
