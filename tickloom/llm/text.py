"""Whole texts as byte arrays: chunks of an Arrow batch, white-space words and byte-level pre-tokens, all vectorised."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
BASE = np.uint64(0x9E3779B97F4A7C15)
LONG_WORD = 64


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def release() -> None:
    """Gives freed memory back to the system; for the end of a task, since workers live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent from some C libraries
    if trim:
        trim(0)


def tidy(run):
    """A function over Arrow batches that releases memory when its task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pat, every):
            a, b = m.span()
            for x, y in ((min(a, 0xD800), min(b, 0xD800)), (max(a, 0xD800) + 0x800, max(b, 0xD800) + 0x800)):
                out[x:y] = kind
    return out


def char_classes(b: np.ndarray) -> np.ndarray:
    """Class of the character each UTF-8 byte belongs to."""
    table = _classes()
    cls = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        b0 = b[lead].astype(np.int32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = np.where(size == 2, b0 & 0x1F, np.where(size == 3, b0 & 0x0F, b0 & 0x07))
        for k in (1, 2, 3):
            m = size > k
            cp[m] = (cp[m] << 6) | (b[lead[m] + k] & 0x3F)
        kind = table[cp]
        for k in range(4):
            m = size > k
            cls[lead[m] + k] = kind[m]
    return cls


_ONE = np.zeros(256, bool)
_ONE[[ord(c) for c in "stmd"]] = True


def pre_tokens(b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Start bytes of the matches of the byte-level pattern (contractions, then runs of letters, digits, others with one
    leading blank, then white space), each text on its own.  doc: offsets of the texts in b, as from ``utf8``."""
    n = len(b)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = char_classes(b)
    start = np.zeros(n + 1, bool)
    start[1:n] = cls[1:] != cls[:-1]
    begin = doc[:-1][doc[:-1] < doc[1:]]
    edge = np.zeros(n + 1, bool)
    edge[begin] = edge[n] = True
    start |= edge
    # a white-space run before other text gives up its last character, which joins what follows if it is a blank
    stop = np.flatnonzero(start[1:n] & (cls[:-1] == SPACE) & ~edge[1:n]) + 1
    last = stop - 1
    while (more := (b[last] & 0xC0) == 0x80).any():
        last = last - more
    start[last] = True
    start[stop[b[last] == 0x20]] = False
    # contractions: an apostrophe that begins a match, before letters of the same text
    q = np.flatnonzero((b[:-1] == 0x27) & start[:n - 1] & start[1:n] & (cls[1:] == LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(q):
        pad = np.concatenate([b, np.zeros(2, np.uint8)])
        c1, c2 = pad[q + 1], pad[q + 2]
        same = np.zeros(len(q), bool)
        ok = q + 2 < n
        same[ok] = ~edge[q[ok] + 2]
        two = same & (((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108)))
        one = _ONE[c1]
        start[q[one | two] + 1] = False
        start[q[one] + 2] = True
        start[q[two] + 3] = True
    return np.flatnonzero(start[:n])


def word_starts(b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words split at the bytes 0x20 and 0x09-0x0D, each text on its own."""
    white = (b == 0x20) | ((b >= 9) & (b <= 13))
    solid = ~white
    first = solid.copy()
    first[1:] &= white[:-1]
    begin = doc[:-1][doc[:-1] < doc[1:]]
    first[begin] |= solid[begin]
    s = np.flatnonzero(first)
    final = np.ones(len(b), bool)
    final[:-1] = white[1:]
    final[begin[begin > 0] - 1] = True
    e = np.flatnonzero(final & solid) + 1
    return s, e


_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        keep = 1 << max(16, (n - 1).bit_length()) if n < 1 << 22 else n  # doubles while short
        for name, base in (("p", BASE), ("i", np.uint64(pow(int(BASE), -1, 1 << 64)))):
            a = np.full(max(n, keep), base, np.uint64)
            a[0] = 1
            _pow[name] = np.cumprod(a, dtype=np.uint64)
    return _pow["p"], _pow["i"]


def span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans; used only to group spans of at most LONG_WORD bytes."""
    p, inv = _powers(len(b) + 1)
    acc = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:len(b)], dtype=np.uint64, out=acc[1:])
    h = (acc[e] - acc[s]) * inv[s]
    h ^= (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def distinct(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, hashes): spans with one code hold the same bytes; first is the position of a code's first span.

    Spans longer than LONG_WORD bytes get a code and a hash of 0 each.
    """
    h = span_hashes(b, s, e)
    far = np.flatnonzero(e - s > LONG_WORD)
    codes, uniq = pd.factorize(h)
    first = np.empty(len(uniq), np.int64)
    first[codes[::-1]] = np.arange(len(s) - 1, -1, -1)
    if len(far):
        codes = codes.copy()
        codes[far] = len(uniq) + np.arange(len(far))
        first, uniq = np.concatenate([first, far]), np.concatenate([uniq, np.zeros(len(far), np.uint64)])
        used = np.zeros(len(uniq), bool)
        used[codes] = True
        codes, first, uniq = (np.cumsum(used) - 1)[codes], first[used], uniq[used]
    return codes, first, uniq


def expand(off: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged gather: (index into the data, new offsets) for the rows ``pick`` of a ragged array with offsets ``off``."""
    size = off[pick + 1] - off[pick]
    out = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    kind = np.int32 if max(int(out[-1]), int(off[-1])) < 1 << 31 else np.int64
    idx = np.arange(out[-1], dtype=kind)
    idx += np.repeat((off[pick] - out[:-1]).astype(kind), size)
    return idx, out


class WordCache:
    """Values (ragged arrays) of words by their hash, at most ``most`` words; cleared when full."""

    def __init__(self, dtype, most: int = 400_000):
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.off, self.data = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is unknown."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where((self.hash[at] == h) & (h != 0), self.row[at], -1)

    def note(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Gives hashes their rows; a hash of 0 stays unknown."""
        known = h != 0
        hh, rr = np.concatenate([self.hash, h[known]]), np.concatenate([self.row, rows[known]])
        o = np.argsort(hh, kind="stable")
        self.hash, self.row = hh[o], rr[o]

    def fill(self, values: list[list[int]]) -> None:
        """Values of the rows noted since, in order."""
        size = np.fromiter(map(len, values), np.int64, len(values))
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(size)])
        self.data = np.concatenate([self.data, np.fromiter(itertools.chain.from_iterable(values), self.dtype, int(size.sum()))])
