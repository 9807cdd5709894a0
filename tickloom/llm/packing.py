"""Packing into windows by best-fit decreasing.

A document is its ids and one end id.  Full windows are cut off first; what remains of each document goes, longest first,
into the open window with the least capacity that still holds it, found by a segment tree over remaining capacities.
Every task packs the documents of its own partition, ``hold`` remainders at a time, so nothing is shuffled and memory is
bounded; windows less than ``fill`` full go on open into the next lot, the fullest first, at most half a lot.

Null and empty texts are one end id.  Rows repeated with one id are packed each on its own.  An empty table gives no piece.
Ids come from the merges of a ``tokenizers`` file.  With ``added``, strings of the file's added tokens in a text get those
tokens' ids and the parts between are cut on their own, as ``Tokenizer.encode`` has it; else they are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import bpe, text as T

CHUNK = 2 << 20  # bytes of text cut at once
PIECES = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(2)
def encoder(path: str):
    """Pre-tokens as bytes -> ids, by the BPE model of a tokenizers file."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} does not cut texts by the byte-level pattern")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = dict(zip(plain, plain))
    for k, x in enumerate(x for x in range(256) if x not in names):
        names[x] = 256 + k
    model = tok.model

    def many(pieces: list[bytes]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(p.decode("latin-1").translate(names))] for p in pieces]

    return many


@lru_cache(2)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """Pattern and ids of the added tokens of a tokenizers file; of those that begin at one place the longest is taken."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens") or []
    if tokens and (spec.get("normalizer") or len({t["normalized"] for t in tokens}) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens)):
        raise ValueError(f"{path} does not find added tokens by their plain strings")
    ids = {t["content"].encode(): t["id"] for t in tokens}
    return re.compile(b"|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None, ids


def with_added(data: np.ndarray, off: np.ndarray, path: str, merged) -> tuple[np.ndarray, np.ndarray]:
    """merged(bytes, offsets) -> (ids, offsets of the texts in them), with the ids of added tokens where their strings stand."""
    pattern, names = added_tokens(path)
    raw = data.tobytes()
    if pattern is None or not any(t in raw for t in names):
        return merged(data, off)
    found = [(d, *m.span(), names[m[0]]) for d in range(len(off) - 1) for m in pattern.finditer(raw, off[d], off[d + 1])]
    if not found:
        return merged(data, off)
    doc, start, end, name = (np.array(c, np.int64) for c in zip(*found))
    keep = np.ones(len(data), bool)
    for a, z in zip(start, end):
        keep[a:z] = False
    gone = np.concatenate([[0], np.cumsum(end - start)])
    # a text of k added tokens is k + 1 parts
    parts = np.insert(off - gone[np.searchsorted(start, off)], doc + 1, start - gone[:-1])
    ids, at = merged(data[keep], parts)
    before = np.searchsorted(doc, np.arange(len(off)))
    return np.insert(ids, at[doc + np.arange(len(doc)) + 1], name), np.asarray(at)[np.arange(len(off)) + before] + before


class Windows:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count, self.at = [0] * (2 * self.size), {}

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def open(self, room: int, window: int) -> None:
        self.at.setdefault(room, []).append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``need``: (room, window)."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers; items in decreasing length."""
    open_, out = Windows(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        found = open_.tightest(n)
        if found:
            room, w = found
            out[w].append(k)
        else:
            room, w = capacity, len(out)
            out.append([k])
        if room > n:
            open_.open(room - n, w)
    return out


def pack(df: DataFrame, path: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", hold: int = 4096, fill: float = 0.98, added: bool = False) -> DataFrame:
    """Pieces (id_col, start, length, ids as little-endian unsigned 32-bit binary, doc_tokens, sequence_id, offset)."""
    def run(batches):
        many, cache = encoder(path), bpe._caches.setdefault(path, T.WordCache(np.int32))
        merged = lambda data, off: bpe.merged_ids(data, off, cache, many)
        base, used = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []  # remainders: (length, id, start, bytes, doc_tokens)

        def rows(found: list[tuple]):
            cols = list(zip(*found)) if found else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def flush(last: bool):
            nonlocal used, held
            lots = best_fit([h[0] for h in held], window)
            room = [window - sum(held[k][0] for k in lot) for lot in lots]
            keep: set[int] = set()
            if not last:
                # the emptiest windows stay open, with at most half a lot of remainders
                n = 0
                for w in sorted(range(len(lots)), key=lambda w: -room[w]):
                    if window - room[w] >= fill * window or n + len(lots[w]) > hold // 2:
                        break
                    keep.add(w)
                    n += len(lots[w])
            out, rest = [], []
            for w, lot in enumerate(lots):
                if w in keep:
                    rest += [held[k] for k in lot]
                    continue
                at = 0
                for k in lot:
                    n, i, start, ids, total = held[k]
                    out.append((i, start, n, ids, total, base + used, at))
                    at += n
                used += 1
            held = rest
            return rows(out)

        for batch in batches:
            data, off = T.utf8(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in T.chunks(off, CHUNK):
                lo = off[i]
                part = data[lo:off[j]], off[i:j + 1] - lo
                ids, at = with_added(*part, path, merged) if added else merged(*part)
                raw, end = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
                full: list[tuple] = []
                for name, x, y in zip(names[i:j], at[:-1].tolist(), at[1:].tolist()):
                    doc = raw[4 * x:4 * y] + end
                    total = y - x + 1
                    cut = total - total % window
                    for start in range(0, cut, window):
                        full.append((name, start, window, doc[4 * start:4 * (start + window)], total, base + used, 0))
                        used += 1
                    if cut < total:
                        held.append((total - cut, name, cut, doc[4 * cut:], total))
                    if len(held) >= hold:
                        yield flush(False)
                    if len(full) >= 2000:
                        yield rows(full)
                        full = []
                if full:
                    yield rows(full)
        while held:
            yield flush(True)

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(T.tidy(run), PIECES).withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(c) for c in pieces.columns])
