"""Byte-level BPE with a hierarchical-bitmap rank queue, and its inverse.

Each pre-token is a linked list of tokens.  Every adjacent pair that can merge lies in the bucket of its merge rank; three
levels of bit sets say which buckets hold something, so find-first-set gives the lowest rank in a few steps whatever the
length of the pre-token.  A bucket is a heap of list positions, so the leftmost pair goes first; an entry whose pair has
changed since is stale and is skipped.

Null text counts as empty; an empty text gives no ids.  Texts are cut by the pattern with array operations, equal
pre-tokens are merged once per worker and looked up afterwards, and pre-tokens over 64 bytes are merged where they stand.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

SHIFT = 20


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap of 256-bit words."""

    def __init__(self):
        self.top, self.mid, self.low, self.bucket = 0, {}, {}, {}

    def push(self, rank: int, at: int) -> None:
        heap = self.bucket.get(rank)
        if heap:
            heappush(heap, at)
            return
        self.bucket[rank] = [at]
        i, j = rank >> 8, rank >> 16
        self.low[i] = self.low.get(i, 0) | 1 << (rank & 255)
        self.mid[j] = self.mid.get(j, 0) | 1 << (i & 255)
        self.top |= 1 << j

    def add(self, rank: int, positions: np.ndarray) -> None:
        """Puts an array of positions into a bucket whose entries ``pop_all`` takes together."""
        held = self.bucket.get(rank)
        if held:
            held.append(positions)
        else:
            self.push(rank, positions)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position."""
        rank = self._first()
        heap = self.bucket[rank]
        at = heappop(heap)
        if not heap:
            self._clear(rank)
        return rank, at

    def pop_all(self) -> tuple[int, list]:
        """The lowest rank and all that its bucket holds."""
        rank = self._first()
        held = self.bucket.pop(rank)
        self._clear(rank)
        return rank, held

    def _first(self) -> int:
        top = self.top
        j = (top & -top).bit_length() - 1
        mid = self.mid[j]
        i = (j << 8) + (mid & -mid).bit_length() - 1
        low = self.low[i]
        return (i << 8) + (low & -low).bit_length() - 1

    def _clear(self, rank: int) -> None:
        i, j = rank >> 8, rank >> 16
        self.low[i] &= ~(1 << (rank & 255))
        if not self.low[i]:
            self.mid[j] &= ~(1 << (i & 255))
            if not self.mid[j]:
                self.top &= ~(1 << j)


class Bpe:
    """Merge table of a rank file: rank of a pair = id of the joined bytes, as tiktoken has it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.slot_key = None
        self.byte_id = [ranks[bytes([i])] for i in range(256)]
        self.pair = {ranks[t[:k]] << SHIFT | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for t, r in ranks.items():
            by_id[r] = t
        self.bytes_off = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.bytes_data = np.frombuffer(b"".join(by_id), np.uint8)
        digits = [b"%d " % r for r in range(size)]
        self.digits_off = np.concatenate([[0], np.cumsum([len(t) for t in digits])]).astype(np.int64)
        self.digits_data = np.frombuffer(b"".join(digits), np.uint8)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, pair, byte_id = len(piece), self.pair, self.byte_id
        tok = [byte_id[x] for x in piece]
        if n == 1:
            return tok
        nxt, prv, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        q = RankQueue()
        push, pop, get = q.push, q.pop, pair.get
        a = tok[0]
        for i in range(n - 1):
            b = tok[i + 1]
            r = get(a << SHIFT | b)
            if r is not None:
                rank[i] = r
                push(r, i)
            a = b
        while q.top:
            r, i = pop()
            if rank[i] != r:
                continue
            j = nxt[i]
            k = nxt[j]
            tok[i], tok[j], rank[j], nxt[i] = r, -1, -1, k
            if k < n:
                prv[k] = i
                s = get(r << SHIFT | tok[k])
                if s is None:
                    rank[i] = -1
                else:
                    rank[i] = s
                    push(s, i)
            else:
                rank[i] = -1
            h = prv[i]
            if h >= 0:
                s = get(tok[h] << SHIFT | r)
                if s is None:
                    rank[h] = -1
                elif rank[h] != s:
                    rank[h] = s
                    push(s, h)
        return [t for t in tok if t >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_data[T.expand(self.bytes_off, ids.astype(np.int64))[0]].tobytes()

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of token pairs, -1 where they do not merge: one probe or two in an open hash table."""
        if self.slot_key is None:
            keys = np.fromiter(self.pair, np.int64, len(self.pair))
            self.slot_key, self.slot_rank = np.full(1 << 20, -2, np.int64), np.full(1 << 20, -1, np.int32)
            at, left = _slot(keys), np.arange(len(keys))
            while len(left):
                free = left[self.slot_key[at[left]] == -2]
                self.slot_key[at[free]] = keys[free]
                left = left[self.slot_key[at[left]] != keys[left]]
                at[left] = (at[left] + 1) & 0xFFFFF
            self.slot_rank = np.fromiter((self.pair.get(k, -1) for k in self.slot_key.tolist()), np.int32, 1 << 20)
        key = a.astype(np.int64) << SHIFT | b
        at = _slot(key)
        out = np.full(len(key), -1, np.int32)
        live = np.arange(len(key))
        while len(live):
            got = self.slot_key[at]
            hit = got == key[live]
            out[live[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (got != -2)
            live, at = live[more], (at[more] + 1) & 0xFFFFF
        return out

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pre-tokens under one rank queue.  Pre-tokens do not touch each other, so all their leftmost pairs of
        the lowest rank merge at once; a further pair of that rank in one pre-token goes back to its bucket."""
        out: list = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > T.LONG_WORD:
                out[i] = self.encode(p)
            else:
                todo.append(i)
        if not todo:
            return out
        size = np.fromiter((len(pieces[i]) for i in todo), np.int64, len(todo))
        end = np.cumsum(size)
        n = int(end[-1])
        tok = np.append(np.array(self.byte_id, np.int32)[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)], np.int32(-1))
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[end - 1], prv[end - size] = n, n
        word = np.repeat(np.arange(len(todo)), size)
        rank = np.append(self._lookup(tok[:n], tok[nxt[:n]]), np.int32(-1))
        q, get = RankQueue(), self.pair.get

        def push_all(pos: np.ndarray, r: np.ndarray) -> None:
            o = np.argsort(r, kind="stable")
            pos, r = pos[o], r[o]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, x, y in zip(r[np.append(0, cut)].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(r)]):
                q.add(k, pos[x:y])

        live = np.flatnonzero(rank >= 0)
        if len(live):
            push_all(live, rank[live])
        while q.top:
            r, held = q.pop_all()
            pos = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            if len(pos) <= 6:
                last = -1
                for i in pos.tolist():
                    if rank[i] != r:
                        continue
                    w = word[i]
                    if w == last:
                        q.add(r, np.array([i]))
                        continue
                    last = w
                    j = int(nxt[i])
                    k = int(nxt[j])
                    tok[i], tok[j], rank[j], nxt[i], prv[k] = r, -1, -1, k, i
                    s = get(r << SHIFT | int(tok[k]), -1) if k < n else -1
                    rank[i] = s
                    if s >= 0:
                        q.add(s, np.array([i]))
                    h = int(prv[i])
                    if h < n:
                        s = get(int(tok[h]) << SHIFT | r, -1)
                        rank[h] = s
                        if s >= 0:
                            q.add(s, np.array([h]))
                continue
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            w = word[pos]
            again = np.flatnonzero(w[1:] == w[:-1]) + 1
            if len(again):
                q.add(r, pos[again])
                pos = np.delete(pos, again)
            j = nxt[pos]
            k = nxt[j]
            tok[pos], tok[j], rank[j] = r, -1, -1
            nxt[pos], prv[k] = k, pos
            h = prv[pos]
            both, left = np.concatenate([pos, h]), np.concatenate([tok[pos], tok[h]])
            s = self._lookup(left, np.concatenate([tok[k], tok[pos]]))
            rank[both] = s
            rank[n] = -1
            ok = np.flatnonzero((s >= 0) & (both < n))
            if len(ok):
                push_all(both[ok], s[ok])
        keep = np.flatnonzero(tok[:n] >= 0)
        ids, cut = tok[keep].tolist(), np.searchsorted(keep, np.append(0, end)).tolist()
        for i, x, y in zip(todo, cut[:-1], cut[1:]):
            out[i] = ids[x:y]
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


@lru_cache(2)
def load(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def merged_ids(data: np.ndarray, off: np.ndarray, cache: T.WordCache, encode_many) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of the texts in them).  encode_many: pre-tokens as bytes -> their ids.

    Texts are cut and hashed a few MB at a time; the pre-tokens that the cache lacks are merged together.
    """
    starts, value = [], []
    if len(cache.off) > cache.most:
        cache.clear()
    far = len(cache.off) - 1
    pend_w: list[bytes] = []
    for i, j in T.chunks(off):
        lo = off[i]
        b = data[lo:off[j]]
        s = T.pre_tokens(b, off[i:j + 1] - lo)
        codes, first, h = T.distinct(b, s, np.append(s[1:], len(b)))
        row = cache.rows(h)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            # rows are given out now, values follow: an unknown pre-token is met again as a known one
            row[miss] = far + np.arange(len(miss))
            far += len(miss)
            cache.note(h[miss], row[miss])
            raw, e = b.tobytes(), np.append(s[1:], len(b))
            pend_w += [raw[x:y] for x, y in zip(s[first[miss]].tolist(), e[first[miss]].tolist())]
        starts.append(s + lo)
        value.append(row[codes])
    if pend_w:
        cache.fill(encode_many(pend_w))
    starts, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, value))
    idx, at = T.expand(cache.off, value)
    return cache.data[idx], at[np.searchsorted(starts, off)]


_caches: dict[str, T.WordCache] = {}


CHUNK = 12 << 20


def encoded(batches, path: str):
    """(id, ids, decoded) batches of (id, text) batches; within a worker."""
    bpe = load(path)
    cache = _caches.setdefault(path, T.WordCache(np.int32))
    for batch in batches:
        data, off = T.utf8(batch.column(1))
        for i, j in T.chunks(off, CHUNK):
            lo = off[i]
            ids, at = merged_ids(data[lo:off[j]], off[i:j + 1] - lo, cache, bpe.encode_many)
            each = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([v.astype("<u4").tobytes() for v in each], pa.binary()), pa.array([bpe.decode(v) for v in each], pa.binary())], ["id", "ids", "decoded"])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids as little-endian unsigned 32-bit binary, decoded bytes): one row per row of df."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: encoded(batches, path), "id bigint, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row that ``encode`` gives: the number of ids, the SHA-256 of the decimal ids joined by one blank, and that of the decoded bytes."""
    def run(batches):
        bpe = load(path)
        for batch in encoded(batches, path):
            rows: tuple[list, list, list] = ([], [], [])
            for ids, back in zip(batch.column(1), batch.column(2)):
                v = np.frombuffer(ids.as_buffer(), "<u4")
                text = bpe.digits_data[T.expand(bpe.digits_off, v.astype(np.int64))[0]][:-1]
                for k, x in enumerate((len(v), hashlib.sha256(text.tobytes()).hexdigest(), hashlib.sha256(back.as_buffer()).hexdigest())):
                    rows[k].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
