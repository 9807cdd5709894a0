"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's word shingles.  For radius r there are
2^(r+1) - 1 masks: bit i carries a vector m(i) of r+1 bits, and mask v keeps the bits with odd <m(i), v>.  Any r differing
bits leave some v orthogonal to all their vectors, so that mask keeps none of them: every pair within r shares a key of
some table.  Equal fingerprints are one row from the start.  A key that more than ``most`` fingerprints share is cut
again by the pigeonhole rule: its still unknown bits fall into r+1 blocks, a pair within r agrees on one of them, and keys
grow by each block in turn until groups are small or few bits are left.  A group is compared whole, block by block, and
gives at most one link per member, enough for its components.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other.  Rows that
share an id take part each by its own text; ``keep_one`` keeps one row of a group, the first by file and place if ids tie.
Null ids take part but never name a component unless all its ids are null.  Empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from . import common as C, text as T

BITS = 64


def fingerprint_of(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text's words; for tests and short jobs."""
    if not words:
        return 0
    h = [xxh64_intdigest(b" ".join(words[i:i + width]), seed) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << k for k in range(BITS) if 2 * sum(x >> k & 1 for x in h) > len(h))


def majority(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Bit majorities (as uint64) of the hash groups h[cut[i]:cut[i+1]]."""
    out = np.zeros(len(cut) - 1, np.uint64)
    full = np.flatnonzero(cut[1:] > cut[:-1])
    if not len(full):
        return out
    n = (cut[1:] - cut[:-1])[full]
    for byte in range(8):
        part = ((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        for bit in range(8):
            ones = np.add.reduceat((part >> bit) & 1, cut[:-1][full], dtype=np.int64)
            out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp bigint) per row, and ROW if df has it; A-Z are lower-cased, words end at 0x20 and 0x09-0x0D."""
    more = [C.ROW] if C.ROW in df.columns else []

    def run(batches):
        for batch in batches:
            data, off = T.utf8(batch.column(1))
            fps = []
            for i, j in T.chunks(off, 1 << 20):
                lo = off[i]
                b, doc = data[lo:off[j]], off[i:j + 1] - lo
                b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
                s, e = T.word_starts(b, doc)
                # words of a chunk joined by one blank: shingle k is one slice of that buffer
                idx, at = T.expand(np.concatenate([s, [0]]), np.zeros(0, np.int64)) if not len(s) else _joined(s, e)
                joined = b[idx]
                if len(s):
                    joined[at[1:] - 1] = 32
                raw = joined.tobytes()
                first = np.searchsorted(s, doc)
                words = first[1:] - first[:-1]
                n = np.where(words == 0, 0, np.maximum(1, words - width + 1))
                cut = np.concatenate([[0], np.cumsum(n)])
                k = np.arange(cut[-1]) + np.repeat(first[:-1] - cut[:-1], n)
                last = np.minimum(k + width, np.repeat(first[1:], n))
                h = np.fromiter([xxh64_intdigest(raw[x:y], seed) for x, y in zip(at[k].tolist(), (at[last] - 1).tolist())], np.uint64, len(k))
                fps.append(majority(h, cut))
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["id", "fp", *more])

    schema = "id bigint, fp bigint" + "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in more)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more).mapInArrow(T.tidy(run), schema).withColumnRenamed("id", id_col)


def _joined(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the words' bytes with one byte more after each, and the words' places in it."""
    size = e - s + 1
    at = np.concatenate([[0], np.cumsum(size)])
    idx = np.arange(at[-1]) + np.repeat(s - at[:-1], size)
    idx[at[1:] - 1] = s
    return idx, at


def masks(radius: int = 3) -> list[int]:
    """The 2^(radius+1) - 1 covering masks; m(i) runs through the non-zero vectors in turn."""
    m = [i % ((1 << radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(m[i] & v).count("1") & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside mask in ``parts`` blocks of near-equal size."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in free[p::parts]) for p in range(parts)]


def groups(fps: DataFrame, radius: int = 3, most: int = 1024, floor_bits: int = 13) -> DataFrame:
    """(mask, key, members): groups of at least two fingerprints that hold every pair within the radius."""
    todo = [(m, C_) for m, C_ in ((m, None) for m in masks(radius))]
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m, _ in todo])).alias("mask"))
    out, level = None, {m for m, _ in todo}
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        deepest = all(BITS - bin(m).count("1") <= floor_bits for m in level)
        if deepest:
            small = rows
        else:
            big = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("mask").alias("_m"), F.col("key").alias("_k"))
            big = C.stored(big, "hot-keys")
            on = (F.col("mask") == F.col("_m")) & (F.col("key") == F.col("_k"))
            any_big = bool(big.take(1))
            small = rows.join(big, on, "left_anti") if any_big else rows
        got = small.groupBy("mask", "key").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1).select("members")
        out = got if out is None else out.unionByName(got)
        if deepest or not any_big:
            return out
        # each hot key goes on under r+1 longer masks
        step = {m: [m | b for b in _blocks(m, radius + 1)] for m in level}
        level = {x for v in step.values() for x in v}
        longer = F.create_map(*[y for m, v in step.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in v]))])
        rows = C.stored(rows.join(big, on, "left_semi").select("fp", F.explode(longer[F.col("mask")]).alias("mask")).distinct(), "hot-rows")


def links(found: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links of each group that join its components under the radius; at most one fewer than its members."""
    def run(batches):
        for batch in batches:
            a, b = [], []
            off, flat = batch.column(0).offsets.to_numpy(), batch.column(0).values.to_numpy().view(np.uint64)
            for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
                for u, v in spanning(flat[x:y], radius):
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    return found.mapInArrow(run, "a bigint, b bigint")


def spanning(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a breadth-first forest over the fingerprints within the radius of each other."""
    left, out = fp, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                hit = left[near]
                out += [(int(at), int(x)) for x in hit]
                front, left = np.concatenate([front, hit]), left[~near]
    return out


def near_groups(fp_rows: DataFrame, id_col: str = "doc_id", radius: int = 3, most: int = 1024) -> DataFrame:
    """(id_col, fp, component_id) per row of fp_rows(id_col, fp); with ROW also that and ``kept``, true for one row of a component."""
    more = [C.ROW] if C.ROW in fp_rows.columns else []
    rows = C.stored(fp_rows.select(F.col(id_col).alias("id"), "fp", *more), "fingerprints")
    each = C.stored(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *more)).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fp")
    pairs = C.stored(links(groups(each.select("fp"), radius, most), radius).distinct(), "links")
    root = C.components(pairs).withColumnsRenamed({"node": "fp"})
    named = each.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    label = named.join(best, "root").select("fp", "best", "n")
    out = C.join_groups(rows.withColumn("_b", F.unhex(F.hex("fp"))), label.select(F.unhex(F.hex("fp")).alias("_b"), "best", "n"), "_b", "id", rows.count())
    return out.select(F.col("id").alias(id_col), "fp", F.col("best")["id"].alias("component_id"), *more, *[(F.col(c) == F.col("best")[c]).alias("kept") for c in more])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: bool = False, **kw) -> DataFrame:
    """One document of each group stays: the smallest id; all columns of df.  ``table``: df is a plain read of stored files."""
    rows = C.rowed(df, table)
    return C.without(rows, near_groups(fingerprints(rows, id_col, text_col), id_col, **kw).filter("not kept").select(C.ROW))
