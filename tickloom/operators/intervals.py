"""What lies inside intervals, without pairs of intervals and events.

Events of one moment become one row.  An interval visits the time buckets that it touches; in a bucket events are sorted once, sums
are differences of running sums, and extremes and first crossings come from tables over runs of 2^k events.  So the work grows
with events and intervals, not with how many of the one lie in the other.  Tables span at most CHUNK events at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import bucket_no

CHUNK = 65_536
NEVER = 2 ** 62


def visits(left: DataFrame, events: DataFrame, lo: str, hi: str, bucket: int, by: Sequence[str], on: str, fold: Callable, schema: str) -> DataFrame:
    """``fold(left rows, events)`` per key and bucket; rows without a key or time meet nothing."""
    there = lambda names: " and ".join(f"`{c}` is not null" for c in names)
    l = left.filter(there([*by, lo, hi])).withColumn("_b", F.explode(F.sequence(bucket_no(lo, bucket), bucket_no(hi, bucket))))
    e = events.filter(there([*by, on])).withColumn("_b", bucket_no(on, bucket))
    return l.groupBy(*by, "_b").cogroup(e.groupBy(*by, "_b")).applyInArrow(lambda a, b: fold(a, b.take(np.argsort(_array(b, on), kind="stable"))), schema)


def _array(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _or_0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def places(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, closed: str) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of sorted times inside the intervals."""
    i = np.searchsorted(t, lo, "left" if closed[0] == "[" else "right")
    return i, np.maximum(i, np.searchsorted(t, hi, "right" if closed[1] == "]" else "left"))


def _chunks(v: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int):
    """(chunk of v, its first place, runs that reach into it, their ends within it)"""
    for at in range(0, len(v), chunk):
        part = v[at:at + chunk]
        a, b = np.clip(i - at, 0, len(part)), np.clip(j - at, 0, len(part))
        rows = np.flatnonzero(b > a)
        if len(rows):
            yield part, at, rows, a[rows], b[rows]


def sums(v: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Sum of v over each run; what is not finite stays within the runs that hold it."""
    out = np.zeros(len(i), v.dtype)
    for part, _, rows, a, b in _chunks(v, i, j, chunk):
        run = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[b] - c[a]
        fine = np.isfinite(part)
        out[rows] += run(np.where(fine, part, 0).astype(v.dtype))
        if not fine.all():
            for odd, held in ((np.nan, np.isnan(part)), (np.inf, part == np.inf), (-np.inf, part == -np.inf)):
                out[rows] += np.where(run(held) > 0, odd, 0.0)
    return out


def extremes(v: np.ndarray, i: np.ndarray, j: np.ndarray, pick, start, chunk: int = CHUNK) -> np.ndarray:
    """Largest (pick np.maximum) or smallest (np.fmin) of v over each run, ``start`` for empty ones."""
    out = np.full(len(i), start, v.dtype)
    for part, _, rows, a, b in _chunks(v, i, j, chunk):
        level, most = np.frexp((b - a).astype(float))[1] - 1, part
        for k in range(int(level.max()) + 1):
            if k:
                most = pick(most[:-(1 << k - 1)], most[1 << k - 1:])
            at = np.flatnonzero(level == k)
            out[rows[at]] = pick(out[rows[at]], pick(most[a[at]], most[b[at] - (1 << k)]))
    return out


def first(v: np.ndarray, i: np.ndarray, j: np.ndarray, pick, hit: Callable, chunk: int = CHUNK) -> np.ndarray:
    """Place of the first value of each run that is a hit, -1 without one.

    ``hit(values, rows)`` tells for values of the given runs; it must hold for a stretch's extreme (by ``pick``) if it holds in it.
    """
    out = np.full(len(i), -1, np.int64)
    for part, at, rows, a, b in _chunks(v, i, j, chunk):
        open_ = out[rows] < 0
        rows, pos, b = rows[open_], a[open_], b[open_]
        if not len(rows):
            continue
        most = [part]
        while 2 << len(most) - 1 <= len(part):
            half = 1 << len(most) - 1
            most.append(pick(most[-1][:-half], most[-1][half:]))
        for k in range(len(most) - 1, -1, -1):  # pass over stretches without a hit
            can = np.flatnonzero(pos + (1 << k) <= b)
            pos[can] += np.where(hit(most[k][pos[can]], rows[can]), 0, 1 << k)
        got = pos < b
        out[rows[got]] = at + pos[got]
    return out


def range_agg(left: DataFrame, events: DataFrame, lo: str, hi: str, specs: dict[str, tuple[str, object]], closed: str, bucket: int, key: Sequence[str],
              by: Sequence[str], on: str) -> DataFrame:
    """Count, sum, max or min of a number over the events inside each interval, per ``key``; keys without events are absent."""
    cols = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in specs.items()}
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    e = events.groupBy(*by, on).agg(*[_or_0(kinds[k](c)).alias(f"_v_{n}") for n, (k, c) in cols.items()], *[F.count(c).alias(f"_k_{n}") for n, (_, c) in cols.items()])
    names, kind_of = [f"_{p}_{n}" for n in cols for p in "vk"], {n: k for n, (k, _) in cols.items()}
    kt = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *e.schema.fields]}
    l = left.select(*dict.fromkeys([*key, *by, lo, hi])).filter(" and ".join(f"`{c}` is not null" for c in key))

    def fold(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = places(_array(b, on), _array(a, lo), _array(a, hi), closed)
        some = np.flatnonzero(j > i)
        out, i, j = a.select(list(key)).take(some), i[some], j[some]
        for n, kind in kind_of.items():
            v, k = _array(b, f"_v_{n}"), _array(b, f"_k_{n}")
            if kind in ("max", "min"):
                whole = np.issubdtype(v.dtype, np.integer)
                none = (np.iinfo(v.dtype).min if whole else -np.inf) if kind == "max" else np.iinfo(v.dtype).max if whole else np.nan
                got = extremes(np.where(k > 0, v, none).astype(v.dtype), i, j, np.maximum if kind == "max" else np.fmin, none)
            else:
                got = sums(v, i, j)
            out = out.append_column(f"_v_{n}", pa.array(got)).append_column(f"_k_{n}", pa.array(sums(k, i, j)))
        return out

    schema = ", ".join(f"`{c}` {kt[c]}" for c in [*key, *names])
    p = visits(l, e, lo, hi, bucket, by, on, fold, schema)
    held = lambda n: F.when(F.col(f"_k_{n}") > 0, F.col(f"_v_{n}"))
    return p.groupBy(*key).agg(*[F.sum(f"_v_{n}").alias(n) if k == "count" else kinds[k](held(n)).alias(n) for n, (k, _) in cols.items()])


def crossings(left: DataFrame, events: DataFrame, horizons: Sequence[int], level: float, bucket: int, keep: Sequence[str]) -> DataFrame:
    """Per row of left(symbol, reference_mid, _t0, _t1, *keep), horizon and bucket with events(symbol, ts, mid, signed) from _t0 on:
    _at and _last (time and mid of the last), _hi and _lo (mids), _sum of signed, _up and _down (first times at which the mid is
    ``level`` parts of 10,000 above and below the reference)."""
    e = events.groupBy("symbol", "ts").agg(F.count("mid").alias("_k"), _or_0(F.max("mid")).alias("_hi"), _or_0(F.min("mid")).alias("_lo"), F.count("signed").alias("_ks"), _or_0(F.sum("signed")).alias("_s"))
    kt = {f.name: f.dataType.simpleString() for f in left.schema.fields}

    def fold(a: pa.Table, b: pa.Table) -> pa.Table:
        t, k, ks, s, last = (_array(b, c) for c in ("ts", "_k", "_ks", "_s", "_hi"))
        hi, lo = np.where(k > 0, last, -np.inf), np.where(k > 0, _array(b, "_lo"), np.nan)
        t0, ref = _array(a, "_t0"), a["reference_mid"].to_numpy().astype(float)
        i, j = places(t, t0, t0 + max(horizons), "[]")
        with np.errstate(all="ignore"):
            # NaN counts as the largest number, as in comparisons of columns
            up = first(hi, i, j, np.maximum, lambda v, r: ~((v / ref[r] - 1) * 10000 < level) & ~np.isnan(ref[r]))
            down = first(lo, i, j, np.fmin, lambda v, r: (v / ref[r] - 1) * 10000 <= -level)
        up, down = (np.array([*t, NEVER])[x] for x in (up, down))
        out = []
        for h in horizons:
            j = places(t, t0, t0 + h, "[]")[1]
            r = np.flatnonzero(j > i)
            x, y = i[r], j[r]
            cut = lambda c: np.where(c[r] <= t0[r] + h, c[r], NEVER)
            cols = {"horizon": np.full(len(r), h, np.int64), "_at": t[y - 1], "_last": last[y - 1], "_hi": extremes(hi, x, y, np.maximum, -np.inf), "_lo": extremes(lo, x, y, np.fmin, np.nan),
                    "_sum": sums(s, x, y), "_has": k[y - 1], "_k": sums(k, x, y), "_ks": sums(ks, x, y), "_up": cut(up), "_down": cut(down)}
            got = a.select(list(keep)).take(r)
            for name, c in cols.items():
                got = got.append_column(name, pa.array(c))
            out.append(got)
        return pa.concat_tables(out)

    schema = ", ".join(f"`{c}` {kt[c]}" for c in keep) + ", horizon long, _at long, _last double, _hi double, _lo double, _sum double, _has long, _k long, _ks long, _up long, _down long"
    d = visits(left.select(*dict.fromkeys([*keep, "symbol", "reference_mid", "_t0", "_t1"])), e, "_t0", "_t1", bucket, ["symbol"], "ts", fold, schema)
    if_ = lambda n, c: F.when(F.col(n) > 0, F.col(c))
    time = lambda c: F.when(F.col(c) < NEVER, F.col(c))
    return d.select(*keep, "horizon", "_at", if_("_has", "_last").alias("_last"), if_("_k", "_hi").alias("_hi"), if_("_k", "_lo").alias("_lo"), if_("_ks", "_sum").alias("_sum"), time("_up").alias("_up"), time("_down").alias("_down"))
