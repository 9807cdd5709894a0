"""Books at sample times: carried state over many slices against a book kept row by row."""

import random

from pyspark.sql import functions as F

from tickloom.operators import book

L2 = "symbol string, ts long, is_snapshot boolean, side string, price double, amount double"


def _messages(seed: int):
    r, rows = random.Random(seed), []
    for sym, n in (("A", 260), ("B", 40)):
        for t in range(0, n * 3, 3):
            if t % 240 == 0:                                      # a snapshot message of both sides
                rows += [(sym, t, True, s, p, float(r.randint(1, 9))) for s, base in (("bid", 50), ("ask", 60)) for p in {float(base + r.randint(-4, 4)) for _ in range(3)}]
            else:
                side = r.choice(("bid", "ask"))
                rows += [(sym, t, False, side, float((50 if side == "bid" else 60) + k), float(r.choice((0, 0, 1, 2, 5)))) for k in r.sample(range(-4, 5), r.randint(1, 3))]
    return rows


def _brute(rows, times, bands):
    out = {}
    for sym, at in times:
        live, gen, counts = {}, 0, dict.fromkeys(book.COUNTERS, 0.0)
        mine = sorted((x for x in rows if x[0] == sym and x[1] <= at), key=lambda x: x[1])
        for k, (_, ts, snap, side, price, amount) in enumerate(mine):
            if snap and (k == 0 or mine[k - 1][1] != ts):
                live, gen = {}, gen + 1
            if not snap:
                d = amount - live.get((side, price), 0.0)
                counts[f"{side}_{'replenishment' if d > 0 else 'depletion'}"] += abs(d)
            live[side, price] = amount
        b = sorted(((p, a) for (s, p), a in live.items() if s == "bid" and a > 0), reverse=True)
        o = sorted((p, a) for (s, p), a in live.items() if s == "ask" and a > 0)
        if not b and not o:
            continue
        mid = (b[0][0] + o[0][0]) / 2 if b and o else None
        deep = [(sum(a for p, a in b if p >= mid * (1 - d / 10000)), sum(a for p, a in o if p <= mid * (1 + d / 10000))) if mid else (0.0, 0.0) for d in bands]
        top = [sum(a for _, a in b[:5]), sum(a for _, a in o[:5])]
        out[sym, at] = (gen, *[counts[c] for c in book.COUNTERS], b[0][0] if b else None, o[0][0] if o else None, round((top[0] - top[1]) / sum(top), 9), *[x for d in deep for x in d])
    return out


def test_books_over_many_slices_match_a_book_kept_row_by_row(frame):
    bands = (200, 1500)
    rows = _messages(3)
    times = [(s, t) for s in "AB" for t in range(-2, 800, 7)]
    want = _brute(rows, times, bands)
    for size in (5, 64, 16_384):                                  # fewer rows than levels, several slices, one slice
        d = book.book_as_of(frame(rows, L2), frame(times, "symbol string, ts long"), size, bands=bands, strict=False)
        got = {(r.symbol, r.ts): (r.generation, *[r[c] for c in book.COUNTERS], r.best_bid, r.best_ask, round(r.obi_l5, 9), *[r[f"{s}_depth_{b}bp"] for b in bands for s in ("bid", "ask")]) for r in d.collect()}
        assert got == want


def test_book_of_odd_rows(frame):
    rows = [("A", 0, False, "bid", 9.0, 1.0), ("A", 1, True, "bid", 10.0, 1.0), ("A", 1, True, "ask", 12.0, 1.0), ("A", 1, True, "other", 1.0, 1.0), ("A", 1, True, "bid", None, 1.0),
            ("A", 3, False, "bid", 10.0, None), ("A", 4, False, "bid", 10.5, 2.0), ("A", 4, False, "bid", 10.5, 3.0), (None, 1, True, "bid", 1.0, 1.0), ("A", None, True, "bid", 1.0, 1.0)]
    times = frame([("A", 0), ("A", 1), ("A", 2), ("A", 2), ("A", 3), ("A", 5), ("C", 5), (None, 5)], "symbol string, ts long")
    d = book.book_as_of(frame(rows, L2), times, 4, strict=False).orderBy("ts").collect()
    assert [(r.ts, r.best_bid, r.best_ask) for r in d] == [(1, 10.0, 12.0), (2, 10.0, 12.0), (2, 10.0, 12.0), (3, None, 12.0), (5, 10.5, 12.0)]
    assert d[3].bid_depletion == 0.0 and d[3].mid is None and d[4].bid_replenishment == 3.0 and d[4].obi_l1 == 0.5
    empty = book.book_as_of(frame([], L2), times.filter(F.lit(False)), 4)
    assert empty.count() == 0 and "bid_depth_1bp" in empty.columns
