"""Ordered computation without one task per key.

A symbol may hold a third of all rows, so nothing here partitions by the symbol
alone.  Running values use a two-level scan (time slices, then the small table of
slices), bounded frames use equal blocks of rows with copied edge rows, and
recurrences carry a compact state between slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import DAY, bucket_no

UP = Window.unboundedPreceding


def _agg(kind: str, c: Column, order: Sequence[str]) -> Column:
    if kind == "last":
        return F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](c)


def _carry(kind: str, name: str, w) -> Column:
    if kind == "last":
        return F.last(name, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}[kind](name).over(w)


def _local(kind: str, c: Column, w) -> Column:
    if kind == "last":
        return F.last(F.when(c.isNotNull(), F.struct(c.alias("v"))), ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](c).over(w)


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "last":
        return F.coalesce(b, a)["v"]
    if kind in ("max", "min"):
        return F.greatest(a, b) if kind == "max" else F.least(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)  # no neutral value: 0 times infinity is NaN


MOST = 1 << 20


def bounded_slices(d: DataFrame, by: Sequence[str], order: Sequence[str], most: int = MOST) -> DataFrame:
    """d(by, _slice, ...) with ``_cut``: 0, but in a slice of more than ``most`` rows its runs of most rows, in order.

    Slices are counted first.  Only rows of slices above the bound are dealt out anew, by ranges of their full order with a
    row number for the last, so a day, a moment or a row repeated any number of times takes many tasks.  Each task counts on
    over its sorted rows, a table with a row per task and slice adds what came before, and places are stored.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    keys = [*by, "_slice"]
    full = settled(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most))
    total = full.agg(F.sum("_rows")).first()[0]
    if not total:
        return d.withColumn("_cut", F.lit(0).cast("long"))
    names = d.columns
    f = full.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)])

    def same(t: DataFrame, other: DataFrame) -> Column:
        out = F.lit(True)
        for i, k in enumerate(keys):
            out = out & t[k].eqNullSafe(other[f"_f{i}"])
        return out

    def count(batches):
        task, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            place = []
            for k in zip(*cols):
                n = n + 1 if k == last else 0
                last = k
                place.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(place), pa.int32()), pa.array(place, pa.int64())], [*batch.schema.names, "_task", "_place"])

    ranges = [*keys, *[o for o in order if o not in keys], "_any"]
    h = d.join(f, same(d, f), "left_semi").withColumn("_any", F.monotonically_increasing_id())
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in h.schema.fields)
    h = settled(h.repartitionByRange(int(-(-2 * total // most)), *ranges).sortWithinPartitions(*ranges).mapInArrow(count, f"{schema}, _task int, _place long"))
    w = Window.partitionBy(*keys).orderBy("_task").rowsBetween(UP, -1)
    ahead = h.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_ahead", F.coalesce(F.sum("_rows").over(w), F.lit(0)))
    ahead = ahead.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], F.col("_task").alias("_bt"), "_ahead")
    h = h.join(ahead, same(h, ahead) & (h["_task"] == ahead["_bt"])).withColumn("_cut", F.floor((F.col("_ahead") + F.col("_place")) / most).cast("long"))
    return d.join(f, same(d, f), "left_anti").withColumn("_cut", F.lit(0).cast("long")).unionByName(h.select(*names, "_cut"))


def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, object]],
                slice_width: int = DAY, slice_col: Column | None = None, exclusive: bool = False,
                totals: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """Running sum/count/max/min/last per key in ``order``, exact and skew-free.

    Level one aggregates each (key, slice); level two scans the slice table, which
    has one row per key and slice; the carried values join back and finish inside
    the slice.  ``order[0]`` must be the sliced column.  ``totals`` maps an extra column
    to the output whose whole-key sum (or count) it carries, from the same slice table.  With ``most`` slices are counted
    while the plan is made, and none of more than so many rows stays whole (``bounded_slices``).
    """
    by, order = list(by), list(order)
    place = ["_slice", "_cut"] if most else ["_slice"]
    part = by + place
    d = df.withColumn("_slice", slice_col if slice_col is not None else bucket_no(order[0], slice_width))
    d = bounded_slices(d, by, order, most) if most else d
    cols = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in specs.items()}
    table = d.groupBy(*part).agg(*[_agg(k, c, order).alias(f"_t_{n}") for n, (k, c) in cols.items()])
    keys = by or [F.lit(0)]
    wc = Window.partitionBy(*keys).orderBy(*place).rowsBetween(UP, -1)
    whole = Window.partitionBy(*keys)
    carry = table.select(*part, *[_carry(k, f"_t_{n}", wc).alias(f"_c_{n}") for n, (k, _) in cols.items()],
                         *[F.sum(f"_t_{n}").over(whole).alias(t) for t, n in (totals or {}).items()])
    wl = Window.partitionBy(*part).orderBy(*order).rowsBetween(UP, -1 if exclusive else 0)
    out = d.join(carry, part, "left").withColumns({f"_l_{n}": _local(k, c, wl) for n, (k, c) in cols.items()})
    out = out.withColumns({n: _merge(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in cols.items()})
    return out.drop(*place, *[f"_{p}_{n}" for n in cols for p in "cl"])


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_i",
              slice_width: int = DAY, slice_col: Column | None = None, total: str | None = None, most: int | None = None) -> DataFrame:
    """0-based position of each row in its key; ``total`` also attaches the key's row count."""
    out = prefix_scan(df, by, order, {name: ("count", F.lit(1))}, slice_width, slice_col, totals={total: name} if total else None, most=most)
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def indexed(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_width: int = DAY, most: int | None = None) -> DataFrame:
    """``df`` with its row position ``_i``; a frame that carries it already is left alone.

    Index once, then chain ``framed`` and ``recurrences``: they reuse ``_i`` instead
    of scanning the input again.
    """
    return df if "_i" in df.columns else row_index(df, by, order, "_i", slice_width, most=most)


def pin(df: DataFrame) -> DataFrame:
    """Keep a derived, already reduced set that several branches read (spills to disk, recomputed if executors die)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def dealt(df: DataFrame, by: Sequence[str], rows: int = 1 << 18) -> DataFrame:
    """df dealt by ``by`` over a task for each ``rows`` rows (counted while the plan is made).

    For steps that sort a task's rows several times: Spark merges small partitions by shuffled bytes, not by what the sorts hold.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def settled(df: DataFrame) -> DataFrame:
    """A derived set that many later steps read, written once to the shared folder, so their plans start from files."""
    import uuid

    from ..session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(df.sparkSession)}/set-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str],
           *stages: Callable[[object], dict[str, Column]], back: int = 0, ahead: int = 0,
           block: int = 2048, slice_width: int = DAY) -> DataFrame:
    """Bounded-frame window columns over blocks of ``block`` rows.

    Every block also receives the last ``back`` rows before it and the first
    ``ahead`` rows after it, so any frame, lag or lead within that reach is exact.
    ``stages`` get a WindowSpec and return columns; a later stage sees the earlier
    ones (its look-back adds up, count the total in ``back``).
    """
    size = max(block, back, ahead, 1)
    keep = "_i" in df.columns
    d = indexed(df, by, order, slice_width)
    home = F.floor(F.col("_i") / size).cast("long")
    off = F.col("_i") % size
    none = F.lit(None).cast("long")
    copies = F.array_compact(F.array(
        home,
        F.when(off >= size - back, home + 1) if back else none,
        F.when((off < ahead) & (home > 0), home - 1) if ahead else none))
    x = d.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*by, "_blk").orderBy("_i")
    for stage in stages:
        x = x.withColumns(stage(w))
    x = x.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")
    return x if keep else x.drop("_i")


def k_rows(w, k: int, lag: int = 0):
    """Frame of the ``k`` rows ending ``lag`` rows back."""
    return w.rowsBetween(-k + 1 - lag, -lag)


SUPER = 256


def _after(acc, e) -> Column:
    """Affine step e after acc, both as structs (a, c) of y = a * y' + c."""
    return F.struct((acc["a"] * e["a"]).alias("a"), (e["a"] * acc["c"] + e["c"]).alias("c"))


def _same() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))


def _ema_parts(name: str, x: Column, alpha: float, w) -> tuple[list[dict[str, Column]], list[Column]]:
    """Columns inside a block (three stages) and block aggregates of one EMA.

    A value g rows after the one before it enters with weight alpha / ((1-alpha)^g + alpha), so NULLs let the past decay
    and the output is carried over them.  Products of decays are kept as sums of logs from the block's first value on.
    """
    n, i = name, F.col("_i")
    running, before = w.rowsBetween(UP, 0), w.rowsBetween(UP, -1)
    if alpha >= 1.0:  # the value itself
        one = {f"_v_{n}": x, f"_o_{n}": F.last(x, ignorenulls=True).over(running)}
        return [one], [F.max_by(F.struct(x.alias("v")), F.when(x.isNotNull(), i)).alias(f"_e_{n}"), F.count(x).alias(f"_k_{n}")]
    lb = math.log(1.0 - alpha)
    at = F.when(x.isNotNull(), i)
    gap = F.col(f"_at_{n}") - F.col(f"_prev_{n}")
    decay = F.exp(gap * lb)
    log = F.when(gap == 1, F.lit(lb)).when(gap > 1, gap * lb - F.log(decay + alpha)).otherwise(F.lit(0.0))
    gain = F.when(gap == 1, F.lit(float(alpha))).otherwise(alpha / (decay + alpha))
    first = {f"_v_{n}": x, f"_at_{n}": at, f"_prev_{n}": F.last(at, ignorenulls=True).over(before), f"_x_{n}": F.first(x, ignorenulls=True).over(running),
             f"_f_{n}": F.first(at, ignorenulls=True).over(running)}
    second = {f"_L_{n}": F.sum(log).over(running), f"_g_{n}": gain}
    third = {f"_S_{n}": F.coalesce(F.sum(F.when(F.col(f"_prev_{n}").isNotNull(), F.col(f"_g_{n}") * F.col(f"_v_{n}") * F.exp(-F.col(f"_L_{n}")))).over(running), F.lit(0.0))}
    end = F.max_by(F.struct(F.col(f"_L_{n}").alias("l"), F.col(f"_S_{n}").alias("s"), F.col(f"_x_{n}").alias("x"), F.col(f"_f_{n}").alias("f"), i.alias("i")), F.col(f"_at_{n}"))
    return [first, second, third], [end.alias(f"_e_{n}"), F.count(f"_v_{n}").alias(f"_k_{n}")]


def _weight_of_past(gap: Column, alpha: float) -> Column:
    """What is left of the value before, ``gap`` rows ago; 0 if there is none."""
    d = F.exp(gap * math.log(1.0 - alpha))
    return F.when(gap.isNull(), F.lit(0.0)).when(gap == 1, F.lit(1.0 - alpha)).otherwise(d / (d + alpha))


def _entering(t: DataFrame, by: list[str], at: str, names: list[str]) -> DataFrame:
    """t with _in_*: the value that enters each affine step _w_*, folded from a key's first step on.

    Steps are folded within groups of SUPER blocks, group totals within groups of groups, and their totals over the key, each
    by a window over the one table of blocks: no list is longer than a group, and nothing is planned twice.
    """
    group, groups = [*by, "_u1"], [*by, "_u2"]
    w1, w2, w3 = (Window.partitionBy(*k).orderBy(at) for k in (group, groups, by))
    before = lambda w: w.rowsBetween(UP, -1)
    fold = lambda c, w: F.aggregate(F.collect_list(c).over(before(w)), _same(), _after)
    t = t.withColumns({"_u1": F.floor(F.col(at) / SUPER), "_u2": F.floor(F.col(at) / SUPER ** 2)})
    t = t.withColumns({"_z1": F.lead(F.lit(1)).over(w1).isNull(), "_z2": F.lead(F.lit(1)).over(w2).isNull(), **{f"_p1_{n}": fold(f"_w_{n}", w1) for n in names}})
    t = t.withColumns({f"_t1_{n}": F.when(F.col("_z1"), _after(F.col(f"_p1_{n}"), F.col(f"_w_{n}"))) for n in names})
    t = t.withColumns({f"_p2_{n}": fold(f"_t1_{n}", w2) for n in names})
    t = t.withColumns({f"_t2_{n}": F.when(F.col("_z2"), _after(F.col(f"_p2_{n}"), F.col(f"_t1_{n}"))) for n in names})
    value = lambda e, y: e["a"] * y + e["c"]
    top = lambda n: F.aggregate(F.collect_list(f"_t2_{n}").over(before(w3)), F.lit(0.0), lambda acc, e: value(e, acc))
    t = t.withColumns({f"_t3_{n}": top(n) for n in names})
    return t.withColumns({f"_in_{n}": value(F.col(f"_p1_{n}"), value(F.col(f"_p2_{n}"), F.col(f"_t3_{n}"))) for n in names})


def recurrences(df: DataFrame, by: Sequence[str], order: Sequence[str], emas: dict[str, tuple] | None = None,
                runs: dict[str, Column] | None = None, skip: int = 0, block: int = 256, slice_width: int = DAY) -> DataFrame:
    """Exponential recurrences and run lengths in one pass over row blocks.

    ``emas`` maps an output to (input, alpha) or (input, alpha, min_periods): y = (1-alpha)*y' + alpha*x, seeded with the
    first x; the first ``skip`` rows of each key stay NULL, and so do rows before the min_periods-th value.  A NULL keeps
    the last output and lets the past decay once more, as ``ewm(adjust=False)`` has it; alpha 1 gives the last value.
    ``runs`` maps an output to a state column: how many rows ending here share the state.

    A block is one affine step from the value that enters it to the one that leaves it.  Steps are folded over groups of
    SUPER blocks, groups of groups and then all of a key's largest groups, so the result is exact in double precision.  Blocks are as short as
    the decay asks for, so no power leaves the range of a double.  A run continues into a block when the states meet at
    its edge.  One table with a row per block serves all outputs.
    """
    by, runs = list(by), runs or {}
    emas = {n: (c, float(alpha), *(mp or [1])) for n, (c, alpha, *mp) in (emas or {}).items()}
    steepest = max([-math.log(1.0 - alpha) for _, alpha, _ in emas.values() if alpha < 1.0], default=0.0)
    block = max(1, min(block, int(600 / steepest))) if steepest else block
    keep = "_i" in df.columns
    d = indexed(df, by, order, slice_width).withColumn("_p", F.col("_i") - skip)
    d = d.withColumn("_blk", F.when(F.col("_p") >= 0, F.floor(F.col("_p") / block)).otherwise(-1).cast("long"))
    d = d.withColumns({f"_s_{n}": c for n, c in runs.items()})
    part = by + ["_blk"]
    w = Window.partitionBy(*part).orderBy("_i")
    running = w.rowsBetween(UP, 0)
    wb = Window.partitionBy(*by).orderBy("_blk")
    before = wb.rowsBetween(UP, -1)
    ends = [F.min("_i").alias("_n0")]
    stages: list[dict[str, Column]] = [{}, {}, {}]
    for n, (c, alpha, mp) in emas.items():
        got, last = _ema_parts(n, F.when(F.col("_p") >= 0, F.col(c).cast("double")), alpha, w)
        for k, cols in enumerate(got):
            stages[k].update(cols)
        stages[1][f"_m_{n}"] = F.count(f"_v_{n}").over(running)
        ends += last
    for n in runs:
        st = F.col(f"_s_{n}")
        stages[0][f"_c_{n}"] = F.when(~st.eqNullSafe(F.lag(st, 1).over(w)) & (F.lag(F.lit(1), 1).over(w).isNotNull()), F.col("_i"))
        ends += [F.min_by(f"_s_{n}", "_i").alias(f"_f_{n}"), F.max_by(f"_s_{n}", "_i").alias(f"_z_{n}"), F.max(f"_c_{n}").alias(f"_m_{n}")]
    for cols in stages:
        d = d.withColumns(cols)
    t, outs = d.groupBy(*part).agg(*ends), {}
    steps = {n: a for n, (_, a, _) in emas.items() if a < 1.0}
    for n, (_, alpha, mp) in emas.items():
        t = t.withColumn(f"_seen_{n}", F.coalesce(F.sum(f"_k_{n}").over(before), F.lit(0)))
        if alpha >= 1.0:
            t = t.withColumn(f"_in_{n}", F.last(f"_e_{n}", ignorenulls=True).over(before)["v"])
        else:
            e = F.col(f"_e_{n}")
            t = t.withColumn(f"_last_{n}", F.last(e["i"], ignorenulls=True).over(before))
            past = _weight_of_past(e["f"] - F.col(f"_last_{n}"), alpha)
            t = t.withColumn(f"_w_{n}", F.when(e.isNull(), _same()).otherwise(F.struct((F.exp(e["l"]) * past).alias("a"), (F.exp(e["l"]) * ((1 - past) * e["x"] + e["s"])).alias("c"))))
    if steps:
        t = _entering(t, by, "_blk", list(steps))
    for n, (_, alpha, mp) in emas.items():
        if alpha >= 1.0:
            y = F.coalesce(f"_o_{n}", f"_in_{n}")
        else:
            past = _weight_of_past(F.col(f"_f_{n}") - F.col(f"_last_{n}"), alpha)
            y = F.when(F.col(f"_f_{n}").isNull(), F.when(F.col(f"_last_{n}").isNotNull(), F.col(f"_in_{n}"))).otherwise(
                F.exp(f"_L_{n}") * (F.when(F.col(f"_last_{n}").isNull(), 0.0).otherwise(past * F.col(f"_in_{n}")) + (1 - past) * F.col(f"_x_{n}") + F.col(f"_S_{n}")))
        outs[n] = F.when((F.col("_p") >= 0) & (F.col(f"_seen_{n}") + F.col(f"_m_{n}") >= mp), y)
    # start of the run that reaches a block's first row
    for n in runs:
        t = t.withColumn(f"_edge_{n}", F.when(F.col(f"_f_{n}").eqNullSafe(F.lag(f"_z_{n}", 1).over(wb)) & (F.lag("_n0", 1).over(wb).isNotNull()), None).otherwise(F.col("_n0")))
    for n in runs:
        prior = F.max(F.greatest(f"_edge_{n}", f"_m_{n}")).over(before)
        t = t.withColumn(f"_st_{n}", F.coalesce(F.col(f"_edge_{n}"), prior))
        outs[n] = F.col("_i") - F.coalesce(F.max(f"_c_{n}").over(running), F.col(f"_st_{n}")) + 1
    carried = [f"_{p}_{n}" for n in emas for p in ("seen", "in", "last") if p != "last" or n in steps] + [f"_st_{n}" for n in runs]
    d = d.join(t.select(*part, *carried), part, "left").withColumns(outs)
    drop = ["_p", "_blk", *carried, *[c for cols in stages for c in cols], *[f"_s_{n}" for n in runs]]
    return d.drop(*drop) if keep else d.drop("_i", *drop)


def affine_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, float]], **kw) -> DataFrame:
    """EMA family only, see ``recurrences``."""
    return recurrences(df, by, order, emas=specs, **kw)


# --- greedy chains -------------------------------------------------------------------------

SLICE_ROWS = 65_536
FAN = 32


def _entry_states(maps: DataFrame, by: Sequence[str], most: int, merge: Callable, step: Callable, start, kind: str) -> DataFrame:
    """(by, _slice, _entry): the state that enters each slice of its key, from maps(by, _slice, payload) "entry -> exit".

    Up a tree, FAN neighbouring maps are merged into one until a key has FAN of them; down the tree, each group's entry is
    led through its own maps.  ``most`` is the number of slices of the longest key.  A group never holds more than FAN maps.
    ``merge`` makes one payload (a dict) of several rows' (in order), ``step(row, state)`` applies one.
    """
    import pandas as pd

    by = list(by)
    kt = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    load = [c for c in maps.columns if c not in (*by, "_slice")]
    head = "".join(f"`{k}` {kt[k]}, " for k in by)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("_slice")
        got = merge([r for _, r in p.iterrows()])
        return pd.DataFrame({**{k: [p[k].iloc[0]] for k in by}, "_slice": [p["_slice"].iloc[0] // FAN], **{c: [got[c]] for c in load}})

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("_slice")
        state, entry = (p["_from"].iloc[0] if "_from" in p else start), []
        for _, r in p.iterrows():
            entry.append(state)
            state = step(r, state)
        return p[[*by, "_slice"]].assign(_entry=entry)

    schema = f"{head}_slice long, _entry {kind}"
    levels, n = [maps], most
    while n > FAN:
        t = levels[-1] = settled(levels[-1])  # read on the way up and on the way down
        levels.append(t.withColumn("_up", F.floor(F.col("_slice") / FAN)).groupBy(*by, "_up").applyInPandas(merged, f"{head}_slice long, " + ", ".join(f"`{c}` {kt[c]}" for c in load)))
        n = -(-n // FAN)
    out = levels[-1].groupBy(*by).applyInPandas(walked, schema)
    for t in reversed(levels[:-1]):
        up = out.select(*by, F.col("_slice").alias("_up"), F.col("_entry").alias("_from"))
        out = t.withColumn("_up", F.floor(F.col("_slice") / FAN)).join(up, [*by, "_up"]).groupBy(*by, "_up").applyInPandas(walked, schema)
    return out


def _slices_of(d: DataFrame) -> int:
    """Number of slices of the longest key; d is pinned, so its rows are numbered once for this and what follows."""
    return (d.agg(F.max("_slice")).first()[0] or 0) + 1


def _row_slices(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_width: int, slice_rows: int) -> DataFrame:
    """``_slice``: consecutive rows of a key, at most slice_rows of them, however they lie in time."""
    d = row_index(df, by, order, "_at", slice_width, most=MOST)
    return d.withColumn("_slice", F.floor(F.col("_at") / slice_rows).cast("long")).drop("_at")


def greedy_chain(df: DataFrame, by: Sequence[str], ts: str, free_at: Column, tie: Sequence[str] = (),
                 slice_width: int = DAY, strict: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Keep a row when its time is at or past the moment the last kept row frees its key.

    ``free_at`` is a BIGINT column (for a cooldown: ts + spacing); ``strict`` needs
    the time to be past it.  Each (key, slice) is summarised as a step function
    "entry moment -> exit moment", which stays small because chains that start at
    different rows run into each other.  The step functions are composed pairwise up
    and down a tree of slices (``_entry_states``) and every slice is then replayed from its true entry moment.  A slice holds slice_rows rows at most; each row knows the
    next row a chain through it keeps, so exits and kept rows come from repeated squaring of these jumps, not a row loop.
    """
    import numpy as np
    import pandas as pd

    by, tie, cols = list(by), list(tie), df.columns
    step = 1 if strict else 0
    d = pin(_row_slices(df.withColumn("_free", (free_at + step).cast("long")), by, [ts, *tie], slice_width, slice_rows))
    part = by + ["_slice"]
    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"`{k}` {kt[k]}" for k in by) + ("," if by else "")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([ts, *tie], kind="mergesort")
        t, fr = p[ts].to_numpy("int64"), p["_free"].to_numpy("int64")
        n = len(t)
        last = np.maximum(np.searchsorted(t, fr, "left"), np.arange(n) + 1)
        last = np.where(last < n, last, np.arange(n))
        while True:  # last kept row of the chain through each row
            far = last[last]
            if (far == last).all():
                break
            last = far
        ex = fr[last]
        first = np.searchsorted(t, t, "left")      # an entry at this time starts at the first row of the tie
        ex = ex[first]
        keep = np.append(ex[1:] != ex[:-1], True)
        row = {k: [pdf[k].iloc[0]] for k in part}
        return pd.DataFrame({**row, "upto": [t[keep]], "exit": [ex[keep]]})

    maps = d.select(*part, ts, *[c for c in tie if c not in part and c != ts], "_free").groupBy(*part).applyInPandas(
        summarise, f"{head} _slice long, upto array<long>, `exit` array<long>")

    # no chain enters a slice later than the latest moment that a row before it frees its key: what lies beyond is cut off
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(UP, -1)
    reach = d.groupBy(*part).agg(F.max("_free").alias("_top")).withColumn("reach", F.coalesce(F.max("_top").over(w), F.lit(-(2 ** 62)))).drop("_top")
    need = F.size(F.filter("upto", lambda x: x < F.col("reach"))) + 1
    maps = maps.join(reach, part).withColumns({"upto": F.slice("upto", F.lit(1), need), "exit": F.slice("exit", F.lit(1), need)})

    def through(row, state):
        """States (one or an array) after a slice."""
        j = np.minimum(np.searchsorted(row["upto"], state, "left"), len(row["upto"]))
        return np.where(j < len(row["upto"]), np.append(row["exit"], 0)[j], state)

    def merge(rows) -> dict:
        reach = rows[0]["reach"]
        at = np.unique(np.concatenate([np.asarray(r["upto"], dtype="int64") for r in rows]))
        at = at[:np.searchsorted(at, reach, "left") + 1]
        state = at
        for r in rows:
            state = through(r, state)
        keep = np.append(state[1:] != state[:-1], True)
        return {"upto": at[keep], "exit": state[keep], "reach": reach}

    entries = _entry_states(maps, by, _slices_of(d), merge, lambda r, state: int(through(r, state)), -(2 ** 62), "long")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values([ts, *tie], kind="mergesort")
        t, fr = p[ts].to_numpy("int64"), p["_free"].to_numpy("int64")
        n = len(t)
        jump = np.append(np.maximum(np.searchsorted(t, fr, "left"), np.arange(n) + 1), n)
        kept = np.array([np.searchsorted(t, int(p["_entry"].iloc[0]), "left")])
        while kept[-1] < n:  # twice as many steps each time
            kept, jump = np.append(kept, jump[kept]), jump[jump]
        return p.iloc[kept[kept < n]][cols]

    return d.join(entries, part).groupBy(*part).applyInPandas(replay, df.schema)


RUN = 256


def fold_states(df: DataFrame, by: Sequence[str], order: Sequence[str], letter: str, states: Sequence[str],
                start: str, step: Callable[[str, str], str], out: str, slice_width: int = DAY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Run a finite-state machine over each key in order and attach the state after each row.

    Each (key, slice) is reduced to "entry state -> exit state" (``len(states)``
    values), the maps are composed up and down a tree of slices, and slices replay from their true entry.  A slice holds slice_rows rows at
    most.  ``step`` fills one table of letters by states; rows then move through it in runs of RUN rows, all runs of a
    slice at once.
    """
    import numpy as np
    import pandas as pd

    by, order, cols = list(by), list(order), df.columns
    part = by + ["_slice"]
    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = ", ".join(f"`{k}` {kt[k]}" for k in by) + ","
    d = pin(_row_slices(df, by, order, slice_width, slice_rows))
    names = list(states)
    number = {s: i for i, s in enumerate(names)}

    def runs(values):
        """(table of letters by states, letters in runs, state map of each run); the last run is filled up with a letter that changes nothing."""
        codes, found = pd.factorize(values, use_na_sentinel=False)
        after = [[step(s, x) for s in names] for x in found]
        live, todo = set(), [start]
        while todo:  # every state that rows can reach must have a number
            i = number[todo.pop()]
            if i not in live:
                live.add(i)
                todo += [row[i] for row in after]
        table = np.array([[number.get(t, i) for i, t in enumerate(row)] for row in after] + [range(len(names))])
        grid = np.full(-(-len(codes) // RUN) * RUN, len(found))
        grid[:len(codes)] = codes
        grid = grid.reshape(-1, RUN)
        maps = np.tile(np.arange(len(names)), (len(grid), 1))
        for k in range(RUN):
            maps = table[grid[:, k, None], maps]
        return table, grid, maps

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        now = np.arange(len(names))
        for m in runs(pdf.sort_values(order)[letter])[2]:
            now = m[now]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in part}, "_map": [[names[i] for i in now]]})

    maps = d.select(*part, *[o for o in order if o not in part], letter).groupBy(*part).applyInPandas(
        summarise, f"{head} _slice long, _map array<string>")

    def merge(rows) -> dict:
        now = list(names)
        for r in rows:
            now = [r["_map"][number[x]] for x in now]
        return {"_map": now}

    entries = _entry_states(maps, by, _slices_of(d), merge, lambda r, state: r["_map"][number[state]], start, "string")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        table, grid, maps = runs(p[letter])
        now, state = np.empty(len(grid), dtype=int), number[p["_entry"].iloc[0]]
        for i, m in enumerate(maps):
            now[i], state = state, m[state]
        got = np.empty(grid.shape, dtype=int)
        for k in range(RUN):
            got[:, k] = now = table[grid[:, k], now]
        return p[cols].assign(**{out: np.array(names, dtype=object)[got.ravel()[:len(p)]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"
    return d.join(entries, part).groupBy(*part).applyInPandas(replay, schema)


# --- global order --------------------------------------------------------------------------

HEAVY = 65_536


def ordered_slices(df: DataFrame, key: Column, tie: str | None = None, n: int = 1024, name: str = "_slice_key") -> DataFrame:
    """Attach an order-preserving slice (struct) of a numeric key.

    Equal-width buckets first; a bucket above ``HEAVY`` rows is cut again into
    equal-width parts of its own range, or of its tie range when it holds one value.
    All bounds are exact minima and maxima, so both uses of the slice agree, and the
    broadcast tables have one row and at most ``n`` rows.
    """
    t = F.col(tie).cast("double") if tie else F.lit(0.0)
    d = df.withColumn("_k0", key.cast("double"))
    lim = d.agg(F.min("_k0").alias("_lo"), F.max("_k0").alias("_hi"))

    def cut(x, lo, hi):
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(n - 1), F.floor(F.try_divide((x - F.col(lo)) * n, F.col(hi) - F.col(lo))))).otherwise(0).cast("long")

    d = d.crossJoin(F.broadcast(lim)).withColumn("_b1", F.coalesce(cut(F.col("_k0"), "_lo", "_hi"), F.lit(-1)))
    stat = d.groupBy("_b1").agg(F.count(F.lit(1)).alias("_bn"), F.min("_k0").alias("_l1"), F.max("_k0").alias("_h1"),
                                F.min(t).alias("_l2"), F.max(t).alias("_h2"))
    d = d.join(F.broadcast(stat), "_b1")
    sub = F.when(F.col("_bn") <= HEAVY, 0).when(F.col("_h1") > F.col("_l1"), cut(F.col("_k0"), "_l1", "_h1")).otherwise(cut(t, "_l2", "_h2"))
    d = d.withColumn(name, F.struct(F.col("_b1").alias("a"), F.coalesce(sub, F.lit(0)).cast("long").alias("b")))
    return d.drop("_k0", "_lo", "_hi", "_b1", "_bn", "_l1", "_h1", "_l2", "_h2")


def log_slice(c: Column, per_octave: int = 1024) -> Column:
    """Order-preserving slice of a double without looking at the data: ``per_octave`` steps per power of two.

    For tables of distinct values (ties already collapsed); no bounds pass is needed.
    """
    step = lambda x: F.floor(F.log2(x) * per_octave).cast("long") + F.lit(1 << 22)
    return F.when(c > 0, step(c)).when(c < 0, -step(-c)).otherwise(0).cast("long")


def global_index(df: DataFrame, by: Sequence[str], key: Column, tie: str | Sequence[str], name: str = "_rank", descending: bool = False,
                 total: str | None = None) -> DataFrame:
    """0-based rank by (key, tie columns ascending) per ``by`` (or overall), without a one-task window.

    The first tie column must be numeric: it splits a heavily repeated key.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    d = df.withColumn("_k", (-key if descending else key).cast("double"))
    d = ordered_slices(d, F.col("_k"), ties[0])
    return row_index(d, by, ["_k", *ties], name, slice_col=F.col("_slice_key"), total=total).drop("_k", "_slice_key")


def ranked(df: DataFrame, by: Sequence[str], key: Column, tie: str | Sequence[str], descending: bool = False) -> DataFrame:
    """``_rank`` and ``_total`` per group."""
    return global_index(df, by, key, tie, "_rank", descending, "_total")


# --- general sequential folds ------------------------------------------------------------------

TRIES = 3


def slice_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], walk: Callable, out_schema: str, slice_width: int = DAY,
               slice_rows: int = SLICE_ROWS, passes: list[int] | None = None) -> DataFrame:
    """Exact sequential fold whose state is neither finite nor composable.

    ``walk(rows, state_text) -> (rows_out, state_text)`` takes the next rows in order.  Slices of at most slice_rows rows are
    walked side by side from the state that is assumed to enter them; where the slice before leaves another one, they are
    walked again.  Chains mostly forget their start within a slice, so one or two passes are usual.  After each TRIES passes
    without agreement, neighbours are joined in pairs and walked one after the other, so a chain that never forgets costs at
    most TRIES * (log2(slices) + 1) passes.  A task streams over its rows and holds one batch of them and one state.
    ``passes`` receives the number of slices that each pass walked.
    """
    import pandas as pd

    by, order, cols = list(by), list(order), df.columns
    kt = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    head = "".join(f"`{k}` {kt[k]}, " for k in by)
    d = settled(_row_slices(df, by, order, slice_width, slice_rows))
    most = _slices_of(d)
    key = [*by, "_slice"]

    def states(batches):
        """Entry and exit of each slice; the state goes on from slice to slice of a group."""
        group, now, state, entry = None, None, "", ""
        for batch in batches:
            out = []
            for k, p in batch.groupby([*by, "_grp", "_slice"], sort=False, dropna=False):
                if k != now:
                    if now is not None:
                        out.append((*now[:-2], now[-1], entry, state))
                    if k[:-1] != group:
                        group, state = k[:-1], p["_from"].iloc[0]
                    now, entry = k, state
                state = walk(p[cols], state)[1]
            yield pd.DataFrame(out, columns=[*key, "_entry", "_exit"])
        if now is not None:
            yield pd.DataFrame([(*now[:-2], now[-1], entry, state)], columns=[*key, "_entry", "_exit"])

    def final(batches):
        now, state = None, ""
        for batch in batches:
            for k, p in batch.groupby(key, sort=False, dropna=False):
                if k != now:
                    now, state = k, p["_entry"].iloc[0]
                rows, state = walk(p[cols], state)
                yield rows

    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice")
    table, join, tries = None, 0, 0
    todo = d.select(*key).distinct().select(*by, F.col("_slice").alias("_grp"), F.lit("").alias("_from"))
    while True:
        rows = d.withColumn("_grp", F.shiftright("_slice", join)).join(todo, [*by, "_grp"])
        got = rows.repartition(*by, F.col("_grp")).sortWithinPartitions(*by, "_grp", "_slice", *order).mapInPandas(states, f"{head}_slice long, _entry string, _exit string")
        table = settled(got if table is None else got.withColumn("_new", F.lit(1)).unionByName(table.withColumn("_new", F.lit(0)))
                        .groupBy(*key).agg(F.max_by(F.struct("_entry", "_exit"), "_new").alias("_s")).select(*key, "_s._entry", "_s._exit"))
        if passes is not None:
            passes.append(todo.count())
        tries += 1
        if tries % TRIES == 0 and (most - 1) >> join:
            join += 1
        t = table.withColumn("_want", F.coalesce(F.lag("_exit").over(w), F.lit(""))).withColumn("_grp", F.shiftright("_slice", join))
        todo = settled(t.groupBy(*by, "_grp").agg(F.min_by("_want", "_slice").alias("_from"), F.max(F.when(F.col("_entry") != F.col("_want"), 1)).alias("_bad")).filter("_bad = 1").drop("_bad"))
        if not todo.take(1):
            break
    entries = table.select(*key, "_entry")
    return d.join(entries, key).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(final, out_schema)
