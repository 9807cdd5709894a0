"""Controls, matching and deterministic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hash60, side_sign
from . import scan
from .quality import fail_if


def identity_hash(*parts) -> Column:
    return hash60(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def hash_pick(df: DataFrame, by: Sequence[str], order: str, salt: str) -> DataFrame:
    """One row per group: position = hash(group identity) mod n over the ordered pool.

    Counts come from an aggregate; positions inside a group are numbered in slices, so a
    hot group is never walked whole.
    """
    d = scan.row_index(df, by, [order], "_r", 1 << 20, total="_total")
    return d.filter(F.col("_r") == identity_hash(F.lit(salt), *by) % F.col("_total")).drop("_r", "_total")


def stratified_sample(pop: DataFrame, selected: DataFrame, strata: Sequence[str], key: str, salt: str) -> DataFrame:
    """As many controls per stratum as selected rows, in hash order, selected keys excluded; ``shortage`` is flagged."""
    want = selected.groupBy(*strata).agg(F.count(F.lit(1)).alias("_want"))
    pool = pop.join(selected.select(key), key, "left_anti").withColumn("_h", identity_hash(F.lit(salt), key))
    pool = scan.row_index(pool, strata, ["_h", key], "_r", slice_col=F.shiftright("_h", 50))
    size = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("_have"))
    w = want.join(size, list(strata), "left").withColumn("shortage", F.coalesce("_have", F.lit(0)) < F.col("_want"))
    return pool.join(w, list(strata)).filter(F.col("_r") < F.col("_want")).drop("_h", "_r", "_want", "_have")


def regime_matched(events: DataFrame, pool: DataFrame, strata: Sequence[str], key: str, salt: str, min_distance: int) -> DataFrame:
    """First pool time of the stratum, probing circularly from a hash start, that is far enough from the event.

    Too-near pool rows are one run of positions, bounded by two as-of counts, so the first acceptable position follows
    from the start without probing: the start itself, the end of that run, or the first row.  An event whose whole
    stratum is too near, or empty, has a NULL control and probe.
    """
    strata = list(strata)
    p = scan.row_index(pool.select(*strata, F.col("ts").alias("control_ts")), strata, ["control_ts"], "_pos")
    n = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(None).cast(events.schema[key].dataType)
    # pool rows stand between the two kinds of marks of their time: "before" marks first, "up to" marks last
    rows = pool.select(*strata, F.col("ts").alias("_t"), F.lit(1).alias("_o"), none.alias(key), F.lit(1).alias("_is"))
    mark = lambda t, o: events.select(*strata, t.alias("_t"), F.lit(o).alias("_o"), key, F.lit(0).alias("_is"))
    seen = scan.prefix_scan(rows.unionByName(mark(F.col("ts") - min_distance, 0)).unionByName(mark(F.col("ts") + min_distance, 2)), strata, ["_t", "_o"], {"_c": ("sum", "_is")})
    near = seen.filter("_is = 0").groupBy(key).agg(F.max(F.when(F.col("_o") == 0, F.col("_c"))).alias("_a"), F.max(F.when(F.col("_o") == 2, F.col("_c"))).alias("_b"))
    e = events.select(key, *strata).join(near, key).join(n, strata, "left")
    start = identity_hash(F.lit(salt), key) % F.col("_n")
    e = e.withColumn("_s", start).withColumn("_pos", F.when((F.col("_s") < F.col("_a")) | (F.col("_s") >= F.col("_b")), F.col("_s")).when(F.col("_b") < F.col("_n"), F.col("_b")).when(F.col("_a") > 0, F.lit(0)))
    j = e.join(p, [*strata, "_pos"], "left")
    return j.select(key, "control_ts", F.when(F.col("_pos").isNotNull(), F.pmod(F.col("_pos") - F.col("_s"), F.col("_n"))).alias("probe"))


def baseline_controls(events: DataFrame, panel: DataFrame, ref: str, salt: str, regime: str = "regime") -> DataFrame:
    """Per event and named baseline the control's symbol and side at the same time.

    ``panel(ts, symbol, momentum, regime)``; pools are one timestamp, bounded by the universe.
    """
    w = Window.partitionBy("ts")
    wr = Window.partitionBy("ts", regime)
    p = panel.withColumns({"_r": F.row_number().over(w.orderBy("symbol")) - 1, "_n": F.count(F.lit(1)).over(w), "_rr": F.row_number().over(wr.orderBy("symbol")) - 1, "_rn": F.count(F.lit(1)).over(wr),
                           "_top": F.row_number().over(w.orderBy(F.col("momentum").desc(), "symbol")), "_low": F.row_number().over(w.orderBy("momentum", "symbol"))})
    e = events.select("id", "ts", F.col("symbol").alias("event_symbol"), "side", F.col(regime).alias("_reg"))
    j = e.join(p, "ts").withColumn("_h", identity_hash(F.lit(salt), "id"))
    mom = F.when(F.col("momentum") >= 0, "LONG").otherwise("SHORT")
    flip = F.when(F.col("momentum") >= 0, "SHORT").otherwise("LONG")
    item = lambda ok, name, side: F.when(ok, F.struct(F.lit(name).alias("baseline"), side.alias("control_side")))
    hits = F.array_compact(F.array(item(F.col("_r") == F.col("_h") % F.col("_n"), "RANDOM_ELIGIBLE", F.col("side")),
                                   item((F.col(regime) == F.col("_reg")) & (F.col("_rr") == F.col("_h") % F.col("_rn")), "REGIME_RANDOM", F.col("side")),
                                   item(F.col("_top") == 1, "MOMENTUM", mom), item(F.col("_low") == 1, "REVERSAL", flip), item(F.col("symbol") == ref, "REFERENCE", F.col("side")),
                                   item(F.col("symbol") == F.col("event_symbol"), "ALWAYS_LONG", F.lit("LONG")), item(F.col("symbol") == F.col("event_symbol"), "ALWAYS_SHORT", F.lit("SHORT"))))
    return j.withColumn("_b", F.explode(hits)).select("id", "ts", "_b.baseline", F.col("symbol").alias("control_symbol"), "_b.control_side")


def tiered_match(pos: DataFrame, neg: DataFrame, tiers: Sequence[tuple[str, Sequence[str]]], score: str, ident: str = "id", limit: int = 20) -> DataFrame:
    """Nearest negatives by score gap, tier by tier from the strictest keys to the loosest, ``limit`` per positive.

    The wanted rows are the ``limit`` nearest of each tier, so a positive never meets
    its whole pool: negatives are numbered by score per key, the positive's place among
    them is a running count, and only ``limit`` places on either side can be nearest.
    Below the place equal scores are numbered by falling id and above it by rising id,
    so ties at the edge keep the smallest ids.
    """
    out = None
    for rank, (name, keys) in enumerate(tiers):
        keys = list(keys)
        num = neg.select(*keys, F.col(score).cast("double").alias("_s"), F.col(ident).alias("control_id")).withColumn("_neg", -F.col("control_id"))
        num = scan.ordered_slices(num, F.col("_s"), "control_id")
        cut = F.struct(F.col("_slice_key.a"))       # ties of one score must share a slice in both orders
        num = scan.settled(num)
        hi = scan.row_index(num, keys, ["_s", "control_id"], "_n", slice_col=cut).drop("_slice_key", "_neg")
        lo = scan.row_index(num, keys, ["_s", "_neg"], "_n", slice_col=cut).drop("_slice_key", "_neg")
        u = pos.select(*keys, F.col(score).cast("double").alias("_k"), F.lit(1).alias("_t"), F.col(ident).alias("pos_id"))
        both = num.select(*keys, F.col("_s").alias("_k"), F.lit(0).alias("_t"), F.lit(None).cast("long").alias("pos_id")).unionByName(u)
        at = scan.prefix_scan(scan.ordered_slices(both, F.col("_k"), "_t"), keys, ["_k", "_t"], {"_c": ("count", F.when(F.col("_t") == 0, 1))}, slice_col=F.struct(F.col("_slice_key.a")))
        at = scan.settled(at.filter("_t = 1").select(*keys, "pos_id", F.col("_k").alias("_ps"), "_c"))
        # merged, as Spark reckons with the rows before the explode and would broadcast 2 * limit times as many
        side = lambda df, a, b: at.withColumn("_n", F.explode(F.sequence(F.col("_c") + a, F.col("_c") + b))).hint("merge").join(df, [*keys, "_n"])
        near = side(lo, -limit, -1).unionByName(side(hi, 0, limit - 1)).withColumn("gap", F.abs(F.col("_s") - F.col("_ps")))
        w = Window.partitionBy("pos_id").orderBy("gap", "control_id")
        near = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).select("pos_id", "control_id", "gap", F.lit(rank).alias("_rank"), F.lit(name).alias("tier"))
        near = scan.settled(near)
        out = near if out is None else out.unionByName(near)
    best = out.groupBy("pos_id", "control_id").agg(F.min(F.struct("_rank", "gap", "tier")).alias("b")).select("pos_id", "control_id", "b.*")
    w = Window.partitionBy("pos_id").orderBy("_rank", "gap", "control_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_rank")


def self_exclusion_edges(left: DataFrame, right: DataFrame, keys: Sequence[str], left_cycle: str = "cycle", right_cycle: str = "cycle") -> tuple[DataFrame, DataFrame]:
    """Candidate edges by equal keys without the exact self (same symbol and cycle), and the exclusion counts."""
    l = left.select(*keys, "left_id", F.col("symbol").alias("l_symbol"), F.col(left_cycle).alias("l_cycle"))
    r = right.select(*keys, "right_id", F.col("symbol").alias("r_symbol"), F.col(right_cycle).alias("r_cycle"))
    j = l.join(r, list(keys)).withColumn("self", (F.col("l_symbol") == F.col("r_symbol")) & (F.col("l_cycle") == F.col("r_cycle")))
    # counted per group on either side, without the pairs
    per = lambda d, p, extra: d.groupBy(*keys, *[F.col(f"{p}_{c}").alias(f"_{c}") for c in extra]).agg(F.count(F.lit(1)).alias(f"_n{p}"))
    pairs = lambda extra: per(l, "l", extra).join(per(r, "r", extra), [*keys, *[f"_{c}" for c in extra]]).agg(F.coalesce(F.sum(F.col("_nl") * F.col("_nr")), F.lit(0)).alias("n"))
    counts = pairs([]).withColumnRenamed("n", "total").crossJoin(F.broadcast(pairs(["symbol", "cycle"]).withColumnRenamed("n", "excluded"))).withColumn("retained", F.col("total") - F.col("excluded"))
    return j.filter("not self").drop("self"), counts


def assign_controls(edges: DataFrame, group: Sequence[str], strict: bool = True, seed: str = "", replicate: int = 0) -> DataFrame:
    """One-to-one assignment of controls per group (fold, month): maximum matching by augmenting paths.

    Groups are independent and each is one month's candidate graph; a left node
    without a control fails (or is returned with NULL).  A seed offers the edges in a hash order of its own per
    replicate; without one they come by id.
    """
    from collections import deque

    import pandas as pd

    group = list(group)
    kt = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in ("_draw", "left_id", "right_id") if c in pdf.columns])
        adj: dict = {}
        for l, r in zip(pdf["left_id"], pdf["right_id"]):
            adj.setdefault(l, []).append(r)
        owner: dict = {}
        mate: dict = {}
        for root in adj:
            # breadth-first search for a free control, then flip the path
            parent, queue, end = {}, deque([root]), None
            seen = set()
            while queue and end is None:
                l = queue.popleft()
                for r in adj[l]:
                    if r in seen:
                        continue
                    seen.add(r)
                    parent[r] = l
                    if r not in owner:
                        end = r
                        break
                    queue.append(owner[r])
            while end is not None:
                l = parent[end]
                prev = mate.get(l)
                owner[end], mate[l] = l, end
                end = None if l == root else prev
        head = {k: pdf[k].iloc[0] for k in group}
        return pd.DataFrame([{**head, "left_id": l, "right_id": mate.get(l)} for l in adj])

    schema = ", ".join([f"`{k}` {kt[k]}" for k in group] + [f"left_id {kt['left_id']}", f"right_id {kt['right_id']}"])
    draw = [identity_hash(F.lit(seed), F.lit(replicate), *group, "left_id", "right_id").alias("_draw")] if seed else []
    out = edges.select(*group, "left_id", "right_id", *draw).groupBy(*group).applyInPandas(match, schema)
    return fail_if(out, F.col("right_id").isNull(), "unmatched left node") if strict else out


def shuffled_labels(df: DataFrame, label: str, salt: str, ident: str = "id") -> DataFrame:
    """Permuted label per row: row k in hash order gets the label of row k in id order (two skew-free numberings)."""
    h = df.withColumn("_h", identity_hash(F.lit(salt), ident))
    a = scan.row_index(h, [], ["_h", ident], "_k", slice_col=F.shiftright("_h", 52)).drop("_h")
    b = scan.row_index(df.select(ident, F.col(label).alias("shuffled")), [], [ident], "_k", 1 << 16).select("_k", "shuffled")
    return a.join(b, "_k").drop("_k")


def noise_feature(salt: str, ident: str = "id") -> Column:
    """Uniform [0, 1) noise from the identity."""
    return identity_hash(F.lit(salt), ident) / F.lit(float(1 << 60))
