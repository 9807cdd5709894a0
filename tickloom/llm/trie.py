"""Prefix trie of conversations, rolled up by centroid decomposition of the forest of parent edges.

A node is a distinct sequence of first turns.  Its key is a chain of SHA-256 over the turns' digests, taken CHUNK turns at a
time (chains inside a chunk in parallel, then one chain over the ends of a conversation's chunks), so a very long
conversation is no single task.

Subtree totals: each node counts how many turns of conversations pass at or below it (its weight).  A component's centroid is
its deepest node that holds at least half of the component's weight; the nodes that do are exactly the path from the
centroid to the component's top.  The centroid's own value and the totals of the pieces below it are summed and added to
every node of that path, the path's weights fall by as much, and the component falls apart into the pieces below and the
rest, none heavier than half.  Rounds over whole tables split components while any has more than ``most`` nodes; the others
are finished side by side in tasks, in the same way with node counts for weights.  So a sum is added along O(log n) paths, however deep or wide the trie is.

Turns come in order of turn (null first), then of their digests; null role or text counts as empty; rows without a
conversation id belong to none.  Repeated rows are turns of their own.  A conversation without turns ends at the root.  An
empty table has no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

CHUNK = 1024


def root_key() -> Column:
    """The key of the textless root."""
    return F.lit(b"")


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): each turn's place in its conversation and the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    d = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).alias("chars"))
    d = C.stored(d.withColumn("g", F.col("conv").cast("string")), "turns")
    return C.numbered(d, "g", ["turn", "digest"]).select("conv", "pos", "digest", F.col("chars").cast("bigint").alias("chars"))


def rebuilt(rows: DataFrame, every: int = 100, modulus: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) of turns(conv, pos, ...) where a conversation opens with the first turns of its base.

    Conversation c takes the first h turns of c - c % every (all if fewer, none if absent) and then its own after its first
    h; h is the CRC-32 of c modulo ``modulus``.
    """
    convs = C.stored(rows.filter("pos = 0").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % modulus).alias("h")), "conversations")
    heads = C.stored(rows.filter((F.col("conv") % every == 0) & (F.col("pos") < modulus - 1)).withColumnRenamed("conv", "base"), "heads")
    lent = convs.join(heads, "base").filter("pos < h").select("conv", "pos", "digest", "chars")
    have = heads.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    shift = convs.join(have, "base", "left").select(F.col("conv").alias("_c"), (F.least("h", F.coalesce("have", F.lit(0))) - F.col("h")).alias("shift"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % modulus
    own = rows.filter(F.col("pos") >= h).join(shift, F.col("conv") == F.col("_c")).select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "chars")
    return convs.select("conv"), lent.unionByName(own)


def keyed(rows: DataFrame) -> DataFrame:
    """rows(conv, pos, digest, chars) with the node's ``key`` and that of its ``parent``."""
    def run(batches):
        last, state = None, b""
        for batch in batches:
            out = []
            for c, k, d in zip(*(batch.column(x).to_pylist() for x in (0, 1, 3))):
                state = hashlib.sha256((state if (c, k) == last else b"") + d).digest()
                last = (c, k)
                out.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:3], batch.column(4), batch.column(1), pa.array(out, pa.binary())], ["conv", "pos", "chars", "chunk", "local"])

    d = rows.select("conv", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "digest", "chars").repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
    d = C.stored(d.mapInArrow(run, "conv bigint, pos bigint, chars bigint, chunk bigint, local binary"), "chains")

    def chain(table: pa.Table) -> pa.Table:
        rows_ = sorted(zip(table["chunk"].to_pylist(), table["local"].to_pylist()))
        state, out = b"", []
        for _, local in rows_:
            state = hashlib.sha256(state + local).digest()
            out.append(state)
        return pa.table({"_c": table["conv"], "_k": pa.array([k + 1 for k, _ in rows_], pa.int64()), "before": pa.array(out, pa.binary())})

    ends = d.filter(F.col("pos") % CHUNK == CHUNK - 1).select("conv", "chunk", "local").groupBy("conv").applyInArrow(chain, "_c bigint, _k bigint, before binary")
    d = d.join(ends, (F.col("conv") == F.col("_c")) & (F.col("chunk") == F.col("_k")), "left")
    w = Window.partitionBy("conv", "chunk").orderBy("pos")
    before = F.coalesce("before", root_key())
    d = d.withColumn("key", F.unhex(F.sha2(F.concat(before, "local"), 256)))
    return d.select("conv", "pos", "chars", "key", F.coalesce(F.lag("key").over(w), before).alias("parent"))


def nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, parent, depth, conv, n_convs, chars, weight) per node; weight: turns of conversations at or below it, and the root itself."""
    size = rows.groupBy("conv").agg(F.max("pos").alias("_last")).withColumnRenamed("conv", "_c")
    d = rows.join(size, F.col("conv") == F.col("_c"))
    n = d.groupBy("key").agg(F.first("parent").alias("parent"), (F.first("pos") + 1).alias("depth"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"),
                             F.first("chars").alias("chars"), F.sum(F.col("_last") - F.col("pos") + 1).alias("weight"))
    top = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).crossJoin(rows.agg((F.count(F.lit(1)) + 1).alias("weight")))  # one row each
    top = top.filter("n_convs > 0").select(root_key().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv", "n_convs", F.lit(0).cast("bigint").alias("chars"), "weight")
    return n.unionByName(top)


def _finish(parent: Sequence[int], values: list[list[int]]) -> None:
    """Turns values into subtree totals, in place, of a forest whose parents (-1: none) stand before their children.

    Components are lists of nodes in that order; every one is cut at its centroid until it is a single node.
    """
    n = len(parent)
    own = [v[:] for v in values]
    top, todo = [0] * n, {}
    for i in range(n):
        top[i] = i if parent[i] < 0 else top[parent[i]]
        todo.setdefault(top[i], []).append(i)
    stack = list(todo.values())
    for v in values:
        v[:] = [0] * n
    size, mark = [0] * n, [-1] * n
    while stack:
        part = stack.pop()
        if len(part) == 1:
            for v, o in zip(values, own):
                v[part[0]] += o[part[0]]
            continue
        for i in part:
            size[i] = 1
        for i in reversed(part[1:]):
            size[parent[i]] += size[i]
        half = len(part) / 2
        c = part[0]
        for i in part:  # parents first: the last node that still holds half is the deepest
            if size[i] >= half:
                c = i
        pieces: dict[int, list[int]] = {}
        rest = []
        mark[c] = c
        for i in part:
            if i == c:
                continue
            p = parent[i]
            at = mark[p] if i != part[0] else -1
            mark[i] = i if p == c and i != part[0] else at
            (rest if mark[i] < 0 else pieces.setdefault(mark[i], [])).append(i)
        below = [c] + [i for x in pieces.values() for i in x]
        for v, o in zip(values, own):
            total = sum([o[i] for i in below])
            i = c
            while True:
                v[i] += total
                if i == part[0]:
                    break
                i = parent[i]
        for i in part:
            mark[i] = -1
        stack.extend(pieces.values())
        if rest:
            stack.append(rest)


def subtree_totals(tree: DataFrame, rows: DataFrame, columns: list[str], most: int = 20_000) -> DataFrame:
    """(key, columns): sums over each node and all below it.

    tree has key, parent, depth, conv (a conversation through the node), weight and the columns; rows(conv, pos, key, parent)
    are the conversations' turns, which tell what lies below a centroid.
    """
    sums = [f"_t_{c}" for c in columns]
    live = C.stored(tree.select("key", "parent", "depth", "conv", "weight", *columns, root_key().alias("comp"), *[F.lit(0).cast("bigint").alias(s) for s in sums]), "trie")
    done, small = [], []
    cols = live.columns
    while True:
        per = C.stored(live.groupBy("comp").agg(F.max("weight").alias("_all"), F.count(F.lit(1)).alias("_n")), "components").withColumnRenamed("comp", "_comp")
        big = per.filter(F.col("_n") > most)
        if not big.take(1):
            small.append(live)
            break
        on = F.col("comp") == F.col("_comp")
        small.append(live.join(big, on, "left_anti"))
        x = live.join(big, on)
        path = x.filter(F.col("weight") * 2 >= F.col("_all"))
        cut = path.groupBy("comp").agg(F.min_by(F.struct("key", "depth", "weight"), "weight").alias("_cut")).withColumnRenamed("comp", "_cc")
        x = x.join(cut, F.col("comp") == F.col("_cc"))
        # the turn after the centroid's depth in the node's conversation: its parent is the centroid if the node lies below
        step = rows.select(F.col("conv").alias("_sc"), (F.col("pos")).alias("_sp"), F.col("key").alias("_sk"), F.col("parent").alias("_spar"))
        deeper = F.col("depth") > F.col("_cut")["depth"]
        x = x.join(step, deeper & (F.col("conv") == F.col("_sc")) & (F.col("_cut")["depth"] == F.col("_sp")), "left")
        below = F.coalesce(deeper & (F.col("_spar") == F.col("_cut")["key"]), F.lit(False))
        x = C.stored(x.withColumns({"_below": below, "_mid": F.col("key") == F.col("_cut")["key"]}), "split")
        total = x.filter("_below or _mid").groupBy("comp").agg(*[F.sum(c).alias(f"_d_{c}") for c in columns]).withColumnRenamed("comp", "_tc")
        x = x.join(total, F.col("comp") == F.col("_tc"))
        on_path = ~F.col("_below") & (F.col("weight") * 2 >= F.col("_all"))
        x = x.withColumns({s: F.when(on_path, F.col(s) + F.col(f"_d_{c}")).otherwise(F.col(s)) for s, c in zip(sums, columns)})
        x = x.withColumn("weight", F.when(on_path & ~F.col("_mid"), F.col("weight") - F.col("_cut")["weight"]).otherwise(F.col("weight")))
        x = C.stored(x.withColumn("comp", F.when(F.col("_below"), F.col("_sk")).otherwise(F.col("comp"))).select(*cols, "_mid"), "split")
        done.append(x.filter("_mid").select("key", *[F.col(s).alias(c) for s, c in zip(sums, columns)]))
        live = x.filter("not _mid").select(*cols)
    k = len(columns)

    def finish(table: pa.Table) -> pa.Table:
        t = table.sort_by([("depth", "ascending")])
        keys, parents, comps = (t[c].to_pylist() for c in ("key", "parent", "comp"))
        at = {x: i for i, x in enumerate(keys)}
        up = [at.get(p, -1) for p in parents]
        up = [p if p >= 0 and comps[p] == comps[i] else -1 for i, p in enumerate(up)]
        values = [t[c].to_pylist() for c in columns]
        _finish(up, values)
        sent = [t[s].to_pylist() for s in sums]
        return pa.table([t["key"], *[pa.array([a + b for a, b in zip(values[j], sent[j])], pa.int64()) for j in range(k)]], names=["key", *columns])

    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    rest = C.stored(rest.drop("conv", "weight"), "small-components")
    bins = max(1, rest.count() // (4 * most))
    out = rest.withColumn("_bin", F.pmod(F.xxhash64("comp"), F.lit(bins))).groupBy("_bin").applyInArrow(finish, "key binary, " + ", ".join(f"`{c}` bigint" for c in columns))
    for d in done:
        out = out.unionByName(d)
    return out


def member_digests(convs: DataFrame, rows: DataFrame, width: int = 4096) -> DataFrame:
    """(key, ends_sha256, n): the digest of the ids, in order, of the conversations that end at a node.

    Ids of one range of ``width`` are joined first; a node's ranges then stream through one hash in order.
    """
    last = rows.groupBy("conv").agg(F.max_by("key", "pos").alias("key"))
    ends = convs.join(last, "conv", "left").select("conv", F.coalesce("key", root_key()).alias("key"))
    part = ends.groupBy("key", F.floor(F.col("conv") / width).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))

    def run(batches):
        key, h = None, None
        for batch in batches:
            keys, out = [], []
            for k, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if k == key:
                    h.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    out.append(h.hexdigest())
                key, h = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])

    return part.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(df: DataFrame, every: int = 100, modulus: int = 6, most: int = 20_000, **cols) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    convs, rows = rebuilt(turns(df, **cols), every, modulus)
    rows = C.stored(keyed(rows), "rebuilt")
    tree = C.stored(nodes(convs, rows), "nodes")
    kids = tree.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "_p")
    tree = C.stored(tree.join(kids, F.col("key") == F.col("_p"), "left").drop("_p").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
                    .withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    heads = tree.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("n"))
    named = C.join_groups(tree.drop("n_leaves", "saved_tokens"), heads, "parent", "conv", tree.count())
    totals = subtree_totals(tree, rows, ["n_leaves", "saved_tokens"], most).withColumnRenamed("key", "_tk")
    ends = member_digests(convs, rows).withColumnRenamed("key", "_ek")
    out = named.join(totals, F.col("key") == F.col("_tk")).join(ends, F.col("key") == F.col("_ek"), "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
