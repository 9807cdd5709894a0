"""Merkle manifest of a dataset by butterfly exchange.

Rows of a group are leaves in order of their id; every ``fanout`` consecutive nodes (the last run may be shorter, even one)
become the hash of their digests' hex text until one is left, the group's subroot.  Subroots in order of the groups become
the root in the same way.

A partition is an aligned block of fanout^depth leaves of one group.  It hashes its own subtree, and from there on only
partitions talk to each other: in round r the up to ``fanout`` partitions whose subtrees have one parent, and which stand at
the same place below it, swap roots.  Each hashes the parent itself and notes its siblings, so after the last round every
partition has the root and the upper part of its leaves' proofs, and nothing is handed down.  A ragged subtree has fewer
partitions than its siblings; they serve the places it lacks in turn.  No swap has more than fanout rows, no group of rows
is larger than a block, and a round moves one digest per partition.

Null groups come first, the others bytewise; rows of one id, and null ids (first), follow in the order of their leaves.  A
group of one row is its own subroot.  Empty tables give empty manifests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def framed(c: Column) -> Column:
    """A value with its length before it; `-` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(c) for c in values]), 256))


def leaves(df: DataFrame, fields: list[str], group_col: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(g, id, leaf, now): the digest of a row's fields, and of the row as it is now: with ``changed`` columns ``where`` that holds, else null."""
    g = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    now = F.when(where, digest([changed.get(f, F.col(f)) for f in fields])) if changed else F.lit(None).cast("binary")
    return df.select(g.alias("g"), F.col(id_col).alias("id"), digest([F.col(f) for f in fields]).alias("leaf"), now.alias("now"))


def height(n: int, fanout: int = 8) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def _sha(b: bytes) -> bytes:
    return hashlib.sha256(b).hexdigest().encode()


def climb(nodes: list[bytes], levels: int, fanout: int = 8) -> list[list[bytes]]:
    """Nodes of each level, from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_sha(b"".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def _swap(state: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """One round: the rows of ``keys`` and one slot swap roots, in order of ``_child``.  ``_most``: slots of the widest child."""
    offers = state.withColumn("_s", F.explode(F.sequence(F.col("_slot"), F.col("_most") - 1, F.col("_width"))))
    w = Window.partitionBy(*keys, "_s").orderBy("_child")
    offers = offers.withColumns({"_at": F.row_number().over(w), "_all": F.collect_list("root").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    mine = offers.filter(F.col("_s") == F.col("_slot"))
    side = lambda a, n: F.array_join(F.slice("_all", a, n), "")
    step = F.struct(side(F.lit(1), F.col("_at") - 1).alias("before"), side(F.col("_at") + 1, F.lit(fanout)).alias("after"))
    return mine.withColumns({"up": F.concat("up", F.array(step)), "root": F.sha2(F.array_join("_all", ""), 256)}).drop("_s", "_at", "_all")


def _lines(groups: DataFrame, rounds: int, fanout: int) -> DataFrame:
    """groups(g, blocks, rank) with ``line``: per round of the upper tree the run, place, first slot, width and widest sibling of the group's node."""
    out = groups.withColumn("line", F.array().cast("array<struct<run:bigint,child:bigint,off:bigint,width:bigint,most:bigint>>"))
    nodes = groups.select(F.col("rank").alias("child"), F.col("blocks").alias("width"))
    for k in range(rounds):
        w = Window.partitionBy("run")
        nodes = nodes.withColumn("run", F.expr(f"child div {fanout}")).withColumns({
            "off": F.coalesce(F.sum("width").over(w.orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "most": F.max("width").over(w)})
        at = nodes.select(F.col("child").alias("_c"), F.struct("run", "child", "off", "width", "most").alias("_l"))
        out = out.join(at, F.expr(f"rank div {fanout ** k}") == F.col("_c")).withColumn("line", F.concat("line", F.array("_l"))).drop("_c", "_l")
        nodes = nodes.groupBy(F.col("run").alias("child")).agg(F.sum("width").alias("width"))
    return out


def exchange(blocks: DataFrame, groups: DataFrame, highest: int, upper: int, fanout: int = 8) -> DataFrame:
    """blocks(g, block, root) to (g, block, subroot, root, up): ``highest`` rounds within groups, ``upper`` among them."""
    s = blocks.join(groups.select(F.col("g").alias("_g"), "blocks", "line"), F.col("g") == F.col("_g")).drop("_g")
    s = s.withColumn("up", F.array().cast("array<struct<before:string,after:string>>"))
    for r in range(highest):
        size = fanout ** r
        child, run = F.expr(f"block div {size}"), F.expr(f"block div {size * fanout}")
        width = F.least(F.lit(size), F.col("blocks") - child * size)
        alone = F.col("blocks") - run * size * fanout <= size
        busy = s.filter(F.col("blocks") > size).withColumns({"_run": run, "_child": child, "_slot": F.col("block") - child * size, "_width": width, "_most": F.when(alone, width).otherwise(F.lit(size))})
        s = C.stored(_swap(busy, ["g", "_run"], fanout).select(*s.columns).unionByName(s.filter(F.col("blocks") <= size)), "butterfly")
    s = s.withColumns({"subroot": F.col("root"), "slot": F.col("block")})
    for k in range(upper):
        at = F.col("line")[k]
        x = s.withColumns({"_run": at["run"], "_child": at["child"], "_slot": F.col("slot"), "_width": at["width"], "_most": at["most"]})
        s = C.stored(_swap(x, ["_run"], fanout).withColumn("slot", F.col("slot") + at["off"]).select(*s.columns), "butterfly")
    return s.select("g", "block", "subroot", "root", "up")


def manifest(rows: DataFrame, fanout: int = 8, depth: int = 4) -> DataFrame:
    """rows(g, id, leaf, now) of ``leaves`` to (id, leaf, subroot, root, proof_sha256, folded_root), digests as hex text.

    proof_sha256 is the hash of a leaf's siblings, level by level from left to right; folded_root goes up from ``now`` (from
    the leaf where that is null) by the siblings as they were.
    """
    size = fanout ** depth
    placed = C.numbered(C.stored(rows, "leaves"), "g", ["id", "leaf"])
    placed = placed.withColumn("block", F.expr(f"pos div {size}"))
    groups = placed.filter("pos = 0").select("g", "n", F.ceil(F.col("n") / size).cast("bigint").alias("blocks"))
    groups = C.stored(C.numbered(groups.withColumn("_one", F.lit("")), "_one", ["g"], "rank", "_groups"), "groups")
    count, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    if not count:
        return rows.sparkSession.createDataFrame([], "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    upper = height(count, fanout)
    groups = C.stored(_lines(groups.select("g", "blocks", "rank"), upper, fanout), "lines")

    def tree(table: pa.Table) -> tuple[np.ndarray, list[list[bytes]]]:
        o = np.argsort(table["pos"].to_numpy())
        hexes = [x.hex().encode() for x in table["leaf"].to_pylist()]
        return o, climb([hexes[i] for i in o], min(depth, height(table["n"][0].as_py(), fanout)), fanout)

    def root(table: pa.Table) -> pa.Table:
        return pa.table({"g": table["g"][:1], "block": table["block"][:1], "root": [tree(table)[1][-1][0].decode()]})

    blocks = C.stored(placed.select("g", "block", "pos", "n", "leaf").groupBy("g", "block").applyInArrow(root, "g string, block bigint, root string"), "block-roots")
    tops = exchange(blocks, groups, max(0, height(most, fanout) - depth), upper, fanout)

    def prove(table: pa.Table, top: pa.Table) -> pa.Table:
        o, levels = tree(table)
        up = [(u["before"].encode(), u["after"].encode()) for u in top["up"][0].as_py()]
        rest = b"".join(a + b for a, b in up)
        now = table["now"].to_pylist()
        proofs, folded = [], []
        for i, row in enumerate(o.tolist()):
            cur = levels[0][i] if now[row] is None else now[row].hex().encode()
            h, k = hashlib.sha256(), i
            for nodes in levels[:-1]:
                a = k // fanout * fanout
                left, right = b"".join(nodes[a:k]), b"".join(nodes[k + 1:a + fanout])
                h.update(left)
                h.update(right)
                cur, k = _sha(left + cur + right), k // fanout
            h.update(rest)
            for a, b in up:
                cur = _sha(a + cur + b)
            proofs.append(h.hexdigest())
            folded.append(cur.decode())
        same = lambda c: pa.array([top[c][0].as_py()] * len(o), pa.string())
        return pa.table({"id": table["id"].combine_chunks().take(pa.array(o)) if len(o) else table["id"], "leaf": [x.decode() for x in levels[0]], "subroot": same("subroot"), "root": same("root"),
                         "proof_sha256": proofs, "folded_root": folded})

    return placed.groupBy("g", "block").cogroup(tops.groupBy("g", "block")).applyInArrow(
        prove, "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
