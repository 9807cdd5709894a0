"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws -ln(u)/weight with u hashed from the row's id and
the child's name, and the smallest draw wins; a child's weight is the sum of the shards below it.  A change of one weight
moves rows only into or out of the subtrees whose weights change.  ``regular(n)`` opens a new region for the first shard
beyond each full one, so a shard that starts a region takes rows only into itself.

Null ids hash to one place; null texts have no bytes; rows repeated with one id land in one shard and get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

Tree = list[tuple[str, list[tuple[str, list[tuple[int, float]]]]]]


def regular(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Equal shards 0 to shards - 1, per_rack in a rack and racks in a region."""
    out: Tree = []
    for r0 in range(0, shards, per_rack * racks):
        ids = range(r0, min(shards, r0 + per_rack * racks))
        out.append((f"region{len(out)}", [(f"region{len(out)}/rack{k}", [(i, 1.0) for i in ids[x:x + per_rack]]) for k, x in enumerate(range(0, len(ids), per_rack))]))
    return out


def _draw(key, children: list[tuple[str, float, F.Column]]):
    """The payload of the child with the smallest weighted draw."""
    live = [(n, w, v) for n, w, v in children if w > 0]
    if len(live) == 1:
        return live[0][2]
    def one(name, weight, value):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(name).alias("name"), value.alias("value"))
    return F.least(*[one(*c) for c in live])["value"]


def shard_of(key, tree: Tree):
    """Column: shard of the row with the given key column."""
    def rack(shards): return sum(w for _, w in shards)
    def region(racks): return sum(rack(s) for _, s in racks)
    where = _draw(key, [(n, region(r), F.lit(n)) for n, r in tree])
    out = F.lit(None).cast("int")
    for name, racks in tree:
        inner = F.lit(None).cast("int")
        which = _draw(key, [(n, rack(s), F.lit(n)) for n, s in racks])
        for n, shards in racks:
            inner = F.when(which == n, _draw(key, [(f"{n}/{i}", w, F.lit(i)) for i, w in shards])).otherwise(inner)
        out = F.when(where == name, inner).otherwise(out)
    return out


def place(df: DataFrame, tree: Tree, grown: Tree, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 2048) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot, grown_shard) per row; slots of a shard run from 0 without gaps.

    Slots come from hash blocks of about block_rows rows: numbers within a block, plus the rows of the blocks before it.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    k = F.col(id_col)
    rows = df.select(k.alias("id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                     shard_of(k, tree).alias("shard"), shard_of(k, grown).alias("grown_shard"))
    shards = sum(len(s) for _, r in tree for _, s in r)
    blocks = max(1, -(-df.count() // (shards * block_rows)))
    rows = C.stored(rows.withColumn("block", F.pmod(F.xxhash64(F.lit("slot"), "id"), F.lit(blocks)).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32"))
    return rows.withColumn("at", at).join(base, ["shard", "block"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("at") - 1).alias("slot"), "grown_shard")
