"""Embedding near-dedup by a forest of random-projection trees.

Vectors of equal direction are one class from the start.  Each tree splits recursively along the difference of two random
sample vectors, near the middle of the sample's projections; a vector within ``spill`` of a split goes both ways.  Trees are
fitted on a bounded sample, every class is routed through all of them, and classes are compared within leaves, whole leaf
against itself in blocks of rows, by cosine in double precision.  A leaf returns per class the number of vectors it links
(pairs that met in an earlier leaf are left out there, so every pair counts once) and one link to join its component, never
the pairs themselves.  Links of all leaves are united by distributed connected components.

The sample is bounded, so its trees end in larger leaves on larger tables.  Leaves of more than ``LARGE`` classes go on
splitting, each by a subtree fitted on a bounded sample of its own, until none is larger or no split is found.  A split must
leave fewer pairs to compare in spite of its spill; a ball too tight for that, such as a large group of near copies, stays
one leaf.  Members of a large leaf are numbered in blocks of about ``LARGE``, and every two blocks meet in a task of their
own, so a task's size does not grow with the table and no pair of a leaf is lost.

Vectors that are null, zero, of another length than most, or hold null or non-finite components link with nothing.  Rows
repeated with one id are vectors of their own.  A null id never names a component unless all its ids are null.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from . import common as C

LEAF = 768
LARGE = 4 * LEAF


def prepared(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(id, key, vec): vec holds the components over the largest, as 64-bit little-endian floats; key names equal directions; null where invalid."""
    def run(batches):
        for batch in batches:
            keys, vecs = [], []
            for v in batch.column(1):
                x = None
                if v.is_valid and len(v) == size and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    # quotients are rounded correctly, so multiples of one vector give the same bytes
                    x = x / np.abs(x).max() + 0.0 if np.isfinite(x).all() and x.any() else None
                keys.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                vecs.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "key", "vec"])

    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id bigint, key binary, vec binary")


def unit(vecs, size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), "<f8").reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grow(sample: np.ndarray, scale: float, seed: int, spill: float, leaf: int = LEAF, least: int = 12) -> list[tuple]:
    """One tree as nodes (direction, threshold, spill, left, right) or (None,) for a leaf; scale: rows of the table per sample row."""
    rng, nodes = np.random.default_rng(seed), [None]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        at, rows = todo.pop()
        nodes[at] = (None,)
        if len(rows) * scale <= leaf or len(rows) < 2 * least:
            continue
        for _ in range(12):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            d = a - b
            n = np.sqrt((d * d).sum())
            if n < 1e-9:
                continue
            d = d / n
            p = sample[rows] @ d
            cut = float(np.quantile(p, rng.uniform(0.4, 0.6)))
            left, right = rows[p <= cut + spill], rows[p >= cut - spill]
            if len(left) ** 2 + len(right) ** 2 <= 0.9 * len(rows) ** 2 and min(len(left), len(right)):
                nodes[at] = (d, cut, spill, len(nodes), len(nodes) + 1)
                nodes += [None, None]
                todo += [(nodes[at][3], left), (nodes[at][4], right)]
                break
    return nodes


def route(x: np.ndarray, nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf node) of every leaf that every row of x goes to."""
    rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        at, r = todo.pop()
        if not len(r):
            continue
        if nodes[at][0] is None:
            rows.append(r)
            leaves.append(np.full(len(r), at))
            continue
        d, cut, margin, a, b = nodes[at]
        p = x[r] @ d
        todo += [(a, r[p <= cut + margin]), (b, r[p >= cut - margin])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def refined(routed: DataFrame, size: int, spill: float, seed: int, large: int, leaf: int, sample_rows: int = 4096, part_rows: int = 20_000, rounds: int = 40) -> tuple[DataFrame, bool]:
    """routed(leaf, key, n, vec) with every leaf of more than ``large`` rows split again where a split is found, and whether any was."""
    whole, split_any = None, False  # leaves without a split
    for step in range(rounds):
        big = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > large)
        big = C.stored(big if whole is None else big.join(whole, "leaf", "left_anti"), "large-leaves")
        if not big.count():
            break
        hot = routed.join(big, "leaf").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "key"), F.ceil(F.col("rows") / part_rows)))
        few = hot.filter(F.pmod(F.xxhash64(F.lit(step), "key"), F.lit(1_000_000)) * F.col("rows") < 1_000_000 * sample_rows)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = unit(pdf.sort_values("key")["vec"], size)
            at, rows = int(pdf["leaf"].iloc[0]), int(pdf["rows"].iloc[0])
            tree = grow(x, rows / len(x), (at ^ seed) & 0x7FFFFFFF, spill, leaf)
            return pd.DataFrame({"leaf": [at], "rows": [rows], "tree": [pickle.dumps(tree) if len(tree) > 1 else None]})

        trees = few.groupBy("leaf").applyInPandas(fit, "leaf bigint, rows bigint, tree binary")
        trees = C.stored(trees, "subtrees")
        cut = trees.filter("tree is not null")
        left = big.join(cut, "leaf", "left_anti").select("leaf")
        whole = left if whole is None else whole.unionByName(left)
        if not cut.count():
            break
        split_any, big = True, big.join(cut.select("leaf"), "leaf", "left_semi")
        hot = hot.join(cut.select("leaf"), "leaf", "left_semi")
        trees = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / part_rows) - 1)))

        def down(pdf: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(tree):
                return pdf[["leaf", "key", "n", "vec"]]
            row, node = route(unit(pdf["vec"], size), pickle.loads(tree["tree"].iloc[0]))
            at = int(tree["leaf"].iloc[0])
            name = {k: at if k == 0 else xxh64_intdigest(b"%d/%d" % (at, k)) >> 1 for k in np.unique(node).tolist()}
            return pdf.iloc[row][["key", "n", "vec"]].assign(leaf=[name[k] for k in node.tolist()])[["leaf", "key", "n", "vec"]]

        parts = hot.groupBy("leaf", "part").cogroup(trees.groupBy("leaf", "part")).applyInPandas(down, "leaf bigint, key binary, n bigint, vec binary")
        routed = C.stored(routed.join(big, "leaf", "left_anti").unionByName(parts), "routed")
    return routed, split_any


def compare(x: np.ndarray, weight: np.ndarray, leaves: list[np.ndarray], leaf: int, least: float, first: int = 0, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of other classes linked to each class and not met in an earlier leaf, class it hangs on or -1).
    first: where given, only the first so many classes meet the others, and neither meets its own side."""
    m = len(x)
    early = np.unique(np.concatenate([v[v < leaf] for v in leaves])) if m else np.zeros(0, np.int64)
    member = np.zeros((m, len(early)), np.float32)
    for i, v in enumerate(leaves):
        member[i, np.searchsorted(early, v[v < leaf])] = 1
    links, root = np.zeros(m, np.int64), np.arange(m)
    hang = np.full(m, -1)
    for a in range(0, first or m, block):
        z = min(a + block, first or m)
        near = x[a:z] @ x[first:].T >= least
        if not first:
            near[np.arange(z - a), np.arange(a, z)] = False
        fresh = near & ~(member[a:z] @ member[first:].T > 0) if len(early) else near
        links[a:z] = fresh @ weight[first:]
        if first:
            links[first:] += weight[a:z] @ fresh
        for i in np.flatnonzero(near.any(1)):
            # join the trees of a row's partners: a partner's root hangs on the row's root
            mine = _find(root, a + i)
            for j in np.unique(root[first + np.flatnonzero(near[i])]):
                j = _find(root, j)
                if j != mine:
                    root[j] = mine
                    hang[j] = mine
            root[root == a + i] = mine
        # flatten, so that the next block sees few roots
        for i in range(m):
            root[i] = _find(root, i)
    return links, hang


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return int(i)


def near_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, trees: int = 6, spill: float = 0.03, sample_rows: int = 16_384, seed: int = 11, leaf: int = LEAF, large: int = LARGE) -> DataFrame:
    """(id_col, n_links, component_id) per row.  sample_rows: the bound of the sample that the trees are fitted on."""
    common = df.select(F.size(vec_col).alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    size = common.n if common else 1
    rows = C.stored(prepared(df, id_col, vec_col, size), "vectors")
    classes = C.stored(rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "classes")
    total = classes.count()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    share = min(1.0, 1.5 * sample_rows / total)
    picked = classes.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("key")).limit(sample_rows)
    sample = unit([bytes(r.vec) for r in picked.select("vec").collect()], size)
    forest = [grow(sample, total / len(sample), seed + k, spill, leaf) for k in range(trees)]
    shared = df.sparkSession.sparkContext.broadcast(forest)  # at most sample_rows / 12 splits a tree
    base = np.concatenate([[0], np.cumsum([len(t) for t in forest])])

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(2).to_pylist(), size)
            got = [route(x, t) for t in shared.value]
            row = np.concatenate([r for r, _ in got])
            leaf = np.concatenate([v + base[k] for k, (_, v) in enumerate(got)])
            o = np.lexsort((leaf, row))
            row, leaf = row[o], leaf[o]
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(leaf))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *[batch.column(i).take(take) for i in range(3)], lists.take(take)], ["leaf", "key", "n", "vec", "leaves"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values("block", kind="stable")
        first = int((pdf["block"] == i).sum()) if i != j else 0
        if i != j and first in (0, len(pdf)):  # the other block has no member
            return pd.DataFrame({"key": [], "links": [], "other": []})
        key = pdf["key"].tolist()
        links, hang = compare(unit(pdf["vec"], size), pdf["n"].to_numpy(), list(pdf["leaves"]), int(pdf["leaf"].iloc[0]), least, first)
        hit = np.flatnonzero((links > 0) | (hang >= 0))
        return pd.DataFrame({"key": [key[i] for i in hit], "links": links[hit], "other": [key[hang[i]] if hang[i] >= 0 else None for i in hit]})

    routed = classes.select("key", "n", "vec").mapInArrow(spread, "leaf bigint, key binary, n bigint, vec binary, leaves array<bigint>")
    routed = C.stored(routed, "routed")
    finer, split = refined(routed.drop("leaves"), size, spill, seed, large, leaf)
    if split:
        routed = finer.join(finer.groupBy("key").agg(F.collect_list("leaf").alias("leaves")), "key")
    # members of a large leaf go to every pair of blocks that has theirs
    blocks = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > large)
    blocks = C.stored(blocks.select("leaf", F.ceil(F.col("rows") / large).alias("blocks")), "leaf-blocks")
    routed = routed.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    routed = routed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "key"), "blocks"))
    routed = routed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")})
    found = C.stored(routed.groupBy("leaf", "i", "j").applyInPandas(link, "key binary, links bigint, other binary"), "leaf-links")
    pairs = found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    root = C.components(pairs)
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.drop("vec").join(root, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    best = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = named.join(best, "root").join(linked, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id", "n")
    keyed = rows.select("id", F.coalesce("key", F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")).alias("key"))
    out = C.join_groups(keyed, label, "key", "id", rows.count())
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
