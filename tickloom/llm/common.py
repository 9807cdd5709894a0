"""Helpers of the operators in this folder: shared-folder tables, skew-safe group joins, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import ensure_checkpoint_dir

WHITE = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under the cluster's checkpoint folder; nothing is created."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so later steps and lost executors start from files."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


ROW = "__row"


def rowed(df: DataFrame, table: bool = False) -> DataFrame:
    """df with ROW, each row's file and place in it, by which single rows can be told apart whatever their ids.

    ``table`` says that df is a plain read of stored files; anything else is stored first.
    """
    d = df if table else stored(df, "rows")
    m = d.metadataColumn("_metadata")
    return d.select("*", F.struct(m["file_path"].alias("file"), m["row_index"].alias("at")).alias(ROW))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (with ROW) less those whose ROW is in gone, without that column."""
    g = gone.select(F.col(ROW)["file"].alias("__f"), F.col(ROW)["at"].alias("__a"))
    return rows.join(g, (F.col(ROW)["file"] == F.col("__f")) & (F.col(ROW)["at"] == F.col("__a")), "left_anti").drop(ROW)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, row_id: str, total: int, parts: int = 200) -> DataFrame:
    """rows left-joined to groups (one row per key, with its number of rows in ``n``) without a hot task.

    Groups of at least total/parts rows, so at most ``parts`` of them, are broadcast; the others meet in a shuffled join,
    where rows of a broadcast group are dealt out by row_id instead of their key.
    """
    extra = [c for c in groups.columns if c != key]
    big = max(1000, -(-total // parts))
    hot = groups.filter(F.col("n") >= big).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in extra])
    cold = groups.filter(F.col("n") < big).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in extra])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    spread = F.concat(F.lit("~"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))).cast("binary")
    out = out.withColumn("_k", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(spread))
    out = out.join(cold, F.col("_k") == F.col("_ck"), "left")
    return out.select(*[rows[c] for c in rows.columns], *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in extra])


def smallest(rows: DataFrame, order: str, n: int) -> list:
    """About the n rows with the least ``order`` (rows that tie with the last come too, at most as many again).

    The bound is found on the order column alone, so tasks send the driver numbers, and then only the rows themselves.
    """
    edge = rows.select(order).orderBy(order).limit(n).agg(F.max(order)).first()[0]
    if edge is None:
        return []
    return sorted(rows.filter(F.col(order) <= edge).limit(2 * n).collect(), key=lambda r: tuple(r))[:n]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps over the edge table, each a grouped minimum and a join, stored in the
    shared folder.  The table never holds more rows than there are edges.  A node with very many edges is one key of a
    sort-merge join, which adaptive execution splits; its minimum is combined before the shuffle.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
        seen = mark
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(large.filter("a <> b").distinct(), "cc")
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = e.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "cc")
    raise RuntimeError("components did not settle")


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "pos", total: str = "n") -> DataFrame:
    """rows with their 0-based position in their group by ``order``, and the group's number of rows; stored on the way.

    Rows are dealt out by ranges of (group, order), so a hot group takes many tasks.  Each task counts as it streams over its
    sorted rows, and one table row per (task, group) says how many came before.  group is a string without nulls; rows that
    tie in the whole order may be numbered either way.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(group)).to_pylist()
            local = []
            for k in keys:
                seen = seen + 1 if k == last else 0
                last = k
                local.append(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(keys), pa.int32()), pa.array(local, pa.int64())], [*batch.schema.names, "_task", "_local"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    d = stored(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(run, f"{fields}, _task int, _local bigint"), "numbered")
    w = Window.partitionBy(group).orderBy("_task")
    parts = d.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.select(F.col(group).alias("_g"), F.col("_task").alias("_t"), F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy(group)).alias(total))
    d = d.join(parts, (F.col(group) == F.col("_g")) & (F.col("_task") == F.col("_t")))
    return d.select(*rows.columns, (F.col("_off") + F.col("_local")).alias(name), total)
