"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import utc_date
from ..operators import scan
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """Fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/tickloom-{uuid.uuid4().hex}"


def write_parts(df: DataFrame, path: str, ts: str = "ts", mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Parquet parts under date=/symbol=; a partition spreads over as many tasks as its rows ask for."""
    d = df.withColumn("date", utc_date(ts))
    size = d.groupBy(F.col("date").alias("_d"), F.col("symbol").alias("_y")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_parts"))
    d = d.join(size, F.col("date").eqNullSafe(F.col("_d")) & F.col("symbol").eqNullSafe(F.col("_y"))).withColumn("_salt", F.pmod(F.xxhash64(ts), F.col("_parts")))
    d.repartition("date", "symbol", "_salt").drop("_salt", "_d", "_y", "_parts").write.mode(mode).partitionBy("date", "symbol").option(
        "compression", "zstd").parquet(path)


def content_digest(df: DataFrame, key: str, tie: str, chunk: int = 10_000) -> DataFrame:
    """Row count and SHA-256 of the rows as canonical JSON in (key, tie) order.

    A digest tree: chunks of rows, then chunks of digests until one is left, so no task sees more than ``chunk``
    entries.  Independent of the partitioning.  Without rows the digest is that of an empty text.
    """
    left = df.count()
    if not left:
        return df.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.lit(""), 256).alias("sha256"))
    d = scan.global_index(df.withColumn("_json", F.to_json(F.struct(*sorted(df.columns)))), [], F.col(key), tie, "_n")
    d = d.select(F.col("_n"), F.col("_json").alias("_t"), F.lit(1).cast("long").alias("_rows"))
    while True:
        arr = F.array_sort(F.collect_list(F.struct("_n", "_t")))
        d = d.groupBy(F.floor(F.col("_n") / chunk).alias("_n")).agg(
            F.sha2(F.array_join(F.transform(arr, lambda x: x["_t"]), "\n"), 256).alias("_t"), F.sum("_rows").alias("_rows"))
        left = -(-left // chunk)
        if left == 1:
            break
    return d.select(F.col("_rows").alias("rows"), F.col("_t").alias("sha256"))


def export_sorted(df: DataFrame, key: str, tie: str, path: str, fmt: str = "json", chunk: int = 10_000) -> DataFrame:
    """Write rows in (key, tie) order as gzip text files (ordered by file name) and return their digest."""
    cols = sorted(df.columns)
    out = df.select(*cols).orderBy(key, tie)
    w = out.write.mode("overwrite").option("compression", "gzip")
    w.json(path) if fmt == "json" else w.option("header", True).csv(path)
    return content_digest(df, key, tie, chunk)
