"""Exact dedup against a persistent digest index, a table bucketed and sorted by digest.

A batch's distinct digests meet the index in a sort-merge anti-join whose index side is read bucket by bucket without a
shuffle; digests that are new are appended with the row that keeps them.

Null text counts as empty.  Runs of the bytes 0x20, 0x09-0x0D count as one space.  Within a batch the smallest id of equal
texts stays, and of rows that tie, the first by file and place; a text already in the index is a copy of the row that the
index names, and no row of the batch stays for it.  Rows are told apart by their place, so rows that share an id but not a
text are judged each by its text.  A null id never keeps a text unless no row of the text has an id.  An empty table gives
an empty report.

The number of buckets belongs to the index and is kept beside its data; opening it with another number is refused.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), C.WHITE, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest) of the rows of ``common.rowed``."""
    return df.select(F.col(id_col).alias("id"), F.col(C.ROW).alias("row"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))


class DigestIndex:
    """Digest -> id of the row that keeps the text, at a path; opening a path that holds an index goes on with it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        layout = f"{path.rstrip('/')}/_layout"  # names with an underscore are no part of the table
        known = self._first(layout, "buckets int")
        if known is None and self._first(path, "digest binary, keep_id bigint") is not None:
            raise ValueError(f"{path} holds an index without its number of buckets")
        if known is not None and buckets not in (None, known.buckets):
            raise ValueError(f"the index at {path} has {known.buckets} buckets, not {buckets}")
        self.buckets = known.buckets if known is not None else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if known is None:
            spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).write.mode("overwrite").parquet(layout)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _first(self, path: str, schema: str):
        try:
            return self.spark.read.schema(schema).parquet(path).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        return groups.hint("merge").join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)


def dedup(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the batch df (with ROW) to the index; (id, row, digest, keep_id, kept, n): n counts the rows of df with the text."""
    rows = C.stored(digests(df, id_col, text_col), "digests")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).select("digest", F.col("first")["id"].alias("keep_id"), F.col("first")["row"].alias("keep_row"), "n")
    groups = C.stored(groups, "groups")
    fresh = C.stored(index.unseen(groups), "fresh")
    index.append(fresh)
    known = groups.drop("keep_id", "keep_row").join(index.read(), "digest").join(fresh.select("digest", "keep_row"), "digest", "left")
    return C.join_groups(rows, known, "digest", "id", rows.count()).withColumn("kept", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).drop("keep_row")


def _judged(rows: DataFrame, index: DigestIndex | None, id_col: str, text_col: str) -> DataFrame:
    return dedup(rows, index or DigestIndex(rows.sparkSession, C.shared_path(rows.sparkSession, "digest-index")), id_col, text_col)


def report(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", table: bool = False) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) per row of df; ``table``: df is a plain read of stored files."""
    d = _judged(C.rowed(df.select(id_col, text_col), table), index, id_col, text_col)
    return d.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", table: bool = False) -> DataFrame:
    """The rows of df that keep their text, with all their columns."""
    rows = C.rowed(df, table)
    return C.without(rows, _judged(rows, index, id_col, text_col).filter("not kept").select(F.col("row").alias(C.ROW)))
