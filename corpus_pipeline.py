"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes the documents its predecessor kept and returns them with the columns of ``documents``; the last returns
packed pieces.  Between stages the rows are written as Parquet in the shared folder and read again, so a stage's docs are
always a plain read of stored files, whose rows are told apart by file and place, not by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tickloom.llm import common as C, exact_dedup, langid, packing, secret_scan, simhash
from tickloom.llm.queries import tokenizer_file


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language of the corpus stay; labels of the rows themselves serve to fit the text models."""
    return langid.keep_identified(docs, table=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_first(docs, table=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group stays."""
    return simhash.keep_one(docs, table=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mask; n_chars follows the text."""
    out = secret_scan.redact(docs, secret_scan.fit(secret_scan.sample(docs)))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows, with their ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, added=True)


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("secret scans", redact_secrets), ("packing", pack)]
ORACLE_SQL = None  # the stages are not SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
