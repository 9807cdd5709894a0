"""One registered query per operator, over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, common as C, exact_dedup, langid, lm, merkle, packing, rp_forest, secret_scan, sharding, simhash, sql, toxicity, trie, warc


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR overrides the folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learnt outside the held-out quarter only."""
    docs = C.documents(spark, sf_dir)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(C.documents(spark, sf_dir), table=True)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(secret_scan.sample(docs))))


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rp_forest.near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return g.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.shared_path(spark, "warc")
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, min_bytes=0)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(C.documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_groups(simhash.fingerprints(C.documents(spark, sf_dir)))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.place(C.documents(spark, sf_dir), sharding.regular(8), sharding.regular(9))
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and web pages (page_id), each table with its own host priors; text models come from documents."""
    docs = C.documents(spark, sf_dir)
    model = langid.fit(langid.sample(docs))
    none = F.lit(None).cast("long")
    d = langid.fuse(langid.document_rows(docs), model).select(F.col("id").alias("doc_id"), none.alias("page_id"), "host", "declared", "address", "text_lang", "lang", "confidence", "accepted")
    p = langid.fuse(langid.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), model).select(none.alias("doc_id"), F.col("id").alias("page_id"), "host", "declared", "address", "text_lang", "lang", "confidence", "accepted")
    return d.unionByName(p)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(C.documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=1, added=True))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = {"text": F.translate("text", merkle.UPPER, merkle.UPPER.lower())}
    rows = merkle.leaves(C.documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], changed=low, where=hit)
    return merkle.manifest(rows).withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return lm.score(docs, lm.fit(docs, ~held), keep={"held_out": held})


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_secret_scan, op4_rp_forest, op5_warc, op6_byte_bpe, op7_simhash, op8_sharding, op9_language_id, op10_packing, op11_prefix_trie, op12_merkle_manifest, op13_lm_scoring)}

ORACLE = {
    "op11_prefix_trie": sql.prefix_trie(),
    "op12_merkle_manifest": sql.merkle(),
    "op2_exact_dedup": r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
        g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.h AS text_sha256 FROM t JOIN g ON t.h = g.h""",
    "op5_warc": """WITH t AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, min(page_id) AS first FROM t GROUP BY h)
        SELECT page_id, strlen(p)::BIGINT AS payload_bytes,
          list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(t.h, (i // 4) * 5 + 1, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM t JOIN g ON t.h = g.h""",
}
