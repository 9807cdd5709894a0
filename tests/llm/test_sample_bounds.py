"""The language sample and tables stay bounded for many labels and many copies; ranges of archives are read by many tasks."""

from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm import common as C, langid, warc


def test_many_labels_share_the_bound(spark):
    # 2,000 labels whose texts have words of their own, of letters: all digits are one symbol to the model
    word = F.translate(F.substring(F.sha1(F.concat(F.col("id") % 2000, F.lit("x")).cast("binary")), 1, 12), "0123456789", "ghijklmnop")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", word, F.reverse(word), word, F.col("id")).alias("text"),
                                      F.concat(F.lit("l"), F.col("id") % 2000).alias("lang"), F.lit(None).cast("string").alias("source"))
    rows = langid.sample(docs, most_rows=16_000)
    assert len(rows) == 16_000 and all(n == 8 for n in Counter(x for _, x in rows).values())
    model = langid.fit(rows)
    assert len(model["langs"]) == 2001 and model["table"].nbytes <= 4 * langid.TABLE_CELLS + 4 * langid.BUCKETS
    few = docs.filter("doc_id < 200").select("text", F.lit(None).cast("string").alias("d"), "lang")
    got = langid.text_evidence(few, model, most_evidence=60).select("ll", "lang").collect()
    hit = sum(model["langs"][max(range(len(r.ll)), key=lambda i: r.ll[i])] == r.lang for r in got)
    assert hit >= 190


def test_labels_beyond_the_bound(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc "), "id").alias("text"), F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("l"), F.col("id") % 1000)).alias("lang"))
    got = langid.sample(docs, most_rows=100, least=5)
    assert len(got) <= 100 and len({x for _, x in got}) <= 20 and any(x == "big" for _, x in got)


def test_copies_of_a_row_count_once(spark):
    text = "one row that stands very many times in the table "
    docs = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit(text), 300).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.range(100, 130).select(F.col("id").alias("doc_id"), F.concat(F.lit("another "), "id").alias("text"), F.lit("en").alias("lang")))
    got = langid.sample(docs)
    assert len(got) == 31 and len(set(got)) == 31


def test_text_together_is_bounded(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 1000, "ab ").alias("text"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"))
    got = langid.sample(docs, rows=100, most_chars=600, each=100)
    assert len(got) == 200 and all(len(t) == 300 for t, _ in got)
    assert all(len(t) == 600 for t, _ in langid.sample(docs, rows=100, most_chars=600, each=50))


def test_ranges_are_read_by_many_tasks(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("s"), "id"), 512)).alias("html"))
    folder = C.shared_path(spark, "t-warc")
    index = warc.write(pages.coalesce(1), folder)
    n = warc.ranges(index, range_bytes=1 << 12).count()
    got = warc.read(index, folder, range_bytes=1 << 12)
    used = got.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert n > 12 and got.rdd.getNumPartitions() == n == warc.tasks(n) and used > n / 3
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got.collect()) == sorted((r.page_id, r.html) for r in pages.collect())
    assert [warc.tasks(x) for x in (0, 1, 1024, 5000, 160_000)] == [1, 1, 1024, 1024, 10_000]
