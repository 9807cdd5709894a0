"""A language that is rare in the table is modelled and its documents stay."""

from pyspark.sql import functions as F

from tickloom.llm import langid


def test_rare_language_stays(spark):
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat sat with that other one and then "), F.hex("id")).alias("text"), F.lit("en").alias("lang"))
    rare = [(100_000 + i, f"\u043a\u043e\u0448\u043a\u0430 \u0441\u0438\u0434\u0435\u043b\u0430 \u043d\u0430 \u043e\u043a\u043d\u0435 \u0438 \u0441\u043c\u043e\u0442\u0440\u0435\u043b\u0430 \u0432 \u0441\u0430\u0434 {i}", "ru") for i in range(30)]
    long = [(200_000 + i, "der Hund liegt unter dem Tisch " * 800 + str(i), "de") for i in range(8)]
    docs = many.unionByName(spark.createDataFrame(rare + long, "doc_id long, text string, lang string")).withColumn("source", F.lit(None).cast("string"))
    model = langid.fit(langid.sample(docs))
    assert model["langs"] == ["de", "en", "ru", langid.UND]
    kept = langid.keep_identified(docs).filter("lang <> 'en'").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in kept} == {"ru": 30, "de": 8}


def test_sample_is_bounded_per_label(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc "), "id").alias("text"), F.when(F.col("id") % 100 == 0, "xx").otherwise("en").alias("lang"))
    got = langid.sample(docs, rows=600)
    assert sum(x == "xx" for _, x in got) == 50 and sum(x == "en" for _, x in got) == 300 and got == langid.sample(docs.repartition(7), rows=600)
