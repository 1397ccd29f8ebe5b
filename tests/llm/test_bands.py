"""Bands of the quality rules beside many copies of one text."""

from pyspark.sql import functions as F

from tastemill.llm import fertility

FOLDER = "/root/testdata/sf0.01"


def rejected(docs, **options):
    found = fertility.verdicts(docs, **options).where("doc_id < 1000000 AND NOT base_failed AND NOT fertile")
    return sorted(r["doc_id"] for r in found.select("doc_id").collect())


def test_copies_do_not_set_the_bands(spark):
    """Copies that are a third of all rows change no verdict of another document."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").where("lang = 'en' AND text IS NOT NULL").dropDuplicates(["text"]).cache()
    sized = fertility.measure(docs, carry=["doc_id", "text"]).withColumn("l", fertility.length()).where("n_words >= 20 AND n_repeat_words = 0 AND n_tokens >= 40")
    cell = sized.groupBy("l").count().orderBy(F.desc("count"), "l").first()["l"]
    one = sized.where(F.col("l") == cell).orderBy("doc_id").first()["text"]
    copies = spark.range(docs.count() // 2).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit(one).alias("text"), F.lit("en").alias("lang"))
    alone, beside = rejected(docs), rejected(docs.unionByName(copies))
    assert beside == alone
    assert rejected(docs.unionByName(copies), carry=["doc_id"], lang=None) == rejected(docs, carry=["doc_id"], lang=None)


def test_input_columns_named_like_the_digest_stay(spark):
    docs = spark.createDataFrame([(1, "some words " * 40, "en", "mine", "yours")], "doc_id long, text string, lang string, _digest string, _digest_ string")
    for carry in (None, ["doc_id", "_digest", "_digest_"]):
        found = fertility.verdicts(docs, carry=carry)
        assert [found.first()[c] for c in ("_digest", "_digest_")] == ["mine", "yours"] and "_digest__" not in found.columns
