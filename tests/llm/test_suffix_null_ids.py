"""Rows without an id in op8, whose texts alone tell them apart."""

from pyspark.sql import functions as F

from meterlake.llm import suffixdedup as X


def test_texts_of_equal_32_bit_hashes_are_told_apart(spark):
    # Among 400,000 texts some pairs share hash(); the key holds them apart, null ids and one hot id alike.
    texts = spark.range(400_000).select(F.concat(F.lit("text "), "id").alias("text"))
    assert texts.select(F.hash("text")).distinct().count() < 400_000
    for one in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        assert X._documents(texts.withColumn("doc_id", one)).select("d", "t").distinct().count() == 400_000


def test_a_span_is_cut_from_its_own_text_only(spark):
    texts = spark.range(400_000).select(F.concat(F.lit("text "), "id", F.repeat(F.lit("x"), 390)).alias("text"))
    twins = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("two")).where("size(two) = 2").select("two").limit(1).first().two
    # The first twin repeats and goes; the second one is its own and stays.
    rows = [(None, twins[0]), (None, twins[1]), (1, twins[0])]
    kept = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in X.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [("1", ""), ("None", ""), ("None", twins[1])]
