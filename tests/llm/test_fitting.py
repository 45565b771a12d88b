from pyspark.sql import functions as F

from foretally.llm.fitting import bounded_sample


def test_rare_rows_fill_the_sample(spark):
    rows = spark.range(20000).select("id", (F.col("id") % 100 == 0).alias("rare"))
    found = bounded_sample(rows, 100, "id", keep=F.col("rare")).collect()
    assert len(found) == 100 and len(set(found)) == 100 and all(r.rare for r in found)


def test_null_and_repeated_keys_take_their_share(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("key"), F.col("id").cast("string").alias("text"))
    keys = [r.key for r in bounded_sample(rows, 300, "key", "text").collect()]
    assert len(keys) == 300 and 60 < keys.count(None) < 150
