from pyspark.sql import functions as F

from veritally.llm import common


def test_stored_and_clear(spark):
    df = common.stored(spark.range(100).withColumn("x", F.col("id") * 2), "t", small=True)
    assert df.agg(F.sum("x")).first()[0] == 9900
    other = common.stored(spark.range(3), "u")
    common.dropped(other)
    assert df.count() == 100
    common.clear(spark)
    assert common.stored(spark.range(0), "v").count() == 0


def test_held_out_and_sample(spark):
    import zlib

    rows = spark.range(200).select("id", common.held_out("id", 7).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 7 == 2) for r in rows)
    assert common.sample(spark.range(50), 100, "id").count() == 50 and 50 < common.sample(spark.range(5000), 100, "id").count() < 160
