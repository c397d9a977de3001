"""Streaming unique barcodes against the batch result."""

from tagmill.streaming import unique


def test_first_reads(spark, tmp_path):
    batch = spark.createDataFrame([("k", "A", "2024-01-01 00:00:00"), ("k", "A", "2024-01-01 00:00:05"), ("k", "B", "2024-01-01 00:01:00")], "key string, umi string, t string").selectExpr("key", "umi", "cast(t as timestamp) as ts")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = unique.first_reads(stream, ["key"]).writeStream.format("memory").queryName("first_reads").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(*) from first_reads").first()[0] == 2
