from pyspark.sql import functions as F

from weftgraph.streaming.degrees import windowed_degrees


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).alias("src"), (F.col("id") % 5).alias("dst"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_degrees(spark.read.parquet(str(tmp_path / "in"))).collect()}
    stream = windowed_degrees(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("deg").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("deg").collect()} == batch
