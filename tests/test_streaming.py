"""The streamed daily count equals the batch one on closed days."""

from pyspark.sql import functions as F

from hearsay.operators.aggregates import daily_count
from hearsay.streaming.daily import daily_count_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = daily_count_stream(source, "ts", "event_id", "n", ["event_type"], "30 days")
    query = (counted.writeStream.outputMode("complete").format("memory").queryName("daily")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    expected = daily_count(batch, "ts", "event_id", "n", ["event_type"])
    streamed = spark.table("daily").select(expected.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, expected.collect()))
