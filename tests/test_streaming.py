"""Streams against the same count in one go."""

from pyspark.sql import functions as F

from tidemark.streaming import usage


def test_hourly_usage(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    ordered = rows.orderBy("at").toPandas()
    for k in range(3):  # three deliveries, in order of time, the last rows of each delivered again with the next
        part = ordered.iloc[max(0, len(ordered) * k // 3 - 5) : len(ordered) * (k + 1) // 3]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert usage.write(usage.hourly_usage(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.kind, r.hour): r.calls for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = rows.agg(F.max("at") - F.expr("INTERVAL 1 HOUR")).first()[0]
    wanted = rows.groupBy("kind", F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("calls")).where(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    wanted = {(r.kind, r.hour): r.calls for r in wanted.collect()}
    assert wanted and {k: got.get(k) for k in wanted} == wanted and len(got) <= len(wanted) + 20
