from datetime import datetime, timedelta

from pyspark.sql import functions as F

from modewave.streaming import axes


def rows(spark, start, n, base=0):
    t0 = datetime(2025, 1, 1)
    return spark.createDataFrame([(base + i, t0 + timedelta(hours=(start + i) // 2), float(base + i)) for i in range(n)], "src long, ts timestamp, value double")


def test_last_record_wins_across_batches(spark, tmp_path):
    path, source = str(tmp_path / "table"), str(tmp_path / "source")
    rows(spark, 0, 40).coalesce(1).write.parquet(source)
    rows(spark, 30, 40, 1000).coalesce(1).write.mode("append").parquet(source)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    stream = spark.readStream.schema("src long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(axes.prefer_last_sink(path, "ts", "src")).option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    both = rows(spark, 0, 40).unionByName(rows(spark, 30, 40, 1000))
    want = {(r["ts"], r["s"]) for r in both.groupBy("ts").agg(F.max("src").alias("s")).collect()}
    assert {(r["ts"], r["src"]) for r in spark.read.parquet(path).collect()} == want


def test_daily_means_and_sessions(spark, tmp_path):
    source = str(tmp_path / "source")
    rows(spark, 0, 200).coalesce(1).write.parquet(source)
    for name, build in (("daily", lambda s: axes.daily_mean_stream(s, "ts", "value")), ("sessions", lambda s: axes.session_stream(s.withColumn("series", F.lit(1)), "ts", "90 minutes", "series"))):
        stream = spark.readStream.schema("src long, ts timestamp, value double").parquet(source)
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "daily" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("daily").count() == 5
    batch = rows(spark, 0, 200).groupBy(F.session_window("ts", "90 minutes")).count()
    assert batch.count() == 1 and batch.first()["count"] == 200
