"""Time-axis operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeaxis import prefer_last


def daily_mean_stream(events: DataFrame, time: str, value: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Daily means in append mode; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), *keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def session_stream(events: DataFrame, time: str, gap: str, key: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Segments without gaps, for each key (streams have no session windows without one); a session ends where a gap is at least ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("segment"), key, *keys).agg(F.count(F.lit(1)).alias("n"))


def prefer_last_sink(path: str, time: str, src: str, *keys: str):
    """For ``foreachBatch``: a table in which each time holds its last record in source order, whatever the batches.

    Each batch is merged with the table's rows of the same days only, and those day folders are replaced; a batch
    that is retried gives the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        here, aside = hadoop.Path(path), hadoop.Path(f"{path}.next")
        fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = prefer_last(batch, time, src, *keys).withColumn("day", F.date_format(time, "yyyyMMdd"))
        schema = rows.schema
        if fs.exists(here):
            old = spark.read.schema(schema).parquet(path).join(rows.select("day").distinct(), "day", "left_semi")
            rows = prefer_last(old.unionByName(rows), time, src, *keys, "day")
            # what is read is being replaced, so it is set down beside the table first
            rows.write.mode("overwrite").parquet(f"{path}.next")
            rows = spark.read.schema(rows.schema).parquet(f"{path}.next")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        fs.delete(aside, True)

    return merge
