"""Continuous hit log and counters (STM-01, STM-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import traffic
from tessera.session import scratch
from tessera.sources.adapters import hits


def hit_log_stream(events: DataFrame) -> DataFrame:
    """STM-01: log lines of a stream of events; a projection, so it holds no state."""
    return traffic.record(hits(events))


def append_log(log: DataFrame, path: str, checkpoint: str, country: str = "nz"):
    """STM-01: append a stream of log lines by country and arrival month; returns the running query."""
    lines = log.withColumns({"country": F.lit(country), "month": F.date_format("ts", "yyyy-MM")})
    return lines.writeStream.format("parquet").partitionBy("country", "month").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def period_counts(log: DataFrame, lateness: str = "40 days") -> DataFrame:
    """STM-02: hits by UTC month, week from Monday and agent; late lines count while the watermark allows."""
    watched = log.where("kind = 'hit'").withWatermark("ts", lateness)
    week = F.window("ts", "7 days", "7 days", "4 days")
    return watched.groupBy(week, F.date_format("ts", "yyyy-MM").alias("month"), "agent").agg(F.count("*").alias("hits"))


def run_to_table(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an updating aggregation over all that is there and return its last state.

    Every micro-batch writes the rows that changed to the shared folder under
    its own number; the last version of a key is its count.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, label), scratch(spark, f"{label}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    changed = spark.read.parquet(out)
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return changed.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "n", "batch")
