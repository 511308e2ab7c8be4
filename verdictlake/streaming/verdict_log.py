"""The append-only verdict log as a stream: latest answer a key, failures a minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The last row of each key; later answers supersede earlier ones however late they come."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in at])
    return log.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def per_minute(log: DataFrame, at: str, kind: str) -> DataFrame:
    return log.groupBy(F.window(at, "1 minute").alias("w"), kind).agg(F.count(F.lit(1)).alias("failures")).select(F.col("w.start").alias("minute"), kind, "failures")


def failures_stream(spark: SparkSession, path: str, schema, at: str = "ts", kind: str = "event_type", lateness: str = "1 hour", files_a_trigger: int = 4) -> DataFrame:
    """Streaming form: bounded state by watermark, back-pressure by files a trigger."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return per_minute(log.withWatermark(at, lateness), at, kind)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Consume what is there, in micro-batches, into a table in memory."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
