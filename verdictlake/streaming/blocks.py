"""The rolling block pipeline as a stream: a block is a micro-batch, back-pressure is files a trigger, the checkpoint marks done blocks.

Each block is answered, settled and written to a folder of its own number. A block that is run again after a failure
writes its folder again, so that whole blocks count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_blocks(spark: SparkSession, source: str, schema, settle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_block: int = 3) -> DataFrame:
    """Settle what is there, block after block, and return all settled rows."""

    def block(rows: DataFrame, number: int) -> None:
        settle(rows).write.mode("overwrite").parquet(f"{out}/block={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_block).parquet(source)
    stream.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
