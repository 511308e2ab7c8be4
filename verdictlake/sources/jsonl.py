"""Row files of JSON lines: written whole, read strictly or past lines that a kill cut short, and marks of done phases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def write_rows(rows: DataFrame, path: str) -> int:
    """Write (replacing) and give the number of rows, as the committed files hold them."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def read_rows(spark: SparkSession, path: str, schema: StructType, tolerant: bool = False) -> DataFrame:
    """Blank lines are skipped; a missing file is an error. A line that is no JSON fails, or, if tolerant, is left out."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    marked = StructType([*schema.fields, StructField("_broken", StringType())])
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull()).select(*schema.fieldNames())


def mark_done(spark: SparkSession, marks: str, phase: str, summary: dict) -> None:
    """A one-row folder a phase; Spark's own success file ends it, so a phase is done wholly or not."""
    line = json.dumps({"phase": phase, "summary": json.dumps(summary, sort_keys=True)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{marks}/phase={phase}")


def done_summary(spark: SparkSession, marks: str, phase: str) -> dict | None:
    """The summary of a done phase, else None."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{marks}/phase={phase}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return None
    return json.loads(json.loads(spark.read.text(f"{marks}/phase={phase}").first()["value"])["summary"])
