"""Files with manifests and refusals: pinned sources, exports, checked loads, JSON arrays, and lines filtered before parsing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "name string, rows bigint, sha256 string, made_for string"


def fingerprint(df: DataFrame):
    """One row: rows and a hash of the content that no order changes: every row's SHA-256, its first 15 digits added up."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    return df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum("h"), F.lit(0)).cast("string"), 256).alias("sha256"))


def export(tables: dict[str, DataFrame], folder: str, made_for: str) -> None:
    """Write each table and, last, the manifest that names them: without it nothing is there."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        seen = fingerprint(spark.read.parquet(f"{folder}/{name}")).first()
        rows.append((name, seen["rows"], seen["sha256"], made_for))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{folder}/manifest")


def load(spark: SparkSession, folder: str, name: str, made_for: str) -> DataFrame:
    """A table of an export, refused where its rows or content are not the manifest's, or it was made for another parent."""
    listed = {r["name"]: r for r in spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect()}  # one row a table
    if name not in listed:
        raise ValueError(f"{folder} holds no {name}: only {sorted(listed)}")
    if listed[name]["made_for"] != made_for:
        raise ValueError(f"{name} was made for {listed[name]['made_for']}, not for {made_for}")
    df = spark.read.parquet(f"{folder}/{name}")
    seen = fingerprint(df).first()
    if (seen["rows"], seen["sha256"]) != (listed[name]["rows"], listed[name]["sha256"]):
        raise ValueError(f"{name} holds {seen['rows']} rows that are not those of the manifest ({listed[name]['rows']})")
    return df


def pinned(spark: SparkSession, files: dict[str, str]) -> list[str]:
    """Paths whose bytes have the SHA-256 pinned for them; refused where one has not. Files are hashed where they are read."""
    found = {r["path"]: r["sha"] for r in spark.read.format("binaryFile").load(list(files)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha")).collect()}  # a row a file
    wrong = sorted(p for p, sha in files.items() if found.get(p.removeprefix("file:")) != sha)
    if wrong:
        raise ValueError(f"{wrong[0]} and {len(wrong) - 1} others have not the bytes that are pinned")
    return sorted(files)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON array, a row an element, numbered in their order."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("pos"), "*")


def first_statements(rows: DataFrame, statement: str, group: str, pos: str = "pos") -> DataFrame:
    """Rows whose statement is a theorem, the first of each natural-language text."""
    from ..operators.pool import first_of_key

    return first_of_key(rows.where(F.col(statement).rlike(r"^\s*theorem\s")), [group], [pos])


def of_split(rows: DataFrame, split: str, key: str) -> DataFrame:
    return rows.where(F.col("split") == split).orderBy(key)


def parts_in_name_order(spark: SparkSession, glob: str) -> DataFrame:
    """The lines of many parts with the part each came from; parts follow each other by name, lines by their place."""
    lines = spark.read.text(glob).withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/?$", 1))
    return lines.select("part", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def wanted_lines(spark: SparkSession, path: str, schema: StructType | str, key: str, wanted: DataFrame) -> DataFrame:
    """JSON lines of wanted ids: the id is cut out of each line's start, and only lines that stay are parsed."""
    lines = spark.read.text(path).withColumn("id_", F.regexp_extract("value", rf'^\{{"{key}":\s*"?([^",}}]*)"?', 1))
    kept = lines.join(wanted.select(F.col(key).cast("string").alias("id_")).distinct(), "id_", "left_semi")
    return kept.select(F.from_json("value", schema).alias("r")).select("r.*")


def report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown; tables of more rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in found]) + "\n"


def settings_key(settings: dict, ids: DataFrame, key: str) -> str:
    """The key of a cache: settings and the set of ids, whatever their order."""
    total = ids.select(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).first()
    import hashlib

    return hashlib.sha256(f"{json.dumps(settings, sort_keys=True)}:{total['n']}:{total['s'] or 0}".encode()).hexdigest()[:16]
