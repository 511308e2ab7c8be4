"""Tensor files (a length, a JSON header, little-endian data) as rows, compared and averaged by chunk."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4"}  # fixed values: names of element types
ROWS = "path string, tensor string, chunk int, dtype string, data binary"


def write(path: str, tensors: dict[str, np.ndarray]) -> None:
    names = {np.dtype(v): k for k, v in TYPES.items()}
    header, at = {}, 0
    for name, x in sorted(tensors.items()):
        header[name] = {"dtype": names[x.dtype.newbyteorder("<")], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    head = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head + b"".join(np.ascontiguousarray(x).tobytes() for _, x in sorted(tensors.items())))


def scan(spark: SparkSession, paths: list[str], chunk: int = 1 << 20) -> DataFrame:
    """path, tensor, chunk, dtype, data: every tensor in chunks of so many elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                (n,) = struct.unpack("<Q", content[:8])
                for name, about in json.loads(content[8 : 8 + n]).items():
                    if name == "__metadata__":
                        continue
                    first, last = about["data_offsets"]
                    size = np.dtype(TYPES[about["dtype"]]).itemsize * chunk
                    cuts = range(first, max(last, first + 1), size)
                    yield pd.DataFrame({"path": path, "tensor": name, "chunk": range(len(cuts)), "dtype": about["dtype"], "data": [content[8 + n + c : 8 + n + min(c + size, last)] for c in cuts]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, ROWS)


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """tensor, elements, changed, largest: bit for bit."""
    pairs = one.select("tensor", "chunk", "dtype", F.col("data").alias("a")).join(other.select("tensor", "chunk", F.col("data").alias("b")), ["tensor", "chunk"], "full")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, kind, x, y in zip(b["tensor"], b["dtype"], b["a"], b["b"], strict=True):
                if x is None or y is None or len(x) != len(y):
                    raise ValueError(f"{t} is not in both files with the same shape")
                x, y = (np.frombuffer(v, TYPES[kind]) for v in (x, y))
                unlike = x.view(f"V{x.itemsize}") != y.view(f"V{y.itemsize}")
                rows.append((t, len(x), int(unlike.sum()), float(np.abs(x.astype(float) - y.astype(float)).max()) if len(x) else 0.0))
            yield pd.DataFrame(rows, columns=["tensor", "elements", "changed", "largest"])

    found = pairs.mapInPandas(run, "tensor string, elements bigint, changed bigint, largest double")
    return found.groupBy("tensor").agg(F.sum("elements").alias("elements"), F.sum("changed").alias("changed"), F.max("largest").alias("largest"))


def mean(files: DataFrame) -> DataFrame:
    """tensor, chunk, dtype, data: the mean over the files in double precision, rounded once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kind = TYPES[group["dtype"].iloc[0]]
        total = sum((np.frombuffer(d, kind).astype(float) for d in group["data"]), start=0.0)
        return pd.DataFrame({"tensor": [group["tensor"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "dtype": [group["dtype"].iloc[0]], "data": [(total / len(group)).astype(kind).tobytes()]})

    return files.groupBy("tensor", "chunk").applyInPandas(run, "tensor string, chunk int, dtype string, data binary")
