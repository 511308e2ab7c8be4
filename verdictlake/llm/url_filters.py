"""URL rules and lists behind a blocked Bloom filter.

A listed key is a host and a path prefix (``example.org/es/``). Its form is its host's number of labels and its path's
length. A URL has one candidate for each form that some listed key has: so many last labels of its host with so many first
characters of its path, whatever its own length. The Bloom filter holds the listed keys,
cut into blocks of 512 bits: a key's hash picks one block and sets ``PROBES`` bits in it, so that a test touches one
cache line. Only URLs with a candidate that the filter passes go on to an exact join with the list, which removes its false
positives; the others are never shuffled. Of the listed keys that fit, the longest decides. A URL that none fits gets the
default verdict.

The filter is sent to the tasks and is ``most_bits`` at most: a longer list raises the share of false positives, not
its size. The join is by broadcast up to ``most_broadcast`` listed keys of together ``most_broadcast_bytes``, beyond it by shuffle with the hot keys' rows
dealt out over ``salts`` copies of the list.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; very long hosts and paths
are judged whole; repeated rows are judged alike; a null id stays null; equal keys with different verdicts resolve to block; of equally long keys the longer host wins; a rule
without "/" has an empty path and fits all paths; empty tables give empty results; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BLOCK_BITS, PROBES = 512, 8


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A to Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(df: DataFrame, key: str, verdict: str) -> DataFrame:
    """The list by key: host, path, verdict, hash. Block wins where a key stands twice."""
    host = F.substring_index(F.col(key), "/", 1)
    rows = df.where(F.col(key).isNotNull()).select(F.lower(host).alias("rule_host"), F.expr(f"substring({key}, length(substring_index({key}, '/', 1)) + 1)").alias("rule_path"), F.col(verdict).alias("rule_verdict"))
    rows = rows.groupBy("rule_host", "rule_path").agg(F.max_by("rule_verdict", F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("rule_verdict"))
    return rows.withColumn("rule_hash", F.xxhash64("rule_host", "rule_path"))


def probes(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each hash and its bits there, by double hashing within the block."""
    u = h.view(np.uint64)
    block = (u >> np.uint64(32)) % np.uint64(blocks)
    a, b = u & np.uint64(0xFFFF), (u >> np.uint64(16)) & np.uint64(0xFFFF) | np.uint64(1)
    return block, [((a + np.uint64(i) * b) * np.uint64(0x9E37) >> np.uint64(5)) % np.uint64(BLOCK_BITS) for i in range(PROBES)]


class BlockedBloom:
    def __init__(self, blocks: int):
        self.blocks, self.words = blocks, np.zeros((blocks, BLOCK_BITS // 64), np.uint64)

    @classmethod
    def sized(cls, n: int, bits_a_key: int = 16, most_bits: int = 1 << 29) -> BlockedBloom:
        return cls(max(1, min(most_bits, n * bits_a_key) // BLOCK_BITS))

    def add(self, h: np.ndarray) -> None:
        block, bits = probes(h, self.blocks)
        for bit in bits:
            np.bitwise_or.at(self.words, (block, bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))

    def test(self, h: np.ndarray) -> np.ndarray:
        block, bits = probes(h, self.blocks)
        found = np.ones(len(h), bool)
        for bit in bits:
            found &= (self.words[block, bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filter_of(rules: DataFrame, n: int, **sizes) -> BlockedBloom:
    """Built in the tasks, one partial filter each, and joined by OR as they arrive; no list reaches the driver."""
    bloom = BlockedBloom.sized(n, **sizes)
    blocks = bloom.blocks

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BlockedBloom(blocks)
        for p in parts:
            own.add(p["rule_hash"].to_numpy(np.int64))
        yield pd.DataFrame({"words": [own.words.tobytes()]})

    for row in rules.select("rule_hash").coalesce(8).mapInPandas(partial, "words binary").toLocalIterator():
        bloom.words |= np.frombuffer(row["words"], np.uint64).reshape(bloom.words.shape)
    return bloom


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", most_broadcast: int = 100_000, most_broadcast_bytes: int = 16 << 20, salts: int = 32, **sizes) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. rules: from listed()."""
    spark = pages.sparkSession
    # Forms of listed keys: labels of the host and length of the path. Their number is set by the list's longest key.
    forms = rules.select((F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."))) + 1).alias("labels"), F.length("rule_path").alias("chars"))
    forms = sorted((r["labels"], r["chars"], r["n"]) for r in forms.groupBy("labels", "chars").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(f[2] for f in forms)
    urls = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not n:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    bloom = spark.sparkContext.broadcast(filter_of(rules, n, **sizes))

    @F.pandas_udf("array<boolean>")
    def passes(hashes: pd.Series) -> pd.Series:
        many = hashes.map(len).to_numpy()
        flat = np.concatenate([*hashes.to_numpy(), np.zeros(0, np.int64)]).astype(np.int64)
        return pd.Series(np.split(bloom.value.test(flat), np.cumsum(many)[:-1])) if len(hashes) else pd.Series([], dtype=object)

    # A URL has at most one candidate of each form: its host's last labels and its path's first characters.
    asked = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k, _ in forms])
    own = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    asked = F.filter(asked, lambda f: (f["m"] <= own) & (f["k"] <= F.length("path")) & (F.col("host") != ""))
    tail, start = (lambda f: F.call_function("substring_index", "host", F.lit("."), -f["m"])), (lambda f: F.substring("path", F.lit(1), f["k"]))
    urls = urls.withColumn("candidates", F.transform(asked, lambda f: F.struct(f["m"].alias("m"), f["k"].alias("k"), F.xxhash64(tail(f), start(f)).alias("x"))))
    urls = urls.withColumn("hits", passes(F.transform("candidates", lambda c: c["x"])))
    kept = F.transform(F.filter(F.arrays_zip("candidates", "hits"), lambda c: c["hits"]), lambda c: c["candidates"])
    urls = staged(urls.select("page_id", "host", "path", kept.alias("hits")), "urls")
    clear = urls.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("struct<n:int,m:int,rule:string,verdict:string>").alias("best"))
    hits = urls.where(F.size("hits") > 0).withColumn("uid", F.monotonically_increasing_id()).select("uid", "page_id", "host", "path", F.explode("hits").alias("c"))
    hits = hits.select("uid", "page_id", "host", "path", tail(F.col("c")).alias("rule_host"), start(F.col("c")).alias("rule_path"), F.col("c.x").alias("rule_hash"))
    on = ["rule_hash", "rule_host", "rule_path"]
    if n <= most_broadcast and sum(f[2] * (16 * f[0] + 4 * f[1]) for f in forms) <= most_broadcast_bytes:
        exact = hits.join(F.broadcast(rules), on, "left")
    else:
        copies = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        exact = hits.withColumn("salt", F.pmod("uid", F.lit(salts)).cast("int")).join(copies, [*on, "salt"], "left")
    fits = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = exact.groupBy("uid").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("rule_verdict").isNotNull(), fits)).alias("best"))
    both = clear.unionByName(best.select("page_id", "host", "path", "best"))
    return both.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
