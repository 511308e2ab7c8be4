"""Selection rules by name: each takes a pool (problem, k, n, score), a size and a seed, and gives the chosen problems in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import rank_hash
from .pool import half_pass_rate

Rule = Callable[[DataFrame, int, int], DataFrame]
RULES: dict[str, Rule] = {}


def rule(f: Rule) -> Rule:
    RULES[f.__name__] = f
    return f


@rule
def by_hash(pool: DataFrame, size: int, seed: int) -> DataFrame:
    return pool.orderBy(rank_hash(seed, "random", F.col("problem"))).limit(size)


@rule
def barely_provable(pool: DataFrame, size: int, seed: int, band: float = 0.25) -> DataFrame:
    p = F.col("k") / F.col("n")
    return pool.where("k > 0").orderBy(~(p <= band), p, rank_hash(seed, "difficulty", F.col("problem"))).limit(size)


@rule
def half_rate(pool: DataFrame, size: int, seed: int) -> DataFrame:
    return half_pass_rate(pool, "k", "n", "problem", size).drop("distance")


@rule
def learning_progress(pool: DataFrame, size: int, seed: int) -> DataFrame:
    return pool.orderBy(F.desc("score"), "problem").limit(size)


def select(name: str, pool: DataFrame, size: int, seed: int) -> DataFrame:
    if name not in RULES:
        raise ValueError(f"no rule {name!r}: there are {', '.join(sorted(RULES))}")
    return pool.transform(lambda df: RULES[name](df, size, seed)).select(F.lit(name).alias("rule"), "problem")
