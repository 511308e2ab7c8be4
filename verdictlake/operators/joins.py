"""Joins that say what does not match. A refusal is a table of the rows that break the rule; ``checks.refuse`` raises on it.

Keys are compared by equality only; conditions joined by OR are one equi join each. Nothing is broadcast by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_verdicts(attempts: DataFrame, verdicts: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Attempts with ``verified``; one without a verdict is not verified."""
    known = verdicts.select(key, (F.col(status) == "verified").alias("verified"))
    return attempts.join(known, key, "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def named(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias(key)).distinct()


def pair_refusals(before: DataFrame, after: DataFrame, key: str = "problem", n: str = "n") -> DataFrame:
    """rule, key: problems that one side lacks or holds twice, or whose sides have different numbers of episodes."""
    one = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"rows_{name}"), F.max(n).alias(f"n_{name}"))
    both = one(before, "before").join(one(after, "after"), key, "full")
    rules = {"not before": F.col("rows_before").isNull(), "not after": F.col("rows_after").isNull(), "twice": (F.col("rows_before") > 1) | (F.col("rows_after") > 1), "other number of episodes": F.col("n_before") != F.col("n_after")}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in rules.items()]))
    return both.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias(key))


def strictly_paired(before: DataFrame, after: DataFrame, key: str = "problem", k: str = "k", n: str = "n") -> DataFrame:
    """k and n of both sides by problem; refused unless they hold the same problems once, with the same n."""
    from .checks import refuse

    refuse(pair_refusals(before, after, key, n), "the two sides cannot be paired")
    return before.select(key, F.col(k).alias("k_before"), F.col(n).alias("n_before")).join(after.select(key, F.col(k).alias("k_after"), F.col(n).alias("n_after")), key)


def added(samplings: list[DataFrame], key: str, sums: list[str]) -> DataFrame:
    """Samplings of the same problems added up by problem, with how many of them held it (a whole cover has all)."""
    rows = reduce(DataFrame.unionByName, [s.select(key, *sums) for s in samplings])
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("samplings"))


def cover_violations(attempts: DataFrame, versions: dict[str, DataFrame], key: str) -> DataFrame:
    """rule, key: attempts given twice, and attempts that a version lacks or has beyond those given."""
    found = [named(attempts.groupBy(key).count().where("count > 1"), "given twice", key)]
    ids = attempts.select(key).distinct()
    for name, judged in versions.items():
        found += [named(ids.join(judged.select(key), key, "left_anti"), f"{name} lacks it", key), named(judged.join(ids, key, "left_anti"), f"{name} has another", key)]
    return reduce(DataFrame.unionByName, found)


def in_every_seed(results: DataFrame, key: str, seed: str, n: str, least: int) -> DataFrame:
    """Problems that every seed holds with at least so many draws (results: one row a problem and seed)."""
    seeds = results.select(seed).distinct().agg(F.count(F.lit(1)).alias("all_seeds"))
    own = results.groupBy(key).agg(F.count(F.lit(1)).alias("own_seeds"), F.min(n).alias("least_n"))
    return own.crossJoin(F.broadcast(seeds)).where((F.col("own_seeds") == F.col("all_seeds")) & (F.col("least_n") >= least)).select(key)  # one row is broadcast


def rebuilt(rows: DataFrame, candidates: DataFrame, key: str, wanted: str, source: Column, pos: str) -> DataFrame:
    """key, wanted, pos: the first of a problem's candidates whose rebuilt source has the wanted hash; pos null if none has."""
    built = candidates.select(key, F.sha2(source, 256).alias(wanted), F.col(pos).alias("pos")).groupBy(key, wanted).agg(F.min("pos").alias("pos"))
    return rows.select(key, wanted).join(built, [key, wanted], "left")


def earliest(refs: DataFrame, values: DataFrame, keys: list[str], owner: str, value: str) -> DataFrame:
    """owner, first: the least whole number among the referenced rows; what is no number counts as absent."""
    return refs.join(values, keys, "left").groupBy(owner).agg(F.min(F.expr(f"try_cast({value} AS bigint)")).alias("first"))


def preferred(rows: DataFrame, key: str, own: Column, order: list[str]) -> DataFrame:
    """One row a key: one of its own name if the key's list has it, else the first."""
    w = Window.partitionBy(key).orderBy(F.coalesce(own, F.lit(False)).desc(), *order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def pick_refusals(rows: DataFrame, picks: DataFrame, key: str = "problem") -> DataFrame:
    """rule, key: rows without a pick, picked twice, with another k than the pick's, or verified although the pick has k = 0."""
    own = picks.groupBy(key).agg(F.count(F.lit(1)).alias("picked"), F.max("k").alias("pick_k"), F.max("n").alias("pick_n"))
    both = rows.join(own, key, "left")
    rules = {"no pick": F.col("picked").isNull(), "picked twice": F.col("picked") > 1, "k is not of n": ~F.col("pick_k").between(0, F.col("pick_n")), "a row of an unsolved problem": F.col("pick_k") == 0}
    return both.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"), F.col(key).cast("string").alias(key)).distinct()


def with_requested_state(steps: DataFrame, states: DataFrame, arm: str, keys: list[str], loop: str, state: str, first: str = "first") -> DataFrame:
    """Each step with the state left by the loop before it: that of its own arm, in the arms' common loop 1 of arm ``first``."""
    before = states.select(F.col(arm).alias("_arm"), *keys, F.col(loop).alias("_loop"), F.col(state).alias("state_before"))
    asked = steps.withColumn("_loop", F.col(loop) - 1).withColumn("_arm", F.when(F.col("_loop") == 1, F.lit(first)).otherwise(F.col(arm)))
    return asked.join(before, ["_arm", *keys, "_loop"], "left").drop("_arm", "_loop")


def answered_once(rows: DataFrame, sha: str, answers: DataFrame) -> DataFrame:
    """Many rows share one check: the answers by hash, at all rows that asked for it."""
    return rows.join(answers, sha, "left")


def one_check_each(rows: DataFrame, sha: str, pos: str) -> DataFrame:
    """Identical files are one check: the first row of each hash stands for all."""
    return rows.groupBy(sha).agg(F.min(pos).alias(pos), F.count(F.lit(1)).alias("rows"))


def not_contained(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Rows of a set that another set must hold and does not."""
    return part.select(key).distinct().join(whole.select(key).distinct(), key, "left_anti")


def first_difference(one: DataFrame, other: DataFrame, pos: str, value: str) -> DataFrame:
    """pos, one, other: the first position where two ordered lists differ; no row if they are equal."""
    both = one.select(pos, F.col(value).alias("one")).join(other.select(pos, F.col(value).alias("other")), pos, "full")
    return both.where(~F.col("one").eqNullSafe(F.col("other"))).orderBy(pos).limit(1)


def three_sets(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """set (both, one, other), key: union, intersection and differences of two id sets from one outer join."""
    both = one.select(key).distinct().withColumn("i", F.lit(True)).join(other.select(key).distinct().withColumn("j", F.lit(True)), key, "full")
    return both.select(F.when(F.col("i") & F.col("j"), "both").when(F.col("i"), "one").otherwise("other").alias("set"), key)
