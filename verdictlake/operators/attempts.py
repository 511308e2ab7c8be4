"""Attempts rolled up to k of n, and reads of the roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import pass_at, reward, rung


def k_of_n(attempts: DataFrame, problem: str = "problem", episode: str = "episode") -> DataFrame:
    """Per problem the episodes and those resolved by either side. Two partial aggregations on nested keys."""
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    once = attempts.groupBy(problem, episode).agg(
        flag(F.col("verified") & (F.col("side") == "O")).alias("by_statement"), flag(F.col("verified") & (F.col("side") == "F")).alias("by_negation"),
        F.count_if(F.col("status") == "no_answer").alias("no_answer"), F.count(F.lit(1)).alias("attempts"),
    )
    return once.groupBy(problem).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("by_statement") | F.col("by_negation")).alias("resolved"), F.count_if("by_statement").alias("resolved_by_statement"),
        F.count_if("by_negation").alias("resolved_by_negation"), F.sum("no_answer").alias("attempts_without_an_answer"), F.sum("attempts").alias("attempts"),
    )


def first_attempts(attempts: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n of each key in a total order; those beyond are cut before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return attempts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def paired(results: DataFrame, arm: str, before, after, problem: str = "problem") -> DataFrame:
    """k and n of two arms side by side, in one aggregation instead of a self-join; problems without both are left out."""
    side = lambda v, c: F.max(F.when(F.col(arm) == v, F.col(c)))
    rows = results.where(F.col(arm).isin([before, after])).groupBy(problem).agg(side(before, "k").alias("k_before"), side(before, "n").alias("n_before"), side(after, "k").alias("k_after"), side(after, "n").alias("n_after"))
    return rows.where("k_before is not null and k_after is not null")


def change_by(pairs: DataFrame, group: Column, name: str) -> DataFrame:
    p, q = F.col("k_before") / F.col("n_before"), F.col("k_after") / F.col("n_after")
    return pairs.groupBy(group.alias(name)).agg(
        F.count(F.lit(1)).alias("problems"), F.avg(p).alias("mean_before"), F.avg(q).alias("mean_after"), F.avg(q - p).alias("mean_change"),
        F.count_if(F.expr("k_before = 0 and k_after > 0")).alias("gained"), F.count_if(F.expr("k_before > 0 and k_after = 0")).alias("lost"),
    )


def figure(results: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("k") / F.col("n")
    return results.groupBy(*keys).agg(
        (F.sum("k") / F.sum("n")).alias("per_attempt"), (1000 * F.sum("k") / F.sum("n")).alias("per_1000"),
        (F.sqrt(F.sum(p * (1 - p) / F.col("n"))) / F.count(F.lit(1))).alias("sampling_noise"), F.count_if(F.expr("k > 0")).alias("solved"),
    )


def histogram(results: DataFrame, n: int) -> DataFrame:
    """Problems by k, with the empty bins."""
    bins = results.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("k"))
    return bins.join(results.groupBy(F.col("k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("problems")), "k", "left").na.fill(0, ["problems"])


def arm_reward(results: DataFrame, arm: str, target: float = 0.25) -> DataFrame:
    p = F.col("k") / F.col("n")
    return results.groupBy(arm).agg(
        F.avg(reward(p, target)).alias("mean_reward"), F.avg(F.when(rung(F.col("k"), F.col("n"), target) == "in", 1.0).otherwise(0.0)).alias("share_in_band"),
        F.avg(F.when(F.col("k") == 0, 1.0).otherwise(0.0)).alias("share_at_none"), F.avg(F.when(F.col("k") == F.col("n"), 1.0).otherwise(0.0)).alias("share_at_all"), F.count(F.lit(1)).alias("problems"),
    )


def mean_pass_at(results: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    return results.groupBy(*keys).agg(*[F.avg(pass_at(k, F.col("k"), F.col("n"))).alias(f"pass_at_{k}") for k in ks])


def chunked(attempts: DataFrame, problem: str, order: list[str], size: int) -> DataFrame:
    """Episodes of ``size`` attempts in draw order; the rest that fills none is dropped."""
    rows = attempts.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(problem).orderBy(*order)) - 1) / size).cast("int"))
    whole = rows.groupBy(problem, "chunk").agg(F.bool_or("verified").alias("solved"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
    return whole.groupBy(problem).agg(F.count(F.lit(1)).alias("episodes"), F.count_if("solved").alias("resolved"))


def first_success(attempts: DataFrame, problem: str, order: list[str]) -> DataFrame:
    """The place of the first verified attempt of each problem that has one."""
    rows = attempts.withColumn("place", F.row_number().over(Window.partitionBy(problem).orderBy(*order)))
    return rows.groupBy(problem).agg(F.min(F.when(F.col("verified"), F.col("place"))).alias("first_success")).where("first_success is not null")


def within_k(firsts: DataFrame, most: int) -> DataFrame:
    """Problems resolved within 1..most attempts, running."""
    return firsts.where(F.col("first_success") <= most).select(F.explode(F.sequence(F.col("first_success"), F.lit(most))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("resolved"))


def settled(certificates: DataFrame, problem: str, pos: str, status: str) -> DataFrame:
    """Certificates in order: the first verified one settles a problem in, an unanswered one before it leaves it open, else it is out."""
    at = lambda c: F.min(F.when(c, F.col(pos)))
    rows = certificates.groupBy(problem).agg(at(F.col(status) == "verified").alias("won"), at(F.col(status).isNull()).alias("waits"), F.count(status).alias("answers"))
    state = F.when(F.col("won").isNotNull() & (F.col("waits").isNull() | (F.col("won") < F.col("waits"))), "in").when(F.col("waits").isNotNull(), "open").otherwise("out")
    return rows.select(problem, state.alias("state"), F.when(state == "in", F.col("won")).alias("settled_at"), F.when(state == "open", F.col("waits")).alias("next_check"))
