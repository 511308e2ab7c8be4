"""Training files and their refusals, attempts to assemble, checks given up, progress, and names of arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import named


def training_violations(rows: DataFrame, barred: DataFrame, known: DataFrame, halves: dict[str, int] | None = None) -> DataFrame:
    """rule, id of a training file (id, problem, origin, pos, proof): an id twice, a problem twice in one origin, a barred problem, an
    unknown one, an empty proof, a place that is missing or taken twice, or an origin with another number of rows than asked."""
    own = rows.withColumn("id", F.col("id").cast("string"))
    n = own.agg(F.count(F.lit(1)).alias("n_"))
    found = [
        named(own.groupBy("id").count().where("count > 1"), "id twice", "id"), named(own.groupBy("origin", "problem").agg(F.count(F.lit(1)).alias("c_"), F.min("id").alias("id")).where("c_ > 1"), "problem twice", "id"),
        named(own.join(barred.select("problem").distinct(), "problem", "left_semi"), "barred problem", "id"), named(own.join(known.select("problem").distinct(), "problem", "left_anti"), "unknown problem", "id"),
        named(own.where(F.col("proof").isNull() | (F.trim("proof") == "")), "empty proof", "id"), named(own.groupBy("pos").agg(F.count(F.lit(1)).alias("c_"), F.min("id").alias("id")).where("c_ > 1"), "place twice", "id"),
        named(own.crossJoin(F.broadcast(n)).where((F.col("pos") < 1) | (F.col("pos") > F.col("n_")) | F.col("pos").isNull()), "no such place", "id"),  # one row is broadcast
    ]
    if halves:
        counts = own.groupBy("origin").agg(F.count(F.lit(1)).alias("c_"))
        wanted = F.create_map(*[x for k, v in halves.items() for x in (F.lit(k), F.lit(v))])
        found.append(named(counts.where(~F.coalesce(F.col("c_") == wanted[F.col("origin")], F.lit(False))).withColumn("id", F.col("origin")), "other number of rows", "id"))
    return reduce(DataFrame.unionByName, found)


def given_up(log: DataFrame, sha: str, at: list[str], crashed: Column, most: int = 3) -> DataFrame:
    """sha, answered (its last row that is an answer has one), given_up: crashed at least so often and was never answered."""
    return log.groupBy(sha).agg(F.count_if(~crashed).alias("answers"), F.count_if(crashed).alias("crashes")).select(sha, (F.col("answers") > 0).alias("answered"), ((F.col("answers") == 0) & (F.col("crashes") >= most)).alias("given_up"))


def with_assembly(results: DataFrame, assembled: DataFrame, key: str) -> DataFrame:
    """k of a problem that only the assembly resolved is read as 1, with a flag beside it."""
    flags = assembled.select(key).distinct().withColumn("by_assembly", F.lit(True))
    rows = results.join(flags, key, "left").withColumn("by_assembly", F.coalesce("by_assembly", F.lit(False)))
    return rows.withColumn("k", F.when((F.col("k") == 0) & F.col("by_assembly"), F.lit(1)).otherwise(F.col("k")).cast("bigint"))


def to_assemble(attempts: DataFrame, unresolved: DataFrame, key: str, side: str, usable: Column, order: list[str], chain: int = 8) -> DataFrame:
    """Of each unresolved problem and side its first usable rejected attempts in order, as one chain."""
    own = attempts.join(unresolved.select(key).distinct(), key, "left_semi").where(usable)
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy(key, side).orderBy(*order))).where(F.col("nth") <= chain)
    return first.groupBy(key, side).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", *order))), lambda x: x[order[0]]).alias("chain"))


def refiltered(stored: DataFrame, published: DataFrame, compiling: DataFrame, key: str, text: str) -> DataFrame:
    """Stored statements that still compile; refused where a stored text is not the published one."""
    from .checks import refuse

    both = stored.join(published.select(key, F.col(text).alias("published_")), key, "left")
    refuse(both.where(~F.col(text).eqNullSafe(F.col("published_"))).select(key), "a stored statement is not the published one")
    return stored.join(compiling.select(key).distinct(), key, "left_semi")


def record_differences(expected: DataFrame, recorded: DataFrame, step: str, value: str, within: float = 1e-9) -> DataFrame:
    """Steps whose recorded value is missing, extra, or not the expected one within a share of it."""
    both = expected.select(step, F.col(value).alias("expected")).join(recorded.select(step, F.col(value).alias("recorded")), step, "full")
    return both.where(F.col("expected").isNull() | F.col("recorded").isNull() | (F.abs(F.col("expected") - F.col("recorded")) > within * F.abs("expected")))


def progress(checks: DataFrame, problem: str, settled: Column, seconds: str) -> DataFrame:
    """One row: problems settled and left, checks a settled problem, checks a second, and the seconds that the rest will take."""
    each = checks.groupBy(problem).agg(F.bool_or(settled).alias("s_"), F.count(F.lit(1)).alias("c_"), F.sum(seconds).alias("t_"))
    found = each.agg(F.count_if("s_").alias("settled"), F.count_if(~F.col("s_")).alias("left"), (F.sum(F.when(F.col("s_"), F.col("c_"))) / F.nullif(F.count_if("s_"), F.lit(0))).alias("checks_each"), (F.sum("c_") / F.sum("t_")).alias("rate"))
    return found.withColumn("seconds_left", F.col("left") * F.col("checks_each") / F.col("rate"))


def checks_asked(certificates: DataFrame, problem: str, pos: str, status: str) -> DataFrame:
    """How many checks rounds of one question a problem ask until none is open: up to the first verified one, or all."""
    first = F.min(F.when(F.col(status) == "verified", F.col(pos)))
    return certificates.groupBy(problem).agg(F.least(F.coalesce(first, F.max(pos)), F.max(pos)).cast("bigint").alias("asked"))


ARM = r"^([a-z]+)(?:-r(\d+))?(?:-s(\d+))?$"


def arm_parts(name: Column) -> Column:
    """struct<recipe, rank, seed> of a name like recipe-r64-s2; a part that is not there is null."""
    part = lambda i: F.nullif(F.regexp_extract(name, ARM, i), F.lit(""))
    return F.struct(part(1).alias("recipe"), part(2).cast("int").alias("rank"), part(3).cast("int").alias("seed"))


def arm_name(recipe: Column, rank: Column, seed: Column) -> Column:
    return F.concat(recipe, F.coalesce(F.concat(F.lit("-r"), rank.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("-s"), seed.cast("string")), F.lit("")))
