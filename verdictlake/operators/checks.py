"""Refusals as queries: each returns the rows that break a rule, and ``refuse`` raises where there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_data_violations(heldout: DataFrame, base_map: DataFrame, candidates: DataFrame, facts: DataFrame, results: DataFrame, episodes: int) -> DataFrame:
    """rule, problem. All tables have ``problem``; results have also set (heldout or base_map), k and n."""
    ids = lambda df: df.select("problem").distinct()
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("problem").cast("string").alias("problem")).distinct()
    found = []
    found.append(named(candidates.groupBy("problem").count().where("count > 1"), "candidate twice"))
    for name, rows in (("heldout", heldout), ("base_map", base_map)):
        own = results.where(F.col("set") == name)
        found.append(named(candidates.join(ids(rows), "problem", "left_semi"), f"candidate in {name}"))
        found.append(named(own.groupBy("problem").count().where("count > 1"), f"result of {name} twice"))
        found.append(named(rows.join(ids(own), "problem", "left_anti"), f"no result of {name}"))
        found.append(named(own.join(ids(rows), "problem", "left_anti"), f"result outside {name}"))
    found.append(named(results.where(~F.coalesce(F.col("set").isin("heldout", "base_map"), F.lit(False))), "unknown set"))
    found.append(named(results.where(~F.coalesce(F.col("k").between(0, F.col("n")), F.lit(False))), "not k of n"))
    found.append(named(results.where((F.col("set") == "heldout") & (F.col("n") != episodes)), "other number of episodes"))
    found.append(named(base_map.join(ids(facts), "problem", "left_anti"), "no facts"))
    found.append(named(facts.join(ids(base_map), "problem", "left_anti"), "facts outside base_map"))
    return reduce(DataFrame.unionByName, found)


def set_differences(stored: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """key, stored and made (times): where a stored set is not what its rule makes again."""
    a = stored.groupBy(key).agg(F.count(F.lit(1)).alias("stored"))
    b = made.groupBy(key).agg(F.count(F.lit(1)).alias("made"))
    both = a.join(b, key, "full").na.fill(0, ["stored", "made"])
    return both.where((F.col("stored") != F.col("made")) | (F.col("stored") > 1))


def side_plan(ruled_out: Column, has_negation: Column, audited: Column, audit_only: bool, skip: bool = False) -> Column:
    """map<side, checked or generated_only>: the side that a certificate rules out is checked only where all are or the
    problem is in the audit share; else it is generated only, or left out (``skip``), as is a negation that is not there."""
    plain = lambda c: F.coalesce(c, F.lit(False))

    def entry(side: str, there: Column) -> Column:
        checked = ~plain(ruled_out == side) | F.lit(not audit_only) | plain(audited)
        done = F.when(checked, "checked") if skip else F.when(checked, "checked").otherwise("generated_only")
        return F.when(there & done.isNotNull(), F.struct(F.lit(side).alias("key"), done.alias("value")))

    return F.map_from_entries(F.array_compact(F.array(entry("statement", F.lit(True)), entry("negation", plain(has_negation)))))


def refuse(violations: DataFrame, what: str) -> None:
    first = violations.limit(3).collect()
    if first:
        raise ValueError(f"{what}: refused ({'; '.join(str(r.asDict()) for r in first)})")
