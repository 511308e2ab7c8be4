"""Paired estimators over seeds, versions and repairs, and reads that refuse to pool what was not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals


def per_attempt_change(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Successes per attempt paired by problem (the mean of differences), with the totals of both sides per 1,000."""
    b, a = F.col("k_before") / F.col("n_before"), F.col("k_after") / F.col("n_after")
    total = lambda k, n: 1000 * F.sum(k) / F.sum(n)
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("problems"), F.avg(a - b).alias("change"), total("k_before", "n_before").alias("per_1000_before"), total("k_after", "n_after").alias("per_1000_after"), F.sum("k_after").alias("successes"), F.sum("n_after").alias("attempts"))


def over_seeds(rows: DataFrame, problem: str, seed: str, value: Column, name: str) -> DataFrame:
    """A problem's mean over the seeds; nothing for a problem that some seed lacks."""
    all_seeds = rows.select(seed).distinct().agg(F.count(F.lit(1)).alias("all_"))
    own = rows.groupBy(problem).agg(F.avg(value).alias(name), F.count_distinct(seed).alias("seeds"))
    return own.crossJoin(F.broadcast(all_seeds)).where("seeds = all_").drop("all_")  # one row is broadcast


def per_seed_difference(rows: DataFrame, seed: str, arm: str, two: list[str], third: str) -> DataFrame:
    """seed, difference: the mean of two arms' successes per attempt minus the third's; null where an arm is missing."""
    rate = lambda a: F.sum(F.when(F.col(arm) == a, F.col("k"))) / F.sum(F.when(F.col(arm) == a, F.col("n")))
    return rows.groupBy(seed).agg(((rate(two[0]) + rate(two[1])) / 2 - rate(third)).alias("difference"))


def t_interval(values: DataFrame, value: str) -> DataFrame:
    """mean, sd, low, high over a few values; refused for a number of them whose critical value is not given."""
    from ..functions.rates import t_critical

    half = F.lit(t_critical(values.count())) * F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))
    return values.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def reach(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """One row: problems resolved at least once by each side, gained and lost. The sides hold the same problems (refused
    otherwise) but may have different numbers of episodes."""
    from .checks import refuse
    from .joins import pair_refusals

    refuse(pair_refusals(before.withColumn("n", F.lit(1)), after.withColumn("n", F.lit(1)), key), "the sides do not hold the same problems")
    both = after.select(key, (F.col("k") > 0).alias("a")).join(before.select(key, (F.col("k") > 0).alias("b")), key)
    return both.agg(F.count(F.lit(1)).alias("problems"), F.count_if("a").alias("resolved_after"), F.count_if("b").alias("resolved_before"), F.count_if(F.col("a") & F.col("b")).alias("by_both"), F.count_if(F.col("a") & ~F.col("b")).alias("gained"), F.count_if(~F.col("a") & F.col("b")).alias("lost"))


def pooled(rows: DataFrame, seed: str, read: str, key: str) -> DataFrame:
    """k and n of every problem over all seeds; no row at all if some seed was not read."""
    unread = rows.where(~F.coalesce(F.col(read), F.lit(False))).select(F.lit(1).alias("u_")).limit(1)
    sums = rows.groupBy(key).agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count_distinct(seed).alias("seeds"))
    return sums.join(unread, F.lit(True), "left_anti")  # at most one row


def noise_band(low: Column, high: Column) -> Column:
    """The size of what two trainings on the same data differ by: the end of an interval that lies farthest from zero."""
    return F.greatest(F.abs(low), F.abs(high))


def control_episodes(loop_episodes: int, problems: int) -> int:
    """Episodes a problem that spend what the loop spent; what does not divide is not spent."""
    if loop_episodes < 0 or problems < 0:
        raise ValueError("episodes and problems cannot be negative")
    return loop_episodes // problems if problems else 0


FIGURES = ("earlier", "later", "share", "difference")
COUNTS = ["drawn", "earlier", "later"]
#: Places drawn in one task, and the most tasks of a section.
PART, PARTS = 1 << 28, 64


def packed_section(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A section in one row: its statements' kinds in their order, a byte or a few each, what a kind counts (the three numbers
    and whether the last two are above 0) and the totals."""
    known, kinds = {}, []
    for b in batches:
        section = b.column("section").slice(0, 1)
        rows, of = np.unique(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COUNTS]), axis=0, return_inverse=True)
        codes = [known.setdefault(tuple(r), len(known)) for r in rows.tolist()]
        kinds.append(np.array(codes, np.min_scalar_type(len(known)))[of.ravel()])
    kinds, values = np.concatenate(kinds), np.array(list(known))
    values = np.column_stack([values, values[:, 1:] > 0])
    totals = np.bincount(kinds, minlength=len(values)) @ values
    packed = {"n": [len(kinds)], "size": [kinds.itemsize], "kinds": [kinds.tobytes()], "values": [values.tobytes()], "totals": [totals.tolist()]}
    yield pa.RecordBatch.from_arrays([section, *map(pa.array, packed.values())], names=["section", *packed])


def version_intervals(statements: DataFrame, section: str, key: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """section, kind (attempt or statement), figure, value, low, high from statements (drawn, earlier, later): rates of two
    versions, the later as a share of the earlier, and their difference, each with an interval from resampling statements
    with numpy's draws. A ratio to 0 is undefined: null as a value, left out of an interval.

    A section's resamples are dealt over tasks, each with the packed section. Where a task begins in numpy's stream depends on
    the numbers that numpy passes over before, so these are counted first, by parts of the stream.
    """

    def step(n: int, parts: int) -> int:
        return 2 * -(-n * resamples // (2 * parts))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = zip(*(b.column(c).to_pylist() for c in ("n", "parts", "part")), strict=True)
            found = [intervals.numbers_kept(n, part * step(n, parts), (part + 1) * step(n, parts), seed) if parts > 1 else None for n, parts, part in asked]
            yield b.append_column("kept", pa.array(found, pa.int64()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, parts, part, size, before = (b.column(c)[i].as_py() for c in ("n", "parts", "part", "size", "kept"))
                kinds, values = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("kinds", f"u{size}"), ("values", float)))
                first, last = (resamples * p // parts for p in (part, part + 1))
                draw = intervals.stream_from(n, n * first, np.cumsum([0, *before[:-1]]), step(n, parts), seed)
                again = intervals.resampled_sums(kinds, values.reshape(-1, 5), last - first, draw)
                yield b.slice(i, 1).select(["section", "n", "totals", "part"]).append_column("sums", pa.array([again.tobytes()]))

    def figures(batch: pd.DataFrame) -> pd.DataFrame:
        b = batch.sort_values("part")
        n, (drawn, early, late, solved, solved_late) = float(b["n"].iloc[0]), map(float, b["totals"].iloc[0])
        s = dict(zip(("d", "e", "l", "es", "ls"), np.concatenate([np.frombuffer(x).reshape(-1, 5) for x in b["sums"]]).T, strict=True))
        rows = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for kind, base, e, l, se, sl in (("attempt", drawn, early, late, "e", "l"), ("statement", n, solved, solved_late, "es", "ls")):
                under = s["d"] if kind == "attempt" else n
                values = (e / base, l / base, l / e if e else None, (l - e) / base)
                for name, v, again in zip(FIGURES, values, (s[se] / under, s[sl] / under, s[sl] / s[se], (s[sl] - s[se]) / under), strict=True):
                    again = again[np.isfinite(again)]
                    low, high = np.quantile(again, [0.025, 0.975]) if len(again) else (None, None)
                    rows.append((b["section"].iloc[0], kind, name, v, low, high))
        return pd.DataFrame(rows, columns=["section", "kind", "figure", "value", "low", "high"]).astype({"value": float, "low": float, "high": float})

    tasks = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as a few small rows are much work
    dealt = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = statements.select(F.col(section).cast("string").alias("section"), F.col(key).alias("key"), *COUNTS)
    ordered = asked.repartition("section").sortWithinPartitions("section", F.asc_nulls_last("key"), *COUNTS)
    row = "section string, n bigint, size bigint, kinds binary, values binary, totals array<double>"
    packed = ordered.groupBy("section").applyInArrow(packed_section, row)
    parts = F.when(F.col("n") < 2**32, F.least(F.lit(PARTS), F.lit(resamples), F.ceil(F.col("n") * resamples / PART))).otherwise(1)  # above, numpy's stream is another
    once = {c: F.when(F.col("part") == 0, F.col(c)) for c in ("kinds", "values", "totals")}
    counted = dealt(packed.withColumn("parts", parts.cast("int"))).withColumns(once).repartition(tasks, "section", "part").mapInArrow(kept, f"{row}, parts int, part int, kept bigint")
    whole = counted.groupBy("section", "n", "size", "parts").agg(*(F.first(c, ignorenulls=True).alias(c) for c in once), F.sort_array(F.collect_list(F.struct("part", "kept"))).kept.alias("kept"))
    drawn = dealt(whole).repartition(tasks, "section", "part").mapInArrow(sums, "section string, n bigint, totals array<double>, part int, sums binary")
    return drawn.groupBy("section").applyInPandas(figures, "section string, kind string, figure string, value double, low double, high double")


def fact_features(categories: dict[str, list[str]], lengths: list[str], round_column: str) -> tuple[Column, list[str]]:
    """An array of features and their names: one-hots, logarithms of lengths, and the round over 50 (0 where unknown)."""
    hot = [(F.coalesce(F.col(c) == v, F.lit(False)).cast("double"), f"{c}={v}") for c, vs in categories.items() for v in vs]
    logs = [(F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), f"log1p({c})") for c in lengths]
    parts = [*hot, *logs, (F.coalesce(F.col(round_column).cast("double"), F.lit(0.0)) / 50, f"{round_column}/50")]
    return F.array(*[c for c, _ in parts]), [n for _, n in parts]


def refit_observations(base: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """Base-map observations with those of the finished batches; a problem observed twice is refused."""
    from .checks import refuse

    rows = base.unionByName(batches)
    refuse(rows.groupBy(key).count().where("count > 1"), "a problem is observed twice")
    return rows
