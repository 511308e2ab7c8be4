"""Reads over roll-ups: parts and classes, calibration, losses, repair loops, budgets, series. One aggregation each wherever
rows belong to several parts: they are exploded over the names of their parts, never scanned once a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import band_edges, expected_reward, reward


def over_parts(rows: DataFrame, parts: dict[str, Column | None]) -> DataFrame:
    """Each row once for every part (name: condition, None: all) that it belongs to."""
    names = F.array_compact(F.array(*[F.lit(n) if c is None else F.when(c, F.lit(n)) for n, c in parts.items()]))
    return rows.withColumn("part", F.explode(names))


def share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def figures_by_part(results: DataFrame, parts: dict[str, Column | None]) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    return over_parts(results, parts).groupBy("part").agg(F.count(F.lit(1)).alias("problems"), F.sum(k).alias("successes"), F.sum(n).alias("attempts"), (F.sum(k) / F.sum(n)).alias("per_attempt"), F.count_if(k > 0).alias("solved"))


def solved_counts(pairs: DataFrame, parts: dict[str, Column | None], before: str = "k_before", after: str = "k_after") -> DataFrame:
    """Solved by either side, gained and lost, by part."""
    b, a = F.col(before) > 0, F.col(after) > 0
    return over_parts(pairs, parts).groupBy("part").agg(F.count_if(b).alias("solved_before"), F.count_if(a).alias("solved_after"), F.count_if(a & b).alias("by_both"), F.count_if(a & ~b).alias("gained"), F.count_if(b & ~a).alias("lost"))


def picks(rows: DataFrame, how: str, target: float, floor: float) -> DataFrame:
    """The picks table by how they were chosen, and of all: fixed classes by k, and the band's moving ones."""
    k, p = F.col("k"), F.col("k") / F.col("n")
    low, high = band_edges(target, floor)
    both = over_parts(rows, {"all": None}).unionByName(rows.withColumn("part", F.col(how)))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("picks"), share(F.col("known_false")).alias("share_known_false"), F.avg(p).alias("mean_pass_rate"), share(k == 0).alias("share_at_none"), share((p > 0) & (p < low)).alias("share_below"),
        share((p >= low) & (p <= high)).alias("share_in_band"), share(p > high).alias("share_above"), share(k.between(1, 3)).alias("share_1_to_3"), share(k >= 4).alias("share_4_or_more"), F.avg(reward(p, target)).alias("mean_reward"), F.avg("predicted").alias("mean_predicted"),
    )


def first_and_last(rounds: DataFrame, by: str, figures: list[str]) -> DataFrame:
    """One row: each figure at the first and the last round."""
    return rounds.agg(*[f(c, by).alias(f"{c}_{name}") for c in figures for name, f in (("first", F.min_by), ("last", F.max_by))])


EDGES = (0.0, 0.05, 0.13, 0.25, 0.41, 0.6, 0.8, 1.0)


def calibration_bins(rows: DataFrame, predicted: str, edges=EDGES) -> DataFrame:
    """Observed rates by bins [low, high) of the predicted one, the last bin closed; empty bins are left out."""
    p = F.col(predicted)
    low = F.lit(None).cast("double")
    for e in edges[:-1]:
        low = F.when(p >= e, F.lit(e)).otherwise(low)
    inside = rows.where((p >= edges[0]) & (p <= edges[-1])).withColumn("low", low)
    return inside.groupBy("low").agg(F.count(F.lit(1)).alias("problems"), F.avg(p).alias("mean_predicted"), (F.sum("k") / F.sum("n")).alias("observed"))


def deviance(rate: Column, least: float = 1e-6) -> Column:
    """Binomial deviance an attempt of rows with k and n, rates clipped."""
    r = F.greatest(F.lit(least), F.least(F.lit(1 - least), rate))
    return -2 * F.sum(F.col("k") * F.log(r) + (F.col("n") - F.col("k")) * F.log(1 - r)) / F.sum("n")


def calibration(rows: DataFrame, key: str, predicted: str, target: float, n: int) -> DataFrame:
    """One row: deviance against that of one rate for all, and what the best tenth by expected reward earned."""
    sums = rows.agg(F.sum("k").alias("ks"), F.sum("n").alias("ns"), F.count(F.lit(1)).alias("all_rows"))
    scored = rows.withColumn("expected", expected_reward(F.col(predicted), n, target)).withColumn("earned", reward(F.col("k") / F.col("n"), target))
    whole = scored.crossJoin(F.broadcast(sums)).agg(F.first("all_rows").alias("problems"), deviance(F.col(predicted)).alias("deviance"), deviance(F.col("ks") / F.col("ns")).alias("deviance_of_the_mean"), F.avg("earned").alias("mean_reward"))  # one row is broadcast
    tenth = max(1, rows.count() // 10)
    best = scored.orderBy(F.desc("expected"), key).limit(tenth).agg(F.avg("earned").alias("mean_reward_of_the_best_tenth"))
    return whole.crossJoin(best)  # one row and one row


def never_proved(rows: DataFrame, group: str) -> DataFrame:
    """The census of what was never proved: built, compiling, exact and disproved, each of those before it."""
    steps = ["built", "compiles", "exact", "disproved"]
    held = [F.col(s) for s in steps]
    chained = [held[0], held[0] & held[1], held[0] & held[1] & held[2], held[0] & held[1] & held[2] & held[3]]
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("never_proved"), *[F.count_if(c).alias(s) for s, c in zip(steps, chained, strict=True)])
    return found.withColumn("share_disproved", F.col("disproved") / F.nullif("exact", F.lit(0)))


def loss_parts(rows: DataFrame, group: str, tokens: str = "tokens", losses: str = "losses") -> DataFrame:
    """losses: a row's nats a token: first, body, newline, fence. Mean loss, each part's contribution, nats a proof and a body token."""
    xs, t = F.col(losses), F.col(tokens)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    body = total(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 3, F.lit(0))))
    parts = {"first": F.get(xs, 0), "body": body, "newline": F.get(xs, F.size(xs) - 2), "fence": F.get(xs, F.size(xs) - 1)}
    return rows.groupBy(group).agg(F.avg(total(xs) / t).alias("mean_loss"), *[F.avg(c / t).alias(f"{n}_share") for n, c in parts.items()], F.avg(total(xs)).alias("nats_a_proof"), (F.sum(body) / F.nullif(F.sum(F.greatest(t - 3, F.lit(0))), F.lit(0))).alias("body_nats_a_token"))


def line_statistics(rows: DataFrame, group: str, lines: str, long: int = 8) -> DataFrame:
    c = F.col(lines)
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("proofs"), F.median(c).alias("median"), F.avg(c).alias("mean"), share(c >= long).alias("share_long"), F.max(c).alias("longest"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The element at place n div 2 (from 0) of each group's sorted values."""
    w = Window.partitionBy(group)
    at = rows.withColumn("at_", F.row_number().over(w.orderBy(value))).withColumn("n_", F.count(F.lit(1)).over(w))
    return at.where(F.col("at_") == F.floor(F.col("n_") / 2) + 1).select(group, F.col(value).alias("upper_median"))


def doses(rows: DataFrame, pos: str, checkpoints: list[int], by: str, tokens: str) -> DataFrame:
    """Rows and tokens by kind of each prefix of an order; the prefixes overlap."""
    return over_parts(rows, {str(c): F.col(pos) < c for c in checkpoints}).groupBy(F.col("part").cast("int").alias("rows_seen"), by).agg(F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("tokens"))


# Repair: steps (arm, problem, episode, loop, verified, ...)
def episodes(steps: DataFrame) -> DataFrame:
    """arm, problem, episode with the loop that resolved it (null: none)."""
    return steps.groupBy("arm", "problem", "episode").agg(F.min(F.when(F.col("verified"), F.col("loop"))).alias("resolved_at"), F.max("loop").alias("loops"))


def by_arm(steps: DataFrame, arms: list[str]) -> DataFrame:
    """One row a problem: episodes and resolved ones of every arm."""
    return episodes(steps).groupBy("problem").pivot("arm", arms).agg(F.count(F.lit(1)).alias("episodes"), F.count("resolved_at").alias("resolved")).na.fill(0)


def resolved_within(steps: DataFrame, loops: int) -> DataFrame:
    """arm, k: the mean over problems of the share of their episodes resolved within k loops; totals beside."""
    each = episodes(steps).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(loops)))).withColumn("won", F.coalesce(F.col("resolved_at") <= F.col("k"), F.lit(False)))
    problems = each.groupBy("arm", "k", "problem").agg(share(F.col("won")).alias("rate"), F.count_if("won").alias("won"))
    return problems.groupBy("arm", "k").agg(F.avg("rate").alias("mean_rate"), F.sum("won").alias("resolved"))


def leads(steps: DataFrame, one: str, other: str, loops: int) -> DataFrame:
    """k, resolved by each arm, the lead, and problems that one arm alone has resolved so far."""
    each = episodes(steps).where(F.col("arm").isin(one, other)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(loops))))
    won = lambda arm: F.count_if((F.col("arm") == arm) & (F.col("resolved_at") <= F.col("k")))
    problems = each.groupBy("k", "problem").agg(won(one).alias("a"), won(other).alias("b"))
    return problems.groupBy("k").agg(F.sum("a").alias("one"), F.sum("b").alias("other"), (F.sum("a") - F.sum("b")).alias("lead"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_one"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("only_other"))


def next_after_failure(steps: DataFrame) -> DataFrame:
    """By arm, of the episodes whose first loop failed and that went on: how many the second resolved; by how it was prompted."""
    w = Window.partitionBy("arm", "problem", "episode")
    first = F.max(F.when((F.col("loop") == 1) & F.col("verified"), 1).otherwise(0)).over(w)
    second = steps.withColumn("won_first", first).where((F.col("loop") == 2) & (F.col("won_first") == 0))
    return second.groupBy("arm", "how").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("verified").alias("verified"), share(F.col("verified")).alias("share"))


def by_position(steps: DataFrame) -> DataFrame:
    return steps.groupBy("arm", "loop").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("verified").alias("verified"), F.count_if(F.col("how") == "resume").alias("with_a_state"))


def by_way(steps: DataFrame) -> DataFrame:
    """Resolved episodes by the way of the step that resolved them, the first of equal loops by way."""
    won = steps.where("verified").groupBy("arm", "problem", "episode").agg(F.min(F.struct("loop", "how")).alias("f"))
    return won.groupBy("arm", F.col("f.how").alias("way")).agg(F.count(F.lit(1)).alias("episodes"))


def budgets(steps: DataFrame, of: str, against: str, more: float = 0.10) -> DataFrame:
    """arm, loop, tokens and checks through it, the ratio to the other arm's tokens there, and whether it is the largest loop
    within 1 + more of them at their end."""
    used = steps.groupBy("arm", "loop").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("arm").orderBy("loop").rowsBetween(Window.unboundedPreceding, 0)
    through = used.select("arm", "loop", F.sum("used").over(run).alias("tokens"), F.sum("n").over(run).alias("checks"))
    other = through.where(F.col("arm") == against).select("loop", F.col("tokens").alias("other_tokens"))
    end = through.where(F.col("arm") == against).agg(F.max("tokens").alias("end_tokens"))
    rows = through.join(other, "loop", "left").crossJoin(F.broadcast(end))  # one row is broadcast
    within = F.max(F.when((F.col("arm") == of) & (F.col("tokens") <= F.col("end_tokens") * (1 + more)), F.col("loop"))).over(Window.partitionBy("arm"))
    return rows.select("arm", "loop", "tokens", "checks", (F.col("tokens") / F.col("other_tokens")).alias("ratio"), (F.col("loop") == within).alias("largest_within"))


def cut_diagnostics(steps: DataFrame) -> DataFrame:
    """By arm: the share of later loops with a state, and how the kept part moves from one loop to the next."""
    w = Window.partitionBy("arm", "problem", "episode").orderBy("loop", "kept")
    moved = steps.withColumn("before", F.lag("kept").over(w))
    later = F.col("loop") > 1
    return moved.groupBy("arm").agg(F.count_if(later).alias("later"), F.avg(F.when(later, F.when(F.col("how") == "resume", 1.0).otherwise(0.0))).alias("state_share"), F.count_if(F.col("kept") > F.col("before")).alias("forward"), F.count_if(F.col("kept") == F.col("before")).alias("same"), F.count_if(F.col("kept") < F.col("before")).alias("back"))


def nested_sums(rows: DataFrame, group: str, children: dict[str, str]) -> DataFrame:
    """Sums over each child array by itself (never over two exploded together): name -> array of numbers."""
    one = lambda a: F.aggregate(F.coalesce(F.col(a), F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v)
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.size(F.coalesce(F.col(a), F.array().cast("array<double>")))).alias(f"{n}_count") for n, a in children.items()], *[F.sum(one(a)).alias(f"{n}_sum") for n, a in children.items()])


# Order
def longest_other(proofs: DataFrame, key: str, text: str, canonical: str, tokens: str, order: list[str]) -> DataFrame:
    """The longest proof of each problem whose stripped text differs from the canonical one's."""
    other = proofs.where(F.trim(text) != F.trim(canonical))
    return other.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(tokens), *order))).where("nth = 1").drop("nth")


def in_source_order(certificates: DataFrame, key: str, source: str, text: str, sources: list[str], each: int) -> DataFrame:
    """Certificates numbered in the order of sources, in a source from the shortest on, at most ``each`` of one."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source))
    own = Window.partitionBy(key, source).orderBy(F.length(text), text)
    kept = certificates.dropDuplicates([key, source, text]).withColumn("own_", F.row_number().over(own)).where(F.col("own_") <= each)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(rank, F.length(text), text))).drop("own_")


def overfitted(readings: DataFrame, run: str, step: str, held: str, train: str, last: int = 4) -> DataFrame:
    """readings with whether, by the losses, a run overfits there: the held-out loss lies above its lowest so far by more than the spread
    of its last readings, while the training loss lies below what it was at that lowest."""
    so_far = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    late = Window.partitionBy(run).orderBy(step).rowsBetween(1 - last, 0)
    lowest = F.min(F.struct(F.col(held).alias("h"), F.col(step).alias("s"), F.col(train).alias("t"))).over(so_far)
    rows = readings.withColumn("low_", lowest).withColumn("spread", F.max(held).over(late) - F.min(held).over(late))
    above = F.col(held) - F.col("low_.h")
    return rows.withColumn("above", above).withColumn("lowest_at", F.col("low_.s")).withColumn("by_loss", (above > F.col("spread")) & (F.col(train) < F.col("low_.t"))).drop("low_")


def chains(rows: DataFrame, key: str, before: str, after: str, tactic: str, end: str = "no goals", most: int = 64) -> DataFrame:
    """key, tactics: of each problem whose rows are one chain from a single root to the end, its tactics in order; else null.

    Every row points on by its state; the walk follows all problems at once, one join a step. A problem is given up where a step
    branches, or after as many steps as it has rows; longer chains than ``most`` are refused."""
    states = rows.select(key, F.col(before).alias("b_"), F.col(after).alias("a_"), F.col(tactic).alias("t_"))
    sizes = states.groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    if sizes.where(F.col("n_") > most).limit(1).count():
        raise ValueError(f"a chain of more than {most} rows")
    single = states.groupBy(key, "b_").agg(F.count(F.lit(1)).alias("c_"), F.first("a_").alias("a_"), F.first("t_").alias("t_"))
    roots = states.join(states.select(key, F.col("a_").alias("b_")).distinct(), [key, "b_"], "left_anti")
    one = roots.groupBy(key).agg(F.count(F.lit(1)).alias("roots"), F.first("b_").alias("at"))
    walk = sizes.join(one.where("roots = 1"), key).select(key, "n_", "at", F.array().cast("array<string>").alias("tactics"))
    done, longest = None, sizes.agg(F.max("n_")).first()[0] or 0
    for _ in range(longest):
        walk = walk.join(single.withColumnRenamed("b_", "at"), [key, "at"]).where("c_ = 1").select(key, "n_", F.col("a_").alias("at"), F.concat("tactics", F.array("t_")).alias("tactics")).checkpoint()
        ended = walk.where((F.col("at") == end) & (F.size("tactics") == F.col("n_"))).select(key, "tactics")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.where((F.col("at") != end) & (F.size("tactics") < F.col("n_")))
    return sizes.select(key).join(done, key, "left") if done is not None else sizes.select(key, F.lit(None).cast("array<string>").alias("tactics"))


def series(rows: DataFrame, group: str, x: str, ys: list[str]) -> DataFrame:
    """Arrays for a plot: x and each y in the order of x."""
    found = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(x, *ys))).alias("s_"))
    return found.select(group, *[F.col(f"s_.{c}").alias(c) for c in (x, *ys)])


def part_of_pass(pos: Column, n: Column, parts: int = 20) -> Column:
    """The part, from 0, of a pass over n rows that the row at pos (from 0) falls in, parts being cut at n * i div parts."""
    return (F.ceil((pos + 1) * parts / n) - 1).cast("int")


def warm_rate(step: Column, warmup: Column, total: Column, decay: bool) -> Column:
    """The factor of the learning rate at a step from 1: up to 1 over the warm-up, then level or down a line that would be 0 one step on."""
    up = F.least(F.lit(1.0), step / warmup)
    down = F.greatest(F.lit(0.0), (total + 1 - step) / F.nullif(total + 1 - warmup, F.lit(0)))
    return F.when((step <= warmup) | (total <= warmup), up).otherwise(down) if decay else up


def smallest_decisive(changed: Column, level: float = 0.05) -> Column:
    """The least number gained of so many changed at which the sign test is below the level; null if no split is."""
    from ..functions.rates import sign_probability

    tried = F.transform(F.sequence(F.floor(changed / 2).cast("int"), changed.cast("int")), lambda g: F.struct(g.alias("g"), sign_probability(g.cast("long"), changed - g).alias("p")))
    return F.get(F.filter(F.when(changed > 0, tried), lambda x: x["p"] < level), 0)["g"]
