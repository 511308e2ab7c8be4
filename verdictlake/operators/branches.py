"""The staged decision rules as tables: gates first, then the frame, then what follows.

A rule is a list of (condition, outcome) over named figures; the first condition that holds decides, a condition that is
null does not hold, and the last outcome needs none. Conditions are plain SQL, so a rule is one CASE expression in any
engine and judges all rows of figures in one projection. Intervals are ``mean, low, high`` (null: nothing was measured);
one that ends at zero holds zero. Shares are compared as products of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of outcomes that all families use, and the level of the sign test.
INCONCLUSIVE, NOT_READ, NOT_SHOWN, NARROWER, SHORTER = "INCONCLUSIVE", "NOT READ", "NOT SHOWN", "NARROWER", "SHORTER"
LEVEL = "0.05"

#: More gained than lost (or lost than gained) with the sign test under the level. A null p is no change at all.
BROADER_IF = f"gained > lost AND coalesce(p_value < {LEVEL}, false)"
NARROWER_IF = f"lost > gained AND coalesce(p_value < {LEVEL}, false)"


def three_ways(up: str, holds: str, down: str, failed: str = "failed > 0", mean: str = "mean", low: str = "low", high: str = "high") -> list[tuple[str, str]]:
    """The frame: a failed check says nothing else; nothing measured; clear above; clear below; else zero is held."""
    return [(failed, INCONCLUSIVE), (f"{mean} IS NULL", NOT_READ), (f"{low} > 0", up), (f"{high} < 0", down), ("true", holds)]


# The outcomes' names in the rules' own words; gates and lines by the specification of each stage.
RULES: dict[str, list[tuple[str, str]]] = {
    # The resumed attempt verifies at least half as often as the blind one above the band; a state came back for half of the failed.
    "repair": [
        ("NOT coalesce(blind_share > 0 AND resume_share >= 0.5 * blind_share, false)", INCONCLUSIVE), ("NOT coalesce(failed_firsts > 0 AND 2 * states >= failed_firsts, false)", INCONCLUSIVE), ("mean IS NULL", INCONCLUSIVE),
        ("low > 0", "REPAIR IS A STRONGER SEARCH STEP"), ("high < 0", "RESUMING IS WORSE THAN RESAMPLING FOR THIS MODEL UNTRAINED"), ("true", "NOT SHOWN AT THIS SIZE"),
    ],
    # A state for half of the repair steps; at position 2 the step verifies at least half as often as the blind attempt.
    "alternate": [
        ("NOT coalesce(steps > 0 AND 2 * states >= steps, false)", INCONCLUSIVE), ("NOT coalesce(blind_verified > 0 AND 2 * step_verified * blind_attempts >= blind_verified * step_attempts, false)", INCONCLUSIVE), ("mean IS NULL", INCONCLUSIVE),
        ("low > 0", "THIS IS THE EPISODE A ROUND SHOULD USE"), ("high < 0", "L3A'S SINGLE STEP DID NOT REPEAT ON FRESH ATTEMPTS"), ("true", "NOT SHOWN AT THIS SIZE"),
    ],
    # A pool in 30 % of the hard episodes, a state in half of the continuing generations, the pool standing in 95 % of its checks.
    "accumulate": [
        ("NOT coalesce(hard > 0 AND 10 * pools >= 3 * hard, false)", INCONCLUSIVE), ("NOT coalesce(steps > 0 AND 2 * states >= steps, false)", INCONCLUSIVE), ("NOT coalesce(pool_checks > 0 AND 100 * standing >= 95 * pool_checks, false)", INCONCLUSIVE), ("mean IS NULL", INCONCLUSIVE),
        ("low > 0", "THE ACCUMULATING EPISODE IS THE SOLVER'S EPISODE FROM HERE"), ("high < 0", "THE ACCUMULATING EPISODE RESOLVES FEWER EPISODES THAN BLIND ATTEMPTS"),
        (BROADER_IF, "THE EPISODE REACHES PROBLEMS WITHOUT RESOLVING MORE EPISODES"), ("true", "NOT SHOWN AT THIS SIZE"),
    ],
    "ceiling": [
        ("failed > 0", INCONCLUSIVE), ("mean IS NULL", NOT_READ), ("low > 0 AND mean >= 2 * own_gain", "THE MODEL CAN LEARN LONGER PROOFS FROM EXAMPLES"), ("low > 0", "LONGER PROOFS HELP ABOUT AS THE LOOP'S OWN DO"),
        ("high < 0", "FEWER SUCCESSES THAN THE BASE"), ("mean > own_gain", "TWO MORE SEEDS BEFORE ANYTHING IS CONCLUDED"), ("true", "NOT SHOWN TO BE LEARNABLE AT THIS SIZE"),
    ],
    # band: the end of the noise floor's interval that lies farthest from zero.
    "assembled_step_1": [
        ("failed > 0", INCONCLUSIVE), ("mean IS NULL", NOT_READ), ("band IS NULL", NOT_READ), ("(low > 0 OR high < 0) AND abs(mean) <= band", "WITHIN WHAT TWO TRAININGS ON THE SAME DATA DIFFER BY"),
        ("low > 0", "ASSEMBLED PROOFS TEACH"), ("high < 0", "THE ASSEMBLED PROOFS COST ONE-SHOT ATTEMPTS"), ("NOT seen", "UNDETECTABLE AT THIS SIZE"), ("true", "NOT SHOWN AT H0'S SIZE"),
    ],
    "assembled_step_2": [
        ("failed > 0", INCONCLUSIVE), ("mean IS NULL", NOT_READ), ("low > 0", "ASSEMBLED PROOFS TEACH"), ("high < 0", "THE ASSEMBLED PROOFS COST ONE-SHOT ATTEMPTS"),
        ("gain_of_a_proof * proofs >= (high - low) / 2", NOT_SHOWN), ("true", "UNDETECTABLE AT THIS SIZE"),
    ],
    "on_pretraining": three_ways("THE LOOP ADDS ON TOP OF PRETRAINING", "NOT SHOWN ON TOP OF PRETRAINING", "THE ROUNDS COST THE PRETRAINED MODEL"),
    "adapter_size": three_ways("THE ADAPTER'S SIZE CAPPED THE PRETRAINED MODEL", "NOT THE CAP AT THIS SIZE", "THE LARGER ADAPTER IS WORSE AFTER ONE PASS AT THIS LEARNING RATE"),
    "old_rule": [
        ("failed > 0", INCONCLUSIVE), ("coalesce(problems, 0) = 0 OR mean IS NULL", NOT_READ), (NARROWER_IF, "THE OLD RULE NARROWS AT RANK 64 TOO"), ("low > 0", "NO NARROWING SHOWN AT RANK 64"), ("true", "NOT READ AS EITHER"),
    ],
    # failed: of either model; alone_low: the rehearsal alone against the start.
    "question_1": [
        ("failed > 0", INCONCLUSIVE), ("mean IS NULL", NOT_READ), ("low > 0", "THE LOOP'S ROWS ADD BESIDE THE REHEARSAL"), ("alone_low > 0", "THE GAIN IS A SECOND PASS OVER PUBLISHED PROOFS"), ("true", "NOT SEPARATED AT THIS SIZE"),
    ],
    # adds, not_narrower, holds: three reads, each true, false or null (not made).
    "question_2": [
        ("failed > 0", INCONCLUSIVE), ("NOT adds AND NOT not_narrower AND NOT holds", "IT FAILS: ADDS AND NOT NARROWER AND HOLDS THE LONG PROOFS"), ("NOT adds AND NOT not_narrower", "IT FAILS: ADDS AND NOT NARROWER"),
        ("NOT adds AND NOT holds", "IT FAILS: ADDS AND HOLDS THE LONG PROOFS"), ("NOT not_narrower AND NOT holds", "IT FAILS: NOT NARROWER AND HOLDS THE LONG PROOFS"), ("NOT adds", "IT FAILS: ADDS"), ("NOT not_narrower", "IT FAILS: NOT NARROWER"),
        ("NOT holds", "IT FAILS: HOLDS THE LONG PROOFS"), ("adds AND not_narrower AND holds", "IT ADDS, KEEPS THE BREADTH AND HOLDS THE LONG PROOFS"), ("true", NOT_READ),
    ],
    # question_1: its outcome; one and other: all three reads of the two rules; margins: gained minus lost of each.
    "arms_rule": [
        ("question_1 = 'THE GAIN IS A SECOND PASS OVER PUBLISHED PROOFS'", "NO ARM WITH REHEARSAL ROWS"), ("question_1 IN ('INCONCLUSIVE', 'NOT READ')", "NO RULE IS NAMED"), ("one IS NULL OR other IS NULL", "NO RULE IS NAMED"),
        ("one AND one_margin >= other_margin", "reward_rehearse"), ("other", "rehearse"), ("true", "NO RULE IS NAMED"),
    ],
    "matched_rows": [("failed > 0", INCONCLUSIVE), ("other_failed > 0", NOT_READ), *three_ways("THE ROUNDS' HARD ROWS ADD BESIDE THE SAME PUBLISHED ROWS", "NOT SEPARATED AT THIS SIZE", "THEY COST")[1:]],
    "second_pass_dose": [("NOT measured", NOT_READ), ("failed > 0", INCONCLUSIVE), ("other_failed > 0", NOT_READ), *three_ways("MORE OF THE SECOND PASS HELPS", "THE FIRST SEVENTH GAVE WHAT A SECOND PASS GIVES", "MORE COSTS")[1:]],
    "separation": [("failed > 0", NOT_READ), ("mean IS NULL", NOT_READ), ("low > 0", "THE ROUNDS ADD BESIDE THE REHEARSAL"), ("alone_low > 0", "THE GAIN IS NOT SHOWN TO BE THE ROUNDS'"), ("true", "NOT SEPARATED AT THIS SIZE")],
    "deep_primary": three_ways("DEEP SOLVES ADD WHAT THE SAME NUMBER OF PUBLISHED PROOFS DO NOT", "NOT SEPARATED AT THIS SIZE", "THEY COST"),
    "deep_mechanism": [("failed > 0", INCONCLUSIVE), ("mean IS NULL", NOT_READ), (f"low > 0 OR ({BROADER_IF})", "DEPTH MATTERS"), ("true", NOT_SHOWN)],
    "replication": three_ways("ABOVE ZERO", "HOLDS ZERO", "BELOW ZERO"),
    "after_depth": [
        ("main_read IN ('INCONCLUSIVE', 'NOT READ')", NOT_READ),
        ("main_read LIKE 'DEEP SOLVES ADD%' OR (mechanism = 'DEPTH MATTERS' AND main_read <> 'THEY COST')", "TWO MORE SEEDS, THEN A LOOP WHOSE ROUNDS ARE DEEP SEARCHES"),
        (f"main_read = 'THEY COST' AND ({NARROWER_IF})", "THE MODEL'S OWN PROOFS, DEEP OR NOT, ARE NOT ROWS TO TRAIN ON AT THIS SIZE"), ("true", "NOT SEPARATED: THE DEPTH IS THE THING TO RAISE BEFORE THE SEEDS"),
    ],
    "three_seeds": [("coalesce(seeds, 0) <> 3 OR mean IS NULL", NOT_READ), ("low > 0", "DEEP SOLVES ADD WHAT THE SAME NUMBER OF PUBLISHED PROOFS DO NOT"), ("high < 0", "THEY COST"), ("true", "NOT SHOWN AT THREE SEEDS")],
    # least: the least of the new seeds' own differences (of their own leads in solved problems for reach).
    "lead": [("coalesce(seeds, 0) <> 2 OR mean IS NULL", NOT_READ), ("low > 0 AND least > 0", "THE LEAD IS CONFIRMED"), ("true", "NOT CONFIRMED")],
    "lead_split": [("coalesce(lead <> 'THE LEAD IS CONFIRMED', true) OR mean IS NULL", "NO NAME"), ("low > 0", "REACH TOO"), ("true", "RELIABILITY")],
    "long_reach": [("coalesce(seeds, 0) <> 2 OR mean IS NULL", NOT_READ), ("low > 0 AND least > 0", "REACH IS CONFIRMED ON THE LONG PROBLEMS"), ("true", "NOT CONFIRMED")],
    "after_the_seeds": [
        ("'NOT READ' IN (main_read, lead, reach)", NOT_READ), ("reach = 'REACH IS CONFIRMED ON THE LONG PROBLEMS' OR main_read LIKE 'DEEP SOLVES ADD%'", "A LOOP WHOSE ROUNDS ARE DEEP SEARCHES, WITH ORDINARY SOLVES MATCHED IN LENGTH AS A CONTROL"),
        ("lead = 'THE LEAD IS CONFIRMED' AND split = 'RELIABILITY'", "RELIABILITY, AND REACH NOT SHOWN: THE DEPTH OF THE SEARCH IS THE THING TO RAISE"), ("main_read = 'THEY COST'", "STOP: THE THREE SEEDS NEED A DECISION"),
        ("true", "OTHERWISE: THE DEPTH OR THE DOSE IS THE THING TO RAISE"),
    ],
    "order_spread": [("failed > 0", INCONCLUSIVE), ("sd IS NULL OR sd_seeds IS NULL", NOT_READ), ("sd >= 0.5 * sd_seeds", "ORDER ALONE MAKES THE SPREAD"), ("true", "THE ROWS DRAWN MAKE MOST OF IT")],
    "decay_spread": [("failed > 0", INCONCLUSIVE), ("sd > 0 AND sd_decay <= 0.5 * sd", "DECAY LOWERS THE SPREAD"), ("true", NOT_SHOWN)],
    "decay_level": [("failed > 0", INCONCLUSIVE), ("high < 0", "DECAY COSTS"), ("true", "NAMED NOTHING")],
    "averaging": [("failed > 0", INCONCLUSIVE), ("models_mean - averaged <= 2 * noise", "AVERAGING GIVES AT LEAST THE MEAN OF ITS MODELS"), ("true", "AVERAGING GIVES LESS THAN THE MEAN OF ITS MODELS")],
    "after_noise": [
        ("'INCONCLUSIVE' IN (spread, level, averaging)", NOT_READ), ("spread = 'DECAY LOWERS THE SPREAD' AND level <> 'DECAY COSTS'", "EVERY LATER STAGE TRAINS WITH THE DECAY"),
        ("averaging = 'AVERAGING GIVES AT LEAST THE MEAN OF ITS MODELS'", "A LATER STAGE TRAINS EACH MODEL FOUR TIMES AND MEASURES THE AVERAGED ADAPTER"), ("true", "THE SPREAD IS THE RECIPE'S OWN AT THIS SIZE: THE CHOICE NEEDS A DECISION"),
    ],
    "seed_draws": [
        ("mean IS NULL", NOT_READ), ("low > 0", "THE MODEL'S OWN PROOFS BESIDE PUBLISHED ONES BEAT PUBLISHED ONES ALONE ON THE GOAL SET"), ("high < 0", "THEY COST"), ("(high - low) / 2 > 0.0165", "UNDETECTABLE AT THIS NUMBER OF SEEDS"), ("true", NOT_SHOWN),
    ],
    "stock_dose": [
        ("failed > 0", INCONCLUSIVE), ("coalesce(n * n0, 0) = 0", NOT_READ), ("k * n0 >= k0 * n", "THE SOLVE RATE DOES NOT FALL WITH THE DOSE: ESCALATE"), ("10000 * (k * n0 - k0 * n) < -100 * n * n0", "MORE OF ITS OWN PROOFS COSTS AT THIS SEED"), ("true", "NOT SHOWN AT ONE SEED"),
    ],
    # The interval again: of the problems that the start does not solve; solved_low: of those that it does.
    "where_it_sits": [("draws NOT LIKE '%BEAT PUBLISHED ONES ALONE%'", NOT_READ), ("low IS NULL OR solved_low IS NULL", NOT_READ), ("low > 0", "REACH TOO"), ("solved_low > 0 AND high >= 0", "RELIABILITY"), ("true", "NAMED NOTHING")],
    "after_draws": [
        ("draws IN ('INCONCLUSIVE', 'NOT READ')", NOT_READ), ("draws LIKE '%BEAT PUBLISHED ONES ALONE%'", "THE BET'S FIRST CONDITION HOLDS ON THE GOAL SET AT THIS SIZE: L6 RUNS WITH THIS RECIPE"),
        ("draws = 'THEY COST'", "STOP: THE NINE SEEDS NEED A DECISION"), ("true", "THE SIGN OF L5'S THREE SEEDS IS NOT CONFIRMED: L6 DOES NOT RUN ON IT"),
    ],
    "after_stock": [
        ("dose IN ('INCONCLUSIVE', 'NOT READ')", NOT_READ), ("dose LIKE '%ESCALATE'", "ESCALATE: THE FURTHER SEEDS OF THIS STAGE RUN, EACH AFTER L5d's OWN RUN OF THAT SEED"), ("true", "NO FURTHER SEED: THE DOSE IS NOT THE LEVER AT THIS SIZE"),
    ],
    "holds_on_the_set": three_ways("THE GAIN HOLDS ON THE HELD-ASIDE SET", "NOT SHOWN ON THE HELD-ASIDE SET", "IT DOES NOT HOLD THERE"),
    "holds_on_fresh": three_ways("THE GAIN HOLDS ON FRESH ATTEMPTS", NOT_SHOWN, "IT DOES NOT HOLD"),
    "after_measure": [
        ("on_set IN ('INCONCLUSIVE', 'NOT READ') OR on_fresh IN ('INCONCLUSIVE', 'NOT READ')", NOT_READ), ("on_set <> 'THE GAIN HOLDS ON THE HELD-ASIDE SET'", "THE NIGHT'S FIRST-SAMPLING COMPARISONS ARE SELECTION ON G UNTIL A FURTHER SEED SHOWS OTHERWISE"),
        ("on_fresh = 'THE GAIN HOLDS ON FRESH ATTEMPTS'", "THE CANDIDATE IS THE BEST MODEL MEASURED IN FULL: THE NEXT CYCLE IS PROPOSED FROM IT"), ("true", "NOT NAMED BY THE SECTION: IT HOLDS ON THE HELD-ASIDE SET AND NOT ON FRESH ATTEMPTS"),
    ],
    "cycle_primary": three_ways("THE CYCLE ADDS WHAT THE SAME NUMBER OF PUBLISHED PROOFS DOES NOT", "NOT SEPARATED AT THIS SIZE", "IT COSTS"),
    "compounding": three_ways("THE SECOND ROUND ADDS", NOT_SHOWN, "IT COSTS"),
    "hard_or_long": three_ways("HARD TO FIND MATTERS BEYOND LENGTH", "NOT SEPARATED FROM LENGTH", "LONG ORDINARY SOLVES DO BETTER"),
    "cycle_reach": [("failed > 0", INCONCLUSIVE), ("coalesce(problems, 0) = 0", NOT_READ), (BROADER_IF, "REACH SHOWN AT THIS SEED"), ("true", NOT_SHOWN)],
    "after_cycle": [
        ("main_read IN ('INCONCLUSIVE', 'NOT READ')", NOT_READ), ("mean >= 0 OR reach = 'REACH SHOWN AT THIS SEED' OR compounding = 'THE SECOND ROUND ADDS'", "TWO FURTHER SEEDS OF THE FOUR MODELS ON THE SAME TWO SEARCHES"),
        ("spread IS NULL", "THE SPREAD IS NOT GIVEN: NO KILL IS NAMED"), ("mean < -2 * spread", "THE CYCLE AT THIS SIZE DOES NOT CLEAR THE BAR"), ("true", "IN BETWEEN: STATED AS IT IS, FOR A DECISION"),
    ],
    # point: k / n - k0 / n0 in ten thousandths of n * n0, on whole numbers.
    "new_proofs": [
        ("failed > 0", INCONCLUSIVE), ("coalesce(n * n0, 0) = 0", NOT_READ), ("10000 * (k * n0 - k0 * n) >= 85 * n * n0", "THE MODEL'S OWN NEW PROOFS ADD FROM THE BEST MODEL"), ("10000 * (k * n0 - k0 * n) < -85 * n * n0", "THEY COST THERE AT THIS SEED"),
        ("true", "NOT SHOWN AT ONE SEED"),
    ],
    "whose_proofs": [
        ("failed > 0", INCONCLUSIVE), ("coalesce(n * n0, 0) = 0", NOT_READ), ("10000 * (k * n0 - k0 * n) >= 85 * n * n0", "PROOFS THE STRONGER MODEL FOUND TEACH MORE THAN THE WEAKER MODEL'S"), ("10000 * (k * n0 - k0 * n) < -85 * n * n0", "THEY TEACH LESS"),
        ("true", "NOT SHOWN AT ONE SEED"),
    ],
    "after_new_proofs": [
        ("NOT enough", "TOO FEW NEW SOLVES: NOTHING IS TRAINED, AND THE SEARCH IS THE FINDING"), ("main_read IN ('INCONCLUSIVE', 'NOT READ')", NOT_READ),
        ("main_read LIKE '%ADD FROM THE BEST MODEL'", "THE CYCLE TURNS FROM THE BEST MODEL: TWO FURTHER SEEDS OF `new_own` AND OF THE BAR BEFORE ANYTHING IS SAID OVER SEEDS"),
        ("main_read = 'NOT SHOWN AT ONE SEED'", "NOT SHOWN: SAID AS IT IS, WITH THE SEARCH'S YIELD; A THIRD ROUND IS NOT RUN ON IT"), ("true", "THEY COST: TO A DECISION WITH L5f's READ; THE FULL-SIZE CYCLE IS NOT PROPOSED ON IT"),
    ],
}

#: How a branch is said with what stands beside it: the breadth, the separation and the long proofs never move its name.
SAID_BESIDE = (
    "CASE WHEN branch = 'INCONCLUSIVE' THEN branch ELSE concat(branch, CASE WHEN narrower THEN ', NARROWER' ELSE '' END, CASE WHEN narrower AND branch = 'THE LOOP ADDS ON TOP OF PRETRAINING' THEN ': adds per attempt, on fewer problems' ELSE '' END, "
    "CASE WHEN branch = 'THE LOOP ADDS ON TOP OF PRETRAINING' THEN concat('; apart from the rehearsal: ', apart) ELSE '' END, CASE WHEN coalesce(long_high < 0, false) THEN ', SHORTER' ELSE '' END) END"
)


def case_sql(rule: str) -> str:
    """The rule as a CASE expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    *cases, (_, last) = RULES[rule]
    return "CASE " + " ".join(f"WHEN {c} THEN {quote(name)}" for c, name in cases) + f" ELSE {quote(last)} END"


def decide(rule: str) -> Column:
    """The outcome over a row that has the rule's figures as columns."""
    *cases, (_, last) = RULES[rule]
    found = F.lit(last)
    for condition, name in reversed(cases):
        found = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)).otherwise(found)
    return found


def with_branches(figures: DataFrame, rules: dict[str, str]) -> DataFrame:
    """figures with a column name: outcome of rule for each entry, in order; later rules may stand on earlier columns."""
    for name, rule in rules.items():
        figures = figures.withColumn(name, decide(rule))
    return figures


def could_have_been_seen(low: Column, high: Column, band: Column, proofs: Column, doses: list[tuple[Column, Column]]) -> Column:
    """Whether some dose's gain a row times the proofs here reaches what is resolved (half the width, or the band); null without doses."""
    resolves = F.round(F.greatest((high - low) / 2, band), 5)
    read = [F.coalesce(mean / rows * proofs >= resolves, F.lit(False)) for mean, rows in doses]
    there = F.greatest(*[c.isNotNull().cast("int") for c, _ in doses], F.lit(0)) == 1 if doses else F.lit(False)
    any_of = F.array_max(F.array(*read)) if read else F.lit(False)
    return F.when(there, any_of)


def training_gates(losses: DataFrame, run: str, loss: str, pos: str, share: float = 0.1, errors: float = 2.0) -> DataFrame:
    """run, rows, compared, first, last, rise, allowed, took, not_risen: the last share of a run's rows against its first.

    took: the last mean is below the first. not_risen: it is not above it by more than ``errors`` standard errors of the
    two windows' difference; windows of one row have none. A run of fewer than two windows compares its halves.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(run)
    rows = losses.select(run, F.col(loss).cast("double").alias("loss"), F.row_number().over(w.orderBy(pos)).alias("at"), F.count(F.lit(1)).over(w).alias("rows"))
    rows = rows.withColumn("compared", F.least(F.greatest(F.lit(1), F.floor(F.col("rows") * share)), F.floor(F.col("rows") / 2)))
    first, last = F.col("at") <= F.col("compared"), F.col("at") > F.col("rows") - F.col("compared")
    of = lambda f, c: f(F.when(c, F.col("loss")))
    found = rows.groupBy(run).agg(F.first("rows").alias("rows"), F.first("compared").alias("compared"), of(F.avg, first).alias("first"), of(F.avg, last).alias("last"), of(F.var_samp, first).alias("vf"), of(F.var_samp, last).alias("vl"))
    allowed = F.when(F.col("compared") > 1, errors * F.sqrt((F.col("vf") + F.col("vl")) / F.col("compared"))).otherwise(0.0)
    found = found.withColumn("rise", F.col("last") - F.col("first")).withColumn("allowed", allowed)
    some = F.col("compared") > 0
    return found.select(run, "rows", "compared", "first", "last", "rise", "allowed", (some & F.coalesce(F.col("last") < F.col("first"), F.lit(False))).alias("took"), (some & F.coalesce(F.col("rise") <= F.col("allowed"), F.lit(False))).alias("not_risen"))


def goal_again(results: DataFrame, problem: str, k: str, order: str) -> DataFrame:
    """The goal problems that the first sampling did not solve, in the goal set's order."""
    return results.where(F.col(k) == 0).select(problem, order).orderBy(order)
