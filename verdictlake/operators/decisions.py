"""Decision rules: figures in, one outcome and the reason out, the first case that holds.

Every rule is a column expression, so one plan judges any number of sections. A condition that is null does not hold; the
rules test missing figures themselves. An interval that ends at zero holds zero. Rules on counts compare products of whole
numbers, never rounded rates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The outcomes' names.
VOID, ESCALATE, STOP, STOP_AND_DIAGNOSE = "VOID", "ESCALATE", "STOP", "STOP AND DIAGNOSE"
NOT_NAMED_BY_THE_SPEC, TOKEN_HABIT, UNDETECTABLE = "NOT NAMED BY THE SPEC", "TOKEN_HABIT", "UNDETECTABLE"
SECONDARY_BELOW, SECONDARY_ABOVE = "SECONDARY OUTSIDE LUCK (below)", "SECONDARY OUTSIDE LUCK (above)"
INCONCLUSIVE, NOT_READ, NAMED_NOTHING, NARROWER = "INCONCLUSIVE", "NOT READ", "NAMED NOTHING", "NARROWER"
GIVES_BACK = "THE RULE GIVES THE BREADTH BACK AND KEEPS THE GAIN"
UNDOES = "IT GIVES THE BREADTH BACK BY UNDOING THE TRAINING"
KEEPS_ONLY = "IT KEEPS THE GAIN AND DOES NOT GIVE THE BREADTH BACK"
NOT_THIS_LEVER = "NOT THIS LEVER AT THIS SIZE"
BEAT = "THE MODEL'S OWN PROOFS BESIDE PUBLISHED ONES BEAT PUBLISHED ONES ALONE ON THE GOAL SET"
THEY_COST, UNDETECTABLE_SEEDS = "THEY COST", "UNDETECTABLE AT THIS NUMBER OF SEEDS"
ADDS, COSTS, NOT_SHOWN_AT_ONE = "ADDS: ESCALATE", "COSTS", "NOT SHOWN AT ONE SEED"
AVERAGE_IS_PART, ONE_CONTINUATION = "THE AVERAGE IS PART OF THE GAIN", "ONE CONTINUATION GIVES IT"
# The lines of the rules.
TOKEN_HABIT_LINE, SMALL_TAX, SIGN_LEVEL, EFFECT_FOUND = -0.004, 0.8, 0.05, 0.0165


@dataclass(frozen=True)
class Interval:
    """A mean with its interval; all null where nothing was read."""

    mean: Column
    low: Column
    high: Column


def first_match(*cases: tuple[Column, str, str], otherwise: tuple[str, str]) -> Column:
    """struct<name, reason> of the first case (condition, name, reason) that holds."""
    outcome = lambda name, reason: F.struct(F.lit(name).alias("name"), F.lit(reason).alias("reason"))
    found = outcome(*otherwise)
    for condition, name, reason in reversed(cases):
        found = F.when(F.coalesce(condition, F.lit(False)), outcome(name, reason)).otherwise(found)
    return found


def sides(i: Interval, up: str, down: str, holds: str) -> Column:
    """The bare label of an interval."""
    return F.when(i.low > 0, up).when(i.high < 0, down).otherwise(holds)


def interval_label(i: Interval) -> Column:
    return sides(i, "improved", "degraded", "no measurable change")


def three_way(failed: Column, i: Interval, up: str, down: str, holds: str) -> Column:
    """The frame of every interval rule; ``failed`` is the number of failed checks."""
    return first_match(
        (failed > 0, INCONCLUSIVE, "a check failed"),
        (i.mean.isNull(), NOT_READ, "nothing was measured"),
        (i.low > 0, up, "the interval is above zero"),
        (i.high < 0, down, "the interval is below zero"),
        otherwise=(holds, "the interval holds zero"),
    )


def resolves(i: Interval) -> Column:
    """Half width: the least effect that an interval holding zero could have told from none."""
    return (i.high - i.low) / 2


def scout(difference: Column, reproduced: Column) -> Column:
    return first_match(
        (~F.coalesce(reproduced, F.lit(False)), VOID, "the control is not reproduced"),
        (difference.isNull(), NOT_READ, "nothing was measured"),
        (difference >= 0, ESCALATE, "at or above zero"),
        (difference < TOKEN_HABIT_LINE, TOKEN_HABIT, "below the line"),
        otherwise=(ESCALATE, "between the line and zero"),
    )


def first_rung(primary: Interval, base_rate: Column, void_range: tuple[float, float], secondaries: list[Interval]) -> Column:
    """A secondary below zero outweighs one above it. A base rate that is missing is outside the range."""
    any_of = lambda conditions: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)).cast("int") for c in conditions], F.lit(0), F.lit(0)) == 1, F.lit(False))
    return first_match(
        (~F.coalesce(base_rate.between(*void_range), F.lit(False)), VOID, "the base rate is outside its range"),
        (primary.low > 0, ESCALATE, "the primary is above zero"),
        (primary.high < 0, STOP, "the primary is below zero"),
        (any_of([s.high < 0 for s in secondaries]), SECONDARY_BELOW, "a secondary is below zero"),
        (any_of([s.low > 0 for s in secondaries]), SECONDARY_ABOVE, "a secondary is above zero"),
        otherwise=(UNDETECTABLE, "all intervals hold zero"),
    )


def tax_read(share: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """small, not small or undefined (earlier rate 0); and whether the interval lies on one side of the line."""
    read = F.when(share.isNull(), "undefined").when(share >= SMALL_TAX, "small").otherwise("not small")
    return read, F.when(share.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce((low >= SMALL_TAX) | (high < SMALL_TAX), F.lit(False)))


def aimed_round(primary: Interval, reward: Column, random_reward: Column, problems: Column, least: int) -> Column:
    return first_match(
        (problems < least, VOID, "too few problems on the rung"),
        (reward.isNull() | random_reward.isNull(), VOID, "a mean reward is missing"),
        (reward <= random_reward, VOID, "no better than a random draw"),
        (primary.mean.isNull(), VOID, "the primary is missing"),
        (primary.high < 0, STOP_AND_DIAGNOSE, "the interval is below zero"),
        (primary.mean >= 0, ESCALATE, "the primary is at or above zero"),
        otherwise=(NOT_NAMED_BY_THE_SPEC, "below zero with an interval that holds zero"),
    )


def loop_rounds(measured: Column, in_band: Column, above: Column, any_below: Column, last: Column) -> Column:
    """measured: round 1 was; in_band, above: its means; any_below: some round's below-band interval is below zero."""
    return first_match(
        (~F.coalesce(measured, F.lit(False)), VOID, "round 1 was not measured"),
        ((in_band <= 0) & (above <= 0), VOID, "round 1 did not train"),
        (any_below, STOP_AND_DIAGNOSE, "a round is below zero"),
        (last.isNull(), VOID, "the primary is missing"),
        otherwise=(ESCALATE, "the primary is not below zero"),
    )


def gained_more(gained: Column, lost: Column, p: Column) -> Column:
    return (gained > lost) & F.coalesce(p < SIGN_LEVEL, F.lit(False))


def narrower(gained: Column, lost: Column, p: Column) -> Column:
    return gained_more(lost, gained, p)


def rows_rule(failed: Column, against_failed: Column, problems: Column, gained: Column, lost: Column, p: Column, kept: Interval) -> Column:
    first, second = gained_more(gained, lost, p), kept.low > 0
    return first_match(
        (failed > 0, INCONCLUSIVE, "a check failed"),
        (against_failed > 0, NOT_READ, "what it is held against failed a check"),
        (F.coalesce(problems == 0, F.lit(True)) | kept.mean.isNull(), NOT_READ, "nothing was measured"),
        (first & second, GIVES_BACK, "gained more than lost, and the gain is kept"),
        (first, UNDOES, "gained more than lost, and the gain is not kept"),
        (second, KEEPS_ONLY, "the gain is kept, the breadth not given back"),
        otherwise=(NOT_THIS_LEVER, "neither"),
    )


def three_reads(failed: Column, again: Interval, problems: Column, gained: Column, lost: Column, p: Column, long: Interval) -> tuple[Column, Column, Column, Column]:
    """adds, not_narrower, holds_the_long and all three (three-valued and); all null for a model that failed a check."""
    sound = lambda c: F.when(F.coalesce(failed > 0, F.lit(False)), F.lit(None).cast("boolean")).otherwise(c)
    adds = sound(F.when(again.mean.isNotNull(), again.low > 0))
    broad = sound(F.when(problems > 0, ~narrower(gained, lost, p)))
    holds = sound(F.when(long.mean.isNotNull(), ~(long.high < 0)))
    return adds, broad, holds, adds & broad & holds


def draws(i: Interval) -> Column:
    """A half width of exactly the effect found is not above it."""
    return first_match(
        (i.mean.isNull(), NOT_READ, "nothing was measured"),
        (i.low > 0, BEAT, "the interval is above zero"),
        (i.high < 0, THEY_COST, "the interval is below zero"),
        (resolves(i) > EFFECT_FOUND, UNDETECTABLE_SEEDS, "the half width is above the effect found"),
        otherwise=("NOT SHOWN", "the interval holds zero"),
    )


def exact_line(k: Column, n: Column, k0: Column, n0: Column, ten_thousandths: int) -> tuple[Column, Column, Column]:
    """k/n - k0/n0: whether at or above zero, at or above the line, and below minus the line, in whole numbers."""
    k, n, k0, n0 = (c.cast("decimal(12,0)") for c in (k, n, k0, n0))
    difference, unit = (k * n0 - k0 * n) * F.lit(10000), n * n0 * F.lit(ten_thousandths)
    return difference >= 0, difference >= unit, difference < -unit


def stock_dose(failed: Column, k: Column, n: Column, k0: Column, n0: Column, ten_thousandths: int, up: str = ESCALATE, down: str = COSTS) -> Column:
    at_zero, _, below = exact_line(k, n, k0, n0, ten_thousandths)
    return first_match(
        (failed > 0, INCONCLUSIVE, "a check failed"),
        (F.coalesce((n == 0) | (n0 == 0), F.lit(True)), NOT_READ, "no attempts"),
        (at_zero, up, "at or above zero"),
        (below, down, "below minus the line"),
        otherwise=(NOT_SHOWN_AT_ONE, "between minus the line and zero"),
    )


def against_bar(failed: Column, k: Column, n: Column, k0: Column, n0: Column, ten_thousandths: int = 85) -> Column:
    _, above, below = exact_line(k, n, k0, n0, ten_thousandths)
    return first_match(
        (failed > 0, INCONCLUSIVE, "a check failed"),
        (F.coalesce((n == 0) | (n0 == 0), F.lit(True)), NOT_READ, "no attempts"),
        (above, ADDS, "at or above the line"),
        (below, COSTS, "below minus the line"),
        otherwise=(NOT_SHOWN_AT_ONE, "between the lines"),
    )


def what_made_it(failed: Column, k: Column, n: Column, k0: Column, n0: Column, ten_thousandths: int = 130) -> Column:
    _, _, below = exact_line(k, n, k0, n0, ten_thousandths)
    return first_match(
        (failed > 0, INCONCLUSIVE, "a check failed"),
        (F.coalesce((n == 0) | (n0 == 0), F.lit(True)), NOT_READ, "no attempts"),
        (below, AVERAGE_IS_PART, "below minus the line"),
        otherwise=(ONE_CONTINUATION, "not below minus the line"),
    )
