"""Rewards, bands and estimators of k of n."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reward(p: Column, target: float) -> Column:
    """1 at the target pass rate, 0 at pass rates 0 and 1."""
    a = 1 / target - 1
    return p * F.pow(1 - p, F.lit(a)) / F.lit(target * (1 - target) ** a)


def band_edges(target: float, floor: float, steps: int = 60) -> tuple[float, float]:
    """The pass rates between which the reward is at least the floor.

    The logarithm of the reward is concave in the log-odds x of the pass rate, so Newton's steps from outside the band never pass an edge.
    Outside starts come from dropping one factor of the reward, which bounds it from above.
    """
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    a = 1 / target - 1
    level = math.log(floor * target) + a * math.log(1 - target)
    edges = []
    for log_odds in (level - math.log(-math.expm1(level)), math.log(-math.expm1(level / a)) - level / a):
        for _ in range(steps):
            log_p, log_q = -softplus(-log_odds), -softplus(log_odds)
            slope = math.exp(log_q) - a * math.exp(log_p)
            if abs(slope) < 1e-12:
                break
            log_odds -= (log_p + a * log_q - level) / slope
        edges.append(1 / (1 + math.exp(-log_odds)))
    return edges[0], edges[1]


def rung(k: Column, n: Column, target: float = 0.25, floor: float = 0.8) -> Column:
    """below, in or above the band; null where nothing was solved."""
    p = k / n
    return F.when(k == 0, F.lit(None).cast("string")).when(reward(p, target) >= floor, "in").when(p < target, "below").otherwise("above")


def pass_at(k: int, c: Column, n: Column) -> Column:
    """Unbiased chance that one of k draws succeeds, c of n having done so; null where n < k."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - miss)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Within 0 to 1; null where there is nothing (n is 0) or k is not of n."""
    n = F.when((n > 0) & (k >= 0) & (k <= n), n.cast("double"))
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    within = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return within((centre - spread) / (1 + z * z / n)), within((centre + spread) / (1 + z * z / n))


def sign_probability(gained: Column, lost: Column) -> Column:
    """Two-sided exact probability of a split at least as uneven, to 6 significant digits; null where nothing changed. The
    terms are summed through their logarithms, so that no count overflows."""
    n, fewer = (gained + lost).cast("double"), F.least(gained, lost)
    start = F.struct((-n * math.log(2)).alias("t"), F.exp(-n * math.log(2)).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    places = F.when(fewer >= 1, F.sequence(F.lit(1).cast("long"), fewer.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    both = F.least(F.lit(1.0), 2 * F.aggregate(places, start, add, lambda a: a["s"]))
    return F.when(n > 0, F.format_string("%.5e", both).cast("double"))


def expected_reward(p: Column, n: int, target: float) -> Column:
    total = F.lit(0.0)
    for k in range(n + 1):
        a = 1 / target - 1
        r = (k / n) * (1 - k / n) ** a / (target * (1 - target) ** a)
        total = total + F.lit(math.comb(n, k) * r) * F.pow(p, F.lit(float(k))) * F.pow(1 - p, F.lit(float(n - k)))
    return total


#: Two-sided 95% critical values of Student's t by degrees of freedom.
T_CRITICAL = {1: 12.706204736174698, 2: 4.302652729749462, 3: 3.182446305283709, 4: 2.7764451051977934, 5: 2.5705818356363146, 6: 2.4469118511449692, 7: 2.3646242515927844, 8: 2.306004135204166, 9: 2.262157162798205}


def t_critical(seeds: int) -> float:
    """The critical value for so many seeds; other numbers than those of T_CRITICAL are refused."""
    if seeds - 1 not in T_CRITICAL:
        raise ValueError(f"no critical value for {seeds} seeds: they are given for {min(T_CRITICAL) + 1} to {max(T_CRITICAL) + 1}")
    return T_CRITICAL[seeds - 1]
