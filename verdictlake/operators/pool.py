"""Problem pools: first-wins duplicates, barring, seeded draws and selection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import rank_hash


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("pos_in_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("pos_in_key = 1").drop("pos_in_key")


def barred(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys with a held row: one equi anti join a key, never one condition with OR."""
    for k in keys:
        rows = rows.join(held.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return rows


def seeded_draw(rows: DataFrame, key: str, n: int, seed: int, label: str) -> DataFrame:
    """The n rows of the smallest hashes, kept as top-k in each task."""
    return rows.withColumn("rank_hash", rank_hash(seed, label, F.col(key))).orderBy("rank_hash").limit(n)


def stratified_draw(rows: DataFrame, stratum: str, key: str, n: int, seed: int, label: str) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy("rank_hash")
    return rows.withColumn("rank_hash", rank_hash(seed, label, F.col(key))).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def propose(candidates: DataFrame, key: str, score: str, places: int, random_share: float, seed: int) -> DataFrame:
    """Best scores first, a rounded share of the places drawn by hash from the rest."""
    n = min(places, candidates.count())
    drawn = int(round(n * random_share))
    ranked = candidates.withColumn("tie", rank_hash(seed, "propose", F.col(key)))
    best = ranked.orderBy(F.desc(score), "tie").limit(n - drawn).select(key, score).withColumn("how", F.lit("scored"))
    rest = ranked.join(best.select(key), key, "left_anti").withColumn("place", rank_hash(seed, "random_place", F.col(key)))
    return best.unionByName(rest.orderBy("place").limit(drawn).select(key, score).withColumn("how", F.lit("random_place")))


def half_pass_rate(rows: DataFrame, k: str, n: str, key: str, size: int) -> DataFrame:
    """Nearest to one half. |2k - n| / n is compared in whole parts of 10**12: of fractions with n below a million unequal
    ones lie more than a part apart and equal ones have equal parts, so the order is exact."""
    return rows.withColumn("distance", F.expr(f"abs(2 * cast({k} as bigint) - {n}) * 1000000000000L div {n}")).orderBy("distance", key).limit(size)


def matched_in_length(own: DataFrame, offered: DataFrame, key: str, bins: list[str], seed: int, label: str = "long_ordinary") -> DataFrame:
    """As many offered rows a bin as own has; what a bin lacks is asked of the next shorter one (bins from short to long)."""
    counts = {r["bin"]: (r["own"], r["offered"]) for r in own.groupBy("bin").agg(F.count(F.lit(1)).alias("own")).join(offered.groupBy("bin").agg(F.count(F.lit(1)).alias("offered")), "bin", "full").na.fill(0).collect()}  # a row a bin
    quota, carried = {}, 0
    for b in reversed(bins):
        asked = counts.get(b, (0, 0))[0] + carried
        quota[b] = min(asked, counts.get(b, (0, 0))[1])
        carried = asked - quota[b]
    if carried:
        raise ValueError(f"{carried} rows are missing in the shortest bin")
    limits = F.create_map(*[F.lit(v) for b in bins for v in (b, quota[b])])
    w = Window.partitionBy("bin").orderBy("rank_hash")
    drawn = offered.withColumn("rank_hash", rank_hash(seed, label, F.col(key))).withColumn("draw", F.row_number().over(w))
    return drawn.where(F.col("draw") <= limits[F.col("bin")]).drop("draw", "rank_hash")


def both_sides(rows: DataFrame, key: str, side: str) -> DataFrame:
    """Alarm: keys that stand on more than one side."""
    return rows.groupBy(key).agg(F.count_distinct(side).alias("sides"), F.count(F.lit(1)).alias("rows")).where("sides > 1")
