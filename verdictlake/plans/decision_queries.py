"""Every staged decision rule over all rows of ``part``: figures made from the key reach each branch. The same conditions
run in both engines; the tests hold each outcome and its boundaries against hand-written cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rates
from ..operators import branches as B
from ..operators import decisions as D
from .registry import SIGN_SQL, attempts, load, query, rounded, sql_rounded

K = "p_partkey"


def part_of(n: int, m: int = 1) -> str:
    """A whole number from the key: floor(key / m) modulo n."""
    return f"(CAST(floor({K} / {m}) AS BIGINT) % {n})"


def thousandths(of: str) -> str:
    return f"(CAST({of} AS DOUBLE) / 1000)"


#: Half widths of 0 to 3 thousandths, some of 18.
WIDTH = f"(CASE {part_of(9, 9)} WHEN 8 THEN 18 ELSE {part_of(4, 9)} END)"

FIGURES = {
    "failed": f"CASE WHEN {part_of(11)} = 0 THEN 1 ELSE 0 END", "other_failed": f"CASE WHEN {part_of(19)} = 0 THEN 1 ELSE 0 END", "problems": f"{part_of(23)} * 3", "gained": part_of(17), "lost": part_of(17, 17),
    "low": f"CASE WHEN {part_of(13)} <> 0 THEN {thousandths(part_of(9) + ' - 4')} END", "high": f"CASE WHEN {part_of(13)} <> 0 THEN {thousandths(part_of(9) + ' - 4 + 2 * ' + WIDTH)} END",
    "mean": f"CASE WHEN {part_of(13)} <> 0 THEN {thousandths(part_of(9) + ' - 4 + ' + WIDTH)} END", "least": thousandths(part_of(5, 3) + " - 2"), "seeds": part_of(4, 7),
    "alone_low": thousandths(part_of(5, 5) + " - 2"), "solved_low": thousandths(part_of(5, 2) + " - 2"), "own_gain": thousandths(part_of(3, 4)), "blind_share": f"{thousandths(part_of(8, 3) + ' * 100')}", "resume_share": f"{thousandths(part_of(8, 5) + ' * 100')}",
    "failed_firsts": part_of(40, 3), "states": part_of(20, 2), "steps": part_of(40, 2), "blind_verified": part_of(6, 3), "blind_attempts": f"{part_of(6, 3)} + 5", "step_verified": part_of(4, 2), "step_attempts": f"{part_of(4, 2)} + 4",
    "hard": part_of(30, 2), "pools": part_of(10), "pool_checks": part_of(40), "standing": f"{part_of(40)} - CASE WHEN {part_of(3, 5)} = 0 THEN 3 ELSE 0 END", "proofs": f"{part_of(7, 6)} * 40", "gain_of_a_proof": "CAST(0.00002 AS DOUBLE)",
    "band": f"CASE WHEN {part_of(29)} <> 0 THEN {thousandths(part_of(3, 8))} END", "seen": f"CASE {part_of(3, 3)} WHEN 0 THEN true WHEN 1 THEN false END",
    "adds": f"CASE {part_of(3)} WHEN 0 THEN false WHEN 1 THEN true ELSE {part_of(4, 9)} > 0 END", "not_narrower": f"CASE {part_of(3, 3)} WHEN 0 THEN false WHEN 1 THEN true ELSE {part_of(4, 9)} > 1 END",
    "holds": f"CASE {part_of(4, 9)} WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END", "one": f"CASE {part_of(5)} WHEN 0 THEN NULL ELSE {part_of(2, 3)} = 0 END", "other": f"CASE {part_of(7)} WHEN 0 THEN NULL ELSE {part_of(2, 2)} = 0 END",
    "one_margin": part_of(9, 4), "other_margin": part_of(9, 5), "measured": f"{part_of(31)} <> 0", "enough": f"{part_of(6)} > 0", "sd": f"CASE WHEN {part_of(14)} <> 0 THEN {thousandths(part_of(5))} END", "sd_seeds": f"CASE WHEN {part_of(15)} <> 0 THEN {thousandths(part_of(7, 2))} END",
    "sd_decay": thousandths(part_of(5, 3)), "averaged": thousandths(part_of(9, 2)), "models_mean": thousandths(part_of(9, 3)), "noise": thousandths(part_of(3, 6)), "spread": f"CASE WHEN {part_of(5, 2)} <> 0 THEN CAST(0.0007 AS DOUBLE) END",
    "k": part_of(12, 2), "n": f"CASE WHEN {part_of(16)} = 0 THEN 0 ELSE 960 END", "k0": part_of(12, 24), "n0": "CAST(960 AS BIGINT)", "long_high": thousandths(part_of(5, 4) + " - 2"), "p_size": "p_size",
}


def interval_of(m: int) -> dict[str, str]:
    """Another interval, from other parts of the key."""
    there = f"CASE WHEN {part_of(37, m)} <> 0 THEN "
    return {"low": there + thousandths(f"{part_of(9, m)} - 4") + " END", "high": there + thousandths(f"{part_of(9, m)} - 4 + 2 * {part_of(4, 9 * m)}") + " END", "mean": there + thousandths(f"{part_of(9, m)} - 4 + {part_of(4, 9 * m)}") + " END"}


#: Figures that are made anew before a read.
AFTER = {"lead": {**interval_of(2), "seeds": f"CASE WHEN {part_of(6)} = 0 THEN 1 ELSE 2 END"}, "split": interval_of(3), "reach": {**interval_of(5), "seeds": f"CASE WHEN {part_of(5, 3)} = 0 THEN 3 ELSE 2 END"}, "on_fresh": interval_of(2), "sits": interval_of(2)}


def figures(spark, d):
    rows = load(spark, d, "part").selectExpr(K, *[f"{e} AS {name}" for name, e in FIGURES.items()])
    return rows.withColumn("p_value", rates.sign_probability(F.col("gained"), F.col("lost")))


def branch_sql(rules: dict[str, str], more: dict[str, str] | None = None) -> str:
    sql = f"SELECT *, {SIGN_SQL} AS p_value FROM (SELECT {K}, {', '.join(f'{e} AS {name}' for name, e in FIGURES.items())} FROM part)"
    for name, rule in rules.items():
        for other, e in AFTER.get(name, {}).items():
            sql = f"SELECT * REPLACE ({e} AS {other}) FROM ({sql})"
        sql = f"SELECT *, {B.case_sql(rule)} AS {name} FROM ({sql})"
    for name, e in (more or {}).items():
        sql = f"SELECT *, {e} AS {name} FROM ({sql})"
    return f"SELECT {', '.join([K, *rules, *(more or {})])} FROM ({sql})"


def branches(rows, rules: dict[str, str]):
    """Rule after rule; a read of other attempts than the one before has an interval of its own."""
    for name, rule in rules.items():
        for other, e in AFTER.get(name, {}).items():
            rows = rows.withColumn(other, F.expr(e))
        rows = B.with_branches(rows, {name: rule})
    return rows


REPAIR = {"repair": "repair", "alternate": "alternate", "accumulate": "accumulate", "ceiling": "ceiling"}
ASSEMBLED = {"step_1": "assembled_step_1", "step_2": "assembled_step_2", "pretrained": "on_pretraining", "size_read": "adapter_size", "old_rule": "old_rule"}
ROWS = {"question_1": "question_1", "question_2": "question_2", "arms_rule": "arms_rule", "matched": "matched_rows", "dose": "second_pass_dose"}
BESIDE = {"branch": "on_pretraining", "apart": "separation"}
DEEP = {"main_read": "deep_primary", "mechanism": "deep_mechanism", "again": "replication", "follows": "after_depth"}
SEEDS = {"main_read": "three_seeds", "lead": "lead", "split": "lead_split", "reach": "long_reach", "follows": "after_the_seeds"}
NOISE = {"order_read": "order_spread", "decay": "decay_spread", "level": "decay_level", "averaging": "averaging"}
CYCLE = {"main_read": "cycle_primary", "compounding": "compounding", "longer": "hard_or_long", "reach": "cycle_reach", "follows": "after_cycle"}
NEW = {"main_read": "new_proofs", "whose": "whose_proofs", "follows": "after_new_proofs"}
MEASURE = {"on_set": "holds_on_the_set", "on_fresh": "holds_on_fresh"}


@query(branch_sql(REPAIR))
def branches_repair(spark, d):
    return branches(figures(spark, d), REPAIR).select(K, *REPAIR)


@query(branch_sql(ASSEMBLED))
def branches_assembled(spark, d):
    return branches(figures(spark, d), ASSEMBLED).select(K, *ASSEMBLED)


@query(branch_sql(ROWS))
def branches_rows(spark, d):
    return branches(figures(spark, d), ROWS).select(K, *ROWS)


@query(branch_sql(BESIDE, {"narrower": B.NARROWER_IF, "said": B.SAID_BESIDE}))
def branches_said_beside(spark, d):
    """The pretraining branch with breadth, separation and long proofs beside it."""
    rows = branches(figures(spark, d), BESIDE).withColumn("narrower", F.expr(B.NARROWER_IF))
    return rows.withColumn("said", F.expr(B.SAID_BESIDE)).select(K, *BESIDE, "narrower", "said")


@query(branch_sql(DEEP))
def branches_deep(spark, d):
    return branches(figures(spark, d), DEEP).select(K, *DEEP)


@query(branch_sql(SEEDS))
def branches_seeds(spark, d):
    return branches(figures(spark, d), SEEDS).select(K, *SEEDS)


@query(branch_sql(NOISE | {"follows": "after_noise"}).replace("'INCONCLUSIVE' IN (spread", "'INCONCLUSIVE' IN (decay").replace("WHEN spread = 'DECAY", "WHEN decay = 'DECAY"))
def branches_noise(spark, d):
    rows = branches(figures(spark, d), NOISE).withColumn("spread", F.col("decay"))
    return B.with_branches(rows, {"follows": "after_noise"}).select(K, *NOISE, "follows")


@query(branch_sql(CYCLE))
def branches_cycle(spark, d):
    return branches(figures(spark, d), CYCLE).select(K, *CYCLE)


@query(branch_sql(NEW))
def branches_new_proofs(spark, d):
    return branches(figures(spark, d), NEW).select(K, *NEW)


@query(branch_sql(MEASURE | {"follows": "after_measure"}))
def branches_measure(spark, d):
    return branches(figures(spark, d), MEASURE | {"follows": "after_measure"}).select(K, *MEASURE, "follows")


DRAWS = {"draws": "seed_draws", "dose": "stock_dose", "sits": "where_it_sits", "follows": "after_draws", "after_dose": "after_stock"}


@query(branch_sql(DRAWS))
def branches_draws(spark, d):
    return branches(figures(spark, d), DRAWS).select(K, *DRAWS)


SHARE = "CASE WHEN failed > 0 THEN NULL ELSE blind_share * 1.5 END"
NARROW = B.NARROWER_IF
FIRST_SQL = {
    "rung": "CASE WHEN NOT coalesce(resume_share BETWEEN 0.1 AND 0.5, false) THEN 'VOID' WHEN low > 0 THEN 'ESCALATE' WHEN high < 0 THEN 'STOP' WHEN solved_low < 0 THEN 'SECONDARY OUTSIDE LUCK (below)' WHEN alone_low > 0 THEN 'SECONDARY OUTSIDE LUCK (above)' ELSE 'UNDETECTABLE' END",
    "tax": f"CASE WHEN {SHARE} IS NULL THEN 'undefined' WHEN {SHARE} >= 0.8 THEN 'small' ELSE 'not small' END", "tax_decided": f"CASE WHEN {SHARE} IS NULL THEN NULL ELSE {SHARE} - 0.25 >= 0.8 OR {SHARE} + 0.25 < 0.8 END",
    "rounds": "CASE WHEN NOT measured THEN 'VOID' WHEN alone_low <= 0 AND solved_low <= 0 THEN 'VOID' WHEN other_failed > 0 THEN 'STOP AND DIAGNOSE' WHEN mean IS NULL THEN 'VOID' ELSE 'ESCALATE' END",
    "adds_read": "CASE WHEN failed > 0 OR mean IS NULL THEN NULL ELSE low > 0 END", "broad_read": f"CASE WHEN failed > 0 OR problems = 0 THEN NULL ELSE NOT ({NARROW}) END", "long_read": "CASE WHEN failed > 0 OR mean IS NULL THEN NULL ELSE NOT high < 0 END",
}


@query(branch_sql({}, FIRST_SQL | {"all_three": "adds_read AND broad_read AND long_read"}).replace("0.25 >= 0.8", "0.25::DOUBLE >= 0.8::DOUBLE").replace("0.25 < 0.8", "0.25::DOUBLE < 0.8::DOUBLE").replace("* 1.5", "* 1.5::DOUBLE").replace(">= 0.8 THEN", ">= 0.8::DOUBLE THEN").replace("BETWEEN 0.1 AND 0.5", "BETWEEN 0.1::DOUBLE AND 0.5::DOUBLE"))
def branches_first(spark, d):
    """First rung, version tax, rounds of the loop and the three reads, as column functions."""
    c = F.col
    own, secondary = D.Interval(c("mean"), c("low"), c("high")), D.Interval(c("mean"), c("alone_low"), c("solved_low"))
    share = F.expr(SHARE)
    tax, decided = D.tax_read(share, share - 0.25, share + 0.25)
    adds, broad, long, all_three = D.three_reads(c("failed"), own, c("problems"), c("gained"), c("lost"), c("p_value"), own)
    return figures(spark, d).select(
        K, D.first_rung(own, c("resume_share"), (0.1, 0.5), [secondary])["name"].alias("rung"), tax.alias("tax"), decided.alias("tax_decided"), D.loop_rounds(c("measured"), c("alone_low"), c("solved_low"), c("other_failed") > 0, c("mean"))["name"].alias("rounds"),
        adds.alias("adds_read"), broad.alias("broad_read"), long.alias("long_read"), all_three.alias("all_three"),
    )


GATES_SQL = """WITH l AS (SELECT l_suppkey AS run, l_extendedprice::DOUBLE / 1000 AS loss, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS rows FROM lineitem),
c AS (SELECT *, least(greatest(1, floor(rows * 0.1)), rows // 2) AS compared FROM l),
g AS (SELECT run, any_value(rows) AS rows, any_value(compared)::BIGINT AS compared, avg(loss) FILTER (nth <= compared) AS first, avg(loss) FILTER (nth > rows - compared) AS last, var_samp(loss) FILTER (nth <= compared) AS vf, var_samp(loss) FILTER (nth > rows - compared) AS vl FROM c GROUP BY 1)
SELECT run, rows, compared, first, last, last - first AS rise, CASE WHEN compared > 1 THEN 2 * sqrt((vf + vl) / compared) ELSE 0 END AS allowed, coalesce(last < first, false) AS took, coalesce(last - first <= CASE WHEN compared > 1 THEN 2 * sqrt((vf + vl) / compared) ELSE 0 END, false) AS not_risen FROM g"""


@query(sql_rounded(GATES_SQL, "first", "last", "rise", "allowed"))
def training_gates(spark, d):
    """A supplier's lines as a run's losses: the last tenth against the first."""
    from pyspark.sql import Window

    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate"]
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_extendedprice").cast("double") / 1000).alias("loss"), *order)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy(*order)))
    return rounded(B.training_gates(rows, "run", "loss", "pos"))


@query("""WITH r AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09 AND l_linestatus = 'F') AS k FROM lineitem GROUP BY 1)
SELECT p_partkey AS problem, p_size AS place FROM part LEFT JOIN r ON problem = p_partkey WHERE coalesce(k, 0) = 0""")
def goal_set_again(spark, d):
    """The goal problems that the first sampling does not solve."""
    k = attempts(spark, d).where("side = 'F'").groupBy("problem").agg(F.count_if("thin").alias("k"))
    goal = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), F.col("p_size").alias("place")).join(k, "problem", "left").na.fill(0, ["k"])
    return B.goal_again(goal, "problem", "k", "place")
