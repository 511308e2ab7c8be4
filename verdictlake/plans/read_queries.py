"""Reads over whole tables: parts, calibration, losses, repair loops, orders; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import attempts as A
from ..operators import reads as R
from ..operators.draws import in_order
from .registry import PAIRS_SQL, R_SQL, REWARD_SQL, SIGN_SQL, arms, attempts, load, query, results, rounded, sql_rounded
from .session import working_dir


def with_start(spark, d):
    """Results with the size of the problem and whether the start (side F) solves it."""
    start = attempts(spark, d).where("side = 'F'").groupBy("problem").agg(F.count_if("thin").alias("ks"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size", "p_brand")
    return results(spark, d).join(part, "problem").join(start, "problem", "left").na.fill(0, ["ks"])


W_SQL = "w AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09) AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09 AND l_linestatus = 'F') AS ks, any_value(p_size) AS p_size FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), x AS (SELECT 'all' AS part, * FROM w UNION ALL SELECT CASE WHEN ks > 0 THEN 'solved by the start' ELSE 'unsolved by the start' END, * FROM w UNION ALL SELECT 'long', * FROM w WHERE p_size >= 40)"


def parts():
    return {"all": None, "solved by the start": F.col("ks") > 0, "unsolved by the start": F.col("ks") == 0, "long": F.col("p_size") >= 40}


@query(sql_rounded(f"WITH {W_SQL} SELECT part, count(*) AS problems, sum(k)::BIGINT AS successes, sum(n)::BIGINT AS attempts, sum(k) / sum(n) AS per_attempt, count(*) FILTER (k > 0) AS solved FROM x GROUP BY 1", "per_attempt"))
def figures_by_part(spark, d):
    return rounded(R.figures_by_part(with_start(spark, d), parts()))


@query(f"WITH {PAIRS_SQL}, x AS (SELECT 'all' AS part, * FROM p UNION ALL SELECT 'long', p.* FROM p JOIN part ON p_partkey = problem WHERE p_size >= 40 UNION ALL SELECT 'known false', p.* FROM p JOIN part ON p_partkey = problem WHERE p_size % 2 = 1) SELECT part, count(*) FILTER (k_before > 0) AS solved_before, count(*) FILTER (k_after > 0) AS solved_after, count(*) FILTER (k_before > 0 AND k_after > 0) AS by_both, count(*) FILTER (k_before = 0 AND k_after > 0) AS gained, count(*) FILTER (k_before > 0 AND k_after = 0) AS lost FROM x GROUP BY 1")
def solved_counts(spark, d):
    rows = A.paired(arms(spark, d), "arm", "before", "after").join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size"), "problem")
    return R.solved_counts(rows, {"all": None, "long": F.col("p_size") >= 40, "known false": F.col("p_size") % 2 == 1})


LOW, HIGH = rates.band_edges(0.25, 0.8)
PICK_FIGURES = ["share_known_false", "mean_pass_rate", "share_at_none", "share_below", "share_in_band", "share_above", "share_1_to_3", "share_4_or_more", "mean_reward", "mean_predicted"]


@query(sql_rounded(f"""WITH w AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n, any_value(p_size) AS p_size FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), h AS (SELECT *, CASE WHEN problem % 5 = 0 THEN 'random_place' ELSE 'scored' END AS part, (k + 1) / (n + 2) AS predicted FROM w), x AS (SELECT * FROM h UNION ALL SELECT * REPLACE ('all' AS part) FROM h)
SELECT part, count(*) AS picks, avg((p_size % 2 = 1)::INT) AS share_known_false, avg(k / n) AS mean_pass_rate, avg((k = 0)::INT) AS share_at_none, avg((k > 0 AND k / n < {LOW}::DOUBLE)::INT) AS share_below, avg((k / n >= {LOW}::DOUBLE AND k / n <= {HIGH}::DOUBLE)::INT) AS share_in_band, avg((k / n > {HIGH}::DOUBLE)::INT) AS share_above, avg((k BETWEEN 1 AND 3)::INT) AS share_1_to_3, avg((k >= 4)::INT) AS share_4_or_more, avg({REWARD_SQL}) AS mean_reward, avg(predicted) AS mean_predicted FROM x GROUP BY 1""", *PICK_FIGURES))
def picks_table(spark, d):
    rows = results(spark, d, "verified").join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size"), "problem")
    rows = rows.withColumns({"how": F.when(F.col("problem") % 5 == 0, "random_place").otherwise("scored"), "known_false": F.col("p_size") % 2 == 1, "predicted": (F.col("k") + 1) / (F.col("n") + 2)})
    return rounded(R.picks(rows, "how", 0.25, 0.8))


@query(sql_rounded("WITH r AS (SELECT year(l_shipdate) AS round, avg((l_returnflag = 'R')::INT) AS rate, count(DISTINCT l_partkey) AS problems FROM lineitem GROUP BY 1) SELECT arg_min(rate, round) AS rate_first, arg_max(rate, round) AS rate_last, arg_min(problems, round) AS problems_first, arg_max(problems, round) AS problems_last FROM r", "rate_first", "rate_last"))
def round_trajectory(spark, d):
    rows = attempts(spark, d)
    once = rows.groupBy("round", "problem").agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n")).groupBy("round").agg((F.sum("k") / F.sum("n")).alias("rate"), F.count(F.lit(1)).alias("problems"))
    return rounded(R.first_and_last(once, "round", ["rate", "problems"]))


PRED_SQL = "g AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n, (count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') + 1) / (count(*) FILTER (l_linestatus = 'O') + 2) AS predicted FROM lineitem GROUP BY 1)"
BIN_CASE = "CASE " + " ".join(f"WHEN predicted >= {e} THEN {e}::DOUBLE" for e in reversed(R.EDGES[:-1])) + " END"


def predicted(spark, d):
    side = F.col("side") == "O"
    return attempts(spark, d).groupBy("problem").agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"), ((F.count_if(F.col("verified") & side) + 1) / (F.count_if(side) + 2)).alias("predicted"))


@query(sql_rounded(f"WITH {PRED_SQL} SELECT {BIN_CASE} AS low, count(*) AS problems, avg(predicted) AS mean_predicted, sum(k) / sum(n) AS observed FROM g GROUP BY 1", "mean_predicted", "observed"))
def calibration_by_bin(spark, d):
    return rounded(R.calibration_bins(predicted(spark, d), "predicted"))


DEV = lambda r: f"-2 * sum(k * ln({r}) + (n - k) * ln(1 - ({r}))) / sum(n)"


@query(sql_rounded(f"""WITH {PRED_SQL}, s AS (SELECT sum(k) / sum(n) AS m FROM g), e AS (SELECT *, {REWARD_SQL} AS earned, list_sum(list_transform(range(0, 9), lambda j: (factorial(8) / (factorial(j::INT) * factorial((8 - j)::INT)))::DOUBLE * (j / 8) * power(1 - j / 8, 3) / (0.25 * power(0.75, 3)) * power(predicted, j) * power(1 - predicted, 8 - j))) AS expected FROM g)
SELECT (SELECT count(*) FROM g) AS problems, (SELECT {DEV('predicted')} FROM g) AS deviance, (SELECT {DEV('m')} FROM g, s) AS deviance_of_the_mean, (SELECT avg(earned) FROM e) AS mean_reward, (SELECT avg(earned) FROM (SELECT earned FROM e ORDER BY round(expected, 12) DESC, problem LIMIT (SELECT greatest(1, count(*) // 10) FROM g))) AS mean_reward_of_the_best_tenth""", "deviance", "deviance_of_the_mean", "mean_reward", "mean_reward_of_the_best_tenth"))
def calibration_read(spark, d):
    return rounded(R.calibration(predicted(spark, d), "problem", "predicted", 0.25, 8))


@query(sql_rounded("""WITH c AS (SELECT p_brand, p_size > 5 AS built, p_size % 4 > 0 AS compiles, p_size % 3 > 0 AS exact, p_size % 2 = 0 AS disproved FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09))
SELECT p_brand, count(*) AS never_proved, count(*) FILTER (built) AS built, count(*) FILTER (built AND compiles) AS compiles, count(*) FILTER (built AND compiles AND exact) AS exact, count(*) FILTER (built AND compiles AND exact AND disproved) AS disproved, count(*) FILTER (built AND compiles AND exact AND disproved) / nullif(count(*) FILTER (built AND compiles AND exact), 0) AS share_disproved FROM c GROUP BY 1""", "share_disproved"))
def never_proved_census(spark, d):
    solved = attempts(spark, d).where("thin").select(F.col("problem").alias("p_partkey")).distinct()
    rows = load(spark, d, "part").join(solved, "p_partkey", "left_anti").selectExpr("p_brand", "p_size > 5 AS built", "p_size % 4 > 0 AS compiles", "p_size % 3 > 0 AS exact", "p_size % 2 = 0 AS disproved")
    return rounded(R.never_proved(rows, "p_brand"))


@query(f"WITH {R_SQL} SELECT 'never proved' AS list, problem FROM r WHERE k = 0 UNION ALL SELECT 'below band', problem FROM r WHERE k > 0 AND k / n < 0.05 UNION ALL SELECT 'trained on', problem FROM r WHERE problem % 3 = 0")
def id_lists(spark, d):
    """Never proved, below the band, and trained on: three lists from one scan."""
    rows = R.over_parts(results(spark, d), {"never proved": F.col("k") == 0, "below band": (F.col("k") > 0) & (F.col("k") / F.col("n") < 0.05), "trained on": F.col("problem") % 3 == 0})
    return rows.select(F.col("part").alias("list"), "problem")


LOSS = ["mean_loss", "first_share", "body_share", "newline_share", "fence_share", "nats_a_proof", "body_nats_a_token"]


@query(sql_rounded("""WITH l AS (SELECT l_orderkey, list(l_extendedprice::DOUBLE / 1000 ORDER BY l_linenumber, l_extendedprice, l_partkey) AS xs FROM lineitem GROUP BY 1 HAVING count(*) >= 3), o AS (SELECT o_orderpriority AS g, xs, len(xs) AS t FROM l JOIN orders ON o_orderkey = l_orderkey)
SELECT g, avg(list_sum(xs) / t) AS mean_loss, avg(xs[1] / t) AS first_share, avg(coalesce(list_sum(xs[2:t - 2]), 0) / t) AS body_share, avg(xs[t - 1] / t) AS newline_share, avg(xs[t] / t) AS fence_share, avg(list_sum(xs)) AS nats_a_proof, sum(coalesce(list_sum(xs[2:t - 2]), 0)) / nullif(sum(greatest(t - 3, 0)), 0) AS body_nats_a_token FROM o GROUP BY 1""", *LOSS))
def losses_by_part(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey"))).alias("s")).where("size(s) >= 3")
    rows = rows.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("s", lambda x: x["l_extendedprice"].cast("double") / 1000).alias("losses"), F.size("s").alias("tokens"))
    return rounded(R.loss_parts(rows.join(load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g")), "o_orderkey"), "g"))


@query(sql_rounded("SELECT p_brand, count(*) AS proofs, median(p_size)::DOUBLE AS median, avg(p_size) AS mean, avg((p_size >= 8)::INT) AS share_long, max(p_size) AS longest, list_sort(list(p_size))[count(*) // 2 + 1] AS upper_median FROM part GROUP BY 1", "median", "mean", "share_long"))
def line_statistics(spark, d):
    part = load(spark, d, "part").select("p_brand", "p_size")
    return rounded(R.line_statistics(part, "p_brand", "p_size").join(R.upper_median(part, "p_brand", "p_size"), "p_brand"))


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY sha256('7:dose:' || p_partkey)) - 1 AS pos FROM part) SELECT c::INT AS rows_seen, p_brand, count(*) AS rows, sum(p_size)::BIGINT AS tokens FROM o, (VALUES (100), (500), (1200)) v(c) WHERE pos < c GROUP BY ALL")
def dose_prefixes(spark, d):
    rows = in_order(load(spark, d, "part"), "p_partkey", 7, "dose").withColumn("pos", F.col("pos") - 1)
    return R.doses(rows, "pos", [100, 500, 1200], "p_brand", "p_size")


S_SQL = "s AS (SELECT l_linestatus AS arm, l_partkey AS problem, l_suppkey % 3 AS episode, l_linenumber AS loop, l_returnflag = 'R' AND l_discount >= 0.05 AS verified, CASE WHEN l_tax >= 0.04 THEN 'resume' ELSE 'blind' END AS how, l_quantity AS tokens, round(l_discount * 100)::INT AS kept FROM lineitem), e AS (SELECT arm, problem, episode, min(loop) FILTER (verified) AS resolved_at FROM s GROUP BY ALL)"


def steps(spark, d):
    rows = load(spark, d, "lineitem")
    return rows.selectExpr("l_linestatus AS arm", "l_partkey AS problem", "l_suppkey % 3 AS episode", "l_linenumber AS loop", "l_returnflag = 'R' AND l_discount >= 0.05 AS verified", "CASE WHEN l_tax >= 0.04 THEN 'resume' ELSE 'blind' END AS how", "l_quantity AS tokens", "cast(round(l_discount * 100) AS int) AS kept")


@query(f"WITH {S_SQL} SELECT problem, count(*) FILTER (arm = 'O') AS O_episodes, count(resolved_at) FILTER (arm = 'O') AS O_resolved, count(*) FILTER (arm = 'F') AS F_episodes, count(resolved_at) FILTER (arm = 'F') AS F_resolved FROM e GROUP BY 1")
def repair_by_problem(spark, d):
    return R.by_arm(steps(spark, d), ["O", "F"])


@query(sql_rounded(f"WITH {S_SQL}, p AS (SELECT arm, k, problem, avg(coalesce(resolved_at <= k, false)::INT) AS rate, count(*) FILTER (resolved_at <= k) AS won FROM e, range(1, 8) t(k) GROUP BY ALL) SELECT arm, k::INT AS k, avg(rate) AS mean_rate, sum(won)::BIGINT AS resolved FROM p GROUP BY ALL", "mean_rate"))
def repair_within(spark, d):
    return rounded(R.resolved_within(steps(spark, d), 7))


@query(f"WITH {S_SQL}, p AS (SELECT k, problem, count(*) FILTER (arm = 'O' AND resolved_at <= k) AS a, count(*) FILTER (arm = 'F' AND resolved_at <= k) AS b FROM e, range(1, 8) t(k) GROUP BY ALL), q AS (SELECT k::INT AS k, sum(a)::BIGINT AS one, sum(b)::BIGINT AS other, sum(a)::BIGINT - sum(b)::BIGINT AS lead, count(*) FILTER (a > 0 AND b = 0) AS gained, count(*) FILTER (b > 0 AND a = 0) AS lost FROM p GROUP BY 1) SELECT k, one, other, lead, gained AS only_one, lost AS only_other, {SIGN_SQL} AS p_value FROM q")
def repair_leads(spark, d):
    """Running totals of two arms, the lead, problems that one arm alone resolves, and the sign test of these."""
    rows = R.leads(steps(spark, d), "O", "F", 7)
    return rows.withColumn("p_value", rates.sign_probability(F.col("only_one"), F.col("only_other")))


@query(sql_rounded(f"WITH {S_SQL}, f AS (SELECT arm, problem, episode FROM s GROUP BY ALL HAVING NOT bool_or(loop = 1 AND verified)) SELECT arm, how, count(*) AS attempts, count(*) FILTER (verified) AS verified, avg(verified::INT) AS share FROM s SEMI JOIN f USING (arm, problem, episode) WHERE loop = 2 GROUP BY ALL", "share"))
def repair_next_step(spark, d):
    return rounded(R.next_after_failure(steps(spark, d)))


@query(f"WITH {S_SQL} SELECT arm, loop, count(*) AS attempts, count(*) FILTER (verified) AS verified, count(*) FILTER (how = 'resume') AS with_a_state FROM s GROUP BY ALL")
def repair_by_position(spark, d):
    return R.by_position(steps(spark, d))


@query(f"WITH {S_SQL}, w AS (SELECT arm, how, row_number() OVER (PARTITION BY arm, problem, episode ORDER BY loop, how) AS n FROM s WHERE verified) SELECT arm, how AS way, count(*) AS episodes FROM w WHERE n = 1 GROUP BY ALL")
def repair_by_way(spark, d):
    return R.by_way(steps(spark, d))


@query(sql_rounded(f"""WITH {S_SQL}, u AS (SELECT arm, loop, sum(tokens) AS used, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT arm, loop, sum(used) OVER w AS tokens, (sum(n) OVER w)::BIGINT AS checks FROM u WINDOW w AS (PARTITION BY arm ORDER BY loop)), m AS (SELECT max(tokens) AS m FROM t WHERE arm = 'F')
SELECT t.arm, t.loop, t.tokens, t.checks, t.tokens / f.tokens AS ratio, coalesce(t.loop = max(t.loop) FILTER (t.arm = 'O' AND t.tokens <= m * 1.1::DOUBLE) OVER (PARTITION BY t.arm), false) AS largest_within FROM t LEFT JOIN t f ON f.arm = 'F' AND f.loop = t.loop CROSS JOIN m""", "ratio", "tokens"))
def repair_budget(spark, d):
    rows = R.budgets(steps(spark, d), "O", "F")
    return rounded(rows.withColumn("largest_within", F.coalesce("largest_within", F.lit(False))))


@query(sql_rounded(f"WITH {S_SQL}, m AS (SELECT *, lag(kept) OVER (PARTITION BY arm, problem, episode ORDER BY loop, kept) AS before FROM s) SELECT arm, count(*) FILTER (loop > 1) AS later, avg((how = 'resume')::INT) FILTER (loop > 1) AS state_share, count(*) FILTER (kept > before) AS forward, count(*) FILTER (kept = before) AS same, count(*) FILTER (kept < before) AS back FROM m GROUP BY 1", "state_share"))
def repair_cuts(spark, d):
    return rounded(R.cut_diagnostics(steps(spark, d)))


@query(sql_rounded("""WITH l AS (SELECT l_orderkey, list(l_tax::DOUBLE) FILTER (l_returnflag = 'A') AS pool, list(l_discount::DOUBLE) FILTER (l_returnflag = 'R') AS closers FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS rows, sum(coalesce(len(pool), 0))::BIGINT AS pool_count, sum(coalesce(len(closers), 0))::BIGINT AS closer_count, sum(coalesce(list_sum(pool), 0)) AS pool_sum, sum(coalesce(list_sum(closers), 0)) AS closer_sum FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""", "pool_sum", "closer_sum"))
def pool_use(spark, d):
    """Sums over two child arrays, each by itself."""
    rows = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_tax").cast("double"))).alias("pool"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_discount").cast("double"))).alias("closers"))
    return rounded(R.nested_sums(load(spark, d, "orders").join(rows, "o_orderkey", "left"), "o_orderpriority", {"pool": "pool", "closer": "closers"}))


@query("WITH p AS (SELECT l_partkey AS problem, l_orderkey, l_linenumber, l_quantity::BIGINT AS tokens, 'q' || l_quantity::BIGINT AS text FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT problem, text AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY tokens, l_orderkey, l_linenumber) AS n FROM p) WHERE n = 1) SELECT problem, l_orderkey, l_linenumber, tokens FROM (SELECT p.*, row_number() OVER (PARTITION BY problem ORDER BY tokens DESC, l_orderkey, l_linenumber) AS n FROM p JOIN c USING (problem) WHERE text <> canonical) WHERE n = 1")
def longest_other_proof(spark, d):
    from ..operators.pool import first_of_key

    rows = attempts(spark, d).where("verified").select("problem", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("tokens"), F.concat(F.lit("q"), F.col("l_quantity").cast("bigint").cast("string")).alias("text"))
    canonical = first_of_key(rows, ["problem"], ["tokens", "l_orderkey", "l_linenumber"]).select("problem", F.col("text").alias("canonical"))
    return R.longest_other(rows.join(canonical, "problem"), "problem", "text", "canonical", "tokens", ["l_orderkey", "l_linenumber"]).select("problem", "l_orderkey", "l_linenumber", "tokens")


@query("""WITH c AS (SELECT DISTINCT l_partkey AS problem, l_returnflag AS source, repeat('x', l_linenumber) || l_tax AS text FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY problem, source ORDER BY length(text), text) AS own FROM c)
SELECT problem, source, text, row_number() OVER (PARTITION BY problem ORDER BY CASE source WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, length(text), text)::INT AS pos FROM k WHERE own <= 2""")
def certificates_in_order(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("problem"), F.col("l_returnflag").alias("source"), F.concat(F.repeat(F.lit("x"), F.col("l_linenumber")), F.col("l_tax").cast("string")).alias("text"))
    return R.in_source_order(rows, "problem", "source", "text", ["R", "N", "A"], 2)


READINGS_SQL = "d AS (SELECT l_suppkey AS run, l_linenumber AS step, avg(l_extendedprice)::DOUBLE AS held, avg(l_quantity)::DOUBLE AS train FROM lineitem GROUP BY ALL)"


@query(sql_rounded(f"""WITH {READINGS_SQL}, w AS (SELECT *, arg_min(step, held) OVER s AS lowest_at, min(held) OVER s AS low, arg_min(train, held) OVER s AS train_low, max(held) OVER l - min(held) OVER l AS spread FROM d WINDOW s AS (PARTITION BY run ORDER BY step), l AS (PARTITION BY run ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT run, step, held - low AS above, lowest_at, spread, held - low > spread AND train < train_low AS by_loss FROM w""", "above", "spread").replace(", 9)", ", 5)"))
def overfitting_by_loss(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("step")).agg(F.avg("l_extendedprice").cast("double").alias("held"), F.avg("l_quantity").cast("double").alias("train"))
    return rounded(R.overfitted(rows, "run", "step", "held", "train").select("run", "step", "above", "lowest_at", "spread", "by_loss"), 5)


# Chains from part: three steps in order, a branch, a loop, an unfinished one.
CHAIN_ROWS = {0: [("a", "b", "t1"), ("b", "c", "t2"), ("c", "no goals", "t3")], 1: [("a", "b", "t1"), ("b", "no goals", "t2"), ("b", "c", "t3")], 2: [("a", "no goals", "t1")], 3: [("a", "b", "t1"), ("b", "c", "t2")], 4: [("a", "b", "t1"), ("b", "a", "t2")], 5: [("c", "no goals", "t3"), ("a", "b", "t1"), ("b", "c", "t2"), ("x", "y", "t4")]}


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 't1,t2,t3' WHEN 2 THEN 't1' END AS tactics FROM part")
def tactic_chains(spark, d):
    working_dir(spark)
    rows = spark.createDataFrame([(k, *r) for k, rs in CHAIN_ROWS.items() for r in rs], "shape int, before string, after string, tactic string")
    part = load(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 6).cast("int").alias("shape"))
    found = R.chains(part.join(F.broadcast(rows), "shape"), "p_partkey", "before", "after", "tactic")  # fifteen rows
    return found.select("p_partkey", F.when(F.col("tactics").isNotNull(), F.concat_ws(",", "tactics")).alias("tactics"))


@query("SELECT p_brand, list(p_size ORDER BY p_size, p_partkey)::INTEGER[] AS p_size, list(p_partkey ORDER BY p_size, p_partkey) AS p_partkey FROM part GROUP BY 1")
def plot_series(spark, d):
    return R.series(load(spark, d, "part"), "p_brand", "p_size", ["p_partkey"])


@query(sql_rounded("WITH o AS (SELECT p_retailprice::DOUBLE AS loss, row_number() OVER (ORDER BY sha256('7:pass:' || p_partkey)) - 1 AS pos, count(*) OVER () AS n FROM part) SELECT (ceil((pos + 1) * 20 / n) - 1)::INT AS part, count(*) AS rows, avg(loss) AS loss FROM o GROUP BY 1", "loss").replace(", 9)", ", 5)"))
def loss_by_twentieth(spark, d):
    part = load(spark, d, "part")
    n = part.count()
    rows = in_order(part, "p_partkey", 7, "pass")
    return rounded(rows.groupBy(R.part_of_pass(F.col("pos") - 1, F.lit(n)).alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("p_retailprice").cast("double")).alias("loss")), 5)


@query(sql_rounded("SELECT p_partkey, least(1.0, p_partkey / 100.0::DOUBLE) AS level, CASE WHEN p_partkey <= 100 THEN p_partkey / 100.0::DOUBLE ELSE greatest(0, (1501 - p_partkey) / 1401.0::DOUBLE) END AS decayed FROM part", "level", "decayed"))
def learning_rates(spark, d):
    """The factor of the rate at each step (the key), without and with the decay over 1,500 steps."""
    s, w, t = F.col("p_partkey"), F.lit(100), F.lit(1500)
    return rounded(load(spark, d, "part").select("p_partkey", R.warm_rate(s, w, t, False).alias("level"), R.warm_rate(s, w, t, True).alias("decayed")))


@query("WITH c AS (SELECT p_partkey, p_size AS changed FROM part), t AS (SELECT p_partkey, changed, g, changed - g AS l FROM c, range(0, 51) r(g) WHERE g >= changed // 2 AND g <= changed), p AS (SELECT *, least(1, 2 * list_sum(list_transform(range(0, least(g, l) + 1), lambda i: exp(lgamma(changed + 1) - lgamma(i + 1) - lgamma(changed - i + 1) - changed * ln(2.0::DOUBLE))))) AS v FROM t) SELECT c.p_partkey, min(g)::INT AS gained FROM c LEFT JOIN p ON p.p_partkey = c.p_partkey AND v < 0.05 GROUP BY 1")
def smallest_decisive_split(spark, d):
    return load(spark, d, "part").select("p_partkey", R.smallest_decisive(F.col("p_size")).alias("gained"))
