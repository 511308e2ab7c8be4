"""Joins, refusals and set relations over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import attempts, load, query, rounded, sql_rounded

HAS_VERDICT = "(l_orderkey + l_linenumber) % 5 <> 0"
ONCE_SQL = "o AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_partkey) AS problem, max(l_linestatus) AS side, max(l_returnflag) AS flag, max(year(l_shipdate)) AS round FROM lineitem GROUP BY 1)"


def once(spark, d):
    """One attempt an (order, line): 60 in 100 of the rows have an id of their own."""
    rows = load(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rows.agg(F.max("l_partkey").alias("problem"), F.max("l_linestatus").alias("side"), F.max("l_returnflag").alias("flag"), F.max(F.year("l_shipdate")).alias("round"))


@query(f"WITH {ONCE_SQL} SELECT problem, side, count(*) AS drawn, count(*) FILTER (flag = 'R' AND id % 7 <> 0) AS verified FROM o GROUP BY ALL")
def attempts_with_verdicts(spark, d):
    """Attempts and verdicts by attempt id; one in seven attempts has no verdict and counts as not verified."""
    rows = once(spark, d)
    verdicts = rows.where("id % 7 <> 0").select("id", F.when(F.col("flag") == "R", "verified").otherwise("rejected").alias("status"))
    return J.with_verdicts(rows, verdicts, "id").groupBy("problem", "side").agg(F.count(F.lit(1)).alias("drawn"), F.count_if("verified").alias("verified"))


SIDES_SQL = "s AS (SELECT l_partkey AS problem, year(l_shipdate) >= 1998 AS late, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY ALL)"


def sides(spark, d):
    rows = attempts(spark, d).where("l_quantity < 10").groupBy("problem", (F.col("round") >= 1998).alias("late")).agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.where("not late"), rows.where("late")


@query(f"""WITH {SIDES_SQL}, b AS (SELECT * FROM s WHERE NOT late), a AS (SELECT * FROM s WHERE late), j AS (SELECT coalesce(b.problem, a.problem)::VARCHAR AS problem, b.n AS nb, a.n AS na FROM b FULL JOIN a ON a.problem = b.problem)
SELECT 'not before' AS rule, problem FROM j WHERE nb IS NULL UNION ALL SELECT 'not after', problem FROM j WHERE na IS NULL UNION ALL SELECT 'other number of episodes', problem FROM j WHERE nb <> na""")
def violations_pairing(spark, d):
    return J.pair_refusals(*sides(spark, d))


@query("WITH r AS (SELECT p_partkey AS problem, count(l_partkey) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS ko, count(l_partkey) FILTER (l_linestatus = 'O') AS no, count(l_partkey) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS kf, count(l_partkey) FILTER (l_linestatus = 'F') AS nf FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) SELECT problem, ko + kf AS k, no + nf AS n, 2::BIGINT AS samplings FROM r")
def summed_samplings(spark, d):
    """Two samplings (by side) over the same problems, those without attempts too, added up; each problem is in both."""
    rows = attempts(spark, d).groupBy("problem", "side").agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    base = load(spark, d, "part").select(F.col("p_partkey").alias("problem"))
    parts = [base.join(rows.where(F.col("side") == s).drop("side"), "problem", "left").na.fill(0, ["k", "n"]) for s in ("O", "F")]
    return J.added(parts, "problem", ["k", "n"])


@query(f"""WITH {ONCE_SQL}, g AS (SELECT id FROM o WHERE id % 3 <> 0), e AS (SELECT id FROM o WHERE id % 3 <> 0 AND id % 11 <> 0), l AS (SELECT id FROM o WHERE id % 3 <> 0 OR id % 13 = 0)
SELECT 'earlier lacks it' AS rule, id::VARCHAR AS id FROM g WHERE id NOT IN (FROM e) UNION ALL SELECT 'later has another', id::VARCHAR FROM l WHERE id NOT IN (FROM g)""")
def violations_cover(spark, d):
    """Two versions must have judged exactly the attempts given."""
    rows = once(spark, d).select("id")
    return J.cover_violations(rows.where("id % 3 <> 0"), {"earlier": rows.where("id % 3 <> 0 and id % 11 <> 0"), "later": rows.where("id % 3 <> 0 or id % 13 = 0")}, "id")


SEEDS_SQL = "r AS (SELECT l_partkey AS problem, year(l_shipdate) AS seed, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY ALL), u AS (SELECT problem FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT seed) FROM r) AND min(n) >= 2)"
PASS2 = "CASE WHEN n - k < 2 THEN 1.0 ELSE 1 - (1 - 2.0 / (n - 1)) * (1 - 2.0 / n) END"


@query(sql_rounded(f"WITH {SEEDS_SQL} SELECT problem, count(*) AS seeds, avg(CASE WHEN n - k < 2 THEN 1.0::DOUBLE ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n - k + 1, n + 1), lambda i: 1 - 2.0::DOUBLE / i)), lambda a, b: a * b) END) AS pass_at_2 FROM r SEMI JOIN u USING (problem) GROUP BY 1", "pass_at_2"))
def pass_over_seeds(spark, d):
    """Problems that every seed (year) drew at least twice, with the mean over the seeds of their pass@2."""
    from ..functions.rates import pass_at

    rows = attempts(spark, d).groupBy("problem", F.col("round").alias("seed")).agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    usable = J.in_every_seed(rows, "problem", "seed", "n", 2)
    return rounded(rows.join(usable, "problem", "left_semi").groupBy("problem").agg(F.count(F.lit(1)).alias("seeds"), F.avg(pass_at(2, F.col("k"), F.col("n"))).alias("pass_at_2")))


@query("SELECT doc_id, coalesce(quality, -1)::INT AS quality, coalesce(toxic, 0)::INT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def facts_with_defaults(spark, d):
    rows = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"))


@query("WITH c AS (SELECT l_partkey AS problem, sha256(l_orderkey || ':' || l_linenumber) AS sha, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), w AS (SELECT DISTINCT l_partkey AS problem, sha256(l_orderkey || ':' || l_linenumber) AS sha FROM lineitem WHERE l_linenumber <= 2) SELECT w.problem, w.sha, c.pos FROM w LEFT JOIN c ON c.problem = w.problem AND c.sha = w.sha")
def rebuilt_certificates(spark, d):
    """The candidate of a problem whose rebuilt text has the stored hash."""
    text = F.concat_ws(":", "l_orderkey", "l_linenumber")
    rows = load(spark, d, "lineitem").withColumn("problem", F.col("l_partkey"))
    wanted = rows.where("l_linenumber <= 2").select("problem", F.sha2(text, 256).alias("sha")).distinct()
    return J.rebuilt(wanted, rows.where("l_returnflag = 'R'"), "problem", "sha", text, "l_linenumber")


@query("SELECT o_custkey, min(TRY_CAST(CASE WHEN l_linenumber % 3 = 0 THEN 'r' || l_linenumber ELSE l_suppkey::VARCHAR END AS BIGINT)) AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def earliest_reference(spark, d):
    values = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("r"), F.col("l_linenumber").cast("string"))).otherwise(F.col("l_suppkey").cast("string")).alias("iteration"))
    return J.earliest(load(spark, d, "orders").select("o_custkey", "o_orderkey"), values, ["o_orderkey"], "o_custkey", "iteration")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 100 = o_custkey % 100) DESC, o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def own_name_preferred(spark, d):
    return J.preferred(load(spark, d, "orders"), "o_custkey", F.col("o_orderkey") % 100 == F.col("o_custkey") % 100, ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT DISTINCT l_partkey AS problem FROM lineitem WHERE l_linenumber = 1), p AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09) AS k, count(*) AS n FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1)
SELECT 'no pick' AS rule, problem::VARCHAR AS problem FROM r WHERE problem NOT IN (SELECT problem FROM p) UNION ALL SELECT 'a row of an unsolved problem', r.problem::VARCHAR FROM r JOIN p USING (problem) WHERE k = 0 UNION ALL SELECT 'picked twice', r.problem::VARCHAR FROM r JOIN p USING (problem) WHERE n > 45""")
def violations_picks(spark, d):
    rows = attempts(spark, d)
    picks = rows.where("problem % 9 <> 0").groupBy("problem").agg(F.count_if("thin").alias("k"), F.count(F.lit(1)).alias("n"))
    picks = picks.unionByName(picks.where("n > 45"))
    return J.pick_refusals(rows.where("l_linenumber = 1").select("problem").distinct(), picks)


@query("""WITH s AS (SELECT conv_id, CASE WHEN turn = 1 THEN 'first' ELSE role END AS arm, turn, length(text) AS state FROM conversations)
SELECT c.conv_id, c.turn, s.state AS state_before FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn - 1 AND s.arm = CASE WHEN c.turn - 1 = 1 THEN 'first' ELSE c.role END""")
def requested_states(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("state"))
    states = rows.withColumn("role", F.when(F.col("turn") == 1, "first").otherwise(F.col("role")))
    return J.with_requested_state(rows.drop("state"), states, "role", ["conv_id"], "turn", "state").select("conv_id", "turn", "state_before")


@query("WITH c AS (SELECT sha256(text) AS sha, min(doc_id) AS check_id, count(*) AS rows FROM documents GROUP BY 1) SELECT doc_id, check_id, rows, check_id % 2 = 0 AS answer FROM documents d LEFT JOIN c ON c.sha = sha256(d.text)")
def answers_by_hash(spark, d):
    """Documents of one text are one check; its answer goes to all of them."""
    rows = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    checks = J.one_check_each(rows, "sha", "doc_id").withColumnRenamed("doc_id", "check_id").withColumn("answer", F.col("check_id") % 2 == 0)
    return J.answered_once(rows, "sha", checks).select("doc_id", "check_id", "rows", "answer")


@query("SELECT DISTINCT l_partkey AS problem FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.05)")
def violations_containment(spark, d):
    rows = attempts(spark, d)
    return J.not_contained(rows.where("verified"), rows.where("l_returnflag = 'A' and l_discount >= 0.05"), "problem")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY sha256('7:order:' || p_partkey)) AS pos, p_partkey AS id FROM part), b AS (SELECT row_number() OVER (ORDER BY sha256('7:order:' || p_partkey)) AS pos, p_partkey AS id FROM part WHERE p_size <> 3) SELECT coalesce(a.pos, b.pos) AS pos, a.id AS one, b.id AS other FROM a FULL JOIN b ON a.pos = b.pos WHERE a.id IS DISTINCT FROM b.id ORDER BY 1 LIMIT 1")
def first_difference(spark, d):
    """Where two orders of the same rule part: one without the problems of a size."""
    from ..operators.draws import in_order

    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    orders = [in_order(rows, "id", 7, "order").select("pos", "id") for rows in (part, part.where("p_size <> 3"))]
    return J.first_difference(*orders, "pos", "id")


@query("WITH a AS (SELECT DISTINCT l_partkey AS problem FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09), b AS (SELECT DISTINCT l_partkey AS problem FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.09) SELECT CASE WHEN b.problem IS NULL THEN 'one' WHEN a.problem IS NULL THEN 'other' ELSE 'both' END AS set, coalesce(a.problem, b.problem) AS problem FROM a FULL JOIN b ON a.problem = b.problem")
def id_sets(spark, d):
    rows = attempts(spark, d).where("l_discount >= 0.09")
    return J.three_sets(rows.where("verified"), rows.where("status = 'rejected'"), "problem")
