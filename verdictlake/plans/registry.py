"""The queries over the driver's tables, each beside the SQL that says the same.

Attempts are lineitem rows: problem l_partkey, side l_linestatus, verified R, no answer N, rejected A. As no problem is
unsolved there, ``thin`` counts a success only from a discount of 0.09 on, which fills every rung.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals, rates, seeded, statements
from ..operators import attempts as A
from ..operators import checks as C
from ..operators import decisions as D
from ..operators import pool as P
from ..operators import predictor as R
from ..streaming import verdict_log as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
ORDER_SQL = ", ".join(ORDER)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").withColumns({
        "problem": F.col("l_partkey"), "side": F.col("l_linestatus"), "episode": F.col("l_linenumber"), "verified": flag == "R", "round": F.year("l_shipdate"),
        "status": F.when(flag == "R", "verified").when(flag == "N", "no_answer").otherwise("rejected"), "thin": (flag == "R") & (F.col("l_discount") >= 0.09),
    })


def results(spark: SparkSession, sf_dir: str, flag: str = "thin") -> DataFrame:
    return attempts(spark, sf_dir).groupBy("problem").agg(F.count_if(flag).alias("k"), F.count(F.lit(1)).alias("n"))


R_SQL = "r AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09) AS k, count(*) AS n FROM lineitem GROUP BY 1)"
REWARD_SQL = "((k / n) * power(1 - k / n, 3) / (0.25 * power(0.75, 3)))"
RUNG_SQL = f"CASE WHEN k = 0 THEN NULL WHEN {REWARD_SQL} >= 0.8 THEN 'in' WHEN k / n < 0.25 THEN 'below' ELSE 'above' END"


def arms(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    rows = attempts(spark, sf_dir).withColumn("arm", F.when(F.col("round") >= 1998, "after").otherwise("before"))
    rows = A.first_attempts(rows, ["problem", "arm"], ORDER, n)
    return rows.groupBy("problem", "arm").agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n)


PAIRS_SQL = f"""
a AS (SELECT *, CASE WHEN year(l_shipdate) >= 1998 THEN 'after' ELSE 'before' END AS arm FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, arm ORDER BY {ORDER_SQL}) AS pos FROM a),
g AS (SELECT l_partkey AS problem, arm, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM f WHERE pos <= 4 GROUP BY ALL HAVING count(*) = 4),
p AS (SELECT b.problem, b.k AS k_before, b.n AS n_before, c.k AS k_after, c.n AS n_after FROM g b JOIN g c USING (problem) WHERE b.arm = 'before' AND c.arm = 'after')"""
CHANGE_SQL = "count(*) AS problems, avg(k_before / n_before) AS mean_before, avg(k_after / n_after) AS mean_after, avg(k_after / n_after - k_before / n_before) AS mean_change, count(*) FILTER (k_before = 0 AND k_after > 0) AS gained, count(*) FILTER (k_before > 0 AND k_after = 0) AS lost"


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to a fixed place, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c, t in df.dtypes if t == "double"})  # no negative zeros


def sql_rounded(sql: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 9) + 0 AS {c}' for c in columns)}) FROM ({sql})"


@query(sql_rounded(f"WITH {PAIRS_SQL} SELECT {RUNG_SQL.replace('k ', 'k_before ').replace('/ n', '/ n_before')} AS rung, {CHANGE_SQL} FROM p GROUP BY 1", "mean_before", "mean_after", "mean_change"))
def paired_change(spark, d):
    return rounded(A.change_by(A.paired(arms(spark, d), "arm", "before", "after"), rates.rung(F.col("k_before"), F.col("n_before")), "rung"))


@query(sql_rounded(f"WITH {PAIRS_SQL} SELECT k_before, {CHANGE_SQL} FROM p GROUP BY 1", "mean_before", "mean_after", "mean_change"))
def gain_by_k(spark, d):
    return rounded(A.change_by(A.paired(arms(spark, d), "arm", "before", "after"), F.col("k_before"), "k_before"))


@query(f"WITH {PAIRS_SQL} SELECT problem, k_before = 0 AS gained FROM p WHERE (k_before = 0) <> (k_after = 0)")
def gained_lost(spark, d):
    pairs = A.paired(arms(spark, d), "arm", "before", "after")
    return pairs.where("(k_before = 0) <> (k_after = 0)").select("problem", F.expr("k_before = 0").alias("gained"))


SIGN_SQL = "CASE WHEN gained + lost > 0 THEN format('{:.5e}', least(1, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1), lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2.0::DOUBLE))))))::DOUBLE END"


@query(f"WITH {PAIRS_SQL} SELECT *, {SIGN_SQL} AS p_value FROM (SELECT count(*) FILTER (k_before = 0 AND k_after > 0) AS gained, count(*) FILTER (k_before > 0 AND k_after = 0) AS lost FROM p)")
def sign_test(spark, d):
    """Two-sided exact sign test of gained against lost (one row)."""
    rows = gained_lost(spark, d).agg(F.count_if("gained").alias("gained"), F.count_if(~F.col("gained")).alias("lost"))
    return rows.withColumn("p_value", rates.sign_probability(F.col("gained"), F.col("lost")))


@query("""
WITH e AS (SELECT l_partkey AS problem, l_linenumber AS episode, bool_or(l_returnflag = 'R' AND l_linestatus = 'O') AS s, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS g, count(*) FILTER (l_returnflag = 'N') AS na, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT problem, count(*) AS episodes, count(*) FILTER (s OR g) AS resolved, count(*) FILTER (s) AS resolved_by_statement, count(*) FILTER (g) AS resolved_by_negation, sum(na)::BIGINT AS attempts_without_an_answer, sum(c)::BIGINT AS attempts FROM e GROUP BY 1""")
def k_of_n(spark, d):
    return A.k_of_n(attempts(spark, d))


@query("SELECT l_partkey AS problem, l_linestatus AS side, count(*) AS drawn, count(*) FILTER (l_returnflag = 'R') AS verified FROM lineitem GROUP BY ALL")
def drawn_verified(spark, d):
    return attempts(spark, d).groupBy("problem", "side").agg(F.count(F.lit(1)).alias("drawn"), F.count_if("verified").alias("verified"))


@query(sql_rounded("SELECT year(l_shipdate)::INT AS round, count(*) AS attempts, avg((l_returnflag = 'R')::INT) AS verified_share, avg((l_returnflag = 'N')::INT) AS no_answer_share FROM lineitem GROUP BY 1", "verified_share", "no_answer_share"))
def status_health(spark, d):
    share = lambda s: F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0))
    return rounded(attempts(spark, d).groupBy("round").agg(F.count(F.lit(1)).alias("attempts"), share("verified").alias("verified_share"), share("no_answer").alias("no_answer_share")))


@query(sql_rounded("WITH q AS (SELECT l_partkey, count(DISTINCT l_quantity) AS u, count(*) AS n FROM lineitem GROUP BY 1) SELECT sum(u) / sum(n) AS distinct_share, avg(u / n) AS mean_of_shares FROM q", "distinct_share", "mean_of_shares"))
def distinct_share(spark, d):
    once = attempts(spark, d).groupBy("problem", "l_quantity").agg(F.count(F.lit(1)).alias("n")).groupBy("problem").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"))
    return rounded(once.agg((F.sum("u") / F.sum("n")).alias("distinct_share"), F.avg(F.col("u") / F.col("n")).alias("mean_of_shares")))


@query(sql_rounded(f"WITH {R_SQL} SELECT p_brand, sum(k) / sum(n) AS per_attempt, 1000 * sum(k) / sum(n) AS per_1000, sqrt(sum((k / n) * (1 - k / n) / n)) / count(*) AS sampling_noise, count(*) FILTER (k > 0) AS solved FROM r JOIN part ON p_partkey = problem GROUP BY 1", "per_attempt", "per_1000", "sampling_noise"))
def attempts_figure(spark, d):
    return rounded(A.figure(results(spark, d).join(load(spark, d, "part"), F.col("problem") == F.col("p_partkey")), ["p_brand"]))


@query(f"WITH {R_SQL} SELECT b.k::INT AS k, count(r.problem) AS problems FROM (SELECT unnest(range(greatest(8, max(k)) + 1)) AS k FROM r) b LEFT JOIN r ON r.k = b.k GROUP BY 1")
def k_histogram(spark, d):
    """All problems: bins from 0 to the largest k, to 8 at least."""
    rows = results(spark, d)
    return A.histogram(rows, max(8, rows.agg(F.max("k").alias("k")).first()["k"] or 0))


@query(f"WITH c AS (SELECT l_partkey AS problem, l_returnflag = 'R' AS v, (row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER_SQL}) - 1) // 8 AS chunk FROM lineitem), e AS (SELECT problem, chunk, bool_or(v) AS solved FROM c GROUP BY ALL HAVING count(*) = 8) SELECT problem, count(*) AS episodes, count(*) FILTER (solved) AS resolved FROM e GROUP BY 1")
def episode_chunks(spark, d):
    return A.chunked(attempts(spark, d), "problem", ORDER, 8)


FIRST_SQL = f"o AS (SELECT l_partkey AS problem, l_returnflag = 'R' AND l_discount >= 0.09 AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER_SQL}) AS place FROM lineitem), f AS (SELECT problem, min(place) FILTER (v) AS first_success FROM o GROUP BY 1 HAVING min(place) FILTER (v) IS NOT NULL)"


def firsts(spark, d):
    return A.first_success(attempts(spark, d).withColumn("verified", F.col("thin")), "problem", ORDER)


@query(f"WITH {FIRST_SQL} SELECT CASE WHEN first_success <= 8 THEN '1-8' WHEN first_success <= 16 THEN '9-16' WHEN first_success <= 32 THEN '17-32' ELSE '33+' END AS band, count(*) AS problems FROM f GROUP BY 1")
def first_success_bands(spark, d):
    p = F.col("first_success")
    return firsts(spark, d).groupBy(F.when(p <= 8, "1-8").when(p <= 16, "9-16").when(p <= 32, "17-32").otherwise("33+").alias("band")).agg(F.count(F.lit(1)).alias("problems"))


@query(f"WITH {FIRST_SQL} SELECT k::INT AS k, count(*) AS resolved FROM f, range(1, 33) s(k) WHERE first_success <= k GROUP BY 1")
def resolved_within_k(spark, d):
    return A.within_k(firsts(spark, d).withColumn("first_success", F.col("first_success").cast("int")), 32)


@query(sql_rounded(f"WITH {R_SQL} SELECT problem, k, n, {REWARD_SQL} AS reward, {RUNG_SQL} AS rung FROM r", "reward"))
def reward_by_problem(spark, d):
    k, n = F.col("k"), F.col("n")
    return rounded(results(spark, d).select("problem", "k", "n", rates.reward(k / n, 0.25).alias("reward"), rates.rung(k, n).alias("rung")))


@query(f"WITH {R_SQL} SELECT coalesce({RUNG_SQL}, 'goal') AS rung, count(*) AS problems, sum(k)::BIGINT AS successes FROM r GROUP BY 1")
def rung_groups(spark, d):
    return results(spark, d).groupBy(F.coalesce(rates.rung(F.col("k"), F.col("n")), F.lit("goal")).alias("rung")).agg(F.count(F.lit(1)).alias("problems"), F.sum("k").alias("successes"))


@query(sql_rounded(f"WITH {R_SQL} SELECT p_brand, avg({REWARD_SQL}) AS mean_reward, avg(CASE WHEN {RUNG_SQL} = 'in' THEN 1.0 ELSE 0.0 END) AS share_in_band, avg((k = 0)::INT) AS share_at_none, avg((k = n)::INT) AS share_at_all, count(*) AS problems FROM r JOIN part ON p_partkey = problem GROUP BY 1", "mean_reward", "share_in_band", "share_at_none", "share_at_all"))
def arm_reward(spark, d):
    return rounded(A.arm_reward(results(spark, d).join(load(spark, d, "part"), F.col("problem") == F.col("p_partkey")), "p_brand"))


@query(sql_rounded(f"WITH {R_SQL} SELECT p_brand, avg(CASE WHEN n - k < 8 THEN 1.0 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n - k + 1, n + 1), lambda i: 1 - 8.0::DOUBLE / i)), lambda a, b: a * b) END) AS pass_at_8 FROM r JOIN part ON p_partkey = problem WHERE n >= 8 GROUP BY 1", "pass_at_8"))
def pass_at_k_mean(spark, d):
    return rounded(A.mean_pass_at(results(spark, d).join(load(spark, d, "part"), F.col("problem") == F.col("p_partkey")).where("n >= 8"), ["p_brand"], [8]))


@query(sql_rounded("WITH s AS (SELECT p_brand, count(*) FILTER (l_returnflag = 'R') AS k, count(*)::DOUBLE AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT p_brand, (k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n) AS low, (k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n) AS high FROM s", "low", "high"))
def wilson_by_stratum(spark, d):
    rows = attempts(spark, d).join(load(spark, d, "part"), F.col("problem") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = rates.wilson(F.col("k"), F.col("n"))
    return rounded(rows.select("p_brand", low.alias("low"), high.alias("high")))


@query(sql_rounded("WITH y AS (SELECT year(l_shipdate) AS seed, count(*) FILTER (l_returnflag = 'R') / count(*) AS rate FROM lineitem GROUP BY 1) SELECT count(*) AS seeds, avg(rate) AS mean, stddev_samp(rate) AS sd, avg(rate) - 2.4469118511449692 * stddev_samp(rate) / sqrt(count(*)) AS low, avg(rate) + 2.4469118511449692 * stddev_samp(rate) / sqrt(count(*)) AS high FROM y", "mean", "sd", "low", "high").replace("2.4469118511449692", f"(CASE count(*) {' '.join(f'WHEN {f + 1} THEN {t}' for f, t in rates.T_CRITICAL.items())} END)::DOUBLE"))
def t_interval_over_seeds(spark, d):
    """Over all years as seeds; a number of years whose critical value is not given is refused."""
    rows = attempts(spark, d).groupBy(F.col("round").alias("seed")).agg((F.count_if("verified") / F.count(F.lit(1))).alias("rate"))
    half = F.lit(rates.t_critical(rows.count())) * F.stddev_samp("rate") / F.sqrt(F.count(F.lit(1)))
    return rounded(rows.agg(F.count(F.lit(1)).alias("seeds"), F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), (F.avg("rate") - half).alias("low"), (F.avg("rate") + half).alias("high")))


@query(sql_rounded("WITH x AS (SELECT l_linestatus AS side, 1 / l_quantity AS inv, l_extendedprice AS loss FROM lineitem WHERE l_quantity > 0) SELECT side, regr_slope(loss, inv) AS slope, regr_intercept(loss, inv) AS intercept FROM x GROUP BY 1", "slope", "intercept").replace(", 9)", ", 3)"))
def ols_per_proof_constant(spark, d):
    rows = load(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_linestatus").alias("side"), (1 / F.col("l_quantity")).alias("inv"), F.col("l_extendedprice").alias("loss"))
    return rounded(rows.groupBy("side").agg(F.regr_slope("loss", "inv").alias("slope"), F.regr_intercept("loss", "inv").alias("intercept")), 3)


@query(sql_rounded(f"""WITH {R_SQL}, a AS (SELECT p_brand, k / n AS x, p_size AS y FROM r JOIN part ON p_partkey = problem),
b AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY x) + (count(*) OVER (PARTITION BY p_brand, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY y) + (count(*) OVER (PARTITION BY p_brand, y) - 1) / 2 AS ry FROM a)
SELECT p_brand, corr(rx, ry) AS spearman FROM b GROUP BY 1""", "spearman"))
def spearman(spark, d):
    rows = results(spark, d).join(load(spark, d, "part"), F.col("problem") == F.col("p_partkey")).select("p_brand", (F.col("k") / F.col("n")).alias("x"), F.col("p_size").alias("y"))
    mean_rank = lambda c: F.rank().over(Window.partitionBy("p_brand").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("p_brand", c)) - 1) / 2
    return rounded(rows.select("p_brand", mean_rank("x").alias("rx"), mean_rank("y").alias("ry")).groupBy("p_brand").agg(F.corr("rx", "ry").alias("spearman")))


@query("SELECT p_partkey AS problem, sha256('7:base_map:' || p_partkey) AS rank_hash FROM part ORDER BY 2 LIMIT 100")
def hash_rank_draw(spark, d):
    return P.seeded_draw(load(spark, d, "part").select(F.col("p_partkey").alias("problem")), "problem", 100, 7, "base_map")


U_SQL = "(('0x' || substr(sha256('7:keep:' || problem), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"WITH {R_SQL} SELECT problem FROM r WHERE {U_SQL} < {REWARD_SQL}")
def reward_keep_rows(spark, d):
    k, n = F.col("k"), F.col("n")
    return results(spark, d).where(seeded.uniform(7, "keep", F.col("problem")) < rates.reward(k / n, 0.25)).select("problem")


@query("SELECT p_partkey AS problem, ('0x' || right(sha256('7:half:' || p_partkey), 1))::INT % 2 AS half FROM part")
def half_split(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("problem"), seeded.half(7, "half", F.col("p_partkey")).alias("half"))


@query("SELECT p_partkey AS problem FROM part WHERE ('0x' || left(sha256('7:contradicted_side_audit:' || p_partkey), 8))::BIGINT / 4294967296.0::DOUBLE < 0.1")
def audit_share(spark, d):
    return load(spark, d, "part").where(seeded.in_share(7, "contradicted_side_audit", F.col("p_partkey"), 0.1)).select(F.col("p_partkey").alias("problem"))


@query("SELECT source, problem, draw::INT AS draw FROM (SELECT source, doc_id AS problem, row_number() OVER (PARTITION BY source ORDER BY sha256('7:survival:' || doc_id)) AS draw FROM documents) WHERE draw <= 5")
def stratified_sample(spark, d):
    return P.stratified_draw(load(spark, d, "documents").select("source", F.col("doc_id").alias("problem")), "source", "problem", 5, 7, "survival").select("source", "problem", "draw")


@query("SELECT doc_id, substr(sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))), 1, 16) AS content_id FROM documents")
def content_ids(spark, d):
    return load(spark, d, "documents").select("doc_id", seeded.content_id(statements.squeezed(F.col("text"))).alias("content_id"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_wins_one_key(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return P.first_of_key(rows, ["key"], ["doc_id"]).select("doc_id")


def first_wins_sql(rows: str, keys: str) -> str:
    """CTEs q(pos, id, keys) and kept(id): the sequential rule as a recursive walk. rows: SELECT pos, id, keys (a list of strings, nulls left out)."""
    return f"q AS (SELECT row_number() OVER (ORDER BY pos) AS pos, id, list_filter({keys}, lambda x: x IS NOT NULL) AS keys FROM ({rows})), walk AS (SELECT 0::BIGINT AS pos, NULL::BIGINT AS id, []::VARCHAR[] AS seen, false AS kept UNION ALL SELECT q.pos, q.id, CASE WHEN list_has_any(seen, keys) THEN seen ELSE list_concat(seen, keys) END, NOT list_has_any(seen, keys) FROM walk JOIN q ON q.pos = walk.pos + 1), kept AS (SELECT id FROM walk WHERE kept)"


@query("WITH RECURSIVE " + first_wins_sql("SELECT doc_id AS pos, doc_id AS id, text, lang, n_chars // 50 AS size FROM documents", "['t' || sha256(text), 'p' || concat_ws(':', lang, length(text) // 50)]").replace("SELECT doc_id AS pos, doc_id AS id, text, lang, n_chars // 50 AS size FROM documents", "SELECT doc_id AS pos, doc_id AS id, text, lang FROM documents") + " SELECT id AS doc_id FROM kept")
def dedup_two_keys(spark, d):
    """Sequential rule over text and (language, length)."""
    from ..operators.draws import first_wins
    from .session import working_dir

    working_dir(spark)
    rows = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"), F.concat_ws(":", "lang", (F.length("text") / 50).cast("int")).alias("print"))
    return first_wins(rows, "doc_id", ["text_key", "print"]).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0) AND n_chars NOT IN (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND n_chars IS NOT NULL)""")
def bar_three_keys(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"), "n_chars")
    held = docs.join(load(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    toxic = load(spark, d, "labels").where("toxic = 1").select("doc_id")
    return P.barred(P.barred(docs, held, ["text_key", "n_chars"]), toxic, ["doc_id"]).select("doc_id")


@query("SELECT sha256(text) AS text_key, count(DISTINCT quality) AS sides, count(*) AS rows FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def both_sides_alarm(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(F.sha2("text", 256).alias("text_key"), "quality")
    return P.both_sides(rows, "text_key", "quality")


@query("""WITH c AS (SELECT o_custkey AS problem, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT AS pos, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' END AS status FROM orders),
g AS (SELECT problem, min(pos) FILTER (status = 'verified') AS won, min(pos) FILTER (status IS NULL) AS waits FROM c GROUP BY 1)
SELECT problem, CASE WHEN won IS NOT NULL AND (waits IS NULL OR won < waits) THEN 'in' WHEN waits IS NOT NULL THEN 'open' ELSE 'out' END AS state,
CASE WHEN won IS NOT NULL AND (waits IS NULL OR won < waits) THEN won END AS settled_at, CASE WHEN NOT (won IS NOT NULL AND (waits IS NULL OR won < waits)) THEN waits END AS next_check FROM g""")
def settle_verdicts(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("problem"), F.row_number().over(w).alias("pos"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' END").alias("status"))
    return A.settled(rows, "problem", "pos", "status")


@query("SELECT lang, doc_id, n FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text), text, doc_id)::INT AS n FROM documents WHERE text IS NOT NULL) WHERE n <= 3")
def k_shortest_per_key(spark, d):
    w = Window.partitionBy("lang").orderBy(F.length("text"), "text", "doc_id")
    return load(spark, d, "documents").where("text is not null").select("lang", "doc_id", F.row_number().over(w).alias("n")).where("n <= 3")


@query(f"WITH {R_SQL} SELECT problem, k, n FROM r ORDER BY abs(2 * k - n) * 1000000000000 // n, problem LIMIT 50")
def half_pass_rate(spark, d):
    return P.half_pass_rate(results(spark, d), "k", "n", "problem", 50).select("problem", "k", "n")


@query(f"WITH {R_SQL} SELECT problem, k, n FROM r ORDER BY NOT (k / n >= 0.02 AND k / n <= 0.05), k / n, sha256('7:difficulty:' || problem) LIMIT 60")
def difficulty_heuristic(spark, d):
    p = F.col("k") / F.col("n")
    return results(spark, d).orderBy(~((p >= 0.02) & (p <= 0.05)), p, seeded.rank_hash(7, "difficulty", F.col("problem"))).limit(60)


@query(f"""WITH {R_SQL}, b AS (SELECT problem, k / n AS score FROM r ORDER BY k / n DESC, sha256('7:propose:' || problem) LIMIT 80),
o AS (SELECT problem, k / n AS score FROM r WHERE problem NOT IN (SELECT problem FROM b) ORDER BY sha256('7:random_place:' || problem) LIMIT 20)
SELECT problem, round(score, 9) AS score, how FROM (SELECT *, 'scored' AS how FROM b UNION ALL SELECT *, 'random_place' AS how FROM o)""")
def propose_with_random_share(spark, d):
    rows = results(spark, d).select("problem", (F.col("k") / F.col("n")).alias("score"))
    return rounded(P.propose(rows, "problem", "score", 100, 0.2, 7))


@query("SELECT l_partkey AS problem, h AS rank_hash FROM (SELECT l_partkey, min(sha256('7:example:' || l_orderkey || '#' || l_linenumber)) AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)")
def training_examples(spark, d):
    """One verified attempt a problem: the least hash (an aggregate on the hash alone combines before the shuffle)."""
    key = F.concat_ws("#", "l_orderkey", "l_linenumber")
    return attempts(spark, d).where("verified").groupBy("problem").agg(F.min(seeded.rank_hash(7, "example", key)).alias("rank_hash"))


@query("SELECT l_partkey AS problem, l_quantity AS tokens, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R') WHERE n = 1")
def canonical_shortest(spark, d):
    rows = P.first_of_key(attempts(spark, d).where("verified"), ["problem"], ["l_quantity", "l_orderkey", "l_linenumber"])
    return rows.select("problem", F.col("l_quantity").alias("tokens"), "l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT DISTINCT year(l_shipdate)::INT AS round, l_partkey AS problem FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09), c AS (SELECT round, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.round AS one, b.round AS two, count(*) AS shared FROM s a JOIN s b ON a.problem = b.problem AND a.round < b.round GROUP BY ALL)
SELECT one, two, round(shared / (c1.n + c2.n - shared), 9) AS jaccard FROM i JOIN c c1 ON c1.round = one JOIN c c2 ON c2.round = two""")
def jaccard_overlap(spark, d):
    """Overlap of the rounds' solved problems. Pairs of rounds come from each problem's short list of rounds."""
    rounds = attempts(spark, d).where("thin").groupBy("problem").agg(F.array_sort(F.collect_set("round")).alias("rs"))
    sizes = rounds.select(F.explode("rs").alias("round")).groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    pairs = rounds.select(F.explode("rs").alias("one"), "rs").select("one", F.explode("rs").alias("two")).where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("shared"))
    a, b = sizes.select(F.col("round").alias("one"), F.col("n").alias("na")), sizes.select(F.col("round").alias("two"), F.col("n").alias("nb"))
    return rounded(pairs.join(a, "one").join(b, "two").select("one", "two", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard")))


BINS = ["1", "2-3", "4-7", "8+"]
BIN_SQL = "CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 3 THEN '2-3' WHEN p_size <= 7 THEN '4-7' ELSE '8+' END"


@query(f"SELECT {BIN_SQL} AS lines, count(*) AS problems, max(p_size) AS longest FROM part GROUP BY 1")
def length_groups(spark, d):
    return load(spark, d, "part").groupBy(statements.length_group(F.col("p_size")).alias("lines")).agg(F.count(F.lit(1)).alias("problems"), F.max("p_size").alias("longest"))


MATCHED_SQL = f"""WITH r AS (SELECT p_partkey AS problem, {BIN_SQL} AS bin, p_brand, p_brand = 'Brand#1' AS own FROM part),
c AS (SELECT bin, count(*) FILTER (own) AS own, count(*) FILTER (NOT own) AS offered, CASE bin WHEN '8+' THEN 1 WHEN '4-7' THEN 2 WHEN '2-3' THEN 3 ELSE 4 END AS k FROM r GROUP BY 1),
f AS (SELECT 0 AS k, '' AS bin, 0::BIGINT AS quota, 0::BIGINT AS carried UNION ALL SELECT c.k, c.bin, least(own + carried, offered), own + carried - least(own + carried, offered) FROM f JOIN c ON c.k = f.k + 1)
SELECT problem, d.bin, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha256('7:long_ordinary:' || problem)) AS n FROM r WHERE NOT own) d JOIN f ON f.bin = d.bin WHERE n <= quota"""


@query(MATCHED_SQL.replace("WITH r AS", "WITH RECURSIVE r AS", 1))
def matched_in_length(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), statements.length_group(F.col("p_size")).alias("bin"), "p_brand")
    own = rows.where("p_brand = 'Brand#1'")
    return P.matched_in_length(own, rows.where("p_brand <> 'Brand#1'"), "problem", BINS, 7)


@query(sql_rounded(f"WITH {R_SQL}, s AS (SELECT (k + 1) / (n + 2) AS predicted, k, n FROM r) SELECT least(9, floor(predicted * 10))::INT AS bin, count(*) AS problems, avg(predicted) AS mean_predicted, sum(k) / sum(n) AS observed FROM s GROUP BY 1", "mean_predicted", "observed"))
def calibration_bins(spark, d):
    rows = results(spark, d).withColumn("predicted", (F.col("k") + 1) / (F.col("n") + 2))
    return rounded(rows.groupBy(F.least(F.lit(9), F.floor(F.col("predicted") * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("problems"), F.avg("predicted").alias("mean_predicted"), (F.sum("k") / F.sum("n")).alias("observed")))


@query(sql_rounded("SELECT year(l_shipdate)::INT AS round, power(0.8::DOUBLE, 2001 - year(l_shipdate)) AS weight, count(*) AS observations FROM lineitem GROUP BY ALL", "weight"))
def recency_weights(spark, d):
    return rounded(attempts(spark, d).groupBy("round").agg(F.count(F.lit(1)).alias("observations")).select("round", F.pow(F.lit(0.8), 2001 - F.col("round")).alias("weight"), "observations"))


@query(sql_rounded(f"""WITH {R_SQL}, s AS (SELECT problem, (k + 1) / (n + 2) AS p FROM r), b AS (SELECT problem, sum((factorial(8) / (factorial(j::INT) * factorial((8 - j)::INT)))::DOUBLE * (j / 8) * power(1 - j / 8, 3) / (0.25 * power(0.75, 3)) * power(p, j) * power(1 - p, 8 - j)) AS expected_reward FROM s, range(9) t(j) GROUP BY 1)
SELECT problem, expected_reward FROM b""", "expected_reward"))
def expected_reward(spark, d):
    p = (F.col("k") + 1) / (F.col("n") + 2)
    return rounded(results(spark, d).select("problem", rates.expected_reward(p, 8, 0.25).alias("expected_reward")))


@query(f"SELECT arm, episode, sum(used) OVER (PARTITION BY arm ORDER BY episode)::DOUBLE AS budget FROM (SELECT l_linestatus AS arm, l_linenumber AS episode, sum(l_quantity) AS used FROM lineitem GROUP BY ALL)")
def cumulative_budget(spark, d):
    used = attempts(spark, d).groupBy(F.col("side").alias("arm"), "episode").agg(F.sum("l_quantity").alias("used"))
    return used.select("arm", "episode", F.sum("used").over(Window.partitionBy("arm").orderBy("episode").rowsBetween(Window.unboundedPreceding, 0)).alias("budget"))


@query("SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, role, text ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earliest FROM conversations")
def known_copies(spark, d):
    w = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, d, "conversations").select("conv_id", "turn", F.min("turn").over(w).alias("earliest"))


@query("SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS moved FROM conversations")
def cut_moves(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", (F.length("text") - F.lag(F.length("text")).over(Window.partitionBy("conv_id", "role").orderBy("turn"))).cast("long").alias("moved"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_answer_per_key(spark, d):
    return S.latest_per_key(load(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL")
def errors_per_minute(spark, d):
    return S.per_minute(load(spark, d, "events").where("event_type = 'error'"), "ts", "event_type")


@query("SELECT value AS kind, n AS answers FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, value LIMIT 3")
def error_kinds_top(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("answers")).orderBy(F.desc("answers"), "kind").limit(3)


TOKEN_SQL = lambda t: f"regexp_matches(text, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_.\'\']){t}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_\'\'])')"


@query(f"SELECT doc_id, CASE WHEN {TOKEN_SQL('the')} THEN 'the' WHEN {TOKEN_SQL('de')} THEN 'de' END AS token FROM documents")
def forbidden_token(spark, d):
    """The first of the tokens, whole words, over the documents of every language."""
    return load(spark, d, "documents").select("doc_id", statements.first_forbidden(F.col("text"), ["the", "de"]).alias("token"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def violations_attempt_twice(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@query("SELECT l_partkey AS problem, count(*) AS alarms FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_linestatus = CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END GROUP BY 1")
def soundness_alarm(spark, d):
    """Verified attempts on the side that a problem's certificate (here: parity of its size) rules out."""
    known = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("ruled_out"))
    return attempts(spark, d).where("verified").join(known, "problem").where("side = ruled_out").groupBy("problem").agg(F.count(F.lit(1)).alias("alarms"))


@query(sql_rounded("""WITH s AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R' AND year(l_shipdate) < 1998) AS a, count(*) FILTER (l_returnflag = 'R' AND year(l_shipdate) >= 1998) AS b FROM lineitem GROUP BY 1)
SELECT section, sum(b) / nullif(sum(a), 0) AS ratio, count(*) AS problems FROM (SELECT 'all' AS section, a, b FROM s UNION ALL SELECT p_brand, a, b FROM s JOIN part ON p_partkey = problem) GROUP BY 1""", "ratio"))
def version_tax_sections(spark, d):
    """Ratio of sums in overlapping sections: one row of counts a problem meets a bridge from problems to sections."""
    side = lambda c: F.count_if(F.col("verified") & c)
    s = attempts(spark, d).groupBy("problem").agg(side(F.col("round") < 1998).alias("a"), side(F.col("round") >= 1998).alias("b"))
    bridged = s.join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_brand"), "problem", "left").select("a", "b", F.explode(F.array_compact(F.array(F.lit("all"), "p_brand"))).alias("section"))
    return rounded(bridged.groupBy("section").agg((F.sum("b") / F.nullif(F.sum("a"), F.lit(0))).alias("ratio"), F.count(F.lit(1)).alias("problems")))


BEAT_SQL = D.BEAT.replace("'", "''")
FIGURES_SQL = f"""{PAIRS_SQL}, d AS (SELECT p_brand, k_before, k_after, (k_after - k_before) / 4 AS change FROM p JOIN part ON p_partkey = problem),
s AS (SELECT p_brand, count(*) AS problems, avg(change) AS mean, avg(change) - 1.96::DOUBLE * stddev_samp(change) / sqrt(count(*)) AS low, avg(change) + 1.96::DOUBLE * stddev_samp(change) / sqrt(count(*)) AS high,
 count(*) FILTER (k_before = 0 AND k_after > 0) AS gained, count(*) FILTER (k_before > 0 AND k_after = 0) AS lost, sum(k_before)::BIGINT AS before, sum(k_after)::BIGINT AS after FROM d GROUP BY 1),
read AS (SELECT *, {SIGN_SQL} AS p_value FROM s)"""


def figures(spark, d):
    """By brand: the paired change with a normal interval, problems gained and lost with their sign test, successes."""
    rows = A.paired(arms(spark, d), "arm", "before", "after").join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_brand"), "problem")
    change, n = (F.col("k_after") - F.col("k_before")) / 4, F.count(F.lit(1))
    half = F.lit(1.96) * F.stddev_samp(change) / F.sqrt(n)
    rows = rows.groupBy("p_brand").agg(
        n.alias("problems"), F.avg(change).alias("mean"), (F.avg(change) - half).alias("low"), (F.avg(change) + half).alias("high"),
        F.count_if(F.expr("k_before = 0 and k_after > 0")).alias("gained"), F.count_if(F.expr("k_before > 0 and k_after = 0")).alias("lost"), F.sum("k_before").alias("before"), F.sum("k_after").alias("after"),
    )
    return rows.withColumn("p_value", rates.sign_probability(F.col("gained"), F.col("lost")))


@query(sql_rounded(f"WITH {FIGURES_SQL} SELECT p_brand, problems, mean, low, high, gained, lost, p_value FROM read", "mean", "low", "high"))
def paired_figures(spark, d):
    return rounded(figures(spark, d).drop("before", "after"))


@query(f"""WITH {FIGURES_SQL} SELECT p_brand, CASE WHEN low > 0 THEN 'improved' WHEN high < 0 THEN 'degraded' ELSE 'no measurable change' END AS label,
CASE WHEN mean IS NULL THEN 'NOT READ' WHEN low > 0 THEN 'UP' WHEN high < 0 THEN 'DOWN' ELSE 'HOLDS' END AS three_way,
CASE WHEN mean >= 0 THEN 'ESCALATE' WHEN mean < -0.004 THEN 'TOKEN_HABIT' ELSE 'ESCALATE' END AS scout,
CASE WHEN problems < 40 THEN 'VOID' WHEN high < 0 THEN 'STOP AND DIAGNOSE' WHEN mean >= 0 THEN 'ESCALATE' ELSE 'NOT NAMED BY THE SPEC' END AS aimed,
CASE WHEN gained > lost AND p_value < 0.05 THEN CASE WHEN low > 0 THEN '{D.GIVES_BACK}' ELSE '{D.UNDOES}' END WHEN low > 0 THEN '{D.KEEPS_ONLY}' ELSE '{D.NOT_THIS_LEVER}' END AS rows_rule,
CASE WHEN low > 0 THEN '{BEAT_SQL}' WHEN high < 0 THEN 'THEY COST' WHEN (high - low) / 2 > 0.0165 THEN '{D.UNDETECTABLE_SEEDS}' ELSE 'NOT SHOWN' END AS draws,
lost > gained AND coalesce(p_value < 0.05, false) AS narrower,
CASE WHEN after >= before THEN 'ESCALATE' WHEN 10000 * (before - after) > 100 * 4 * problems THEN 'COSTS' ELSE 'NOT SHOWN AT ONE SEED' END AS dose,
CASE WHEN 10000 * (after - before) >= 85 * 4 * problems THEN 'ADDS: ESCALATE' WHEN 10000 * (before - after) > 85 * 4 * problems THEN 'COSTS' ELSE 'NOT SHOWN AT ONE SEED' END AS against_bar,
CASE WHEN 10000 * (before - after) > 130 * 4 * problems THEN '{D.AVERAGE_IS_PART}' ELSE '{D.ONE_CONTINUATION}' END AS made_it FROM read""")
def decision_labels(spark, d):
    """The rules over figures by brand; no check failed there."""
    none, c, n = F.lit(0), F.col, F.col("problems") * 4
    own = D.Interval(c("mean"), c("low"), c("high"))
    rules = {
        "three_way": D.three_way(none, own, "UP", "DOWN", "HOLDS"), "scout": D.scout(c("mean"), F.lit(True)), "aimed": D.aimed_round(own, F.lit(0.2), F.lit(0.1), c("problems"), 40),
        "rows_rule": D.rows_rule(none, none, c("problems"), c("gained"), c("lost"), c("p_value"), own), "draws": D.draws(own),
        "dose": D.stock_dose(none, c("after"), n, c("before"), n, 100), "against_bar": D.against_bar(none, c("after"), n, c("before"), n), "made_it": D.what_made_it(none, c("after"), n, c("before"), n),
    }
    named = [rule["name"].alias(name) for name, rule in rules.items()]
    return figures(spark, d).select("p_brand", D.interval_label(own).alias("label"), D.narrower(c("gained"), c("lost"), c("p_value")).alias("narrower"), *named)


@query()
def bootstrap_by_rung(spark, d):
    """Paired change by rung with numpy's resamples: SQL has no such draws, the tests hold it against a plain loop."""
    pairs = A.paired(arms(spark, d), "arm", "before", "after").select("problem", rates.rung(F.col("k_before"), F.col("n_before")).alias("rung"), ((F.col("k_after") - F.col("k_before")) / 4).alias("change"))
    return intervals.bootstrap_by(pairs, "rung", "problem", "change")


@query("""WITH held AS (SELECT p_partkey AS problem FROM part WHERE p_size > 40), mapped AS (SELECT p_partkey AS problem FROM part WHERE p_size <= 10),
candidates AS (SELECT l_partkey AS problem FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09), facts AS (SELECT p_partkey AS problem FROM part WHERE p_size < 10),
r AS (SELECT CASE WHEN p_size > 38 THEN 'heldout' ELSE 'base_map' END AS set, l_partkey AS problem, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 38 OR p_size < 10 GROUP BY ALL)
SELECT DISTINCT rule, problem::VARCHAR AS problem FROM (
SELECT 'candidate twice' AS rule, problem FROM candidates GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'candidate in heldout', problem FROM candidates WHERE problem IN (FROM held) UNION ALL SELECT 'candidate in base_map', problem FROM candidates WHERE problem IN (FROM mapped)
UNION ALL SELECT 'no result of heldout', problem FROM held WHERE problem NOT IN (SELECT problem FROM r WHERE set = 'heldout') UNION ALL SELECT 'no result of base_map', problem FROM mapped WHERE problem NOT IN (SELECT problem FROM r WHERE set = 'base_map')
UNION ALL SELECT 'result outside heldout', problem FROM r WHERE set = 'heldout' AND problem NOT IN (FROM held) UNION ALL SELECT 'result outside base_map', problem FROM r WHERE set = 'base_map' AND problem NOT IN (FROM mapped)
UNION ALL SELECT 'other number of episodes', problem FROM r WHERE set = 'heldout' AND n <> 30
UNION ALL SELECT 'no facts', problem FROM mapped WHERE problem NOT IN (FROM facts) UNION ALL SELECT 'facts outside base_map', problem FROM facts WHERE problem NOT IN (FROM mapped))""")
def violations_round_data(spark, d):
    part = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size")
    tried = attempts(spark, d).join(part, "problem").where("p_size > 38 or p_size < 10").groupBy(F.when(F.col("p_size") > 38, "heldout").otherwise("base_map").alias("set"), "problem")
    found = tried.agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    return C.round_data_violations(part.where("p_size > 40"), part.where("p_size <= 10"), attempts(spark, d).where("thin"), part.where("p_size < 10"), found, 30)


@query("""WITH s AS (SELECT DISTINCT l_partkey AS problem FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount >= 0.09), m AS (SELECT DISTINCT l_partkey AS problem FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.09)
SELECT coalesce(s.problem, m.problem) AS problem, (s.problem IS NOT NULL)::BIGINT AS stored, (m.problem IS NOT NULL)::BIGINT AS made FROM s FULL JOIN m ON s.problem = m.problem WHERE s.problem IS NULL OR m.problem IS NULL""")
def hold_the_sets(spark, d):
    rows = attempts(spark, d)
    return C.set_differences(rows.where("thin and side = 'F'").select("problem").distinct(), rows.where("status = 'rejected' and l_discount >= 0.09").select("problem").distinct(), "problem")


@query("""WITH p AS (SELECT p_partkey AS problem, CASE WHEN p_size % 3 = 0 THEN 'negation' WHEN p_size % 3 = 1 THEN 'statement' END AS out, p_size < 45 AS neg, ('0x' || left(sha256('7:contradicted_side_audit:' || p_partkey), 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 AS audit FROM part)
SELECT problem, side, CASE WHEN out IS DISTINCT FROM side OR audit THEN 'checked' ELSE 'generated_only' END AS done FROM p, (VALUES ('statement'), ('negation')) t(side) WHERE side = 'statement' OR neg""")
def side_plan(spark, d):
    out = F.expr("CASE p_size % 3 WHEN 0 THEN 'negation' WHEN 1 THEN 'statement' END")
    plan = C.side_plan(out, F.col("p_size") < 45, seeded.in_share(7, "contradicted_side_audit", F.col("p_partkey"), 0.1), True)
    return load(spark, d, "part").select(F.col("p_partkey").alias("problem"), F.explode(plan).alias("side", "done"))


@query()
def predictor_scores(spark, d):
    """Rates predicted by the cross-validated fit: iterative, so the tests hold it against numpy instead of SQL."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), F.array(F.col("p_size").cast("double"), F.log1p("p_size"), F.length("p_brand").cast("double")).alias("features"))
    rows = results(spark, d, "verified").join(part, "problem")
    model, dispersion, _ = R.choose(rows, "problem", "features", "k", "n", [1.0, 10.0, 100.0], [0.0, 0.05, 0.1], folds=3, seed=7)
    return part.select("problem", R.predicted(model, F.col("features")).alias("predicted"), F.lit(dispersion).alias("dispersion"))


from . import decision_queries, draw_queries, episode_queries, estimate_queries, join_queries, read_queries, repair_queries, text_queries  # noqa: E402, F401  (they register their queries)
