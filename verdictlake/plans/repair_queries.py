"""Repair texts and the remaining small reads, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import repair_text as X
from ..functions import source_text as T
from ..operators import attempts as A
from ..operators import reads as R
from .registry import ORDER, ORDER_SQL, PAIRS_SQL, R_SQL, arms, attempts, load, query, results, rounded, sql_rounded
from .text_queries import by_shape, shaped

K = "p_partkey"
STATEMENT = "theorem t : 1 = 1 := by\n"
LINE = (T.HEADER + STATEMENT).count("\n") + 1  # the first line of a proof


def errors(*at: tuple) -> str:
    return json.dumps([{"line": line, "column": c, "text": t} for line, c, t in at])


# proof, errors -> kind, kept, failed step, reason; continuation -> repeats
CUTS = [
    ("  simp\n  rfl\n  omega", errors((LINE + 1, 2, "x")), "body", 1, "rfl", None, "  rfl -- again\n  x", True), ("  simp\n  nlinarith [a,\n    b_{k}]", errors((LINE + 2, 4, "unknown")), "body", 1, "nlinarith [a,", None, "  linarith", False),
    ("  simp\n", errors((LINE - 1, 0, "unsolved goals\n⊢ x")), "whole_proof", 1, None, None, "  simp", None), ("  simp\n", errors((LINE - 1, 0, "type mismatch")), None, None, None, "error_on_the_statement", "  simp", None), ("  simp", "[]", None, None, None, "no_error_position", "", None),
    ("  a\n  exact (b", errors((LINE + 7, 0, "unexpected end")), "body", 1, "exact (b", None, "exact (b", True), ("  a\n  b", errors((LINE + 2, 0, "end")), "whole_proof", 2, None, None, "x", None), ("  simp [\"(\"]\n  -- (\n  done_{k}", errors((LINE + 2, 2, "e"), (LINE - 1, 0, "unsolved goals")), "body", 2, "done_{k}", None, "\n  done_{k}", True),
]


@query(f"SELECT p_partkey, {by_shape(K, [c[2] for c in CUTS])} AS kind, CAST({by_shape(K, [c[3] for c in CUTS])} AS INT) AS kept, {by_shape(K, [c[4] for c in CUTS])} AS failed_step, {by_shape(K, [c[5] for c in CUTS])} AS reason, CAST({by_shape(K, [None if c[7] is None else int(c[7]) for c in CUTS])} AS BOOLEAN) AS repeats, sha256({by_shape(K, [None if c[2] is None else T.HEADER + STATEMENT + ''.join(x + chr(10) for x in c[0].rstrip().split(chr(10))[: c[3]]) + '  all_goals sorry' + chr(10) for c in CUTS])}) AS state_sha FROM part")
def cut_plans(spark, d):
    """Where failed proofs are cut, the source that asks for the state there, and whether what follows repeats the failed step."""
    rows = load(spark, d, "part").select(K, shaped(K, [c[0] for c in CUTS]).alias("proof"), shaped(K, [c[1] for c in CUTS]).alias("errors"), shaped(K, [c[6] for c in CUTS]).alias("next"))
    rows = rows.withColumn("cut", X.cut_of(F.col("proof"), F.lit(STATEMENT), F.col("errors")))
    state = T.arrow(lambda kept, p, i: X.state_source(STATEMENT, p, int(kept), i), "string", F.col("cut.kept"), F.col("proof"), F.col("cut.indentation"))
    return rows.select(K, "cut.kind", "cut.kept", "cut.failed_step", "cut.reason", X.repeats_step(F.col("next"), F.col("cut.failed_step")).alias("repeats"), F.sha2(F.when(F.col("cut.kept").isNotNull(), state), 256).alias("state_sha"))


HARVESTS = [
    ("  have h : 1 = 1 := by simp\n  have k : h = {k} := by\n    exact h\n  omega", 4, ["  have h_g2 : 1 = 1 := by simp", "  have k_g2 : h_g2 = {k} := by\n    exact h_g2"], "  omega", "not_a_have"), ("  have h : 1 = 1 := by simp\n  have h : 2 = 2 := by simp\n  exact h", 1, ["  have h_g2 : 1 = 1 := by simp"], None, "the_error"),
    ("    have : a := b\n    have ⟨x, hx⟩ := this\n    y", 3, ["  have : a := b"], None, "not_a_have"), ("simp\n x", 2, [], "  simp\n   x", "not_a_have"), ("  a\n b", 2, [], None, "layout"), ("  have h : p := by simp\n  <;> omega\n  done", 3, [], None, "have_goes_on"), ("  have h : (a := b)\n  done", 2, [], None, "no_proof"),
    ("  have h : q := r\n  have g : q := s\n  exact ⟨h, g.1, x.h⟩", 3, ["  have h_g2 : q := r"], "  exact ⟨h_g2, h_g2.1, x.h⟩", "not_a_have"),
]


@query(f"SELECT p_partkey, {by_shape(K, ['|'.join(h[2]) for h in HARVESTS])} AS lemmas, {by_shape(K, [h[3] for h in HARVESTS])} AS closer, {by_shape(K, [h[4] for h in HARVESTS])} AS ended FROM part")
def harvested_lemmas(spark, d):
    """Lemmas and closing step that failed proofs leave, under names of their generation."""
    kept = F.element_at(F.array(*[F.lit(h[1]) for h in HARVESTS]), (F.col(K) % len(HARVESTS) + 1).cast("int"))
    rows = load(spark, d, "part").select(K, X.harvest_of(shaped(K, [h[0] for h in HARVESTS]), kept, F.lit(2)).alias("h"))
    return rows.select(K, F.concat_ws("|", "h.texts").alias("lemmas"), "h.closer", "h.ended")


@query(sql_rounded("WITH v AS (SELECT vec_id, embedding, lag(embedding) OVER (ORDER BY vec_id) AS before FROM embeddings) SELECT vec_id, list_sum(list_transform(list_zip(embedding, before), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS dot, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM v WHERE before IS NOT NULL", "dot", "norm"))
def vector_products(spark, d):
    """Dot product with the vector before, and the norm."""
    w = Window.orderBy("vec_id")  # a check of the expressions on a small table
    rows = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("b", F.lag("v").over(w)).where("b is not null")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return rounded(rows.select("vec_id", dot(F.col("v"), F.col("b")).alias("dot"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm")))


@query(f"WITH {R_SQL} SELECT problem, CASE WHEN k * 1000 >= n * 50 THEN '+' ELSE '-' END || printf('%.2f', abs(round(1000.0::DOUBLE * k / n - 50, 6))) AS said, CASE problem % 3 WHEN 0 THEN 'own:' || problem || ':' || k WHEN 1 THEN 'published:' || problem ELSE 'assembled:' || problem || '#' || n END AS row_id FROM r")
def row_labels(spark, d):
    """Signed per-1,000 texts, and the ids of rows by their origin."""
    diff = F.round(1000.0 * F.col("k") / F.col("n") - 50, 6)
    said = F.concat(F.when(F.col("k") * 1000 >= F.col("n") * 50, "+").otherwise("-"), F.format_string("%.2f", F.abs(diff)))
    p = F.col("problem").cast("string")
    row_id = F.when(F.col("problem") % 3 == 0, F.concat_ws(":", F.lit("own"), p, "k")).when(F.col("problem") % 3 == 1, F.concat_ws(":", F.lit("published"), p)).otherwise(F.concat(F.lit("assembled:"), p, F.lit("#"), F.col("n").cast("string")))
    return results(spark, d).select("problem", said.alias("said"), row_id.alias("row_id"))


@query("WITH n AS (SELECT 'lemma_' || (l_suppkey % 40) AS name, l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'R') SELECT name, count(DISTINCT l_orderkey) AS certificates, count(DISTINCT l_partkey) AS problems, count(*) FILTER (l_returnflag = 'A') AS by_a, count(*) FILTER (l_returnflag = 'N') AS by_n FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def missing_names(spark, d):
    """The 20 most missed names: distinct certificates and problems, and rows by source."""
    rows = load(spark, d, "lineitem").where("l_returnflag <> 'R'").withColumn("names", F.array(F.concat(F.lit("lemma_"), (F.col("l_suppkey") % 40).cast("string"))))
    each = rows.withColumn("name", F.explode("names")).groupBy("name").agg(F.count_distinct("l_orderkey").alias("certificates"), F.count_distinct("l_partkey").alias("problems"), F.count_if(F.col("l_returnflag") == "A").alias("by_a"), F.count_if(F.col("l_returnflag") == "N").alias("by_n"))
    return each.orderBy(F.desc("certificates"), "name").limit(20)


@query("SELECT l_suppkey % 7 AS batch, count(DISTINCT l_partkey) AS problems, count(*) AS checks, count(*) FILTER (l_returnflag = 'R') AS verified, count(*) FILTER (l_returnflag = 'N') AS unanswered FROM lineitem GROUP BY 1")
def batch_counts(spark, d):
    rows = attempts(spark, d).groupBy((F.col("l_suppkey") % 7).alias("batch"))
    return rows.agg(F.count_distinct("problem").alias("problems"), F.count(F.lit(1)).alias("checks"), F.count_if("verified").alias("verified"), F.count_if(F.col("status") == "no_answer").alias("unanswered"))


@query(sql_rounded(f"WITH o AS (SELECT l_partkey AS problem, l_returnflag = 'R' AND l_discount >= 0.09 AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER_SQL}) AS place FROM lineitem), f AS (SELECT problem, min(place) FILTER (v) AS s FROM o GROUP BY 1), b AS (SELECT CASE WHEN s IS NULL THEN 'none' WHEN s <= 8 THEN '1-8' WHEN s <= 16 THEN '9-16' WHEN s <= 32 THEN '17-32' WHEN s <= 64 THEN '33-64' ELSE '65+' END AS band FROM f) SELECT band, count(*) AS problems, 1000 * count(*) / (SELECT count(*) FROM f) AS per_1000 FROM b GROUP BY 1", "per_1000"))
def search_table(spark, d):
    """Problems by the doubling band of their first success, and per 1,000 problems."""
    place = F.row_number().over(Window.partitionBy("problem").orderBy(*ORDER))
    first = attempts(spark, d).withColumn("place", place).groupBy("problem").agg(F.min(F.when(F.col("thin"), F.col("place"))).alias("s"))
    s = F.col("s")
    band = F.when(s.isNull(), "none").when(s <= 8, "1-8").when(s <= 16, "9-16").when(s <= 32, "17-32").when(s <= 64, "33-64").otherwise("65+")
    counts = first.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("problems"))
    return rounded(counts.withColumn("per_1000", 1000 * F.col("problems") / F.sum("problems").over(Window.partitionBy(F.lit(1)))))  # a row a band


GROUP_SQL = "CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 3 THEN '2-3' WHEN p_size <= 7 THEN '4-7' ELSE '8+' END"


@query(sql_rounded(f"WITH {PAIRS_SQL}, x AS (SELECT {GROUP_SQL} AS lines, p.* FROM p JOIN part ON p_partkey = problem) SELECT lines, count(*) AS problems, avg(k_before / n_before) AS mean_before, avg(k_after / n_after) AS mean_after, avg(k_after / n_after - k_before / n_before) AS mean_change, count(*) FILTER (k_before = 0 AND k_after > 0) AS gained, count(*) FILTER (k_before > 0 AND k_after = 0) AS lost FROM x GROUP BY 1", "mean_before", "mean_after", "mean_change"))
def change_by_proof_length(spark, d):
    from ..functions.statements import length_group

    rows = A.paired(arms(spark, d), "arm", "before", "after").join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size"), "problem")
    return rounded(A.change_by(rows, length_group(F.col("p_size")), "lines"))


@query(f"WITH {R_SQL} SELECT {GROUP_SQL} AS lines, count(*) AS problems, count(*) FILTER (k > 0) AS solved, count(*) FILTER (k = 0 AND problem % 5 = 0) AS by_assembly FROM r JOIN part ON p_partkey = problem GROUP BY 1")
def assembly_by_length(spark, d):
    from ..functions.statements import length_group

    rows = results(spark, d).join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size"), "problem")
    return rows.groupBy(length_group(F.col("p_size")).alias("lines")).agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("k") > 0).alias("solved"), F.count_if((F.col("k") == 0) & (F.col("problem") % 5 == 0)).alias("by_assembly"))


@query(sql_rounded("WITH t AS (SELECT sum(l_quantity) AS tokens, count(*) AS checks, sum(l_extendedprice) / 1000 AS seconds FROM lineitem) SELECT tokens / seconds AS tokens_a_second, checks / seconds AS checks_a_second, 1000000 / (tokens / seconds) + 20000 / (checks / seconds) / 4 AS seconds_wanted FROM t", "tokens_a_second", "checks_a_second", "seconds_wanted").replace(", 9)", ", 6)"))
def run_time_estimate(spark, d):
    """What a run of a million tokens and 20,000 checks on four workers takes at the measured rates."""
    sums = load(spark, d, "lineitem").agg(F.sum("l_quantity").alias("tokens"), F.count(F.lit(1)).alias("checks"), (F.sum("l_extendedprice") / 1000).alias("seconds"))
    rates_ = sums.select((F.col("tokens") / F.col("seconds")).alias("tokens_a_second"), (F.col("checks") / F.col("seconds")).alias("checks_a_second"))
    return rounded(rates_.withColumn("seconds_wanted", 1_000_000 / F.col("tokens_a_second") + 20_000 / F.col("checks_a_second") / 4), 6)


@query(f"WITH o AS (SELECT l_partkey AS problem, l_linestatus AS side, l_returnflag = 'R' AS v, (row_number() OVER (PARTITION BY l_partkey, l_linestatus ORDER BY {ORDER_SQL}) - 1) // 8 AS episode FROM lineitem), e AS (SELECT problem, side, episode, bool_or(v) AS won FROM o GROUP BY ALL HAVING count(*) = 8), p AS (SELECT problem, side, count(*) AS episodes, count(*) FILTER (won) AS resolved FROM e GROUP BY ALL) SELECT side, count(*) AS problems, count(*) FILTER (resolved >= 1) AS at_least_one, count(*) FILTER (4 * resolved >= episodes) AS at_least_a_quarter, count(*) FILTER (2 * resolved >= episodes) AS at_least_half, count(*) FILTER (10 * resolved >= 9 * episodes) AS at_least_nine_tenths FROM p GROUP BY 1")
def goal_episodes(spark, d):
    """Samplings cut into episodes of 8 by problem and side, the rest dropped; how reliably problems are resolved."""
    rows = attempts(spark, d).withColumn("key", F.struct("problem", "side"))
    own = A.chunked(rows, "key", ORDER, 8).select("key.side", "episodes", "resolved")
    at = lambda num, den: F.count_if(den * F.col("resolved") >= num * F.col("episodes"))
    return own.groupBy("side").agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("resolved") >= 1).alias("at_least_one"), at(1, 4).alias("at_least_a_quarter"), at(1, 2).alias("at_least_half"), at(9, 10).alias("at_least_nine_tenths"))


@query("WITH c AS (SELECT o_custkey AS problem, o_custkey % 4 AS part, min(o_orderdate) FILTER (o_orderstatus = 'F') AS won, min(o_orderdate) FILTER (o_orderstatus NOT IN ('F', 'O')) AS waits FROM orders GROUP BY 1) SELECT part, CASE WHEN won IS NOT NULL AND (waits IS NULL OR won < waits) THEN 'in' WHEN waits IS NOT NULL THEN 'open' ELSE 'out' END AS state, count(*) AS problems FROM c GROUP BY ALL")
def slice_status(spark, d):
    """Settled states of a slice's problems by part."""
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("problem"), F.col("o_orderdate").alias("pos"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' END").alias("status"))
    return A.settled(rows, "problem", "pos", "status").groupBy((F.col("problem") % 4).alias("part"), "state").agg(F.count(F.lit(1)).alias("problems"))


@query("SELECT source, status, count(*) AS proofs, max(seconds) AS slowest FROM (SELECT 'orders' AS source, o_orderstatus AS status, o_totalprice::DOUBLE AS seconds FROM orders UNION ALL SELECT 'lines', l_returnflag, l_extendedprice::DOUBLE FROM lineitem UNION ALL SELECT 'events', event_type, value::DOUBLE FROM events) GROUP BY ALL")
def version_gate(spark, d):
    """Known-good proofs of several sources: status counts and the slowest by source."""
    one = lambda name, t, s, v: load(spark, d, t).select(F.lit(name).alias("source"), F.col(s).alias("status"), F.col(v).cast("double").alias("seconds"))
    rows = one("orders", "orders", "o_orderstatus", "o_totalprice").unionByName(one("lines", "lineitem", "l_returnflag", "l_extendedprice")).unionByName(one("events", "events", "event_type", "value"))
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("proofs"), F.max("seconds").alias("slowest"))


@query(sql_rounded("SELECT o_orderpriority AS stratum, count(*) FILTER (o_orderstatus <> 'P') AS answered, count(*) FILTER (o_orderstatus = 'F') AS compile, count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0) AS survival FROM orders GROUP BY 1", "survival"))
def statement_survival(spark, d):
    """Statements that compile at the later version of those answered, by group."""
    rows = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum"))
    found = rows.agg(F.count_if(F.col("o_orderstatus") != "P").alias("answered"), F.count_if(F.col("o_orderstatus") == "F").alias("compile"))
    return rounded(found.withColumn("survival", F.col("compile") / F.nullif("answered", F.lit(0))))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL AND lang = 'en' ORDER BY doc_id")
def of_one_split(spark, d):
    """The rows of one split, by id."""
    from ..sources.files import of_split

    return of_split(load(spark, d, "documents").where("n_chars is not null").withColumnRenamed("lang", "split"), "en", "doc_id").select("doc_id", "n_chars")


