"""Draws, pools and training sets over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seeded
from ..operators import draws as D
from ..operators import pool as P
from .registry import R_SQL, REWARD_SQL, U_SQL, attempts, first_wins_sql, load, query, results
from .session import working_dir

H = lambda label, key="id": f"sha256('7:{label}:' || {key})"
KEYS = ["grp", "txt", "fp"]
POOL_SQL = "p AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'stp' ELSE 'workbook' END AS kind, 'g' || (p_partkey % 700) AS grp, 't' || p_brand || ':' || p_size AS txt, CASE WHEN p_partkey % 3 = 0 THEN 'f' || CAST(floor(p_retailprice) AS BIGINT) END AS fp FROM part)"
FIRST = "id % 13 = 0"


def pool(spark, d):
    working_dir(spark)
    e = ["p_partkey AS id", "CASE WHEN p_size % 3 = 0 THEN 'stp' ELSE 'workbook' END AS kind", "concat('g', p_partkey % 700) AS grp", "concat('t', p_brand, ':', p_size) AS txt", "CASE WHEN p_partkey % 3 = 0 THEN concat('f', CAST(floor(p_retailprice) AS BIGINT)) END AS fp"]
    return load(spark, d, "part").selectExpr(*e)


ONE = first_wins_sql(f"SELECT * REPLACE ((CASE WHEN {FIRST} THEN '0' ELSE '1' END) || {H('heldout_workbook')} AS pos) FROM (SELECT '' AS pos, * FROM p WHERE kind = 'workbook')", "[grp, txt, fp]")
TWO = first_wins_sql(f"SELECT {H('heldout_stp')} AS pos, p.* FROM p WHERE kind = 'stp' AND NOT list_has_any([grp, txt, coalesce(fp, '-')], (SELECT list_distinct(flatten(list([grp, txt, coalesce(fp, '+')]))) FROM h1))", "[grp, txt, fp]").replace("q AS", "q2 AS").replace("JOIN q ON q.pos", "JOIN q2 ON q2.pos").replace("q.", "q2.").replace("walk", "walk2").replace("kept AS (SELECT", "kept2 AS (SELECT")
HELD_SQL = f"{POOL_SQL}, {ONE}, h1 AS (SELECT p.* FROM p JOIN walk ON walk.id = p.id AND kept ORDER BY walk.pos LIMIT 60), {TWO}, h2 AS (SELECT p.* FROM p JOIN walk2 ON walk2.id = p.id AND kept ORDER BY walk2.pos LIMIT 25), h AS (SELECT *, kind AS part FROM h1 UNION ALL SELECT *, kind FROM h2)"


def heldout(spark, d):
    never = F.lit(False)
    return D.draw_heldout(pool(spark, d), "id", "kind", KEYS, 7, [("workbook", "heldout_workbook", 60, F.expr(FIRST)), ("stp", "heldout_stp", 25, never)])


@query(f"WITH RECURSIVE {HELD_SQL} SELECT id, part FROM h")
def heldout_draw(spark, d):
    """Preferred ids first, then hash order; no two members share group, text or fingerprint, across both parts."""
    return heldout(spark, d).select("id", "part")


SAME = "(grp IN (SELECT grp FROM h) OR txt IN (SELECT txt FROM h) OR coalesce(fp IN (SELECT fp FROM h WHERE fp IS NOT NULL), false))"
APART = first_wins_sql(f"SELECT (CASE WHEN id % 17 = 0 THEN 0 ELSE 1 END) * 10000000000 + id AS pos, p.* FROM p WHERE id NOT IN (SELECT id FROM h) AND NOT {SAME}", "[grp, txt, fp]").replace("q AS", "q3 AS").replace("JOIN q ON q.pos", "JOIN q3 ON q3.pos").replace("q.", "q3.").replace("walk", "walk3").replace("kept AS (SELECT", "kept3 AS (SELECT")


@query(f"WITH RECURSIVE {HELD_SQL}, {APART} SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN 'held' WHEN {SAME} THEN 'same problem as a held one' WHEN id IN (SELECT id FROM kept3) THEN 'pool' ELSE 'copy within the pool' END AS why FROM p")
def pool_apart(spark, d):
    rows = pool(spark, d)
    return D.pool_apart_from(rows, "id", "id", KEYS, heldout(spark, d), rows.where("id % 17 = 0")).select("id", "why")


MAP = first_wins_sql(f"SELECT {H('base_map')} AS pos, p.* FROM p WHERE id % 4 <> 0 AND id NOT IN (SELECT id FROM h) AND NOT {SAME}", "[grp, txt, fp]").replace("q AS", "q4 AS").replace("JOIN q ON q.pos", "JOIN q4 ON q4.pos").replace("q.", "q4.").replace("walk", "walk4").replace("kept AS (SELECT", "kept4 AS (SELECT")
MAP_SQL = f"""WITH RECURSIVE {HELD_SQL}, {MAP}, m AS (SELECT id FROM walk4 WHERE kept ORDER BY pos LIMIT 40), o AS (SELECT row_number() OVER (ORDER BY {H('base_map')}) AS pos, * FROM p)
SELECT id, pos, CASE WHEN id % 4 = 0 THEN 'not verified' WHEN id IN (SELECT id FROM h) THEN 'in the held-out set' WHEN {SAME} THEN 'same problem as a held one' WHEN id IN (FROM m) THEN 'taken' ELSE 'copy within the sample' END AS why
FROM o WHERE (SELECT count(*) FROM m) < 40 OR pos <= (SELECT max(pos) FROM o WHERE id IN (FROM m))"""


@query(MAP_SQL)
def base_map_draw(spark, d):
    """Problems considered for the base map with the reason why each is taken or skipped."""
    rows = pool(spark, d)
    return D.draw_base_map(D.in_order(rows, "id", 7, "base_map"), rows.where("id % 4 <> 0"), "id", "pos", KEYS, heldout(spark, d), 40)


@query(f"""WITH {POOL_SQL} SELECT part, id, pos FROM (SELECT 'present' AS part, id, row_number() OVER (ORDER BY {H('heldout_workbook')}) AS pos FROM p WHERE {FIRST} UNION ALL SELECT * FROM (SELECT 'workbook', id, row_number() OVER (ORDER BY {H('heldout_workbook')}) AS pos FROM p WHERE kind = 'workbook' AND NOT {FIRST}) WHERE pos <= 50
UNION ALL SELECT * FROM (SELECT 'stp', id, row_number() OVER (ORDER BY {H('heldout_stp')}) AS pos FROM p WHERE kind = 'stp') WHERE pos <= 30 UNION ALL SELECT * FROM (SELECT 'all', id, row_number() OVER (ORDER BY {H('base_map')}) AS pos FROM p) WHERE pos <= 70)""")
def slice_parts(spark, d):
    kind = F.col("kind")
    return D.slice_parts(pool(spark, d), "id", [("present", F.expr(FIRST), 7, "heldout_workbook", None), ("workbook", (kind == "workbook") & ~F.expr(FIRST), 7, "heldout_workbook", 50), ("stp", kind == "stp", 7, "heldout_stp", 30), ("all", F.lit(True), 7, "base_map", 70)])


@query(f"WITH {R_SQL} SELECT count(*) AS pool, count(*) FILTER (k > 0 AND 4 * k <= n) AS band, CASE WHEN count(*) FILTER (k > 0 AND 4 * k <= n) >= 150 THEN least(500, count(*) // 3, count(*) FILTER (k > 0 AND 4 * k <= n)) ELSE least(500, count(*) // 3) END::INT AS size, count(*) FILTER (k > 0 AND 4 * k <= n) < 150 AS fills_upward, greatest(37, 1 + floor(1.25::DOUBLE * 37 / (count(*) FILTER (k > 0) / count(*)::DOUBLE)))::INT AS more FROM r")
def set_sizes(spark, d):
    """Size of a training set from pool and band, and how many more candidates 37 missing problems need."""
    row = results(spark, d).agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.expr("k > 0 and 4 * k <= n")).alias("band"), F.count_if(F.expr("k > 0")).alias("taken")).first()
    size, fills = D.set_size(row["pool"], row["band"])
    return spark.createDataFrame([(row["pool"], row["band"], size, fills, D.more_candidates(37, row["taken"], row["pool"]))], "pool bigint, band bigint, size int, fills_upward boolean, more int")


@query(f"WITH {R_SQL}, k AS (SELECT problem AS id, {REWARD_SQL} AS paid, {U_SQL} AS draw FROM r) SELECT id, kept_by FROM (SELECT id, 'the rule' AS kept_by FROM k WHERE draw < paid UNION ALL SELECT * FROM (SELECT id, 'the run''s minimum' FROM k WHERE NOT draw < paid ORDER BY draw, id LIMIT (SELECT greatest(0, 1900 - count(*)) FROM k WHERE draw < paid)))")
def kept_rows(spark, d):
    """Rows kept by their reward, filled up to a minimum by the smallest other draws."""
    rows = results(spark, d).withColumnRenamed("problem", "id")
    return D.kept_by_reward(rows, "id", 0.25, 7, 1900).select("id", "kept_by")


@query(f"""WITH {R_SQL}, s AS (SELECT problem AS id, k FROM r WHERE k = 0 ORDER BY {H('search', 'problem')} LIMIT 30), a AS (SELECT problem AS id, k FROM r WHERE k = 0 AND problem NOT IN (SELECT id FROM s) ORDER BY {H('held_aside', 'problem')} LIMIT 20), o AS (SELECT problem AS id, k FROM r WHERE k BETWEEN 1 AND 2 ORDER BY {H('ordinary', 'problem')} LIMIT 25)
SELECT 'search' AS part, id, k FROM s UNION ALL SELECT 'held aside', id, k FROM a UNION ALL SELECT 'ordinary', id, k FROM o""")
def deep_search_draws(spark, d):
    """Problems never solved for the search, others of them held aside by an order of their own, and ordinary solves."""
    rows = results(spark, d).withColumnRenamed("problem", "id")
    never, solved = rows.where("k = 0"), rows.where("k > 0")
    search = D.drawn_of(never, solved, "id", 30, 7, "search")
    aside = D.drawn_of(never.join(search.select("id"), "id", "left_anti"), solved, "id", 20, 7, "held_aside")
    ordinary = D.drawn_of(rows.where("k between 1 and 2"), solved, "id", 25, 7, "ordinary")
    return search.select(F.lit("search").alias("part"), "id", "k").unionByName(aside.select(F.lit("held aside").alias("part"), "id", "k")).unionByName(ordinary.select(F.lit("ordinary").alias("part"), "id", "k"))


@query(f"WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {H('rehearsal', 'doc_id')}) AS pos FROM documents) SELECT id, CASE WHEN pos <= 100 THEN 'rehearsal' ELSE 'next' END AS part FROM o WHERE pos <= 200")
def rehearsal_rows(spark, d):
    """The rows of the smallest hashes, and the next as many of the same order."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"))
    first = D.next_rows(docs, "id", 100, 7, "rehearsal", 0).select("id", F.lit("rehearsal").alias("part"))
    return first.unionByName(D.next_rows(docs, "id", 100, 7, "rehearsal", 100).select("id", F.lit("next").alias("part")))


@query(f"""WITH {R_SQL}, c AS (SELECT problem, k / n AS score FROM r WHERE problem % 10 <> 0 AND problem NOT IN (SELECT p_partkey FROM part WHERE p_size > 45)), b AS (SELECT * FROM c ORDER BY score DESC, {H('propose', 'problem')} LIMIT 45), o AS (SELECT * FROM c WHERE problem NOT IN (SELECT problem FROM b) ORDER BY {H('random_place', 'problem')} LIMIT 5)
SELECT problem, round(score, 9) AS score, how FROM (SELECT *, 'scored' AS how FROM b UNION ALL SELECT *, 'random_place' FROM o)""")
def propose_batch(spark, d):
    from .registry import rounded

    rows = results(spark, d).select("problem", (F.col("k") / F.col("n")).alias("score"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size")
    return rounded(D.propose_batch(rows, "problem", "score", part.where("problem % 10 = 0"), part.where("p_size > 45"), 50, 0.1, 7))


@query(f"WITH {R_SQL} SELECT problem, round(k / n, 9) AS score FROM r ORDER BY {H('random_arm', 'problem')} LIMIT 40")
def random_control(spark, d):
    """The control arm's draw with the scores beside it."""
    from .registry import rounded

    rows = results(spark, d).select("problem", (F.col("k") / F.col("n")).alias("score"))
    return rounded(P.seeded_draw(rows, "problem", 40, 7, "random_arm").select("problem", "score"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 80")
def learning_progress(spark, d):
    return load(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(80)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {H('training', 'doc_id')}) AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def training_order(spark, d):
    """An order that deletions leave as it is: places by the hash of seed and row id."""
    docs = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return D.in_order(docs, "doc_id", 7, "training").select("doc_id", "pos")


@query(f"SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src1' AND text IS NOT NULL) ORDER BY {H('candidates', 'doc_id')} LIMIT 120")
def ranked_candidates(spark, d):
    """Candidates in hash order without those whose text is excluded."""
    docs = load(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_key"))
    left = P.barred(docs.where("text_key is not null"), docs.where("source = 'src1'"), ["text_key"])
    return P.seeded_draw(left, "doc_id", 120, 7, "candidates").select("doc_id")


@query("""WITH o AS (SELECT l_partkey AS problem, year(l_shipdate) AS round, l_returnflag = 'R' AND l_discount >= 0.09 AS won, l_orderkey FROM lineitem),
r AS (SELECT problem, min(round) AS round FROM o WHERE won GROUP BY 1), s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_discount >= 0.09) SELECT problem, round::INT AS round FROM r WHERE round <= 1996 AND problem NOT IN (FROM s)""")
def accumulated_rows(spark, d):
    """Rows of the rounds so far, one a problem, without problems resolved at the start."""
    rows = attempts(spark, d).where("thin")
    return D.accumulated(rows.groupBy("problem").agg(F.min("round").alias("round")), "problem", 1996, rows.where("l_linenumber = 1").select("problem").distinct())


@query(f"""WITH {R_SQL}, e AS (SELECT problem, CASE WHEN k = 0 THEN 'search' WHEN k / n < 0.1 THEN 'rare' ELSE 'common' END AS kind, {H('ceiling', 'problem')} AS h FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) AS nth FROM e) SELECT problem, kind FROM n WHERE kind = 'rare' OR nth <= CASE kind WHEN 'search' THEN 40 ELSE 60 END""")
def ceiling_choice(spark, d):
    """All of one kind and hash draws of the others."""
    p = F.col("k") / F.col("n")
    kind = lambda df: F.when(F.col("k") == 0, "search").when(p < 0.1, "rare").otherwise("common")
    return D.one_of_each_kind(results(spark, d), "problem", kind, {"search": 40, "rare": None, "common": 60}, 7, "ceiling").select("problem", "kind")


@query("""WITH f AS (SELECT l_partkey AS problem, l_linestatus AS side, CAST(l_quantity AS BIGINT) AS proof, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT *, row_number() OVER (PARTITION BY problem, side, proof ORDER BY l_orderkey, l_linenumber) AS c FROM f)
SELECT problem, side, proof, l_orderkey, l_linenumber, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY problem, side ORDER BY l_orderkey, l_linenumber, proof) AS nth FROM c WHERE c = 1) WHERE nth <= 3""")
def harvest_rows(spark, d):
    """Distinct failed attempts a problem and side, at most three in order."""
    rows = attempts(spark, d).where("status = 'rejected'").select("problem", "side", F.col("l_quantity").cast("bigint").alias("proof"), "l_orderkey", "l_linenumber")
    return D.harvested(rows, "problem", "side", "proof", ["l_orderkey", "l_linenumber", "proof"], 3)


@query(f"SELECT doc_id FROM documents ORDER BY {H('held_back', 'doc_id')} LIMIT (SELECT floor(count(*) * 0.15)::BIGINT FROM documents)")
def held_back_share(spark, d):
    return D.held_back(load(spark, d, "documents").select("doc_id"), "doc_id", 0.15, 7, "held_back").select("doc_id")


@query(f"""WITH o AS (SELECT doc_id AS id, 'own' AS origin FROM documents WHERE source = 'src2' ORDER BY {H('own', 'doc_id')} LIMIT 20), p AS (SELECT doc_id AS id, 'published' AS origin FROM documents WHERE source = 'src3' ORDER BY {H('published', 'doc_id')} LIMIT 20)
SELECT id, origin, row_number() OVER (ORDER BY sha256('7:set:' || (origin || ':' || id))) AS pos FROM (FROM o UNION ALL FROM p)""")
def two_halves(spark, d):
    """A set of own and published halves, each a hash draw, in one order by hash of the row's id (origin and problem)."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    own, published = (P.seeded_draw(docs.where(F.col("source") == s), "id", 20, 7, o).select("id", F.lit(o).alias("origin")) for s, o in (("src2", "own"), ("src3", "published")))
    both = own.unionByName(published).withColumn("row_id", F.concat_ws(":", "origin", "id"))
    return D.in_order(both, "row_id", 7, "set").select("id", "origin", "pos")


@query()
def random_selection(spark, d):
    """numpy's permutation of the sorted ids: the tests hold it against numpy."""
    return D.permuted(load(spark, d, "part").select("p_partkey"), "p_partkey", 100, 7)


@query("SELECT p_partkey AS problem, ('0x' || left(sha256('7:sample:' || p_partkey), 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM part QUALIFY row_number() OVER (ORDER BY sha256('7:sample:' || p_partkey)) <= 25")
def sample_positions(spark, d):
    """A fixed sample by hash order, with each one's draw."""
    rows = P.seeded_draw(load(spark, d, "part").select(F.col("p_partkey").alias("problem")), "problem", 25, 7, "sample")
    return rows.select("problem", seeded.uniform(7, "sample", F.col("problem")).alias("draw"))
