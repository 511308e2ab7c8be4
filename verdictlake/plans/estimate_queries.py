"""Estimators over seeds and versions, training files, logs, sources and streams over whole tables, each beside its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attempts as A
from ..operators import estimates as E
from ..operators import reads as R
from ..operators import selection
from ..operators import training as T
from ..sources import files, jsonl
from ..streaming import blocks
from .registry import PAIRS_SQL, R_SQL, arms, attempts, load, query, results, rounded, sql_rounded
from .session import working_dir


def new_folder(spark, name: str) -> str:
    working_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(sql_rounded(f"WITH {PAIRS_SQL} SELECT p_brand, count(*) AS problems, avg(k_after / n_after - k_before / n_before) AS change, 1000 * sum(k_before) / sum(n_before) AS per_1000_before, 1000 * sum(k_after) / sum(n_after) AS per_1000_after, sum(k_after)::BIGINT AS successes, sum(n_after)::BIGINT AS attempts FROM p JOIN part ON p_partkey = problem GROUP BY 1", "change", "per_1000_before", "per_1000_after"))
def per_attempt_paired(spark, d):
    rows = A.paired(arms(spark, d), "arm", "before", "after").join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_brand"), "problem")
    return rounded(E.per_attempt_change(rows, ["p_brand"]))


@query(sql_rounded("""WITH e AS (SELECT l_partkey AS problem, l_suppkey % 3 AS episode, avg((l_returnflag = 'R')::INT) FILTER (l_linestatus = 'O') AS a, avg((l_returnflag = 'R')::INT) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_linestatus = 'O') > 0 AND count(*) FILTER (l_linestatus = 'F') > 0) SELECT problem, count(*) AS episodes, avg(a - b) AS change FROM e GROUP BY 1""", "change"))
def repair_paired(spark, d):
    """Two arms paired by episode, then the mean of a problem's episodes."""
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("verified").cast("int")))
    each = attempts(spark, d).groupBy("problem", (F.col("l_suppkey") % 3).alias("ep")).agg(side("O").alias("a"), side("F").alias("b")).where("a is not null and b is not null")
    return rounded(each.groupBy("problem").agg(F.count(F.lit(1)).alias("episodes"), F.avg(F.col("a") - F.col("b")).alias("change")))


@query(sql_rounded("WITH r AS (SELECT l_partkey AS problem, year(l_shipdate) AS seed, avg((l_returnflag = 'R')::INT) AS v FROM lineitem GROUP BY ALL) SELECT problem, avg(v) AS mean_rate, count(*) AS seeds FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT seed) FROM r)", "mean_rate"))
def mean_over_seeds(spark, d):
    rows = attempts(spark, d).groupBy("problem", "round").agg(R.share(F.col("verified")).alias("v"))
    return rounded(E.over_seeds(rows, "problem", "round", F.col("v"), "mean_rate"))


DIFF_SQL = "x AS (SELECT year(l_shipdate) AS seed, (avg((l_returnflag = 'R')::INT) FILTER (l_linenumber % 3 = 0) + avg((l_returnflag = 'R')::INT) FILTER (l_linenumber % 3 = 1)) / 2 - avg((l_returnflag = 'R')::INT) FILTER (l_linenumber % 3 = 2) AS difference FROM lineitem GROUP BY 1)"


def seed_differences(spark, d):
    rows = attempts(spark, d).groupBy(F.col("round").alias("seed"), (F.col("l_linenumber") % 3).cast("string").alias("arm")).agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    return E.per_seed_difference(rows, "seed", "arm", ["0", "1"], "2")


@query(sql_rounded(f"WITH {DIFF_SQL} SELECT seed::INT AS seed, difference FROM x", "difference"))
def differences_per_seed(spark, d):
    return rounded(seed_differences(spark, d))


@query(sql_rounded(f"WITH {DIFF_SQL} SELECT avg(difference) AS mean, stddev_samp(difference) AS sd, avg(difference) - 2.4469118511449692 * stddev_samp(difference) / sqrt(count(*)) AS low, avg(difference) + 2.4469118511449692 * stddev_samp(difference) / sqrt(count(*)) AS high FROM x", "mean", "sd", "low", "high"))
def difference_interval(spark, d):
    """Student's interval over the seeds' differences (the SQL has the critical value of the seven years there are)."""
    return rounded(E.t_interval(seed_differences(spark, d), "difference"))


@query("WITH s AS (SELECT p_partkey AS problem, count(l_partkey) FILTER (year(l_shipdate) >= 1998 AND l_returnflag = 'R' AND l_discount >= 0.09) AS a, count(l_partkey) FILTER (year(l_shipdate) < 1995 AND l_returnflag = 'R' AND l_discount >= 0.09) AS b FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) SELECT count(*) AS problems, count(*) FILTER (a > 0) AS resolved_after, count(*) FILTER (b > 0) AS resolved_before, count(*) FILTER (a > 0 AND b > 0) AS by_both, count(*) FILTER (a > 0 AND b = 0) AS gained, count(*) FILTER (a = 0 AND b > 0) AS lost FROM s")
def equal_attempts_reach(spark, d):
    """The last rounds against the first ones with a control's attempts added, over the same problems."""
    from ..operators.joins import added

    base = load(spark, d, "part").select(F.col("p_partkey").alias("problem"))
    of = lambda c: base.join(attempts(spark, d).where(c).groupBy("problem").agg(F.count_if("thin").alias("k"), F.count(F.lit(1)).alias("n")), "problem", "left").na.fill(0, ["k", "n"])
    before = added([of("round < 1993"), of("round between 1993 and 1994")], "problem", ["k", "n"])
    return E.reach(of("round >= 1998"), before.drop("samplings"), "problem")


@query("SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n, count(DISTINCT year(l_shipdate)) AS seeds FROM lineitem GROUP BY 1")
def pooled_over_seeds(spark, d):
    """Every problem over all seeds, as all of them were read (each verified something)."""
    rows = attempts(spark, d).groupBy("problem", "round").agg(F.count_if("verified").alias("k"), F.count(F.lit(1)).alias("n"))
    seen = rows.groupBy("round").agg((F.sum("k") > 0).alias("read"))
    return E.pooled(rows.join(seen, "round"), "round", "read", "problem")


V_SQL = "v AS (SELECT l_partkey AS problem, count(*) AS drawn, count(*) FILTER (l_returnflag = 'R' AND year(l_shipdate) < 1997) AS earlier, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.04) AS later FROM lineitem GROUP BY 1), s AS (SELECT 'overall' AS section, * FROM v UNION ALL SELECT CASE WHEN earlier / drawn <= 0 THEN '0' WHEN earlier / drawn <= 0.25 THEN '(0, 0.25]' WHEN earlier / drawn <= 0.75 THEN '(0.25, 0.75]' ELSE '(0.75, 1]' END, * FROM v UNION ALL SELECT p_brand, v.* FROM v JOIN part ON p_partkey = problem)"


def version_sections(spark, d):
    from ..functions.verdicts import band_label

    rows = attempts(spark, d).groupBy("problem").agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("verified") & (F.col("round") < 1997)).alias("earlier"), F.count_if(F.col("verified") & (F.col("l_discount") >= 0.04)).alias("later"))
    rows = rows.join(load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_brand"), "problem", "left")
    names = F.array_compact(F.array(F.lit("overall"), band_label(F.col("earlier") / F.col("drawn"), [0.25, 0.75]), "p_brand"))
    return rows.select("problem", "drawn", "earlier", "later", F.explode(names).alias("section"))


@query(sql_rounded(f"WITH {V_SQL} SELECT section, count(*) AS statements, sum(drawn)::BIGINT AS attempts, sum(earlier)::BIGINT AS verified_earlier, sum(later)::BIGINT AS verified_later, count(*) FILTER (earlier > 0) AS solved_earlier, count(*) FILTER (later > 0) AS solved_later, count(*) FILTER (earlier > 0 AND later > 0) AS solved_at_both, sum(later) / nullif(sum(earlier), 0) AS share, (sum(later) - sum(earlier)) / sum(drawn) AS difference FROM s GROUP BY 1", "share", "difference"))
def version_comparison(spark, d):
    """Two versions overall, by band of the earlier rate and by group: one scan, statements in each of their sections."""
    rows = version_sections(spark, d)
    found = rows.groupBy("section").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("drawn").alias("attempts"), F.sum("earlier").alias("verified_earlier"), F.sum("later").alias("verified_later"), F.count_if(F.col("earlier") > 0).alias("solved_earlier"), F.count_if(F.col("later") > 0).alias("solved_later"),
        F.count_if((F.col("earlier") > 0) & (F.col("later") > 0)).alias("solved_at_both"), (F.sum("later") / F.nullif(F.sum("earlier"), F.lit(0))).alias("share"), ((F.sum("later") - F.sum("earlier")) / F.sum("drawn")).alias("difference"),
    )
    return rounded(found)


@query()
def version_intervals(spark, d):
    """Their intervals by resampling statements with numpy's draws: the tests hold them against a plain loop."""
    return E.version_intervals(version_sections(spark, d), "section", "problem")


@query(sql_rounded("SELECT p_partkey, [(p_type = 'STANDARD')::INT::DOUBLE, (p_type = 'PROMO')::INT::DOUBLE, ln(1 + p_size), ln(1 + length(p_name)), p_size / 50] AS features FROM part").replace("SELECT * REPLACE () FROM", "SELECT p_partkey, list_transform(features, lambda x: round(x, 9)) AS features FROM"))
def fact_features(spark, d):
    rows = load(spark, d, "part").withColumn("name_chars", F.length("p_name"))
    features, _ = E.fact_features({"p_type": ["STANDARD", "PROMO"]}, ["p_size", "name_chars"], "p_size")
    return rows.select("p_partkey", F.transform(F.concat(features, F.array().cast("array<double>")), lambda x: F.round(x, 9)).alias("features"))


@query(f"WITH {R_SQL} SELECT problem, k, n, 0::INT AS round FROM r WHERE problem % 4 = 0 UNION ALL SELECT problem, k, n, (problem % 4)::INT FROM r WHERE problem % 4 IN (1, 2)")
def refit_observations(spark, d):
    rows = results(spark, d)
    batch = lambda c, r: rows.where(c).select("problem", "k", "n", r.cast("int").alias("round"))
    return E.refit_observations(batch("problem % 4 = 0", F.lit(0)), batch("problem % 4 in (1, 2)", F.col("problem") % 4), "problem")


# Training files
FILE_SQL = "f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS problem, CASE WHEN l_partkey % 2 = 0 THEN 'own' ELSE 'published' END AS origin, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) + CASE WHEN l_quantity > 49 THEN 100000000 ELSE 0 END AS pos, CASE WHEN l_tax < 0.01 THEN ' ' ELSE 'p' END AS proof FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08)"


@query(f"""WITH {FILE_SQL}, v AS (SELECT 'id twice' AS rule, id::VARCHAR AS id FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'problem twice', min(id::VARCHAR) FROM f GROUP BY origin, problem HAVING count(*) > 1 UNION ALL SELECT 'barred problem', id::VARCHAR FROM f WHERE problem % 97 = 0 UNION ALL SELECT 'unknown problem', id::VARCHAR FROM f WHERE problem NOT IN (SELECT p_partkey FROM part WHERE p_size < 49)
UNION ALL SELECT 'empty proof', id::VARCHAR FROM f WHERE trim(proof) = '' UNION ALL SELECT 'no such place', id::VARCHAR FROM f WHERE pos > (SELECT count(*) FROM f) UNION ALL SELECT 'other number of rows', origin FROM f GROUP BY origin HAVING count(*) <> 100) SELECT DISTINCT rule, id FROM v""")
def violations_training_file(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")  # a training file's rows
    rows = load(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.08")
    own = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("problem"), F.when(F.col("l_partkey") % 2 == 0, "own").otherwise("published").alias("origin"), (F.row_number().over(w) + F.when(F.col("l_quantity") > 49, 100_000_000).otherwise(0)).alias("pos"), F.when(F.col("l_tax") < 0.01, " ").otherwise("p").alias("proof"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("problem"), "p_size")
    return T.training_violations(own, part.where("problem % 97 = 0"), part.where("p_size < 49"), {"own": 100, "published": 100}).distinct()


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') > 0 AS answered, count(*) FILTER (event_type <> 'error') = 0 AND count(*) >= 2 AS given_up FROM events GROUP BY 1")
def given_up_checks(spark, d):
    return T.given_up(load(spark, d, "events"), "user_id", ["ts"], F.col("event_type") == "error", 2)


@query("WITH r AS (SELECT l_partkey AS problem, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09) AS k FROM lineitem GROUP BY 1) SELECT problem, CASE WHEN k = 0 AND problem % 5 = 0 THEN 1 ELSE k END AS k, problem % 5 = 0 AS by_assembly FROM r")
def results_with_assembly(spark, d):
    rows = results(spark, d).select("problem", "k")
    return T.with_assembly(rows, rows.where("problem % 5 = 0"), "problem")


@query("WITH u AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.09) = 0), a AS (SELECT l_partkey AS problem, l_linestatus AS side, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_linestatus ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_tax > 0.01 AND l_partkey IN (FROM u)) SELECT problem, side, list(l_orderkey ORDER BY n) AS chain FROM a WHERE n <= 8 GROUP BY ALL")
def episodes_to_assemble(spark, d):
    rows = attempts(spark, d)
    unresolved = results(spark, d).where("k = 0")
    return T.to_assemble(rows, unresolved, "problem", "side", F.expr("status = 'rejected' and l_tax > 0.01"), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def refiltered_statements(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_key"))
    return T.refiltered(docs, docs, load(spark, d, "labels").where("quality = 1"), "doc_id", "text_key").select("doc_id", "lang")


@query("WITH e AS (SELECT l_linenumber AS step, count(*) FILTER (l_linestatus = 'O') * 1.0::DOUBLE AS expected, count(*) FILTER (l_linestatus = 'O' AND l_linenumber <> 3) * CASE WHEN l_linenumber = 5 THEN 1.001 ELSE 1 END::DOUBLE AS recorded FROM lineitem GROUP BY 1) SELECT step, expected, CASE WHEN step <> 3 THEN recorded END AS recorded FROM e WHERE step IN (3, 5)")
def violations_training_record(spark, d):
    rows = attempts(spark, d).where("side = 'O'").groupBy(F.col("l_linenumber").alias("step")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    recorded = rows.where("step <> 3").withColumn("value", F.when(F.col("step") == 5, F.col("value") * 1.001).otherwise(F.col("value")))
    return T.record_differences(rows, recorded, "step", "value")


@query(sql_rounded("WITH e AS (SELECT l_partkey, bool_or(l_returnflag = 'R' AND l_discount >= 0.09) AS s, count(*) AS c, sum(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT count(*) FILTER (s) AS settled, count(*) FILTER (NOT s) AS left, sum(c) FILTER (s) / count(*) FILTER (s) AS checks_each, sum(c) / sum(t) AS rate, count(*) FILTER (NOT s) * (sum(c) FILTER (s) / count(*) FILTER (s)) / (sum(c) / sum(t)) AS seconds_left FROM e", "checks_each", "rate", "seconds_left").replace(" AS left,", ' AS "left",').replace("round(seconds_left::DOUBLE, 9)", "round(seconds_left::DOUBLE, 5)"))
def check_progress(spark, d):
    return rounded(T.progress(attempts(spark, d), "problem", F.col("thin"), "l_quantity")).withColumn("seconds_left", F.round("seconds_left", 5))


@query("WITH c AS (SELECT o_custkey AS problem, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderstatus = 'F' AS won FROM orders) SELECT problem, coalesce(min(pos) FILTER (won), max(pos)) AS asked FROM c GROUP BY 1")
def checks_asked(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("problem"), F.row_number().over(w).alias("pos"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("rejected").alias("status"))
    return T.checks_asked(rows, "problem", "pos", "status")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'with' ELSE 'rehearse' END AS recipe, CASE WHEN p_size % 3 > 0 THEN p_size END AS rank, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS seed FROM part")
def arm_names(spark, d):
    """Names of arms written from their parts and read again."""
    rows = load(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN 'with' ELSE 'rehearse' END AS recipe", "CASE WHEN p_size % 3 > 0 THEN p_size END AS rank", "CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS seed")
    named = rows.select("p_partkey", T.arm_parts(T.arm_name(F.col("recipe"), F.col("rank"), F.col("seed"))).alias("a"))
    return named.select("p_partkey", "a.recipe", "a.rank", "a.seed")


@query(f"""WITH {R_SQL} SELECT * FROM (SELECT 'by_hash' AS rule, problem FROM r ORDER BY sha256('7:random:' || problem) LIMIT 20) UNION ALL SELECT * FROM (SELECT 'barely_provable', problem FROM r WHERE k > 0 ORDER BY NOT (k / n <= 0.25), k / n, sha256('7:difficulty:' || problem) LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'half_rate', problem FROM r ORDER BY abs(2 * k - n) * 1000000000000 // n, problem LIMIT 20) UNION ALL SELECT * FROM (SELECT 'learning_progress', problem FROM r ORDER BY n DESC, problem LIMIT 20)""")
def selection_rules(spark, d):
    """Every registered selection rule on one pool."""
    pool = results(spark, d).withColumn("score", F.col("n"))
    return reduce(DataFrame.unionByName, [selection.select(name, pool, 20, 7) for name in selection.RULES])


# Sources and streams
DOCS_SQL = "SELECT doc_id, lang, source, n_chars FROM documents"


def small_docs(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query(DOCS_SQL)
def jsonl_round_trip(spark, d):
    """Rows written as JSON lines and read back, past a line that a kill cut short."""
    folder, rows = new_folder(spark, "jsonl"), small_docs(spark, d)
    jsonl.write_rows(rows, f"{folder}/rows")
    spark.createDataFrame([('{"doc_id": 1, "la',)], "value string").coalesce(1).write.mode("append").text(f"{folder}/rows")
    return jsonl.read_rows(spark, f"{folder}/rows", rows.schema, tolerant=True)


@query(DOCS_SQL)
def manifest_round_trip(spark, d):
    """Tables exported under a manifest and loaded against it."""
    folder = new_folder(spark, "export")
    files.export({"documents": small_docs(spark, d)}, folder, "parent-7")
    return files.load(spark, folder, "documents", "parent-7")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def lines_before_parsing(spark, d):
    """JSON lines of wanted ids, found at the line's start before parsing."""
    folder = new_folder(spark, "lines")
    small_docs(spark, d).write.option("ignoreNullFields", "false").json(folder)
    return files.wanted_lines(spark, folder, "doc_id bigint, lang string", "doc_id", load(spark, d, "labels"))


@query("SELECT part, count(*) AS rows FROM (SELECT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS part FROM documents) GROUP BY 1")
def parts_by_glob(spark, d):
    """A glob of partition folders, each file's rows counted by the folder it is in."""
    folder = new_folder(spark, "parts")
    small_docs(spark, d).write.partitionBy("source").json(folder)
    rows = spark.read.text(f"{folder}/source=*/*.json").withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS split, min(p_partkey) AS p_partkey FROM part WHERE p_size < 40 GROUP BY ALL, p_brand".replace("GROUP BY ALL, p_brand", "GROUP BY p_size % 2, p_brand"))
def json_array_scan(spark, d):
    """A JSON array of rows, theorems only, the first of each text kept, by split."""
    folder = new_folder(spark, "array")
    rows = load(spark, d, "part").orderBy("p_partkey")
    e = F.to_json(F.struct(F.when(F.col("p_size") < 40, F.concat(F.lit("theorem t"), F.col("p_partkey").cast("string"))).otherwise("def x").alias("statement"), F.concat_ws(":", "p_brand", F.col("p_size") % 2).alias("text"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("split"), "p_partkey"))
    lines = rows.select(e.alias("e"), "p_partkey").groupBy().agg(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))).alias("xs"))  # the file is one array by its format
    lines.select(F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["e"]), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(folder)
    found = files.first_statements(files.json_array(spark, folder, "statement string, text string, split string, p_partkey bigint"), "statement", "text")
    return files.of_split(found, "even", "p_partkey").unionByName(files.of_split(found, "odd", "p_partkey")).select("split", "p_partkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def block_pipeline(spark, d):
    """The event log cut into files, settled block by block by a stream, the latest answer a user over all blocks."""
    from ..streaming.verdict_log import latest_per_key

    folder = new_folder(spark, "blocks")
    log = load(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    log.repartition(8, "event_id").write.parquet(f"{folder}/log")
    settle = lambda rows: latest_per_key(rows.where("event_type <> 'error'"), "user_id", ["ts", "event_id"])
    settled = blocks.run_blocks(spark, f"{folder}/log", log.schema, settle, f"{folder}/settled", f"{folder}/state")
    return latest_per_key(settled, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")
