"""Statement and proof texts, verdicts and failures. Texts are made from whole tables in a few shapes; the SQL says for
each shape what must come out, the operators find it by reading the text."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions import source_text as T
from ..functions import verdicts as V
from .registry import load, query, rounded, sql_rounded


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def by_shape(key: str, values: list) -> str:
    """SQL: the shape's value, {k} standing for the key."""
    say = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"replace({quoted(v)}, '{{k}}', {key}::VARCHAR)"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {say(v)}" for i, v in enumerate(values)) + " END"


def shaped(key: str, values: list[str]):
    """The same as a column."""
    k = F.col(key)
    found = F.lit(None).cast("string")
    for i, v in enumerate(values):
        found = F.when(k % len(values) == i, F.replace(F.lit(v), F.lit("{k}"), k.cast("string"))).otherwise(found)
    return found


# statement, name, normal form, negation, places rewritten, rewritten text, negation's claim for exactness
STATEMENTS = [
    ("theorem t_{k} (x : ℕ) : x = {k} := by\n", "t_{k}", "(x : ℕ) : x = {k}", "theorem not_{k} : ¬ (∀ (x : ℕ), x = {k}) := by\n", 0, "theorem t_{k} (x : ℕ) : x = {k} := by\n"),
    ("lemma  {k} : broken := by", "{k}", ": broken", None, 0, "lemma  {k} : broken := by"),
    ("/- note /- theorem inner -/ -/\ntheorem t_{k} {n : ℕ} (h : n > {k}) :\n  ∑ i in Finset.range n, i = 0 := by sorry", "t_{k}", "{n : ℕ} (h : n > {k}) : ∑ i in Finset.range n, i = 0", None, 1, "/- note /- theorem inner -/ -/\ntheorem t_{k} {n : ℕ} (h : n > {k}) :\n  ∑ i ∈ Finset.range n, i = 0 := by sorry"),
    ("@[simp] private theorem A.b_{k} : ∏ i ∈ s, (∑ j in (t i), j) = 1 := by -- lemma z", "A.b_{k}", ": ∏ i ∈ s, (∑ j in (t i), j) = 1", None, 1, "@[simp] private theorem A.b_{k} : ∏ i ∈ s, (∑ j ∈ (t i), j) = 1 := by -- lemma z"),
    ("no statement of {k}", None, "no statement of {k}", None, 0, "no statement of {k}"),
    ("theorem t_{k} : (let y := {k}; y) = {k} := by", "t_{k}", ": (let y := {k}; y) = {k}", "theorem not_{k} : ¬ ((let y := {k}; y) = {k}) := by\n", 0, "theorem t_{k} : (let y := {k}; y) = {k} := by"),
    ("theorem «odd {k}» [Fact (1 < 2)] (f : {x : ℕ // x in s} → ℕ) : ∑ x, f x ≥ 0 := by\n", "«odd", "[Fact (1 < 2)] (f : {x : ℕ // x in s} → ℕ) : ∑ x, f x ≥ 0", "theorem not_{k} : ¬ (∀ [Fact (1 < 2)] (f : {x : ℕ // x in s} → ℕ), ∑ x, f x ≥ 0) := by\n", 0, "theorem «odd {k}» [Fact (1 < 2)] (f : {x : ℕ // x in s} → ℕ) : ∑ x, f x ≥ 0 := by\n"),
]
K = "p_partkey"
OF = lambda i: by_shape(K, [s[i] for s in STATEMENTS])


def statements(spark, d):
    return load(spark, d, "part").select(K, "p_size", shaped(K, [s[0] for s in STATEMENTS]).alias("statement"))


@query(f"SELECT p_partkey, {OF(1)} AS declared, {OF(2)} AS normal, substr(sha256({OF(2)}), 1, 16) AS content_id, {OF(3)} AS negated, {OF(5)} AS rewritten, CAST({OF(4)} AS INT) AS places, sha256({OF(0)}) AS file_sha FROM part")
def statement_forms(spark, d):
    rows, s = statements(spark, d), F.col("statement")
    moved = T.arrow(T.set_membership, "text string, places int", s)
    rows = rows.select(K, T.declared_name(s).alias("declared"), T.normalized(s).alias("normal"), T.arrow(T.negation, "string", s, F.concat(F.lit("not_"), F.col(K).cast("string"))).alias("negated"), moved.alias("m"), F.sha2(s, 256).alias("file_sha"))
    return rows.select(K, "declared", "normal", seeded.content_id(F.col("normal")).alias("content_id"), "negated", F.col("m.text").alias("rewritten"), F.col("m.places").alias("places"), "file_sha")


NAMED = [s[0].replace("t_{k}", "c_{k}") if s[1] == "t_{k}" else s[0].replace("A.b_{k}", "c_{k}") if s[1] == "A.b_{k}" else s[0].replace("«odd {k}»", "c_{k}") if s[1] == "«odd" else s[0].replace("lemma  {k}", "lemma  c_{k}") if s[1] == "{k}" else None for s in STATEMENTS]
CLAIMS = [s[3] and s[3].removeprefix("theorem not_{k} : ¬ (").removesuffix(") := by\n") for s in STATEMENTS]
TRUE_NAMES = ["t_{k}", None, None, None, None, "t_{k}", "«odd {k}»"]
ENDED = [s[0] if s[0].endswith("\n") else s[0] + "\n" for s in STATEMENTS]


@query(f"""SELECT p_partkey, {by_shape(K, NAMED)} AS renamed, sha256({by_shape(K, [c and T.HEADER + e + '  sorry' + chr(10) * 2 + 'example : (¬ (' + c + ')) = (¬ (type_of% @' + n + ')) := rfl' + chr(10) for c, n, e in zip(CLAIMS, TRUE_NAMES, ENDED, strict=True)])}) AS exactness_sha,
sha256({by_shape(K, [n and T.HEADER + e + '  simp' + chr(10) * 2 + '#print axioms ' + n + chr(10) for n, e in zip([s[1] for s in STATEMENTS], ENDED, strict=True)])}) AS proof_sha, sha256({by_shape(K, [T.HEADER + e + '  sorry' + chr(10) * 2 for e in ENDED])}) AS compile_sha, (CASE WHEN {K} % 5 = 0 THEN NULL ELSE {K} * 7 END)::DECIMAL(20,0) AS fingerprint FROM part""")
def statement_sources(spark, d):
    rows, s = statements(spark, d), F.col("statement")
    messages = F.array(F.lit("info: none"), F.when(F.col(K) % 5 != 0, F.concat(F.lit("TYPE FINGERPRINT "), (F.col(K) * 7).cast("string"), F.lit(" end"))).otherwise("TYPE FINGERPRINT x"))
    return rows.select(
        K, T.arrow(T.renamed, "string", s, F.concat(F.lit("c_"), F.col(K).cast("string"))).alias("renamed"), F.sha2(T.arrow(T.exactness, "string", s), 256).alias("exactness_sha"), F.sha2(T.proof_source(s, F.lit("  simp \n\n")), 256).alias("proof_sha"),
        F.sha2(T.compile_source(s), 256).alias("compile_sha"), T.fingerprint(messages, "TYPE FINGERPRINT").alias("fingerprint"),
    )


# generated text -> statement; file -> imports on top
GENERATED = [
    ("g_{k} (x : ℕ) : x = 1 /- why -/ := by simp", "theorem g_{k} (x : ℕ) : x = 1 := by\n"), ("g_{k} x = 1", None), ("g_{k} (x : ℕ : x = 1 := by", None), ("(x : ℕ) : x = 1 := by", None), ("g_{k} : -- t\n  1 = {k}  := by", "theorem g_{k} :\n  1 = {k} := by\n"), ("g_{k} (h : a := b) := by", None),
]
FILES = [
    ("/- license -/\nimport A\nimport B\ntheorem x_{k} := 1\n", "import A\nimport B\n/- license -/\ntheorem x_{k} := 1\n"), ("import A\nopen X\nimport B_{k}", "import A\nopen X\nimport B_{k}"), ("-- import C\n\nimport D_{k}", "import D_{k}\n-- import C\n\n"), ("theorem y_{k} := 2", "theorem y_{k} := 2"),
]


@query(f"SELECT p_partkey, {by_shape(K, [g[1] for g in GENERATED])} AS parsed, {by_shape(K, [f[1] for f in FILES])} AS imports_first FROM part")
def generated_statements(spark, d):
    rows = load(spark, d, "part").select(K, shaped(K, [g[0] for g in GENERATED]).alias("g"), shaped(K, [f[0] for f in FILES]).alias("f"))
    return rows.select(K, T.arrow(T.generated, "string", F.col("g")).alias("parsed"), T.arrow(T.imports_on_top, "string", F.col("f")).alias("imports_first"))


TABLE = {"le_div_iff": "le_div_iff₀", "Set.mem_def": "Set.mem_def", "Nat.sub_le": "Nat.sub_le_self", "a.b": "c.d"}
LIBRARY = [
    ("exact (le_div_iff h).mpr x_{k}", "exact (le_div_iff₀ h).mpr x_{k}", "le_div_iff"), ("rw [Nat.le_div_iff, le_div_iff', le_div_iff₀]", "rw [Nat.le_div_iff, le_div_iff', le_div_iff₀]", ""), ("simp [le_div_iff.mpr, Nat.sub_le.trans, Set.mem_def]", "simp [le_div_iff₀.mpr, Nat.sub_le_self.trans, Set.mem_def]", "Nat.sub_le,le_div_iff"),
    ("x.a.b a.b.c a.b", "x.a.b c.d.c c.d", "a.b"), ("(h x).le_div_iff le_div_iff_mul_{k}", "(h x).le_div_iff le_div_iff_mul_{k}", ""),
]
FILE_PROOFS = [
    ("import Mathlib\n\ntheorem p (x : ℕ) :\n  x = x := by\n  -- first\n  simp\n  rfl\n", "theorem p (x : ℕ) :\n  x = x := by\n", "  simp\n  rfl"), ("theorem p : 1 = 1 := by norm_num_{k}", "theorem p : 1 = 1 := by\n", "  norm_num_{k}"), ("theorem p' : 1 = 1 := by simp", None, None), ("theorem p : 1 = 1 := rfl", None, None),
    ("theorem p : 1 = 1 := by have h := {k}\n    exact h", "theorem p : 1 = 1 := by\n", "    have h := {k}\n    exact h"), ("theorem p : 1 = 1 := bysimp", None, None), ("theorem p : 1 = 1 := by", None, None), ("theorem p : 1 = 1 := by intro x\nsimp\nrfl", "theorem p : 1 = 1 := by\n", "  intro x\n  simp\n  rfl"),
]
PROMPTS = [
    (T.PROMPT_HEAD + "theorem q_{k} : 1 = 1 := by", "theorem q_{k} : 1 = 1 := by\n"), (T.PROMPT_HEAD + "/- c -/ lemma q_{k} :\n  1 = 1   := by\n", "lemma q_{k} :\n  1 = 1 := by\n"), (T.PROMPT_HEAD + "theorem q : 1 = 1 :=", None), (T.PROMPT_HEAD + "theorem q : 1 = 1 := by\nlemma r : 1 = 1 := by", None), ("theorem q_{k} : 1 = 1 := by", None),
]
FORMALS = [("theorem w_{k} : 1 = 1 := by sorry", "theorem w_{k} : 1 = 1 := by\n"), ("def w_{k} := by sorry", None), (" theorem w_{k} (x) : x :=  by\n sorry \n", "theorem w_{k} (x) : x := by\n"), ("theorem w_{k} : open", "theorem w_{k} : open := by\n")]


@query(f"SELECT p_partkey, {by_shape(K, [x[1] for x in LIBRARY])} AS library, {by_shape(K, [x[2] for x in LIBRARY])} AS changed, {by_shape(K, [x[1] for x in FILE_PROOFS])} AS theorem, {by_shape(K, [x[2] for x in FILE_PROOFS])} AS proof, {by_shape(K, [x[1] for x in PROMPTS])} AS prompted, {by_shape(K, [x[1] for x in FORMALS])} AS workbook FROM part")
def published_forms(spark, d):
    rows = load(spark, d, "part").select(K, *[shaped(K, [x[0] for x in xs]).alias(n) for n, xs in (("l", LIBRARY), ("f", FILE_PROOFS), ("q", PROMPTS), ("w", FORMALS))])
    library = T.arrow(lambda text: T.library_names(text, TABLE), "text string, names array<string>", F.col("l"))
    proof = T.arrow(T.file_proof, "theorem string, proof string", F.col("f"), F.lit("p"))
    rows = rows.select(K, library.alias("l"), proof.alias("f"), T.arrow(T.prompt_statement, "string", F.col("q")).alias("prompted"), T.workbook_statement(F.col("w")).alias("workbook"))
    return rows.select(K, F.col("l.text").alias("library"), F.concat_ws(",", "l.names").alias("changed"), "f.theorem", "f.proof", "prompted", "workbook")


READINGS = [
    ("theorem d_{k} (x : ℝ) : x = 1 := by\n", "x : ℝ\n⊢ ¬x = 1", "no_hypotheses", "  have published_for_every_value (x : ℝ) : ¬ (x = 1) := by\n  simp\n  intro claimed_for_every_value\n  exact published_for_every_value default (claimed_for_every_value default)"),
    ("theorem d_{k} (x y : ℕ) (h : x < y) : x = 1 := by\n", "x y : ℕ\nh : x < y\n⊢ ¬x = 1", "has_hypotheses", "  have published_for_every_value (x y : ℕ) (h : x < y) : ¬ (x = 1) := by\n  simp\n  intro claimed_for_every_value\n  exact published_for_every_value default default default (claimed_for_every_value default default default)"),
    ("theorem d_{k} : 1 = 2 := by\n", "⊢ ¬1 = 2", "no_hypotheses", "simp"),
    ("theorem d_{k} (f : ℝ≥0 → ℝ) : f = f := by\n", "f : ℝ≥0 → ℝ\nhf :\n  Continuous f\n⊢ x", "has_hypotheses", "  have published_for_every_value (f : ℝ≥0 → ℝ) : ¬ (f = f) := by\n  simp\n  intro claimed_for_every_value\n  exact published_for_every_value default (claimed_for_every_value default)"),
    ("theorem d_{k} x : x = 1 := by\n", "", "unparsed", None), ("no theorem {k}", "", "unparsed", None), ("theorem d_{k} {n : ℕ} : n = 1 := by\n", "n : ℕ\nh : Even\n  n\n⊢ x", "has_hypotheses", None),
]


@query(f"SELECT p_partkey, {by_shape(K, [r[2] for r in READINGS])} AS reading, {by_shape(K, [r[3] for r in READINGS])} AS proof FROM part")
def hypotheses_readings(spark, d):
    rows = load(spark, d, "part").select(K, shaped(K, [r[0] for r in READINGS]).alias("s"), shaped(K, [r[1] for r in READINGS]).alias("state"))
    made = T.arrow(T.negation_proof, "theorem string, proof string", F.col("s"), F.lit("simp"), F.lit("n"))
    return rows.select(K, T.arrow(T.hypotheses, "string", F.col("s"), F.col("state")).alias("reading"), made.alias("m")).select(K, "reading", F.col("m.proof").alias("proof"))


PROOFS = [("  -- why\n\n  have h := {k}\n  exact h", 2, "2-3", "have h := {k}", 1), ("  simp", 1, "1", "simp", 0), ("-- only\n", 0, None, None, 0), ("  having\n" + "  x\n" * 4, 5, "4-7", "having", 0), ("a\n" * 12, 12, "8+", "a", 0)]


@query(f"""SELECT p_partkey, CAST({by_shape(K, [p[1] for p in PROOFS])} AS INT) AS lines, {by_shape(K, [p[2] for p in PROOFS])} AS bin, {by_shape(K, [p[3] for p in PROOFS])} AS first_step, {by_shape(K, [p[4] for p in PROOFS])} = 1 AS opens_with_have,
('0x' || substr(sha256('7:half:' || p_partkey), 1, 8))::BIGINT % 2 AS half8, ('0x' || left(sha256('7:holdout:' || p_partkey), 8))::BIGINT / 4294967295.0::DOUBLE < 0.3 AS held, 'nl_' || substr(sha256(trim(p_name)), 1, 16) AS group_id,
CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'axiom' WHEN 2 THEN 'IO.' WHEN 3 THEN 'sorry' END AS forbidden FROM part""".replace("trim(p_name)", "trim(p_brand)"))
def proof_lines(spark, d):
    texts = ["sorry_lemma admits x.axiom imported", "exact axiom #eval 1", "do IO.println elaborate", "by native_decide; sorry"]
    rows = load(spark, d, "part").select(K, "p_brand", shaped(K, [p[0] for p in PROOFS]).alias("proof"), shaped(K, texts).alias("text"))
    p = F.col("proof")
    return rows.select(
        K, T.line_count(p).alias("lines"), T.line_bin(T.line_count(p), [1, 2, 4, 8]).alias("bin"), T.first_step(p).alias("first_step"), T.opens_with_have(p).alias("opens_with_have"), seeded.half_of_first_digits(7, "half", F.col(K)).alias("half8"),
        seeded.in_share(7, "holdout", F.col(K), 0.3, (1 << 32) - 1).alias("held"), T.group_id(F.col("p_brand")).alias("group_id"), T.forbidden(F.col("text")).alias("forbidden"),
    )


# Verdicts: a raw answer, its status under v4.9 and v4.27, its failure class, kind of the deciding error.
MESSAGE = lambda *ms, **more: json.dumps({"time": 1.5, "diagnostics": {"memory_max": 9}, "response": {"messages": [{"severity": s, "data": t} for s, t in ms], **more}}, ensure_ascii=False)
CLEAN = ("info", "'t' depends on axioms: [propext,\n Quot.sound]")
ANSWERS = [
    (json.dumps({"error": "Lean REPL command timed out in 60 seconds"}), "timeout", "timeout", "timeout", None), (json.dumps({"error": "worker crashed: timed out"}), "server_error", "server_error", None, None), (json.dumps({"time": 2.0}), "server_error", "server_error", None, None),
    (json.dumps({"error": "Lean REPL header command timed out in 30 seconds"}), "timeout", "timeout", None, None), (json.dumps({"response": {"message": "could not parse"}}), "lean_error", "lean_error", "other_error", ""),
    (MESSAGE(("error", "linarith failed to find `h_{k}`:\nmore"), ("error", "Unknown identifier `foo_{k}`: "), CLEAN), "lean_error", "lean_error", "unknown_identifier", "Unknown identifier _"), (MESSAGE(("error", "unknown constant 'thm_{k}'"), ("error", "unsolved goals x ⊢ 'y'")), "lean_error", "lean_error", "other_error", "unsolved goals x ⊢ _"),
    (MESSAGE(("warning", "aesop: failed to prove"), CLEAN), "lean_error", "verified", "other_error", ""), (MESSAGE(("warning", "declaration uses 'sorry'"), CLEAN), "uses_sorry", "uses_sorry", "other_error", ""), (MESSAGE(CLEAN, sorries=["x"]), "uses_sorry", "uses_sorry", "other_error", ""),
    (MESSAGE(("info", "nothing")), "forbidden_axiom", "forbidden_axiom", "other_error", ""), (MESSAGE(("info", "'t' depends on axioms: [propext, sorryAx]")), "forbidden_axiom", "forbidden_axiom", "other_error", ""), (MESSAGE(CLEAN), "verified", "verified", None, None), (MESSAGE(("info", "'t' does not depend on any axioms")), "verified", "verified", None, None),
]
O = "o_orderkey"
STATUS = {"v4.9": by_shape(O, [a[1] for a in ANSWERS]), "v4.27": by_shape(O, [a[2] for a in ANSWERS])}
ATTEMPT_SQL = by_shape(O, ["no_answer" if a[1] == "server_error" or "header" in a[0] else a[1] for a in ANSWERS])


def answers(spark, d):
    """An order's raw answer with its parsed form and its own errors."""
    rows = load(spark, d, "orders").select(O, "o_custkey", "o_orderpriority", F.concat(F.lit("thm_"), F.col(O).cast("string")).alias("name"), shaped(O, [a[0] for a in ANSWERS]).alias("raw"))
    rows = rows.withColumn("answer", V.parsed(F.col("raw")))
    return rows.withColumn("errors", V.without_echoes(V.error_texts(F.col("answer")), F.col("name")))


@query(f"SELECT o_orderkey, '{{v}}' AS pin, {STATUS['v4.9']} AS status, {ATTEMPT_SQL} AS attempt_status FROM orders".replace("{v}", "v4.9") + f" UNION ALL SELECT o_orderkey, 'v4.27', {STATUS['v4.27']}, {by_shape(O, ['no_answer' if a[2] == 'server_error' or 'header' in a[0] else a[2] for a in ANSWERS])} FROM orders")
def verdict_status(spark, d):
    """Every answer under every version's rules; the rules are a broadcast table of one row a version."""
    rows = answers(spark, d).withColumn("pins", F.explode(F.array(*[F.struct(F.lit(p.pin).alias("pin"), F.lit(p.failed_warning_is_error).alias("strict")) for p in V.PINS.values()])))
    rows = rows.withColumn("read", V.classified(F.col("answer"), F.col("pins.strict")))
    return rows.select(O, "pins.pin", F.col("read.status").alias("status"), V.attempt_status(F.col("read.status"), F.col("answer.error")).alias("attempt_status"))


LATER = by_shape(O, [a[3] if "aesop" not in a[0] else None for a in ANSWERS])
EARLIER_SQL = "(o_orderkey * 5 + o_custkey) % 3 = 0"


def failures(spark, d):
    """The later version's outcome and class beside whether the earlier one verified it."""
    rows = answers(spark, d).withColumn("read", V.classified(F.col("answer"), F.lit(V.pin("v4.27").failed_warning_is_error)))
    status = V.attempt_status(F.col("read.status"), F.col("answer.error"))
    rows = rows.select(O, "o_custkey", "o_orderpriority", status.alias("status"), F.expr(EARLIER_SQL).alias("earlier"), V.failure_class(status, F.col("errors")).alias("class"), V.deciding_error(F.col("errors"), F.lit("")).alias("error"))
    return rows.where(F.col("status") != V.NO_ANSWER)


CLASS_SQL = f"f AS (SELECT *, {LATER} AS class, {EARLIER_SQL} AS earlier FROM orders WHERE {by_shape(O, ['no_answer' if a[2] == 'server_error' or 'header' in a[0] else a[2] for a in ANSWERS])} <> 'no_answer')"


@query(f"WITH {CLASS_SQL}, s AS (SELECT DISTINCT o_orderpriority FROM f), c(class) AS (VALUES ('unknown_identifier'), ('other_error'), ('timeout'), ('rejected_lexical')) SELECT s.o_orderpriority, c.class, count(f.o_orderkey) AS failures, count(f.o_orderkey) FILTER (f.earlier) AS lost FROM s CROSS JOIN c LEFT JOIN f ON f.o_orderpriority = s.o_orderpriority AND f.class = c.class GROUP BY ALL")
def failure_classes(spark, d):
    """Failures and lost attempts by section and class, classes without any as 0."""
    counts = failures(spark, d).groupBy("o_orderpriority", "class").agg(F.count(F.lit(1)).alias("f"), F.count_if("earlier").alias("l"))
    one = lambda c, v: F.coalesce(F.max(F.when(F.col("class") == c, F.col(v))), F.lit(0))
    each = F.array(*[F.struct(F.lit(c).alias("class"), one(c, "f").alias("failures"), one(c, "l").alias("lost")) for c in V.FAILURE_CLASSES])
    return counts.groupBy("o_orderpriority").agg(each.alias("each")).select("o_orderpriority", F.inline("each"))


@query(f"WITH {CLASS_SQL}, k AS (SELECT {by_shape(O, [a[4] for a in ANSWERS])} AS kind, o_orderkey FROM f WHERE {STATUS['v4.27']} = 'lean_error') SELECT kind, count(*) AS errors FROM k GROUP BY 1 ORDER BY 2 DESC, min(o_orderkey) LIMIT 6")
def error_kinds(spark, d):
    """The most frequent kinds of deciding error; kinds equally frequent in the order of their first attempt."""
    rows = failures(spark, d).where(F.col("status") == V.LEAN_ERROR).groupBy(V.error_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("errors"), F.min(O).alias("first"))
    return rows.orderBy(F.desc("errors"), "first").limit(6).select("kind", "errors")


@query(f"WITH {CLASS_SQL}, u AS (SELECT class, o_custkey, min(o_orderkey) AS o_orderkey FROM f WHERE class IS NOT NULL AND earlier GROUP BY ALL) SELECT class, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY o_orderkey) AS n FROM u) WHERE n <= 3")
def lost_examples(spark, d):
    """Up to three attempts a class that the earlier version verified and the later does not, of different statements."""
    once = failures(spark, d).where("class is not null and earlier").groupBy("class", "o_custkey").agg(F.min(O).alias(O))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy(O))).where("n <= 3").select("class", O, "o_custkey")


@query("SELECT CASE WHEN k = 0 THEN '0' WHEN k / n <= 0.25 THEN '(0, 0.25]' WHEN k / n <= 0.75 THEN '(0.25, 0.75]' ELSE '(0.75, 1]' END AS band, count(*) AS statements FROM (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def pass_rate_bands(spark, d):
    from .registry import results

    return results(spark, d, "verified").groupBy(V.band_label(F.col("k") / F.col("n"), [0.25, 0.75]).alias("band")).agg(F.count(F.lit(1)).alias("statements"))


SURVIVAL_SQL = f"SELECT o_orderpriority AS stratum, count(*) FILTER (s <> 'no_answer') AS answered, count(*) FILTER (s = 'verified') AS verified, list_sort(list(o_totalprice::DOUBLE) FILTER (s <> 'no_answer'))[count(*) FILTER (s <> 'no_answer') // 2 + 1] AS upper_median FROM (SELECT *, {ATTEMPT_SQL} AS s FROM orders) GROUP BY 1"
Z = "1.959963984540054"
WILSON = lambda sign: f"CASE WHEN answered > 0 THEN {'greatest(0' if sign == '-' else 'least(1'}, (verified / answered + {Z} * {Z} / (2 * answered) {sign} {Z} * sqrt(verified / answered * (1 - verified / answered) / answered + {Z} * {Z} / (4.0 * answered * answered))) / (1 + {Z} * {Z} / answered)) END"


@query(sql_rounded(f"SELECT *, {WILSON('-')} AS low, {WILSON('+')} AS high FROM ({SURVIVAL_SQL})", "low", "high", "upper_median"))
def survival_by_stratum(spark, d):
    """Verified of answered with Wilson's interval, and the upper median of a measured quantity, by stratum."""
    from ..functions import rates

    price = load(spark, d, "orders").select(O, F.col("o_totalprice").cast("double").alias("price"))
    rows = answers(spark, d).withColumn("read", V.classified(F.col("answer"), F.lit(True))).join(price, O)
    status = V.attempt_status(F.col("read.status"), F.col("answer.error"))
    rows = rows.select(F.col("o_orderpriority").alias("stratum"), status.alias("s"), "price").where(F.col("s") != V.NO_ANSWER)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("price"))
    rows = rows.withColumn("at", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stratum")))
    found = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("answered"), F.count_if(F.col("s") == V.VERIFIED).alias("verified"), F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("price"))).alias("upper_median"))
    low, high = rates.wilson(F.col("verified"), F.col("answered"))
    return rounded(found.select("stratum", "answered", "verified", "upper_median", low.alias("low"), high.alias("high")))
