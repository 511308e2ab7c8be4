"""Accumulating episodes and injected checkers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from .registry import load, query

# proof, kept, verified, stands -> kind, added, pool, checks, copy_of; by shape and loop
ONE = "  have h : p := by x\n  exact h"
EPISODES = [
    [((ONE, 1, False, True), ("fresh", 1, 1, 1, None)), (("  have k : q := by y\n  z", 1, False, False), ("continue", 0, 1, 1, None)), ((ONE, 1, False, True), ("fresh", 0, 1, 0, 1))],
    [(("  simp", 0, False, True), ("fresh", 0, 0, 0, None)), (("  simp\n", 0, False, True), ("fresh", 0, 0, 0, 1)), ((ONE, 1, False, True), ("fresh", 1, 1, 2, None))],
    [((ONE, 1, False, True), ("fresh", 1, 1, 1, None)), (("  have g : r := by x\n  exact g", 1, False, True), ("continue", 1, 2, 2, None)), (("  done", 1, True, True), ("continue", 0, 2, 0, None))],
    [((ONE, 0, False, True), ("fresh", 0, 0, 0, None)), (("  have h : p := by x\n  have h : p := by x\n  exact h", 2, False, True), ("fresh", 1, 1, 1, None)), (("  have k : p := by z\n  exact k", 1, False, True), ("continue", 0, 1, 0, None))],
]


def episode_sql() -> str:
    def case(i: int) -> str:
        say = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
        return "CASE " + " ".join(f"WHEN p_partkey % 4 = {s} AND loop = {n + 1} THEN {say(loops[n][1][i])}" for s, loops in enumerate(EPISODES) for n in range(3)) + " END"

    return f"SELECT p_partkey, p_size AS episode, loop::INT AS loop, {case(0)} AS kind, ({case(1)})::INT AS added, ({case(2)})::INT AS pool, ({case(3)})::INT AS checks, ({case(4)})::INT AS copy_of FROM part, range(1, 4) r(loop)"


@query(episode_sql())
def accumulating_episodes(spark, d):
    """What three loops of an episode leave in its pool, over all problems."""
    rows = spark.createDataFrame([(s, n + 1, *loop[0]) for s, loops in enumerate(EPISODES) for n, loop in enumerate(loops)], "shape int, loop int, proof string, kept int, verified boolean, stands boolean")
    part = load(spark, d, "part").select("p_partkey", F.col("p_size").alias("episode"), (F.col("p_partkey") % 4).cast("int").alias("shape"))
    return E.accumulated_episodes(part.join(F.broadcast(rows), "shape").drop("shape"), "p_partkey", "episode")  # twelve rows


@query("SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN 'no_answer' ELSE 'a' || (n_chars % 3) END AS answer FROM documents WHERE n_chars IS NOT NULL")
def injected_checks(spark, d):
    """A checker that fails for some files, asked in batches: what fails alone has no answer."""

    def check(texts: list[str]) -> list[str]:
        if any(int(t) % 11 == 0 for t in texts):
            raise RuntimeError("a worker crashed")
        return [f"a{int(t) % 3}" for t in texts]

    rows = load(spark, d, "documents").where("n_chars is not null").select("doc_id", F.col("n_chars").cast("string").alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    return rows.join(E.checked(rows, "sha", "text", check), "sha").select("doc_id", "answer")


@query("SELECT p_partkey, list_filter(list_transform(range(0, p_size % 9), lambda i: 'b' || i), lambda b: b IN ('b1', 'b4', 'b7')) AS kept FROM part")
def minimised_pools(spark, d):
    """Pools without the blocks that their proof does not need."""
    needed = {"b1", "b4", "b7"}
    n = F.col("p_size") % 9
    rows = load(spark, d, "part").select("p_partkey", F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("b"), i.cast("string"))).alias("blocks"))
    return E.minimised(rows, "p_partkey", "blocks", lambda left, whole: needed & set(whole) <= set(left))
