"""Estimators, sources, tensor files, block streams and texts against plain versions; refusals."""

import json
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import intervals
from verdictlake.functions import repair_text as X
from verdictlake.functions import source_text as T
from verdictlake.operators import estimates as E
from verdictlake.operators import reads as R
from verdictlake.operators import selection
from verdictlake.operators import training as G
from verdictlake.plans.session import working_dir
from verdictlake.sources import files, tensors
from verdictlake.streaming import blocks


def test_version_intervals_match_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"p{i:03d}", int(n), int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1))) for s in "ab" for i, n in enumerate(rng.integers(1, 9, 40))] + [("none", "x", 4, 0, 2)]
    got = {(r.section, r.kind, r.figure): (r.value, r.low, r.high) for r in E.version_intervals(spark.createDataFrame(rows, "section string, p string, drawn int, earlier int, later int").repartition(3), "section", "p", resamples=700).collect()}
    own = sorted(r[1:] for r in rows if r[0] == "b")
    drawn, early, late = (np.array([r[i] for r in own], float) for i in (1, 2, 3))
    draw, ratios = np.random.default_rng(0), []
    for size in (500, 200):
        for pick in draw.integers(0, 40, size=(size, 40)):
            ratios.append(late[pick].sum() / early[pick].sum())
    assert np.allclose(got["b", "attempt", "share"], [late.sum() / early.sum(), *np.quantile(ratios, [0.025, 0.975])])
    undefined = got["none", "attempt", "share"]
    assert undefined[0] is None or np.isnan(undefined[0])
    assert len(got) == 3 * 8


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1 << 20, 3 << 30])
def test_a_stream_is_entered_at_any_place(n):
    whole = np.random.default_rng(4).integers(0, n, size=200_000)
    for step in (20_000, 66_002):
        before = np.cumsum([0, *(intervals.numbers_kept(n, at, at + step, 4) for at in range(0, 200_000, step))])[:-1] if n > 1 else np.array([0])
        for place in (0, 1, 19_999, 20_000, 131_073, 199_000):
            got = intervals.stream_from(n, place, before, step, 4).integers(0, n, size=999)[: 200_000 - place]
            assert (got == whole[place : place + 999]).all()


@pytest.mark.parametrize("n, kinds", [(7, 3), (1000, 1000), (70_000, 5), (140_001, 66_000)])
def test_sums_of_kinds_are_sums_of_their_rows(n, kinds):
    rng = np.random.default_rng(n)
    own, values = rng.integers(0, kinds, n).astype(np.uint32), rng.integers(0, 50, (kinds, 5)).astype(float)
    picks = np.random.default_rng(9).integers(0, n, size=(9, n))
    assert (intervals.resampled_sums(own, values, 9, np.random.default_rng(9)) == values[own][picks].sum(axis=1)).all()
    values[own[picks[0, 0]], 2] = np.nan
    got = intervals.resampled_sums(own, values, 9, np.random.default_rng(9))
    assert np.array_equal(got, values[own][picks].sum(axis=1), equal_nan=True) and np.isnan(got[0, 2])


def test_version_intervals_do_not_depend_on_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(s, int(i), int(n), int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1))) for s, m in (("a", 700), (None, 90), ("one", 1)) for i, n in enumerate(rng.integers(1, 9, m))]
    table = spark.createDataFrame(rows, "section string, p int, drawn int, earlier int, later int").repartition(5)
    read = lambda: {(r.section, r.kind, r.figure): (r.value, r.low, r.high) for r in E.version_intervals(table, "section", "p", resamples=600, seed=8).collect()}
    whole = read()
    monkeypatch.setattr(E, "PART", 5000)  # 64, 11 and 1 tasks
    assert read() == whole and len(whole) == 3 * 8
    own = np.array([r[2:] for r in rows if r[0] == "a"], float)
    drawn, early, late = own[np.random.default_rng(8).integers(0, 700, size=(600, 700))].sum(axis=1).T
    for figure, again in (("earlier", early / drawn), ("later", late / drawn), ("share", late / early), ("difference", (late - early) / drawn)):
        assert whole["a", "attempt", figure][1:] == tuple(np.quantile(again, [0.025, 0.975]))


LARGE_SECTION = """
from pyspark.sql import SparkSession
from verdictlake.operators import estimates as E
conf = {"spark.master": "local[1]", "spark.sql.shuffle.partitions": "2", "spark.executor.pyspark.memory": "1536m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
rows = spark.range(300_000).selectExpr("'overall' AS section", "id", "1 + id % 9 AS drawn", "id % 2 AS earlier", "id % 3 % 2 AS later")
assert E.version_intervals(rows, "section", "id", resamples=500).count() == 8
"""


def test_a_large_section_fits_a_small_worker():
    """Places of 500 resamples of 300,000 statements are 1.2 GB; a worker has 1.5 GB of address space."""
    run = subprocess.run([sys.executable, "-c", LARGE_SECTION], env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_seeds_and_pools(spark):
    rows = spark.createDataFrame([(1, 1, 2, 4), (1, 2, 0, 4), (2, 1, 1, 4)], "problem int, seed int, k int, n int")
    assert [(r.problem, r.m) for r in E.over_seeds(rows, "problem", "seed", F.col("k") / F.col("n"), "m").collect()] == [(1, 0.25)]
    assert E.pooled(rows.withColumn("read", F.col("seed") == 1), "seed", "read", "problem").count() == 0
    assert {(r.problem, r.k) for r in E.pooled(rows.withColumn("read", F.lit(True)), "seed", "read", "problem").collect()} == {(1, 2), (2, 1)}
    assert E.control_episodes(24_000, 392) == 61 and E.control_episodes(5, 0) == 0
    with pytest.raises(ValueError):
        E.control_episodes(-1, 3)
    with pytest.raises(ValueError):
        E.reach(rows.where("seed = 1"), rows.where("seed = 2"), "problem")
    with pytest.raises(ValueError):
        E.t_interval(spark.range(30).select(F.col("id").cast("double").alias("v")), "v")
    with pytest.raises(ValueError):
        E.refit_observations(rows, rows, "problem")


def test_training_refusals(spark):
    rows = spark.createDataFrame([("a", 1, "own", 1, "p"), ("a", 2, "own", 2, " "), ("b", 1, "own", 2, "p"), ("c", 9, "published", 7, None)], "id string, problem int, origin string, pos int, proof string")
    problems = lambda *p: spark.createDataFrame([(x,) for x in p], "problem int")
    got = {tuple(r) for r in G.training_violations(rows, problems(2), problems(1, 2), {"own": 3, "published": 2}).collect()}
    assert got == {("id twice", "a"), ("problem twice", "a"), ("barred problem", "a"), ("unknown problem", "c"), ("empty proof", "a"), ("empty proof", "c"), ("place twice", "a"), ("no such place", "c"), ("other number of rows", "published")}
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "problem int, text string")
    with pytest.raises(ValueError):
        G.refiltered(stored, stored.withColumn("text", F.lit("x")), stored, "problem", "text")
    with pytest.raises(ValueError):
        selection.select("no such", rows, 1, 1)


def test_manifest_and_pins(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    files.export({"rows": df}, str(tmp_path / "x"), "parent")
    assert sorted(map(tuple, files.load(spark, str(tmp_path / "x"), "rows", "parent").collect())) == [(1, "a"), (2, None)]
    for name, parent in (("rows", "other"), ("nothing", "parent")):
        with pytest.raises(ValueError):
            files.load(spark, str(tmp_path / "x"), name, parent)
    df.where("id = 1").unionByName(df.where("id = 1")).write.mode("overwrite").parquet(str(tmp_path / "x" / "rows"))
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "x"), "rows", "parent")
    import hashlib

    path = tmp_path / "pinned.bin"
    path.write_bytes(b"bytes")
    assert files.pinned(spark, {str(path): hashlib.sha256(b"bytes").hexdigest()}) == [str(path)]
    with pytest.raises(ValueError):
        files.pinned(spark, {str(path): "0" * 64})
    assert "| 1 | a |" in files.report(df, "Rows") and files.settings_key({"a": 1}, df, "id") == files.settings_key({"a": 1}, df.repartition(3), "id") != files.settings_key({"a": 2}, df, "id")


def test_tensors(spark, tmp_path):
    rng = np.random.default_rng(0)
    one = {"w": rng.normal(size=(7, 9)).astype(np.float32), "b": np.arange(5, dtype=np.float64)}
    other = {"w": one["w"].copy(), "b": one["b"]}
    other["w"][2, 3] += 0.5
    for name, x in (("one", one), ("other", other)):
        tensors.write(str(tmp_path / name), x)
    (n,) = struct.unpack("<Q", (tmp_path / "one").read_bytes()[:8])
    assert json.loads((tmp_path / "one").read_bytes()[8 : 8 + n])["w"]["shape"] == [7, 9]
    a, b = (tensors.scan(spark, [str(tmp_path / name)], chunk=10) for name in ("one", "other"))
    got = {r.tensor: (r.elements, r.changed, round(r.largest, 5)) for r in tensors.compared(a, b).collect()}
    assert got == {"w": (63, 1, 0.5), "b": (5, 0, 0.0)}
    mean = tensors.mean(a.unionByName(b)).where("tensor = 'w'").orderBy("chunk").collect()
    assert np.array_equal(np.concatenate([np.frombuffer(r.data, "<f4") for r in mean]), ((one["w"].astype(float) + other["w"]) / 2).astype(np.float32).ravel())
    with pytest.raises(Exception, match="same shape"):
        tensors.compared(a, b.where("tensor = 'w'")).collect()


def test_blocks_are_settled_once(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), rows.schema, lambda df: df.where("v > 3"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert blocks.run_blocks(*args, files_a_block=2).count() == blocks.run_blocks(*args, files_a_block=2).count() == rows.where("v > 3").count()
    assert len(list((tmp_path / "out").glob("block=*"))) == 3


def test_chains_and_arms(spark):
    working_dir(spark)
    rows = [("one", "a", "b", "t1"), ("one", "b", "no goals", "t2"), ("two roots", "a", "no goals", "t"), ("two roots", "x", "y", "u"), ("branch", "a", "b", "t"), ("branch", "b", "no goals", "u"), ("branch", "b", "c", "v"), ("loop", "a", "b", "t"), ("loop", "b", "a", "u")]
    got = {r.id: r.tactics for r in R.chains(spark.createDataFrame(rows, "id string, b string, a string, t string"), "id", "b", "a", "t").collect()}
    assert got == {"one": ["t1", "t2"], "two roots": None, "branch": None, "loop": None}
    with pytest.raises(ValueError):
        R.chains(spark.createDataFrame(rows, "id string, b string, a string, t string"), "id", "b", "a", "t", most=2)
    names = spark.createDataFrame([("with",), ("with-r64",), ("with-s2",), ("with-r64-s2",), ("No",)], "n string")
    assert [tuple(r[0]) for r in names.select(G.arm_parts(F.col("n"))).collect()] == [("with", None, None), ("with", 64, None), ("with", None, 2), ("with", 64, 2), (None, None, None)]


def test_texts():
    assert T.outside("f (a := b) := c", ":=") == 11 and T.outside("(a := b", ":=") is None and T.balanced("([])") and not T.balanced(")(") and not T.balanced("(")
    assert T.signature("theorem t (x : ℕ) : x = 1 := by") == ("t", "(x : ℕ)", "x = 1") and T.signature("theorem t (x : ℕ) x = 1 := by") is None and T.signature("def t : 1 := by") is None
    assert T.set_membership("∑ x in s, ∑ y in t, f") == ("∑ x ∈ s, ∑ y ∈ t, f", 2) and T.set_membership("∑ x, f in s") == ("∑ x, f in s", 0) and T.set_membership("(∑ x) in s")[1] == 0 and T.set_membership("∑ (x in a) in s,")[0] == "∑ (x in a) ∈ s,"
    assert T.library_names("a.b.c x'a.b", {"a.b": "q", "a": "z"}) == ("q.c x'a.b", ["a.b"])
    assert T.binder_groups("(a : b) {c}") == ["(a : b)", "{c}"] and T.binder_groups("(a) b") is None and T.binder_groups("") == []
    assert X.opener(["simp [", "a"]) == 0 and X.opener(['x "("', "-- ("]) is None and X.opener(["(", ")", "{ [", "]"]) == 2
    assert X.resumed("  a\n  b\n  c", 1, "  d\n\n") == "  a\n  d\n"
    texts, statements, closer, ended = X.harvest("  have h : p := by x\n  have : p := y\n  exact this", 3, 1, size=1)
    assert texts == ["  have h_g1 : p := by x"] and closer == "  exact this" and ended == X.NOT_A_HAVE


def test_fold_and_asked():
    from verdictlake.operators import episodes as P
    from verdictlake.plans.episode_queries import EPISODES

    for loops in EPISODES:
        assert [r[1:] for r in P.fold([(n + 1, *loop[0]) for n, loop in enumerate(loops)], 16)] == [loop[1] for loop in loops]
    proof = "  have h : p := by x\n  have k : q := by x\n  exact k"
    assert P.fold([(1, proof, 2, False, True)], 1) == [(1, "fresh", 1, 1, 0, None)]  # the closing step needs a lemma that had no room
    calls = []

    def check(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    assert P.asked(["a", "b", "bad", "c", "d"], check, 2) == ["A", "B", P.NO_ANSWER, "C", "D"] and calls.count(1) >= 2
