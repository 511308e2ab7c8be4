"""Sequential rules against plain loops, and refusals."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.operators import draws as D
from verdictlake.operators import joins as J
from verdictlake.operators import pool as P
from verdictlake.plans.session import working_dir

KEYS = ["g", "t", "f"]


def loop(rows, seen=None):
    seen, kept = set() if seen is None else seen, []
    for r in rows:
        keys = {(i, k) for i, k in enumerate(r[1:]) if k is not None}
        if not keys & seen:
            kept.append(r[0])
            seen |= keys
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_on_three_keys(spark, seed):
    working_dir(spark)
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(9)]), rng.randrange(40), rng.choice([None, "hot", *"abcdef"])) for i in range(80)]
    df = spark.createDataFrame(rows, "pos int, g int, t int, f string").repartition(4)
    assert sorted(r.pos for r in D.first_wins(df, "pos", KEYS).collect()) == loop(rows)
    for wanted in (1, 5, 500):
        assert sorted(r.pos for r in D.first_taken(df, "pos", KEYS, wanted).collect()) == loop(rows)[:wanted]
    assert D.first_wins(df.where("false"), "pos", KEYS).count() == 0


def test_order_and_permutation(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(300)], "id string").repartition(3)
    want = sorted((f"p{i}" for i in range(300)), key=lambda p: hashlib.sha256(f"3:x:{p}".encode()).hexdigest())
    assert [r.id for r in D.in_order(df, "id", 3, "x").orderBy("pos").collect()] == want
    assert [r.id for r in D.next_rows(df, "id", 10, 3, "x", 20).orderBy("pos").collect()] == want[20:30]
    ids = sorted(f"p{i}" for i in range(300))
    assert [r.id for r in D.permuted(df, "id", 12, 5).orderBy("place").collect()] == [ids[i] for i in np.random.default_rng(5).permutation(300)[:12]]
    with pytest.raises(ValueError):
        D.permuted(df, "id", 12, 5, most_rows=10)


def test_sizes():
    assert D.set_size(1000, 400) == (333, False) and D.set_size(3000, 400) == (400, False) and D.set_size(3000, 149) == (500, True) and D.set_size(100, 0, share=0.29) == (29, True)
    assert D.more_candidates(10, 50, 100) == 26 and D.more_candidates(10, 0, 0) == 26 and D.more_candidates(0, 5, 5) == 1
    with pytest.raises(ValueError):
        D.set_size(10, 11)


def test_refusals(spark):
    df = lambda rows: spark.createDataFrame(rows, "problem int, k int, n int")
    one, other = df([(1, 1, 4), (2, 0, 4), (3, 1, 4), (3, 1, 4)]), df([(2, 2, 4), (3, 1, 5), (4, 1, 4)])
    assert {tuple(r) for r in J.pair_refusals(one, other).collect()} == {("not after", "1"), ("not before", "4"), ("twice", "3"), ("other number of episodes", "3")}
    with pytest.raises(ValueError):
        J.strictly_paired(one, other)
    assert [tuple(r) for r in J.strictly_paired(df([(2, 0, 4)]), df([(2, 2, 4)])).collect()] == [(2, 0, 4, 2, 4)]
    with pytest.raises(ValueError):
        D.drawn_of(one.where("k = 0"), one, "problem", 2, 1, "x")
    assert {r.taken_by for r in D.drawn_of(one.where("k = 0"), one.where("k > 0"), "problem", 2, 1, "x", at_least=3).collect()} == {"the rule", "the run's minimum"}
    rounds = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (3, 3)], "problem int, round int")
    with pytest.raises(ValueError):
        D.accumulated(rounds, "problem", 2, rounds.where("false"))
    assert {r.problem for r in D.accumulated(rounds, "problem", 1, rounds.where("problem = 2")).collect()} == {1}


def test_first_difference(spark):
    lists = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos int, id string")
    assert [tuple(r) for r in J.first_difference(lists("abcd"), lists("abxd"), "pos", "id").collect()] == [(2, "c", "x")]
    assert [tuple(r) for r in J.first_difference(lists("abc"), lists("ab"), "pos", "id").collect()] == [(2, "c", None)]
    assert J.first_difference(lists("abc"), lists("abc"), "pos", "id").count() == 0


def test_half_pass_rate_is_exact(spark):
    from fractions import Fraction

    rng = random.Random(1)
    rows = [(i, *(lambda n: (rng.randint(0, n), n))(rng.randint(1, 999_999))) for i in range(300)] + [(300 + i, k, 12) for i, k in enumerate((5, 7, 6, 5))]
    want = sorted(rows, key=lambda r: (abs(Fraction(r[1], r[2]) - Fraction(1, 2)), r[0]))
    got = P.half_pass_rate(spark.createDataFrame(rows, "id int, k int, n int"), "k", "n", "id", 304).collect()
    assert [r.id for r in got] == [r[0] for r in want]


def test_rebuilt_and_states(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "z"), (2, "b")], "problem int, text string").withColumn("sha", F.sha2("text", 256))
    candidates = spark.createDataFrame([(1, "a", 3), (1, "a", 2), (2, "a", 1), (2, "c", 2)], "problem int, text string, pos int")
    got = J.rebuilt(rows, candidates, "problem", "sha", F.col("text"), "pos").collect()
    assert sorted((r.problem, r.pos) for r in got if r.pos is not None) == [(1, 2)] and len(got) == 3
    states = spark.createDataFrame([("first", 1, 1, "s1"), ("x", 1, 2, "s2"), ("y", 1, 2, "t2")], "arm string, p int, loop int, state string")
    steps = spark.createDataFrame([("x", 1, 2), ("y", 1, 2), ("x", 1, 3), ("y", 1, 3), ("x", 1, 4)], "arm string, p int, loop int")
    got = {(r.arm, r.loop): r.state_before for r in J.with_requested_state(steps, states, "arm", ["p"], "loop", "state").collect()}
    assert got == {("x", 2): "s1", ("y", 2): "s1", ("x", 3): "s2", ("y", 3): "t2", ("x", 4): None}
