"""Hand values, equivalences on grids, and laws of the seeded draws."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import rates, seeded, statements
from verdictlake.operators import attempts as A
from verdictlake.operators import draws as D
from verdictlake.operators import pool as P
from verdictlake.plans.session import working_dir
from verdictlake.streaming import verdict_log as S


def test_pass_at_equals_the_closed_form(spark):
    rows = spark.createDataFrame([(c, n) for n in range(1, 13) for c in range(n + 1)], "c int, n int")
    for k in (1, 2, 5):
        for r in rows.select("c", "n", rates.pass_at(k, F.col("c"), F.col("n")).alias("p")).collect():
            want = None if r.n < k else 1 - math.comb(r.n - r.c, k) / math.comb(r.n, k)
            assert (r.p is None) == (want is None) and (want is None or abs(r.p - want) < 1e-12)


def test_band_and_rungs(spark):
    for target, floor in ((0.25, 0.8), (0.1, 0.5), (0.5, 0.999), (0.9, 0.5)):
        a, (low, high) = 1 / target - 1, rates.band_edges(target, floor)
        assert low < target < high and all(abs(p * (1 - p) ** a / (target * (1 - target) ** a) - floor) < 1e-9 for p in (low, high))
    low, high = rates.band_edges(0.25, 0.8)
    rows = spark.createDataFrame([(k, 100) for k in range(101)], "k int, n int").select("k", rates.rung(F.col("k"), F.col("n")).alias("r")).collect()
    for r in rows:
        p = r.k / 100
        assert r.r == (None if r.k == 0 else "in" if low <= p <= high else "below" if p < 0.25 else "above")


@pytest.mark.parametrize(("gained", "lost", "p"), [(0, 0, None), (5, 0, 0.0625), (3, 3, 1.0), (8, 1, 0.0390625)])
def test_sign_test(spark, gained, lost, p):
    assert spark.range(1).select(rates.sign_probability(F.lit(gained).cast("bigint"), F.lit(lost).cast("bigint")).alias("p")).first()["p"] == p


def test_seeded_draws_follow_the_hash(spark):
    ids = [str(i) for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    h = {i: hashlib.sha256(f"3:x:{i}".encode()).hexdigest() for i in ids}
    got = df.select("id", seeded.uniform(3, "x", F.col("id")).alias("u"), seeded.half(3, "x", F.col("id")).alias("h"), seeded.in_share(3, "x", F.col("id"), 0.4).alias("s")).collect()
    for r in got:
        assert r.u == int(h[r.id][:13], 16) / 16**13 and r.h == int(h[r.id], 16) % 2 and r.s == (int(h[r.id][:8], 16) / 2**32 < 0.4)
    small, large = ([r.id for r in P.seeded_draw(df, "id", n, 3, "x").collect()] for n in (7, 20))
    assert large[:7] == small == sorted(ids, key=h.get)[:7]


COMMENTS = [
    ("a -- b\nc", "a     \nc"), ("a /- x /- y -/ z -/ b", "a                   b"), ("/- open\nstill", "       \n     "), ("no", "no"), ("/-- doc -/ t", "           t"), ("--/- no block\nx -/ y", "             \nx -/ y"),
    ("/- -- -/ after", "         after"), ("a-b - c/d", "a-b - c/d"), ("x/-/y", "x    "), (None, None), ("", ""),
]


def test_comments_become_spaces(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(COMMENTS)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", statements.strip_comments(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(COMMENTS))] == [want for _, want in COMMENTS]


@pytest.mark.parametrize("seed", range(3))
def test_two_key_duplicates_match_the_loop(spark, seed):
    working_dir(spark)
    rng = random.Random(seed)
    rows = [(i, f"t{rng.randrange(14)}", rng.choice([None, *(f"f{j}" for j in range(12))])) for i in range(60)]
    seen_t, seen_f, want = set(), set(), []
    for i, t, f in rows:
        if t in seen_t or (f is not None and f in seen_f):
            continue
        want.append(i)
        seen_t.add(t)
        if f is not None:
            seen_f.add(f)
    df = spark.createDataFrame(rows, "pos int, t string, f string")
    assert sorted(r.pos for r in D.first_wins(df, "pos", ["t", "f"]).collect()) == want


def test_settle(spark):
    rows = [("a", 1, "rejected"), ("a", 2, "verified"), ("a", 3, None), ("b", 1, None), ("b", 2, "verified"), ("c", 1, "rejected"), ("d", 1, "verified")]
    got = {r.p: (r.state, r.settled_at, r.next_check) for r in A.settled(spark.createDataFrame(rows, "p string, pos int, status string"), "p", "pos", "status").collect()}
    assert got == {"a": ("in", 2, None), "b": ("open", None, 1), "c": ("out", None, None), "d": ("in", 1, None)}


def test_matched_in_length_falls_back_to_shorter_bins(spark):
    rows = lambda bins: spark.createDataFrame([(f"{b}{i}", b) for b, n in bins.items() for i in range(n)], "id string, bin string")
    got = P.matched_in_length(rows({"8+": 3, "1": 1}), rows({"8+": 1, "4-7": 5, "1": 4}), "id", ["1", "2-3", "4-7", "8+"], 7)
    assert {r.bin: r["count"] for r in got.groupBy("bin").count().collect()} == {"8+": 1, "4-7": 2, "1": 1}
    with pytest.raises(ValueError):
        P.matched_in_length(rows({"1": 9}), rows({"1": 2}), "id", ["1"], 7)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select id, timestamp_seconds(1700000000 + id * 7) ts, if(id % 3 = 0, 'error', 'view') event_type from range(400)")
    rows.repartition(6).write.parquet(str(tmp_path / "log"))
    stream = S.failures_stream(spark, str(tmp_path / "log"), rows.schema)
    got = S.run_available(stream, "failures_test", str(tmp_path / "state"))
    assert sorted(got.collect()) == sorted(S.per_minute(rows, "ts", "event_type").collect())
