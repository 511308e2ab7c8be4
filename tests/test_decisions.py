"""Every boundary of the decision rules, the bootstrap against a plain loop, and the refusals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import intervals, rates
from verdictlake.operators import checks as C
from verdictlake.operators import decisions as D


def figures(spark, rows, names):
    return spark.createDataFrame(rows, names)


def own():
    return D.Interval(F.col("mean"), F.col("low"), F.col("high"))


def names(df, rule):
    return [r[0] for r in df.select(F.col("at"), rule["name"].alias("name")).orderBy("at").select("name").collect()]


INTERVALS = [(0, 0, 0.02, 0.01, 0.03), (1, 0, 0.01, 0.0, 0.02), (2, 0, -0.01, -0.02, 0.0), (3, 0, -0.02, -0.03, -0.01), (4, 1, 0.02, 0.01, 0.03), (5, 0, None, None, None)]
NAMES = "at int, failed int, mean double, low double, high double"


def test_three_way_and_labels(spark):
    rows = figures(spark, INTERVALS, NAMES)
    assert names(rows, D.three_way(F.col("failed"), own(), "UP", "DOWN", "HOLDS")) == ["UP", "HOLDS", "HOLDS", "DOWN", D.INCONCLUSIVE, D.NOT_READ]
    assert [r[0] for r in rows.where("at < 4").orderBy("at").select(D.interval_label(own())).collect()] == ["improved", "no measurable change", "no measurable change", "degraded"]
    assert names(rows, D.draws(own()))[:4] == [D.BEAT, "NOT SHOWN", "NOT SHOWN", D.THEY_COST]


def test_draws_at_exactly_the_effect_found(spark):
    rows = figures(spark, [(0, 0, 0.0, -0.0165, 0.0165), (1, 0, 0.0, -0.0166, 0.0166)], NAMES)
    assert names(rows, D.draws(own())) == ["NOT SHOWN", D.UNDETECTABLE_SEEDS]


def test_scout_and_aimed(spark):
    rows = figures(spark, [(0, 0.0, True), (1, -0.004, True), (2, -0.0041, True), (3, 0.1, False), (4, None, True)], "at int, d double, ok boolean")
    assert names(rows, D.scout(F.col("d"), F.col("ok"))) == [D.ESCALATE, D.ESCALATE, D.TOKEN_HABIT, D.VOID, D.NOT_READ]
    cases = [(0, 9, 0.2, 0.1, 0.0, -1.0, 1.0), (1, 10, None, 0.1, 0.0, -1.0, 1.0), (2, 10, 0.1, 0.1, 0.0, -1.0, 1.0), (3, 10, 0.2, 0.1, None, None, None), (4, 10, 0.2, 0.1, -0.2, -0.3, -0.1), (5, 10, 0.2, 0.1, 0.0, -0.1, 0.1), (6, 10, 0.2, 0.1, -0.1, -0.2, 0.0)]
    rows = figures(spark, cases, "at int, n int, r double, r0 double, mean double, low double, high double")
    assert names(rows, D.aimed_round(own(), F.col("r"), F.col("r0"), F.col("n"), 10)) == [D.VOID] * 4 + [D.STOP_AND_DIAGNOSE, D.ESCALATE, D.NOT_NAMED_BY_THE_SPEC]


def test_first_rung_and_loop(spark):
    cases = [(0, 0.5, 0.0, -1.0, 1.0, 1.0), (1, 0.1, 0.1, 0.05, 0.2, 1.0), (2, 0.1, -0.1, -0.2, -0.05, 1.0), (3, 0.1, 0.0, -1.0, 1.0, -1.0), (4, 0.1, 0.0, -1.0, 1.0, 1.0), (5, 0.1, 0.0, -1.0, 1.0, 0.0), (6, None, 0.0, -1.0, 1.0, 1.0)]
    rows = figures(spark, cases, "at int, base double, mean double, low double, high double, second double")
    rule = D.first_rung(own(), F.col("base"), (0.0, 0.2), [D.Interval(F.col("second"), F.col("second"), F.col("second"))])
    assert names(rows, rule) == [D.VOID, D.ESCALATE, D.STOP, D.SECONDARY_BELOW, D.SECONDARY_ABOVE, D.UNDETECTABLE, D.VOID]
    cases = [(0, False, 1.0, 1.0, False, 1.0), (1, True, 0.0, 0.0, False, 1.0), (2, True, 0.0, 0.1, True, 1.0), (3, True, None, 0.0, False, None), (4, True, 1.0, 1.0, None, -0.1)]
    rows = figures(spark, cases, "at int, m boolean, i double, a double, b boolean, l double")
    assert names(rows, D.loop_rounds(*map(F.col, "miabl"))) == [D.VOID, D.VOID, D.STOP_AND_DIAGNOSE, D.VOID, D.ESCALATE]


def test_rows_rule_and_three_reads(spark):
    cases = [(0, 0, 0, 9, 10, 1, 0.01, 0.1, 0.01, 0.2), (1, 0, 0, 9, 10, 1, 0.01, 0.1, 0.0, 0.2), (2, 0, 0, 9, 5, 5, 1.0, 0.1, 0.01, 0.2), (3, 0, 0, 9, 1, 10, 0.01, 0.0, -0.1, 0.1), (4, 1, 0, 9, 10, 1, 0.01, 0.1, 0.01, 0.2), (5, 0, 2, 9, 10, 1, 0.01, 0.1, 0.01, 0.2), (6, 0, 0, 0, 0, 0, None, 0.1, 0.01, 0.2), (7, 0, 0, 9, 10, 1, 0.05, 0.1, 0.01, 0.2)]
    rows = figures(spark, cases, "at int, failed int, against int, n int, g int, l int, p double, mean double, low double, high double")
    c = F.col
    assert names(rows, D.rows_rule(c("failed"), c("against"), c("n"), c("g"), c("l"), c("p"), own())) == [D.GIVES_BACK, D.UNDOES, D.KEEPS_ONLY, D.NOT_THIS_LEVER, D.INCONCLUSIVE, D.NOT_READ, D.NOT_READ, D.KEEPS_ONLY]
    reads = rows.select("at", *D.three_reads(c("failed"), own(), c("n"), c("g"), c("l"), c("p"), own())).orderBy("at").collect()
    assert [tuple(r)[1:] for r in reads] == [(True, True, True, True), (False, True, True, False), (True,) * 4, (False, False, True, False), (None,) * 4, (True,) * 4, (True, None, True, None), (True,) * 4]


def test_exact_lines(spark):
    rows = figures(spark, [(0, 500, 0), (1, 491, 0), (2, 490, 0), (3, 489, 0), (4, 1, 1)], "at int, k int, failed int")
    assert names(rows, D.stock_dose(F.col("failed"), F.col("k"), F.lit(1000), F.lit(500), F.lit(1000), 100)) == [D.ESCALATE, D.NOT_SHOWN_AT_ONE, D.NOT_SHOWN_AT_ONE, D.COSTS, D.INCONCLUSIVE]
    rows = figures(spark, [(0, 10085, 20000), (1, 10170, 20000), (2, 9830, 20000), (3, 9829, 20000), (4, 0, 0)], "at int, k int, n int")
    bar = (F.lit(0), F.col("k"), F.col("n"), F.lit(10000), F.lit(20000))
    assert names(rows, D.against_bar(*bar)) == [D.NOT_SHOWN_AT_ONE, D.ADDS, D.NOT_SHOWN_AT_ONE, D.COSTS, D.NOT_READ]
    assert names(rows, D.what_made_it(*bar)) == [D.ONE_CONTINUATION] * 4 + [D.NOT_READ]


def test_tax_read(spark):
    rows = figures(spark, [(0, 0.8, 0.8, 0.9), (1, 0.79, 0.7, 0.8), (2, 0.79, 0.7, 0.79), (3, None, None, None), (4, 0.9, None, None)], "at int, s double, low double, high double")
    read = rows.select("at", *D.tax_read(F.col("s"), F.col("low"), F.col("high"))).orderBy("at").collect()
    assert [tuple(r)[1:] for r in read] == [("small", True), ("not small", False), ("not small", True), ("undefined", None), ("small", False)]


def test_sign_probability_equals_the_exact_one(spark):
    pairs = [(g, l) for g in range(0, 12) for l in range(0, 12)] + [(700, 640), (2000, 1800), (30, 0)]
    for r in spark.createDataFrame(pairs, "g long, l long").select("g", "l", rates.sign_probability(F.col("g"), F.col("l")).alias("p")).collect():
        n = r.g + r.l
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(r.g, r.l) + 1)) / 2**n) if n else None
        assert (want is None and r.p is None) or math.isclose(r.p, want, rel_tol=2e-5)


def test_bootstrap_draws_do_not_depend_on_the_step(monkeypatch):
    values = np.random.default_rng(1).normal(size=137)
    draw = np.random.default_rng(5).integers(0, 137, size=(3000, 137))
    means = values[0] + (values - values[0])[draw].mean(axis=1)
    want = (values.mean(), *np.quantile(means, [0.025, 0.975]))
    for places in (1, 137 * 7, 4_000_000):
        monkeypatch.setattr(intervals, "PLACES", places)
        assert np.allclose(intervals.bootstrap(values, 3000, seed=5), want, rtol=0, atol=1e-12)
    assert intervals.bootstrap(np.full(9, 0.1)) == (0.1, 0.1, 0.1)
    for bad in ([], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            intervals.bootstrap(np.array(bad))


def test_bootstrap_by_section(spark):
    rows = [("a", i, (i % 5 - 2) / 4) for i in range(40)] + [("b", 1, None), (None, 3, 0.5)]
    got = {r["s"]: tuple(r)[1:] for r in intervals.bootstrap_by(spark.createDataFrame(rows, "s string, p int, d double"), "s", "p", "d").collect()}
    want = intervals.bootstrap(np.array([d for s, _, d in rows if s == "a"]))
    assert got["a"] == (40, *(round(x, 5) for x in want)) and got[None] == (1, 0.5, 0.5, 0.5)
    assert got["b"][0] == 0 and all(x is None or math.isnan(x) for x in got["b"][1:])


def test_round_data(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "problem int")
    results = spark.createDataFrame([("heldout", 1, 1, 4), ("heldout", 2, 0, 5), ("base_map", 3, 5, 4), ("base_map", 3, 0, 4), ("other", 9, 0, 4), ("base_map", 8, None, 4)], "set string, problem int, k int, n int")
    found = {tuple(r) for r in C.round_data_violations(ids(1, 2, 5), ids(3, 4), ids(1, 4, 6, 6), ids(3, 7), results, 4).collect()}
    assert found == {
        ("candidate twice", "6"), ("candidate in heldout", "1"), ("candidate in base_map", "4"), ("result of base_map twice", "3"), ("no result of heldout", "5"), ("no result of base_map", "4"),
        ("result outside base_map", "8"), ("unknown set", "9"), ("not k of n", "3"), ("not k of n", "8"), ("other number of episodes", "2"), ("no facts", "4"), ("facts outside base_map", "7"),
    }
    with pytest.raises(ValueError, match="refused"):
        C.refuse(ids(1), "a set")
    C.refuse(ids(1).where("false"), "a set")


def test_set_differences_and_side_plan(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "p int")
    assert sorted(tuple(r) for r in C.set_differences(ids(1, 2, 2, 3), ids(1, 3, 4), "p").collect()) == [(2, 2, 0), (4, 0, 1)]
    rows = spark.createDataFrame([(0, "negation", True, False), (1, "negation", True, True), (2, "statement", False, False), (3, None, None, None)], "at int, out string, neg boolean, audit boolean")
    args = (F.col("out"), F.col("neg"), F.col("audit"))
    plans = rows.orderBy("at").select(C.side_plan(*args, False), C.side_plan(*args, True), C.side_plan(*args, True, skip=True)).collect()
    both, one = {"statement": "checked", "negation": "checked"}, {"statement": "checked"}
    assert [tuple(r) for r in plans] == [
        (both, {**both, "negation": "generated_only"}, one), (both, both, both), (one, {"statement": "generated_only"}, {}), (one, one, one),
    ]
