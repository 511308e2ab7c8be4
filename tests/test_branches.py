"""Every outcome of the staged decision rules is reached, and the boundaries fall as hand-written cases say."""

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import branches as B
from verdictlake.plans import decision_queries as Q

FRAME = [(dict(failed=1, mean=0.1, low=0.05, high=0.2), 0), (dict(failed=0, mean=None, low=None, high=None), 1), (dict(failed=0, mean=0.1, low=0.0, high=0.2), 4), (dict(failed=0, mean=0.1, low=1e-9, high=0.2), 2), (dict(failed=0, mean=-0.1, low=-0.2, high=0.0), 4), (dict(failed=0, mean=-0.1, low=-0.2, high=-1e-9), 3)]


def read(spark, rule, **figures):
    row = spark.range(1).select(*[F.lit(v).cast("double" if isinstance(v, float) or v is None else type(v).__name__.replace("int", "bigint").replace("str", "string").replace("bool", "boolean")).alias(k) for k, v in figures.items()])
    return row.select(B.decide(rule).alias("r")).first()["r"]


@pytest.mark.parametrize("rule", ["on_pretraining", "adapter_size", "deep_primary", "replication", "holds_on_the_set", "holds_on_fresh", "cycle_primary", "compounding", "hard_or_long"])
def test_frame(spark, rule):
    for figures, case in FRAME:
        assert read(spark, rule, **figures) == B.RULES[rule][case][1]


def test_gates_stand_before_the_interval(spark):
    good = dict(blind_share=0.2, resume_share=0.1, failed_firsts=10, states=5, mean=0.1, low=0.05, high=0.2)
    assert read(spark, "repair", **good) == "REPAIR IS A STRONGER SEARCH STEP"
    for broken in (dict(resume_share=0.0999), dict(blind_share=0.0), dict(states=4), dict(failed_firsts=0, states=0), dict(mean=None, low=None, high=None)):
        assert read(spark, "repair", **(good | broken)) == "INCONCLUSIVE"
    pool = dict(hard=10, pools=3, steps=4, states=2, pool_checks=20, standing=19, mean=0.0, low=-0.1, high=0.1, gained=8, lost=1, p_value=0.039)
    assert read(spark, "accumulate", **pool) == "THE EPISODE REACHES PROBLEMS WITHOUT RESOLVING MORE EPISODES"
    assert read(spark, "accumulate", **(pool | dict(p_value=0.05))) == "NOT SHOWN AT THIS SIZE"
    for broken in (dict(pools=2), dict(states=1), dict(standing=18), dict(pool_checks=0, standing=0)):
        assert read(spark, "accumulate", **(pool | broken)) == "INCONCLUSIVE"


def test_lines_and_points(spark):
    top = dict(failed=0, mean=0.02, low=0.01, high=0.03, own_gain=0.01)
    assert read(spark, "ceiling", **top).startswith("THE MODEL CAN LEARN") and read(spark, "ceiling", **(top | dict(mean=0.0199))).startswith("LONGER PROOFS")
    assert read(spark, "ceiling", failed=0, mean=0.011, low=-0.1, high=0.1, own_gain=0.01).startswith("TWO MORE") and read(spark, "ceiling", failed=0, mean=0.01, low=-0.1, high=0.1, own_gain=0.01).startswith("NOT SHOWN TO BE")
    noise = dict(failed=0, mean=0.02, low=0.01, high=0.03, band=0.02, seen=True)
    assert read(spark, "assembled_step_1", **noise).startswith("WITHIN") and read(spark, "assembled_step_1", **(noise | dict(band=0.0199))) == "ASSEMBLED PROOFS TEACH"
    assert read(spark, "new_proofs", failed=0, k=185, n=10_000, k0=100, n0=10_000).endswith("FROM THE BEST MODEL") and read(spark, "new_proofs", failed=0, k=184, n=10_000, k0=100, n0=10_000) == "NOT SHOWN AT ONE SEED"
    assert read(spark, "new_proofs", failed=0, k=15, n=10_000, k0=100, n0=10_000) == "NOT SHOWN AT ONE SEED" and read(spark, "new_proofs", failed=0, k=14, n=10_000, k0=100, n0=10_000).startswith("THEY COST")
    assert read(spark, "averaging", failed=0, models_mean=0.5, averaged=0.25, noise=0.125).endswith("AT LEAST THE MEAN OF ITS MODELS")
    assert read(spark, "after_cycle", main_read="IT COSTS", reach="NOT SHOWN", compounding="NOT SHOWN", mean=-0.5, spread=0.25).startswith("IN BETWEEN") and read(spark, "after_cycle", main_read="IT COSTS", reach="NOT SHOWN", compounding="NOT SHOWN", mean=-0.51, spread=0.25).startswith("THE CYCLE")


def test_every_outcome_is_reached(spark, tmp_path):
    spark.range(1, 40_001).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    reached = {}
    for query, rules in (("branches_repair", Q.REPAIR), ("branches_assembled", Q.ASSEMBLED), ("branches_rows", Q.ROWS), ("branches_deep", Q.DEEP), ("branches_seeds", Q.SEEDS), ("branches_noise", Q.NOISE | {"follows": "after_noise"}), ("branches_cycle", Q.CYCLE), ("branches_new_proofs", Q.NEW), ("branches_measure", Q.MEASURE | {"follows": "after_measure"}), ("branches_said_beside", Q.BESIDE), ("branches_draws", Q.DRAWS)):
        rows = getattr(Q, query)(spark, str(tmp_path))
        for name, rule in rules.items():
            reached.setdefault(rule, set()).update(r[0] for r in rows.select(name).distinct().collect())
    assert set(reached) == set(B.RULES)
    assert {rule: {name for _, name in B.RULES[rule]} - found for rule, found in reached.items() if {name for _, name in B.RULES[rule]} - found} == {}


def test_training_gates(spark):
    runs = {"falls": [3.0, 2.0, 2.0, 1.0], "rises": [1.0, 2.0], "one": [1.0], "noisy": [1.0, 3.0, 2.0, 3.0, 1.0, 2.5] * 10}
    df = spark.createDataFrame([(r, float(v), i) for r, vs in runs.items() for i, v in enumerate(vs)], "run string, loss double, pos int")
    got = {r["run"]: r for r in B.training_gates(df, "run", "loss", "pos", share=0.2).collect()}
    assert got["falls"]["took"] and got["falls"]["not_risen"] and not got["rises"]["took"] and not got["rises"]["not_risen"]
    assert got["one"]["compared"] == 0 and not got["one"]["took"] and not got["one"]["not_risen"]
    assert got["noisy"]["compared"] == 12 and not got["noisy"]["took"] and got["noisy"]["rise"] == 0 and got["noisy"]["not_risen"]


def test_could_have_been_seen(spark):
    row = spark.range(1)
    c = lambda v: F.lit(v).cast("double")
    read = lambda *doses: row.select(B.could_have_been_seen(c(-0.01), c(0.01), c(0.002), c(500), list(doses)).alias("s")).first()["s"]
    assert read() is None and read((c(None), c(None))) is None
    assert read((c(0.02), c(1000))) is True and read((c(0.0199), c(1000))) is False and read((c(0.0199), c(1000)), (c(0.1), c(2000))) is True
