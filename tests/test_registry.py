"""Registered queries on small tables of their own."""

import datetime
import math
import re
import statistics

import numpy as np
import pytest

from verdictlake.functions import rates
from verdictlake.plans.registry import QUERIES


def test_forbidden_tokens_of_every_language(spark, tmp_path):
    texts = ["in the end", "café de nuit", "then dé", "éthe x.the the'", "de the", None, "", "THE"]
    rows = [(8 * j + i, t, lang) for j, lang in enumerate(["en", "fr", None]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda t: next((k for k in ("the", "de") if re.search(rf"(?<![\w.']){k}(?![\w'])", t)), None) if t is not None else None
    got = QUERIES["forbidden_token"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], str(r["token"])) for r in got) == sorted((i, str(plain(t))) for i, t, _ in rows)


def lineitem(spark, folder, rows):
    kinds = "l_partkey bigint, l_linestatus string, l_linenumber int, l_returnflag string, l_shipdate date, l_discount double"
    spark.createDataFrame(rows, kinds).write.parquet(str(folder / "lineitem.parquet"))


def test_histogram_counts_every_problem(spark, tmp_path):
    lineitem(spark, tmp_path, [(p, "O", i, "R" if i < k else "N", datetime.date(1995, 1, 1), 0.09) for p, k in enumerate([0, 2, 8, 12, 12]) for i in range(15)])
    got = {r["k"]: r["problems"] for r in QUERIES["k_histogram"](spark, str(tmp_path)).collect()}
    assert got == {k: {0: 1, 2: 1, 8: 1, 12: 2}.get(k, 0) for k in range(13)}


@pytest.mark.parametrize("f", rates.T_CRITICAL)
def test_critical_values_leave_the_tails(f):
    x = np.linspace(0, rates.T_CRITICAL[f], 200_001)
    y = (1 + x * x / f) ** (-(f + 1) / 2) * math.gamma((f + 1) / 2) / math.sqrt(f * math.pi) / math.gamma(f / 2)
    assert abs(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum() - 0.475) < 1e-8


def test_t_interval_reads_every_year(spark, tmp_path):
    years = lambda n: [(1, "O", i, "R" if i < 2 + y % 3 else "N", datetime.date(1990 + y, 1, 1), 0.0) for y in range(n) for i in range(6)]
    lineitem(spark, tmp_path, years(9))
    got, shares = QUERIES["t_interval_over_seeds"](spark, str(tmp_path)).first(), [(2 + y % 3) / 6 for y in range(9)]
    half = rates.T_CRITICAL[8] * statistics.stdev(shares) / 3
    assert got["seeds"] == 9 and abs(got["low"] - (statistics.fmean(shares) - half)) < 1e-8 and abs(got["high"] - (statistics.fmean(shares) + half)) < 1e-8
    for n in (1, 11):
        (tmp_path / str(n)).mkdir()
        lineitem(spark, tmp_path / str(n), years(n))
        with pytest.raises(ValueError):
            QUERIES["t_interval_over_seeds"](spark, str(tmp_path / str(n)))
