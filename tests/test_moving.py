"""Trailing statistics by blocks against their definitions, and plans that sort and read once."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import moving as M
from paneltide.operators import windows as W
from paneltide.plans import relational_queries as R


@pytest.mark.parametrize("n,size", [(5, 23), (7, 7), (252, 700), (4, 3)])
def test_scores_and_sums_are_those_of_each_window(n, size):
    rng = np.random.default_rng(0)
    x, known = rng.normal(size=size), rng.random(size) < 0.8
    rolled = pd.Series(np.where(known, x, np.nan)).rolling(n, min_periods=2)
    got, ok = M.zscored(x, known, n, 2)
    want = (np.where(known, x, np.nan) - rolled.mean()) / rolled.std()
    assert (ok == want.notna()).all() and np.allclose(got[ok], want[ok])
    got, ok = M.summed(x, known, n, 2)
    assert (ok == rolled.sum().notna()).all() and np.allclose(got[ok], rolled.sum()[ok])


def test_equal_values_have_no_score_and_far_ones_leave_no_trace():
    every = np.ones(900, bool)
    assert not M.zscored(np.full(900, 0.1), every, 252, 126)[1].any()
    x = np.random.default_rng(1).normal(size=900) * 1e-3
    x[100] = 1e9
    last = x[400:652]
    assert M.zscored(x, every, 252, 126)[0][651] == pytest.approx((x[651] - last.mean()) / last.std(ddof=1), rel=1e-9)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    return spark.createDataFrame([(dt.date(2024, 1, 1 + i % 9), f"N{i // 9}", float(i * i % 7)) for i in range(90)], "date date, ticker string, close double")


def test_recurrences_and_ranks_sort_once(spark):
    assert plan(W.macd(rows(spark))).count("Sort [") == 1
    assert plan(rows(spark).select("date", W.pct_rank("close", "date"))).count("Sort [") == 1
    both = rows(spark).select(W.pct_rank("close", "date").alias("a"), W.pct_rank("close", "date", falling=True).alias("b"))
    assert both.where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_predictions_are_not_joined(spark):
    class Tables:
        panel = rows(spark)

    assert "Join" not in plan(R.preds(Tables))
