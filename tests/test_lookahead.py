"""Changing the last bar of every series must not change any earlier result; order and partitioning do not matter."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions import signals as S
from barlattice.functions.indicators import with_indicators
from barlattice.operators.ranking import expanding_sharpe

SPECS = {"s": ("sma", 20), "e": ("ema", 10), "r": ("rsi", 14), "v": ("vol", 20), "h": ("high", 20), "z": ("zscore", 20), "m": ("macd_hist", 5, 9, 4), "rv": ("realized_vol", 20)}


def twin(df, c="c", key="sym"):
    w = Window.partitionBy(key).orderBy(F.col("d").desc())
    x = df.withColumn("_b", F.row_number().over(w))
    return x.withColumn(c, F.when(F.col("_b") == 1, F.col(c) * 1.5e0).otherwise(F.col(c))).drop("_b")


def before_last(rows, key="sym"):
    last = {}
    for r in rows:
        last[r[key]] = max(last.get(r[key], r["d"]), r["d"])
    return sorted([tuple(r) for r in rows if r["d"] < last[r[key]]], key=str)


def same(a, b):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and u == pytest.approx(v, rel=1e-12, abs=1e-15))


def panel(t):
    return t.candles_type.select("sym", "d", "c")


def test_indicators(t):
    f = lambda df: with_indicators(df, SPECS).drop("c")
    same(before_last(f(panel(t)).collect()), before_last(f(twin(panel(t))).collect()))


@pytest.mark.parametrize("name", list(S.STRATEGIES) + ["trend"])
def test_strategies(t, name):
    fn = S.STRATEGIES.get(name) or (lambda df: S.deadband(S.trend_raw(df, sma_len=50), 1e-1))
    f = lambda df: fn(df).select("sym", "d", "w")
    same(before_last(f(panel(t)).collect()), before_last(f(twin(panel(t))).collect()))


def test_expanding_sharpe(t):
    f = lambda df: expanding_sharpe(df.withColumnRenamed("c", "eq").withColumnRenamed("sym", "spec_id")).select("spec_id", "d", "xs")
    same(before_last(f(panel(t)).collect(), "spec_id"), before_last(f(twin(panel(t))).collect(), "spec_id"))


def test_order_and_partitioning(t):
    a = with_indicators(panel(t), SPECS)
    b = with_indicators(panel(t).orderBy(F.rand(3)).repartition(13), SPECS)
    key = lambda r: (r["sym"], r["d"])
    same([tuple(r) for r in sorted(a.collect(), key=key)], [tuple(r) for r in sorted(b.collect(), key=key)])
