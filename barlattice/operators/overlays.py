"""Market gates, volatility scaling and drawdown switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.metrics import curve_rows


def confirmed_gate(df: DataFrame, raw: Column, n: int, *, key="sym", ts="d", out="gate") -> DataFrame:
    """Regime that flips only after ``n`` agreeing bars in a row; starts off."""
    w = Window.partitionBy(key).orderBy(ts)
    f = w.rowsBetween(-(n - 1), 0)
    x = df.withColumn("_raw", F.when(F.coalesce(raw, F.lit(False)), 1).otherwise(0))
    x = x.withColumn("_set", F.when((F.count("_raw").over(f) == n) & (F.min("_raw").over(f) == F.max("_raw").over(f)), F.col("_raw")))
    state = F.last("_set", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(out, F.coalesce(state, F.lit(0))).drop("_raw", "_set")


def gate_events(df: DataFrame, every: int, *, key="sym", ts="d", gate="gate", gi="gi") -> DataFrame:
    """Exits and re-entries of a gate and the rebalance clock, which restarts at every re-entry."""
    w = Window.partitionBy(key).orderBy(ts)
    prev = F.coalesce(F.lag(gate).over(w), F.lit(0))
    x = df.withColumn("event", F.when((F.col(gate) == 1) & (prev == 0), "reentry").when((F.col(gate) == 0) & (prev == 1), "exit"))
    start = F.coalesce(F.max(F.when(F.col("event") == "reentry", F.col(gi))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return x.withColumn("rebalance", (F.col(gi) - start) % every == 0)


def gate_decisions(events: DataFrame, *, gate="gate", gi="gi") -> DataFrame:
    """(gi, on): the decision bars of a gated book, from ``gate_events``.

    Scheduled rebalances, the clock restarted by each re-entry, merged with the gate's own flips: an exit decides for cash on its bar, a re-entry is a
    full rebalance.  One row per bar, whichever of them falls on it; while the gate is off a scheduled rebalance stays in cash.
    """
    x = events.filter(F.col("event").isNotNull() | F.col("rebalance"))
    return x.select(F.col(gi).cast("long").alias("gi"), (F.col(gate) == 1).alias("on"))


def vol_target_scalar(vol: Column, target: float) -> Column:
    """min(1, target / annualised volatility); 1 while unwarm."""
    ann = vol * (2.52e2 ** 0.5)
    return F.when(ann > 0, F.least(F.lit(1e0), target / F.nullif(ann, F.lit(0e0)))).otherwise(1e0)


def kill_switch_breach(curve: DataFrame, dd: float, *, by=("spec_id",), ts="d", eq="eq") -> DataFrame:
    """First bar on which the drawdown exceeds ``dd``; curves that never breach are left out."""
    x = curve_rows(curve, by=by, ts=ts, eq=eq).filter(F.col("_dd") > dd)
    return x.groupBy(*by).agg(F.min(ts).alias(ts), F.round(F.min_by("_dd", ts), 4).alias("dd"))


def overlay_arms(df: DataFrame, gate: str, scalar: str) -> DataFrame:
    """Every row four times: base, gate only, volatility target only, both, with the arm's exposure ``w``."""
    g, s = F.col(gate).cast("double"), F.col(scalar)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), w.alias("w")) for a, w in
                     (("A_base", F.lit(1e0)), ("B_gate", g), ("C_vol", s), ("D_both", g * s))])
    return df.select("*", F.inline(arms))
