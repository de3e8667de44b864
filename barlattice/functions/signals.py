"""Predicates, null-safe arithmetic and position signals as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.indicators import with_indicators


def _all_set(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


def safe_div(a: Column, b: Column) -> Column:
    """a/b; null when either side is null or b is zero."""
    return a / F.nullif(b, F.lit(0e0))


def safe_min(*xs: Column) -> Column:
    """Smallest argument, null if any is null (``least`` alone skips nulls)."""
    return F.when(_all_set(*xs), F.least(*xs))


def safe_max(*xs: Column) -> Column:
    return F.when(_all_set(*xs), F.greatest(*xs))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(_all_set(x, lo, hi), F.greatest(lo, F.least(hi, x)))


def is_true(p: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(p, F.lit(False))


def all_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a & b, [is_true(p) for p in ps])


def any_of(*ps: Column) -> Column:
    return reduce(lambda a, b: a | b, [is_true(p) for p in ps])


def not_(p: Column) -> Column:
    return ~is_true(p)


def hold_state(df: DataFrame, entry: Column, exit_: Column, *, key="sym", ts="d", out="pos",
               disjoint: bool = False) -> DataFrame:
    """In (1) or out (0) per row: flat rows enter on ``entry``, held rows leave on ``exit_``.

    A row with only one of the two sets the state; a row with both flips it.  So the state is the last set value, flipped
    once per both-row since.  ``disjoint`` promises that both never hold, which saves the second window pass.
    """
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    e, x = is_true(entry), is_true(exit_)
    if disjoint:
        return df.select("*", F.coalesce(F.last(F.when(e, 1).when(x, 0), ignorenulls=True).over(w), F.lit(0)).alias(out))
    flips = df.select("*", F.when(e & ~x, 1).when(x & ~e, 0).alias("_set"),
                      F.sum(F.when(e & x, 1).otherwise(0)).over(w).alias("_flips"))
    since = F.col("_flips") - F.coalesce(
        F.last(F.when(F.col("_set").isNotNull(), F.col("_flips")), ignorenulls=True).over(w), F.lit(0))
    base = F.coalesce(F.last("_set", ignorenulls=True).over(w), F.lit(0))
    return flips.select("*", ((base + since) % 2).cast("int").alias(out)).drop("_set", "_flips")


def signal_weight(pos: Column, weight: Column, sign: int = 1) -> Column:
    """Signed target: clamp(weight, 0, 1) while in position, else 0; unusable weights count as 0."""
    ok = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    return F.when((pos == 1) & ok, sign * clamp(weight, F.lit(0e0), F.lit(1e0))).otherwise(F.lit(0e0))


# ---- strategies: df(sym, d, c) -> df + w ----------------------------------------------------------------------------

def strat_buy_hold(df, **_):
    return df.withColumn("w", F.lit(1e0))


def strat_sma_cross(df, fast=50, slow=200, key="sym", ts="d"):
    x = with_indicators(df, {"_f": ("sma", fast), "_s": ("sma", slow)}, key=key, ts=ts)
    return x.withColumn("w", F.when(F.col("_f") > F.col("_s"), 1e0).otherwise(0e0)).drop("_f", "_s")


def strat_short_trend(df, fast=50, slow=200, key="sym", ts="d"):
    x = with_indicators(df, {"_f": ("sma", fast), "_s": ("sma", slow)}, key=key, ts=ts)
    return x.withColumn("w", F.when(F.col("_f") < F.col("_s"), -1e0).otherwise(0e0)).drop("_f", "_s")


def strat_rsi_reversion(df, n=14, lo=35, hi=65, key="sym", ts="d"):
    x = with_indicators(df, {"_r": ("rsi", n)}, key=key, ts=ts)
    x = hold_state(x, F.col("_r") < lo, F.col("_r") > hi, key=key, ts=ts, disjoint=True)
    return x.withColumn("w", F.when(F.col("_r").isNotNull(), F.col("pos").cast("double")).otherwise(0e0)).drop("_r", "pos")


def strat_donchian(df, n=20, key="sym", ts="d"):
    w = Window.partitionBy(key).orderBy(ts)
    x = with_indicators(df, {"_h": ("high", n), "_l": ("low", n)}, key=key, ts=ts)
    x = x.withColumn("_rn", F.row_number().over(w))
    up = (F.col("_rn") > n) & (F.col("c") >= F.col("_h"))
    down = (F.col("_rn") > n) & (F.col("c") <= F.col("_l")) & ~up
    x = hold_state(x, up, down, key=key, ts=ts, disjoint=True)
    return x.withColumn("w", F.col("pos").cast("double")).drop("_h", "_l", "_rn", "pos")


def strat_vol_target(df, n=20, daily=1e-2, key="sym", ts="d"):
    x = with_indicators(df, {"_v": ("vol", n)}, key=key, ts=ts)
    return x.withColumn("w", F.when(F.col("_v") > 0, F.least(F.lit(1e0), daily / F.col("_v"))).otherwise(0e0)).drop("_v")


def strat_three_up(df, n=3, key="sym", ts="d"):
    """In after n rising closes in a row, out on any falling close."""
    w = Window.partitionBy(key).orderBy(ts)
    x = df.withColumn("_up", F.when(F.col("c") > F.lag("c").over(w), 1).otherwise(0)) \
          .withColumn("_dn", F.col("c") < F.lag("c").over(w))
    x = x.withColumn("_run", F.sum("_up").over(w.rowsBetween(-(n - 1), 0)))
    x = hold_state(x, F.col("_run") == n, F.col("_dn"), key=key, ts=ts, disjoint=True)
    return x.withColumn("w", F.col("pos").cast("double")).drop("_up", "_dn", "_run", "pos")


def strat_coin_flip(df, seed=7, key="sym", ts="d"):
    """50/50 control: an arithmetic hash of the row number instead of a random stream."""
    w = Window.partitionBy(key).orderBy(ts)
    h = ((F.row_number().over(w).cast("bigint") + seed) * 7919 + seed) % 1009
    return df.withColumn("w", F.when(h % 2 == 0, 1e0).otherwise(0e0))


def trend_raw(df, sma_len=200, buffer=5e-2, vol_target=1.5e-1, vol_len=20, key="sym", ts="d"):
    """Trend state with an exit buffer, and the unbanded size min(1, target / annual vol)."""
    x = with_indicators(df, {"_s": ("sma", sma_len), "_v": ("vol", vol_len)}, key=key, ts=ts)
    x = hold_state(x, F.col("c") > F.col("_s"), F.col("c") < (1 - buffer) * F.col("_s"), key=key, ts=ts, disjoint=True)
    ann = F.col("_v") * (2.52e2 ** 0.5)
    raw = F.when(F.col("_v").isNull(), 0e0).when(ann > 0, F.least(F.lit(1e0), vol_target / ann)).otherwise(1e0)
    return x.withColumn("raw", F.when(F.col("pos") == 1, raw).otherwise(0e0)).drop("_s", "_v")


def strat_trend_buffer(df, **kw):
    return trend_raw(df, **kw).withColumnRenamed("raw", "w").drop("pos")


def deadband(df: DataFrame, band: float, *, key="sym", ts="d", pos="pos", raw="raw", out="w") -> DataFrame:
    """While in position, keep the held weight until the wanted one differs by ``band`` or more.

    The held weight restarts with each run of rows in position, so runs are independent and folded in parallel.  A run
    is at most one row per bar of the calendar.
    """
    w = Window.partitionBy(key).orderBy(ts)
    flag = F.col(pos) == 1
    x = df.withColumn("_new", F.when(flag & (F.coalesce(F.lag(pos).over(w), F.lit(0)) != 1), 1).otherwise(0))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = x.filter(flag)
    rest = x.filter(~flag).withColumn(out, F.lit(0e0))
    packed = held.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(ts, raw))).alias("_seq"))
    step = F.aggregate(
        "_seq",
        F.struct(F.lit(None).cast("double").alias("h"), F.array().cast("array<double>").alias("ws")),
        lambda a, r: F.struct(
            F.when(a["h"].isNull() | (F.abs(r[raw] - a["h"]) >= band), r[raw]).otherwise(a["h"]).alias("h"),
            F.concat(a["ws"], F.array(
                F.when(a["h"].isNull() | (F.abs(r[raw] - a["h"]) >= band), r[raw]).otherwise(a["h"]))).alias("ws")),
        lambda a: a["ws"],
    )
    flat = packed.select(key, F.explode(F.arrays_zip(F.col("_seq"), step.alias("ws"))).alias("z")) \
        .select(key, F.col(f"z._seq.{ts}").alias(ts), F.col("z.ws").alias(out))
    held = held.join(flat, [key, ts])
    return held.select(*df.columns, out).unionByName(rest.select(*df.columns, out))


STRATEGIES = {
    "buy_hold": strat_buy_hold, "sma_cross": strat_sma_cross, "rsi_reversion": strat_rsi_reversion,
    "donchian": strat_donchian, "vol_target": strat_vol_target, "three_up": strat_three_up,
    "coin_flip": strat_coin_flip,
}
