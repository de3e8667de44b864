"""Performance metrics: one aggregation per curve after a lag window.

A curve has one row per bar, so its length is bounded by the calendar; curves spread over tasks by ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RF = 6.5e-2
PPY = 252
YEAR_DAYS = 3.6525e2


def curve_rows(curve: DataFrame, *, by=("spec_id",), ts="d", eq="eq") -> DataFrame:
    """Adds the simple return ``_r`` (null after a non-positive value), running peak ``_pk`` and drawdown ``_dd``."""
    w = Window.partitionBy(*by).orderBy(ts)
    prev = F.lag(eq).over(w)
    x = curve.withColumn("_r", F.when(prev > 0, F.col(eq) / F.nullif(prev, F.lit(0e0)) - 1))
    x = x.withColumn("_pk", F.max(eq).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("_dd", F.when(F.col("_pk") > 0, F.least(F.lit(1e0), (F.col("_pk") - F.col(eq)) / F.col("_pk")))
                        .otherwise(0e0))


def _ends(ts, eq) -> tuple[Column, Column, Column, Column]:
    return F.min_by(eq, ts), F.max_by(eq, ts), F.date_diff(F.max(ts), F.min(ts)) / YEAR_DAYS, F.count(eq)


def aggregates(ts="d", eq="eq", ppy: float | Column = PPY, rf: float = RF) -> dict[str, Column]:
    """The metric expressions over ``curve_rows`` output, by name."""
    first, last, years, n = _ends(ts, eq)
    ppy = ppy if isinstance(ppy, Column) else F.lit(float(ppy))
    wiped = F.min(eq) <= 0
    zero = F.lit(0e0)
    m, sd, k = F.avg("_r"), F.stddev_samp("_r"), F.count("_r")
    yrs = F.when(years > 0, years).otherwise((n - 1) / F.lit(float(PPY)))

    def guard(v: Column) -> Column:
        return F.when(wiped, F.least(v, zero)).otherwise(v)

    def sharpe(rate: float) -> Column:
        v = (m - rate / ppy) / F.nullif(sd, zero) * F.sqrt(ppy)
        return F.when((k < 2) | (sd == 0), zero).otherwise(guard(v))

    def downside(rate: float) -> Column:
        e = F.col("_r") - F.lit(rate / PPY)
        dn = F.sqrt(F.sum(F.when(e < 0, e * e).otherwise(0e0)) / F.nullif(k, F.lit(0)))
        v = (m - rate / ppy) / F.nullif(dn, zero) * F.sqrt(ppy)
        return F.when((k < 2) | (dn == 0), zero).otherwise(guard(v))

    return {
        "total_return_pct": F.when((n < 2) | (first <= 0), zero).otherwise((last / F.nullif(first, zero) - 1) * 1e2),
        "cagr_pct": F.when((n < 2) | (first <= 0), zero).when(last <= 0, F.lit(-1e2)).otherwise(
            (F.pow(F.greatest(last, zero) / F.nullif(F.greatest(first, zero), zero), 1 / F.nullif(yrs, zero)) - 1) * 1e2),
        "sharpe": sharpe(rf),
        "sharpe_rf0": sharpe(0e0),
        "sortino": downside(rf),
        "max_drawdown_pct": F.max("_dd") * 1e2,
        "periods_per_year": F.when((n < 3) | (years <= 2e-2), F.lit(float(PPY))).otherwise((n - 1) / F.nullif(years, zero)),
        "final_equity": last,
        "bars": n,
    }


def curve_metrics(curve: DataFrame, *, by=("spec_id",), ts="d", eq="eq", names: list[str] | None = None, digits=2,
                  ppy: float = PPY, rf: float = RF) -> DataFrame:
    """The chosen metrics (default: the summary), rounded, one row per curve; one shuffle on ``by``."""
    agg = aggregates(ts, eq, ppy, rf)
    names = names or ["total_return_pct", "cagr_pct", "sharpe", "sharpe_rf0", "sortino", "max_drawdown_pct", "final_equity"]
    rows = curve_rows(curve, by=by, ts=ts, eq=eq)
    return rows.groupBy(*by).agg(*[
        (agg[n] if n == "bars" else F.round(agg[n], digits) + F.lit(0e0)).alias(n) for n in names])


def drawdown_series(curve: DataFrame, *, by=("spec_id",), ts="d", eq="eq") -> DataFrame:
    """Drawdown at every bar and the one the curve ends in."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = curve_rows(curve, by=by, ts=ts, eq=eq)
    return x.select(*by, ts, F.col("_dd").alias("dd"), F.last("_dd").over(w).alias("current_dd"))
