"""Indicator queries over the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions.indicators import feature_vector, with_indicators
from barlattice.plans.registry import query

W = "partition by sym order by d"


def fr(n: int, shift: int = 0) -> str:
    return f"over ({W} rows between {n - 1 + shift} preceding and {str(shift) + ' preceding' if shift else 'current row'})"


def full(fn: str, x: str, n: int, shift: int = 0) -> str:
    return f"case when count({x}) {fr(n, shift)} = {n} then {fn}({x}) {fr(n, shift)} end"


def sma(n, shift=0):
    return full("avg", "c", n, shift)


def vol(n):
    return full("stddev_pop", "ret", n)


def mom(n):
    return f"case when lag(c,{n}) over ({W}) > 0 then c/lag(c,{n}) over ({W}) - 1 end"


def ema(n, x="c"):
    k = repr(2.0 / (n + 1)) + "e0"
    return (f"case when count({x}) {fr(n)} = {n} then list_reduce(list({x}) {fr(n)}, "
            f"lambda a, v: v*{k} + a*(1-{k})) end")


def rsi(n):
    g = f"sum(greatest(chg,0e0)) {fr(n)}"
    ls = f"sum(greatest(-chg,0e0)) {fr(n)}"
    return f"case when count(chg) {fr(n)} = {n} then case when {ls} = 0 then 1e2 else 1e2 - 1e2/(1+{g}/nullif({ls},0)) end end"


STAGE = f"""stage as (select *, c/lag(c) over ({W}) - 1 ret, c - lag(c) over ({W}) chg,
             ln(c/lag(c) over ({W})) lret from candles_daily)"""
RV = f"case when count(c) {fr(21)} = 21 then stddev_pop(lret) {fr(20)}*sqrt(2.52e2) else 1.8e-1 end"
SLOPE = f"({sma(50)})/({sma(50, 1)}) - 1"
DIST = f"c/({full('max', 'c', 252)}) - 1"
VR = f"({vol(20)})/nullif({vol(63)},0)"
Z = f"(c - ({sma(50)}))/nullif({full('stddev_pop', 'c', 50)},0)"

# query name -> (indicator spec, SQL expression over stage, digits)
CASES = {
    "ret": (("ret",), "ret", 8),
    "price": (("price",), "c", 4),
    "sma": (("sma", 20), sma(20), 6),
    "ema": (("ema", 20), ema(20), 7),
    "rsi": (("rsi", 14), rsi(14), 6),
    "mom": (("mom", 63), mom(63), 8),
    "high": (("high", 20), f"max(c) over ({W} rows between 20 preceding and 1 preceding)", 4),
    "low": (("low", 20), f"min(c) over ({W} rows between 20 preceding and 1 preceding)", 4),
    "vol": (("vol", 20), vol(20), 8),
    "atr_close": (("atr_close", 14), f"case when count(chg) {fr(14)} = 14 then avg(abs(chg)) {fr(14)} end", 7),
    "close_std": (("close_std", 20), full("stddev_pop", "c", 20), 7),
    "dist_high": (("dist_high", 252), DIST, 8),
    "slope": (("slope", 50), SLOPE, 8),
    "volratio": (("volratio", 20, 63), VR, 7),
    "zscore": (("zscore", 50), Z, 6),
    "regime": (("regime", 50), f"case when count(c) {fr(50)} = 50 then case when c > avg(c) {fr(50)} then 1e0 else 0e0 end end", 1),
    "realized_vol": (("realized_vol", 20), RV, 7),
    "model_iv": (("model_iv",), f"greatest(8e-2, ({RV})*1.2e0)", 7),
    "mom_12_1": (("mom_12_1", 252, 21), f"(1+({mom(252)}))/(1+({mom(21)})) - 1", 8),
}


def _register(name, spec, expr, digits):
    @query(name, "candles_daily", f"{STAGE} select sym, d, round({expr}, {digits}) + 0e0 val from stage")
    def run(t, spec=spec, digits=digits):
        return with_indicators(t.candles_daily, {"val": spec}).select(
            "sym", "d", (F.round("val", digits) + F.lit(0e0)).alias("val"))


for _n, (_s, _e, _d) in CASES.items():
    _register(_n, _s, _e, _d)


@query("macd_hist", "candles_daily", f"""
  l as (select *, {ema(12)} - {ema(26)} line from candles_daily)
  select sym, d, round(case when count(c) {fr(35)} = 35 then line - ({ema(9, 'line')}) end, 7) + 0e0 val from l""")
def macd_hist(t):
    return with_indicators(t.candles_daily, {"val": ("macd_hist", 12, 26, 9)}).select(
        "sym", "d", (F.round("val", 7) + F.lit(0e0)).alias("val"))


FEATURE_SQL = {"mom21": mom(21), "mom63": mom(63), "mom126": mom(126), "rsi14": rsi(14), "dist_high": DIST,
               "volratio": VR, "sma_slope": SLOPE, "zscore50": Z}
FEATURE_CTE = (f"{STAGE}, feats as (select sym, d, c, " + ", ".join(f"{e} {n}" for n, e in FEATURE_SQL.items())
               + " from stage)")
FEATURE_OK = " and ".join(f"{n} is not null" for n in FEATURE_SQL)


@query("feature_vector", "candles_daily", FEATURE_CTE + " select sym, d, "
       + ", ".join(f"round({n}, 6) + 0e0 {n}" for n in FEATURE_SQL) + f" from feats where {FEATURE_OK}")
def features(t):
    return feature_vector(t.candles_daily).select(
        "sym", "d", *[(F.round(n, 6) + F.lit(0e0)).alias(n) for n in FEATURE_SQL])


@query("tick_indicators_split", "ticks", """
  s as (select event_id, sym, ts, price c, price - lag(price) over (partition by sym order by ts, event_id) chg from ticks)
  select event_id, sym, round(avg(c) over w, 7) m, round(c/nullif(max(c) over w, 0e0) - 1, 8) + 0e0 dh from s
  window w as (partition by sym order by ts, event_id rows between 19 preceding and current row)
  qualify count(c) over w = 20""")
def tick_indicators_split(t):
    """The same indicators on raw ticks, where one symbol may hold most rows: series are cut into pieces."""
    x = t.ticks.select("event_id", "sym", F.struct("ts", "event_id").alias("d"), F.col("price").alias("c"))
    y = with_indicators(x, {"m": ("sma", 20), "dh": ("dist_high", 20)}, split_rows=2000)
    return y.filter("m is not null").select(
        "event_id", "sym", F.round("m", 7).alias("m"), (F.round("dh", 8) + F.lit(0e0)).alias("dh"))
