"""Predicate, position and strategy queries over the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions import signals as S
from barlattice.functions.indicators import with_indicators
from barlattice.plans.indicators import STAGE, W, fr, rsi, sma, vol
from barlattice.plans.registry import query
from barlattice.plans.registry import rr as r
from barlattice.plans.registry import tr, tr_sql


MATH_CTE = f"""m as (select sym, d, c, {sma(20)} s, case when d < date '1994-01-01' then 0e0 else c - 1e2 end z from candles_daily)"""


@query("safe_math", "candles_daily", f"""{MATH_CTE}
  select sym, d, round(c + s, 6) + 0e0 a, round(c - s, 6) + 0e0 b, {tr_sql('c*s', 4)} p, round(c/nullif(z, 0e0), 6) + 0e0 q,
         case when s is not null then round(least(c, s), 6) end lo, case when s is not null then round(greatest(c, s), 6) end hi
  from m""")
def safe_math(t):
    x = with_indicators(t.candles_daily, {"s": ("sma", 20)})
    c, s = F.col("c"), F.col("s")
    z = F.when(F.col("d") < F.lit("1994-01-01").cast("date"), 0e0).otherwise(c - 1e2)
    return x.select("sym", "d", r(c + s).alias("a"), r(c - s).alias("b"), tr(c * s, 4).alias("p"),
                    r(S.safe_div(c, z)).alias("q"), F.round(S.safe_min(c, s), 6).alias("lo"),
                    F.round(S.safe_max(c, s), 6).alias("hi"))


@query("clamp", "candles_daily", f"""{MATH_CTE}
  select sym, d, case when s is not null then round(greatest(s*9.8e-1, least(s*1.02e0, c)), 9) end val from m""")
def clamp(t):
    x = with_indicators(t.candles_daily, {"s": ("sma", 20)})
    s = F.col("s")
    return x.select("sym", "d", F.round(S.clamp(F.col("c"), s * 9.8e-1, s * 1.02e0), 9).alias("val"))


@query("pred_cmp", "candles_daily", f"""{MATH_CTE}
  select sym, d, coalesce(c > s, false) gt, coalesce(c < s, false) lt, coalesce(c >= s, false) ge, coalesce(c <= s, false) le from m""")
def pred_cmp(t):
    x = with_indicators(t.candles_daily, {"s": ("sma", 20)})
    c, s = F.col("c"), F.col("s")
    return x.select("sym", "d", S.is_true(c > s).alias("gt"), S.is_true(c < s).alias("lt"),
                    S.is_true(c >= s).alias("ge"), S.is_true(c <= s).alias("le"))


@query("pred_logic", "candles_daily", f"""{MATH_CTE}
  select sym, d, coalesce(c > s, false) and coalesce(c > 1e2, false) both_up, coalesce(c > s, false) or coalesce(c > 1e2, false) any_up,
         not coalesce(c > s, false) not_up from m""")
def pred_logic(t):
    x = with_indicators(t.candles_daily, {"s": ("sma", 20)})
    up, hi = F.col("c") > F.col("s"), F.col("c") > 1e2
    return x.select("sym", "d", S.all_of(up, hi).alias("both_up"), S.any_of(up, hi).alias("any_up"), S.not_(up).alias("not_up"))


@query("signal_entry_only", "candles_daily", f"""{MATH_CTE}
  select sym, d, case when c > s then 1 else 0 end pos from m""")
def signal_entry_only(t):
    x = with_indicators(t.candles_daily, {"s": ("sma", 20)})
    return x.select("sym", "d", F.when(F.col("c") > F.col("s"), 1).otherwise(0).alias("pos"))


# entry above the 20-bar mean, exit above 1.01 x the mean or below 0.99 x: the two overlap
@query("signal_entry_exit", "candles_daily", f"""{MATH_CTE},
  e as (select sym, d, coalesce(c > s, false) e, coalesce(c > 1.01e0*s or c < 9.9e-1*s, false) x,
               row_number() over ({W}) rn from m),
  g as (select sym, list(struct_pack(d := d, e := e, x := x) order by rn) seq from e group by sym),
  f as (select sym, list_reduce(list_transform(seq, lambda q: struct_pack(p := case when q.e then 1 else 0 end, e := q.e, x := q.x,
                     acc := [case when q.e then 1 else 0 end])),
            lambda a, b: struct_pack(p := case when a.p = 0 then case when b.e then 1 else 0 end else case when b.x then 0 else 1 end end,
                     e := b.e, x := b.x,
                     acc := list_append(a.acc, case when a.p = 0 then case when b.e then 1 else 0 end else case when b.x then 0 else 1 end end))).acc acc,
               seq from g)
  select sym, unnest(list_transform(seq, lambda q: q.d)) d, unnest(acc) pos from f""")
def signal_entry_exit(t):
    x = with_indicators(t.candles_daily, {"s": ("sma", 20)})
    c, s = F.col("c"), F.col("s")
    return S.hold_state(x, c > s, (c > 1.01e0 * s) | (c < 9.9e-1 * s)).select("sym", "d", "pos")


@query("signal_weight", "candles_daily", f"""{STAGE}, v as (select *, {vol(20)} sd, {sma(20)} s from stage)
  select sym, d, round(case when c < s then case when sd > 0 then -greatest(0e0, least(1e0, 1e-2/sd)) else 0e0 end else 0e0 end, 6) + 0e0 w from v""")
def signal_weight(t):
    x = with_indicators(t.candles_daily, {"sd": ("vol", 20), "s": ("sma", 20)})
    pos = F.when(F.col("c") < F.col("s"), 1).otherwise(0)
    w = S.signal_weight(pos, S.safe_div(F.lit(1e-2), F.col("sd")), sign=-1)
    return x.select("sym", "d", r(w).alias("w"))


def _last_state(entry: str, exit_: str) -> str:
    return (f"coalesce(last_value(case when {entry} then 1 when {exit_} then 0 end ignore nulls) over "
            f"({W} rows between unbounded preceding and current row), 0)")


SMA2 = f"i as (select sym, d, {sma(50)} f, {sma(200)} s from candles_daily)"
STRAT_SQL = {
    "strat_buy_hold": "select sym, d, 1e0 w from candles_daily",
    "strat_sma_cross": f"{SMA2} select sym, d, case when f > s then 1e0 else 0e0 end w from i",
    "strat_short_trend": f"{SMA2} select sym, d, case when f < s then -1e0 else 0e0 end w from i",
    "strat_rsi_reversion": f"""{STAGE}, i as (select sym, d, {rsi(14)} v from stage)
        select sym, d, case when v is null then 0e0 else {_last_state('v < 35', 'v > 65')}::double end w from i""",
    "strat_donchian": f"""i as (select sym, d, c, row_number() over ({W}) rn,
               max(c) over ({W} rows between 20 preceding and 1 preceding) h,
               min(c) over ({W} rows between 20 preceding and 1 preceding) l from candles_daily)
        select sym, d, {_last_state('rn > 20 and c >= h', 'rn > 20 and c <= l')}::double w from i""",
    "strat_vol_target": f"""{STAGE}, i as (select sym, d, {vol(20)} v from stage)
        select sym, d, round(case when v > 0 then least(1e0, 1e-2/v) else 0e0 end, 6) w from i""",
    "strat_three_up": f"""i as (select sym, d, c, lag(c,1) over ({W}) a, lag(c,2) over ({W}) b, lag(c,3) over ({W}) e from candles_daily)
        select sym, d, {_last_state('c > a and a > b and b > e', 'c < a')}::double w from i""",
    "strat_coin_flip": f"""select sym, d, case when (((row_number() over ({W}) + 7) * 7919 + 7) % 1009) % 2 = 0 then 1e0 else 0e0 end w
        from candles_daily""",
}
TREND_CTE = f"""{STAGE}, i as (select sym, d, c, {sma(200)} s, {vol(20)} v from stage),
  tr as (select *, {_last_state('c > s', 'c < 9.5e-1*s')} pos from i),
  rw as (select sym, d, pos, case when pos = 1 then case when v*sqrt(2.52e2) > 0 then least(1e0, 1.5e-1/(v*sqrt(2.52e2)))
                 else 1e0 end else 0e0 end w from tr)"""


def _strategy(name):
    fn = getattr(S, name)

    @query(name, "candles_daily", STRAT_SQL[name])
    def run(t, fn=fn):
        return fn(t.candles_daily).select("sym", "d", r("w").alias("w"))


for _n in STRAT_SQL:
    _strategy(_n)


@query("strat_trend_buffer", "candles_daily", f"{TREND_CTE} select sym, d, round(w, 6) + 0e0 w from rw")
def strat_trend_buffer(t):
    return S.strat_trend_buffer(t.candles_daily).select("sym", "d", r("w").alias("w"))


@query("deadband", "candles_daily", f"""{TREND_CTE},
  nw as (select *, sum(case when pos = 1 and coalesce(lag_pos, 0) <> 1 then 1 else 0 end) over ({W}) run
         from (select *, lag(pos) over ({W}) lag_pos from rw) q),
  g as (select sym, run, list(struct_pack(d := d, w := w) order by d) seq from nw where pos = 1 group by sym, run),
  f as (select sym, seq, list_reduce(list_transform(seq, lambda q: struct_pack(h := q.w, acc := [q.w])),
           lambda a, b: struct_pack(h := case when abs(b.h - a.h) >= 1e-1 then b.h else a.h end,
                                 acc := list_append(a.acc, case when abs(b.h - a.h) >= 1e-1 then b.h else a.h end))).acc acc from g)
  select sym, unnest(list_transform(seq, lambda q: q.d)) d, round(unnest(acc), 6) + 0e0 w from f
  union all select sym, d, 0e0 from nw where pos <> 1""")
def deadband(t):
    return S.deadband(S.trend_raw(t.candles_daily), 1e-1).select("sym", "d", r("w").alias("w"))
