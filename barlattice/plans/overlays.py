"""Overlay queries: confirmed gates, volatility targets, drawdown switches, arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions.indicators import with_indicators
from barlattice.operators import overlays as O
from barlattice.operators.metrics import curve_metrics
from barlattice.operators.returns import cost_model, equity_curve, weight_returns
from barlattice.plans.indicators import full
from barlattice.plans.metrics import ROWS
from barlattice.plans.registry import query, rr

N, EVERY, TARGET = 3, 21, 1.5e-1
MW = "partition by sym order by d"
GATE = f"""mi as (select sym, d, c, row_number() over ({MW}) - 1 gi, c/lag(c) over ({MW}) - 1 ret, {full('avg', 'c', 50)} s from market_daily),
  rw as (select *, case when c > s then 1 else 0 end raw from mi),
  cf as (select *, case when count(*) over f = {N} and min(raw) over f = max(raw) over f then raw end st from rw
         window f as ({MW} rows between {N - 1} preceding and current row)),
  gt as (select *, coalesce(last_value(st ignore nulls) over ({MW} rows between unbounded preceding and current row), 0) gate from cf)"""


def gated(t):
    x = with_indicators(t.market_daily, {"s": ("sma", 50), "vol": ("vol", 20)})
    return O.confirmed_gate(x, F.col("c") > F.col("s"), N)


@query("confirmed_gate", "market_daily", f"{GATE} select d, cast(gate as int) gate from gt")
def confirmed_gate(t):
    return gated(t).select("d", "gate")


EVENTS = f"""{GATE}, ev as (select *, case when gate = 1 and coalesce(lag(gate) over ({MW}), 0) = 0 then 'reentry'
     when gate = 0 and coalesce(lag(gate) over ({MW}), 0) = 1 then 'exit' end event from gt)"""


@query("gate_events", "market_daily", f"""{EVENTS} select d, gi, cast(gate as int) gate, event,
   (gi - coalesce(max(case when event = 'reentry' then gi end) over ({MW} rows between unbounded preceding and current row), 0)) % {EVERY} = 0 rebalance from ev""")
def gate_events(t):
    x = gated(t).withColumn("gi", F.row_number().over(Window.partitionBy("sym").orderBy("d")) - 1)
    return O.gate_events(x, EVERY).select("d", "gi", "gate", "event", "rebalance")


VS = f"""vv as (select *, {full('stddev_pop', 'ret', 20)} vol from gt),
  vs as (select *, case when vol*sqrt(2.52e2) > 0 then least(1e0, {TARGET}/(vol*sqrt(2.52e2))) else 1e0 end sc from vv)"""


@query("vol_target_scalar", "market_daily", f"{GATE}, {VS} select d, round(sc, 7) + 0e0 scalar from vs where gi % {EVERY} = 0")
def vol_target_scalar(t):
    x = gated(t).withColumn("gi", F.row_number().over(Window.partitionBy("sym").orderBy("d")) - 1).filter(F.col("gi") % EVERY == 0)
    return x.select("d", rr(O.vol_target_scalar(F.col("vol"), TARGET), 7).alias("scalar"))


@query("kill_switch_breach", "curves", f"{ROWS} select spec_id, min(d) d, round(min_by((pk - eq)/pk, d), 4) dd from r where (pk - eq)/pk > 2e-1 group by spec_id")
def kill_switch(t):
    return O.kill_switch_breach(t.curves, 2e-1)


DEL = cost_model("delivery")
BUY, SELL = repr(DEL["buy"]) + "e0", repr(DEL["sell"]) + "e0"
ARM = "partition by arm order by d"


@query("overlay_arms", "market_daily", f"""{GATE}, {VS},
  ar as (select arm, d, c, case arm when 'A_base' then 1e0 when 'B_gate' then gate when 'C_vol' then sc else gate*sc end w
         from vs, (values ('A_base'), ('B_gate'), ('C_vol'), ('D_both')) q(arm)),
  h as (select *, coalesce(c/lag(c) over ({ARM}) - 1, 0e0) ret, coalesce(lag(w, 2) over ({ARM}), 0e0) held, coalesce(lag(w, 1) over ({ARM}), 0e0) nw from ar),
  wr as (select *, held*ret - case when nw > held then (nw - held)*{BUY} else (held - nw)*{SELL} end r from h),
  e as (select arm, d, exp(sum(ln(1 + r)) over ({ARM} rows between unbounded preceding and current row)) eq from wr),
  e2 as (select *, eq/lag(eq) over ({ARM}) - 1 rt, max(eq) over ({ARM} rows between unbounded preceding and current row) pk from e),
  mm as (select arm, round((avg(rt) - 6.5e-2/2.52e2)/stddev_samp(rt)*sqrt(2.52e2), 4) + 0e0 sharpe, round(max((pk - eq)/pk)*1e2, 4) max_drawdown_pct from e2 group by arm)
  select *, row_number() over (order by sharpe desc, max_drawdown_pct, arm) rk from mm""")
def overlay_arms(t):
    x = gated(t).withColumn("sc", O.vol_target_scalar(F.col("vol"), TARGET))
    arms = O.overlay_arms(x, "gate", "sc")
    curve = equity_curve(weight_returns(arms, DEL, key=("arm",)), by=("arm",))
    m = curve_metrics(curve, by=("arm",), names=["sharpe", "max_drawdown_pct"], digits=4)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("sharpe"), "max_drawdown_pct", "arm")  # four rows
    return m.withColumn("rk", F.row_number().over(w))
