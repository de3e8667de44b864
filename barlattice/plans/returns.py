"""Return, cost and basket queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.functions.indicators import with_indicators
from barlattice.functions.signals import strat_sma_cross, strat_short_trend
from barlattice.operators import overlays as O
from barlattice.operators import ranking as G
from barlattice.operators import returns as R
from barlattice.operators import xsection as X
from barlattice.operators.align import align_grid, master_timeline
from barlattice.operators.metrics import curve_metrics
from barlattice.plans.indicators import W, sma
from barlattice.plans.overlays import EVENTS
from barlattice.plans.overlays import N as GATE_BARS
from barlattice.plans.registry import query, rr
from barlattice.plans.xsection import CAND, EVERY, SPECS, TOP, K, V, master, top
from barlattice.session import pin

DEL = R.cost_model("delivery")
BUY, SELL = repr(DEL["buy"]) + "e0", repr(DEL["sell"]) + "e0"
OPT = R.cost_model("index_option")
MODELS = ", ".join(f"('{k}', {m['buy']!r}e0, {m['sell']!r}e0, {m['borrow']!r}e0)" for k in R.KINDS for m in [R.cost_model(k)])


def _lit(m):
    return MODELS.replace("e-05e0", "e-05").replace("e-06e0", "e-06")


@query("cost_rates", "fills", f"""m(kind, b, s, r) as (values {_lit(0)}),
  f as (select side, cast(sum(cast(qty*price as decimal(18,2))) as double) val from fills group by side)
  select side, kind, round(b, 9) buy_rate, round(s, 9) sell_rate, round(r, 9) borrow_rate,
         round(case when side = 'BUY' then val*b else val*s end, 2) + 0e0 cost from f, m""")
def cost_rates(t):
    f = t.fills.groupBy("side").agg(F.sum((F.col("qty") * F.col("price")).cast("decimal(18,2)")).cast("double").alias("val"))
    x = R.cost_rates(f)
    cost = F.when(F.col("side") == "BUY", F.col("val") * F.col("buy_rate")).otherwise(F.col("val") * F.col("sell_rate"))
    return x.select("side", "kind", *[F.round(c, 9).alias(c) for c in ("buy_rate", "sell_rate", "borrow_rate")], rr(cost, 2).alias("cost"))


@query("fill_price", "fills", f"""select acct, ikey, ok, ln, pk, d, qty, side, price, round(case when side = 'BUY' then price*(1 + {BUY}) else price*(1 - {SELL}) end, 6) fp from fills""")
def fill_price(t):
    return t.fills.select("acct", "ikey", "ok", "ln", "pk", "d", "qty", "side", "price", F.round(R.fill_price(F.col("side"), F.col("price"), DEL), 6).alias("fp"))


@query("option_fill_price", "chain", f"""select quote_id, case when quote_id % 3 = 0 then 'BUY' else 'SELL' end side,
   round(case when quote_id % 3 = 0 then (vol + greatest(vol*5e-3, 5e-2))*(1 + {OPT['buy']!r}e0)
         else greatest((vol - greatest(vol*5e-3, 5e-2))*(1 - {OPT['sell']!r}e0), 1e-2) end, 8) fp from chain""")
def option_fill_price(t):
    side = F.when(F.col("quote_id") % 3 == 0, "BUY").otherwise("SELL")
    return t.chain.select("quote_id", side.alias("side"), F.round(R.option_fill_price(side, F.col("vol"), OPT), 8).alias("fp"))


SHORT = f"sg as (select sym, d, c, case when f < s then -1e0 else 0e0 end w from (select sym, d, c, {sma(50)} f, {sma(200)} s from candles_daily) q)"


@query("borrow_fee", "candles_daily", f"""{SHORT} select sym, d, round(coalesce(greatest(-lag(w) over ({W}), 0e0)*6e-2*date_diff('day', lag(d) over ({W}), d)/3.6525e2, 0e0), 9) + 0e0 fee from sg""")
def borrow_fee(t):
    return R.borrow_fee(strat_short_trend(t.candles_daily)).select("sym", "d", rr("fee", 9).alias("fee"))


WR = f"""sg as (select sym, d, c, case when f > s then 1e0 else 0e0 end w from (select sym, d, c, {sma(50)} f, {sma(200)} s from candles_daily) q),
  h as (select *, coalesce(c/lag(c) over ({W}) - 1, 0e0) ret, coalesce(lag(w, 2) over ({W}), 0e0) held, coalesce(lag(w, 1) over ({W}), 0e0) nw from sg),
  wr as (select *, case when nw > held then (nw - held)*{BUY} else (held - nw)*{SELL} end cost,
         held*ret - case when nw > held then (nw - held)*{BUY} else (held - nw)*{SELL} end r from h)"""


@query("weight_returns", "candles_daily", f"{WR} select sym, d, round(cost, 9) + 0e0 cost, round(r, 9) + 0e0 r from wr")
def weight_returns(t):
    return R.weight_returns(strat_sma_cross(t.candles_daily), DEL).select("sym", "d", rr("cost", 9).alias("cost"), rr("r", 9).alias("r"))


@query("equity_curve", "candles_daily", f"{WR} select sym, d, round(exp(sum(ln(1 + r)) over ({W} rows between unbounded preceding and current row)), 7) eq from wr")
def equity_curve(t):
    return R.equity_curve(R.weight_returns(strat_sma_cross(t.candles_daily), DEL)).select("sym", "d", F.round("eq", 7).alias("eq"))


# ---- baskets -----------------------------------------------------------------------------------------------------------

# three specs whose last decisions differ: all of them, the earlier half, the later half with one more that executes on the last bar
BASKET = f"""{TOP}, gr as (select m.gi, s.sym, last_value(p.c ignore nulls) over (partition by s.sym order by m.gi) px
         from (select distinct sym from candles_daily) s cross join mst m left join candles_daily p on p.sym = s.sym and p.d = m.d),
  t0 as (select gi, sym, 1e0/count(*) over (partition by gi) w from top),
  cut as (select (min(gi) + max(gi))//2 half, max(gi) last, (select max(gi) from mst) mx from t0),
  tw as (select 'all' spec_id, gi, sym, w from t0 union all select 'early', gi, sym, w from t0, cut where gi <= half
         union all select 'late', gi, sym, w from t0, cut where gi > half union all select 'late', mx - 1, sym, w from t0, cut where gi = last and last < mx - 1),
  decs as (select spec_id, gi dec, gi + 1 x, (select max(gi) from mst) mx, lead(gi) over (partition by spec_id order by gi) + 1 nx from (select distinct spec_id, gi from tw) q),
  per as (select spec_id, dec, x, least(coalesce(nx, mx), mx) e, coalesce(nx <= mx, false) rolled from decs where x <= mx),
  vals as (select tw.spec_id, dec, x, e, rolled, g.gi, tw.sym, w, w*g.px/p0.px wv from per join tw on tw.gi = dec and tw.spec_id = per.spec_id
           join gr p0 on p0.sym = tw.sym and p0.gi = x join gr g on g.sym = tw.sym and g.gi between x and e),
  bar as (select spec_id, dec, x, e, rolled, gi, 1 + sum(wv - w) v from vals group by all),
  old as (select spec_id, e x, sym, wv/v old_w from vals join bar using (spec_id, dec, x, e, rolled, gi) where gi = e and rolled),
  nw as (select spec_id, gi + 1 x, sym, w new_w from tw where gi < (select mx from cut)),
  td as (select coalesce(old.spec_id, nw.spec_id) spec_id, coalesce(old.x, nw.x) x, coalesce(old.sym, nw.sym) sym, coalesce(old_w, 0e0) old_w, coalesce(new_w, 0e0) new_w
         from old full join nw on old.spec_id = nw.spec_id and old.x = nw.x and old.sym = nw.sym),
  trades as (select *, case when new_w > old_w then 'BUY' else 'SELL' end side, abs(new_w - old_w) size,
             case when new_w > old_w then (new_w - old_w)*{BUY} else (old_w - new_w)*{SELL} end cost,
             case when old_w = 0 then 'entry' when new_w = 0 then 'exit' when new_w > old_w then 'add' else 'trim' end kind
             from td where abs(new_w - old_w) > 0),
  xc as (select spec_id, x, sum(cost) cost from trades group by spec_id, x),
  st as (select b.spec_id, b.dec, b.x, b.v pv, coalesce(cost, 0e0) cost from bar b left join xc using (spec_id, x) where b.gi = b.e),
  bs as (select spec_id, dec, exp(coalesce(sum(ln(pv)) over (partition by spec_id order by dec rows between unbounded preceding and 1 preceding), 0e0)
                         + sum(ln(1 - cost)) over (partition by spec_id order by dec rows between unbounded preceding and current row)) base from st),
  bc as (select bar.spec_id, bar.gi, base*v eq from bar join bs using (spec_id, dec) where bar.gi > bar.x)"""


def basket(t):
    x = pin(top(t).withColumn("w", X.w_equal()).select("gi", "sym", "w"))
    grid = pin(align_grid(t.pin("candles_daily"), t.pin("market_daily"), before_listing=False).select("gi", "sym", "px"))
    half, last, end = x.agg(F.floor((F.min("gi") + F.max("gi")) / 2)).scalar(), x.agg(F.max("gi")).scalar(), grid.agg(F.max("gi")).scalar()
    final = x.filter((F.col("gi") == last) & (last < end - 1)).withColumn("gi", end - 1)
    parts = {"all": x, "early": x.filter(F.col("gi") <= half), "late": x.filter(F.col("gi") > half).unionByName(final)}
    named = [p.select(F.lit(n).alias("spec_id"), F.col("gi").cast("long").alias("gi"), "sym", "w") for n, p in parts.items()]
    return pin(named[0].unionByName(named[1]).unionByName(named[2])), grid


@query("basket_returns", V, f"{BASKET} select spec_id, gi, round(eq, 7) eq from bc")
def basket_returns(t):
    w, grid = basket(t)
    return R.basket_returns(w, grid, DEL).select("spec_id", "gi", F.round("eq", 7).alias("eq"))


@query("implied_trades", V, f"{BASKET} select spec_id, x, sym, round(old_w, 7) + 0e0 old_w, round(new_w, 7) + 0e0 new_w, side, round(size, 7) + 0e0 size, kind from trades")
def implied_trades(t):
    w, grid = basket(t)
    x = R.basket_trades(R.basket_values(w, grid), w, DEL)
    return x.select("spec_id", "x", "sym", rr("old_w", 7).alias("old_w"), rr("new_w", 7).alias("new_w"), "side", rr("size", 7).alias("size"), "kind")


@query("turnover_per_year", V, f"""{BASKET}, c as (select spec_id, eq, d from bc join mst using (gi)), ts as (select spec_id, sum(size) s from trades group by spec_id),
  ca as (select spec_id, avg(eq) a, date_diff('day', min(d), max(d))/3.6525e2 y from c group by spec_id)
  select spec_id, case when a > 0 and y > 0 then round(s/2/a/y, 6) end turnover from ca join ts using (spec_id)""")
def turnover(t):
    w, grid = basket(t)
    m = master_timeline(t.pin("candles_daily"), t.pin("market_daily"))
    curve = R.basket_returns(w, grid, DEL).join(m.select("gi", "d"), "gi")
    tr = R.basket_trades(R.basket_values(w, grid), w, DEL)
    return R.turnover_per_year(tr, curve, by="spec_id", value="size").select("spec_id", F.round("turnover", 6).alias("turnover"))


@query("final_holdings", V, f"""{BASKET} select spec_id, string_agg(sym || ':' || cast(round(w*1e2, 1) as varchar), ',' order by w desc, sym) holdings
  from tw where (spec_id, gi) in (select (spec_id, max(gi)) from tw group by spec_id) group by spec_id""")
def final_holdings(t):
    w, _ = basket(t)
    x = R.final_holdings(w)
    return x.select("spec_id", F.array_join(F.transform("holdings", lambda h: F.concat_ws(":", h["sym"], F.round(h["pct"], 1).cast("string"))), ",").alias("holdings"))


@query("participation_flags", V, f"""{BASKET}, tv as (select sym, d, size*5e4 val from trades join mst on mst.gi = trades.x)
  select sym, count(*) checked, count(*) filter (val > 1e-1*v*c) flagged from tv join candles_daily using (sym, d) where v > 0 group by sym""")
def participation(t):
    w, grid = basket(t)
    m = master_timeline(t.pin("candles_daily"), t.pin("market_daily")).select(F.col("gi").alias("x"), "d")
    tr = R.basket_trades(R.basket_values(w, grid), w, DEL).join(m, "x").withColumn("value", F.col("size") * 5e4)
    return R.participation_flags(tr, t.candles_daily)


# baskets whose decisions may say cash, at any bars: sl (spec_id, gi) are the decisions, tw (spec_id, gi, sym, w) their names, gr the price grid
GRIDPX = """gr as materialized (select m.gi, s.sym, last_value(p.c ignore nulls) over (partition by s.sym order by m.gi) px
         from (select distinct sym from candles_daily) s cross join mst m left join candles_daily p on p.sym = s.sym and p.d = m.d)"""
BOOK = f"""decs as (select spec_id, gi dec, gi + 1 x, (select max(gi) from mst) mx, lead(gi) over (partition by spec_id order by gi) + 1 nx from sl),
  per as (select spec_id, dec, x, least(coalesce(nx, mx), mx) e, coalesce(nx <= mx, false) rolled from decs where x <= mx),
  vals as materialized (select tw.spec_id, dec, x, e, rolled, g.gi, tw.sym, w, w*g.px/p0.px wv from per join tw on tw.gi = dec and tw.spec_id = per.spec_id
           join gr p0 on p0.sym = tw.sym and p0.gi = x join gr g on g.sym = tw.sym and g.gi between x and e),
  vb as (select spec_id, dec, gi, sum(wv - w) s from vals group by all),
  bar as materialized (select per.*, m.gi, 1 + coalesce(s, 0e0) v from per join mst m on m.gi between per.x and per.e left join vb on vb.spec_id = per.spec_id and vb.dec = per.dec and vb.gi = m.gi),
  old as (select spec_id, e x, sym, wv/v old_w from vals join bar using (spec_id, dec, x, e, rolled, gi) where gi = e and rolled),
  nw as (select spec_id, gi + 1 x, sym, w new_w from tw where gi < (select max(gi) from mst)),
  td as (select coalesce(old.spec_id, nw.spec_id) spec_id, coalesce(old.x, nw.x) x, coalesce(old.sym, nw.sym) sym, coalesce(old_w, 0e0) old_w, coalesce(new_w, 0e0) new_w
         from old full join nw on old.spec_id = nw.spec_id and old.x = nw.x and old.sym = nw.sym),
  trades as (select *, case when new_w > old_w then 'BUY' else 'SELL' end side, abs(new_w - old_w) size,
             case when new_w > old_w then (new_w - old_w)*{BUY} else (old_w - new_w)*{SELL} end cost,
             case when old_w = 0 then 'entry' when new_w = 0 then 'exit' when new_w > old_w then 'add' else 'trim' end kind
             from td where abs(new_w - old_w) > 0),
  xc as (select spec_id, x, sum(cost) cost from trades group by spec_id, x),
  st as (select b.spec_id, b.dec, b.x, b.v pv, coalesce(cost, 0e0) cost from bar b left join xc using (spec_id, x) where b.gi = b.e),
  bs as (select spec_id, dec, exp(coalesce(sum(ln(pv)) over (partition by spec_id order by dec rows between unbounded preceding and 1 preceding), 0e0)
                         + sum(ln(1 - cost)) over (partition by spec_id order by dec rows between unbounded preceding and current row)) base from st),
  bc as (select bar.spec_id, bar.gi, base*v eq from bar join bs using (spec_id, dec) where bar.gi > bar.x)"""
CAND_B = CAND[:CAND.index(",\n  cand as (")]
GATED = f"""{CAND_B}, {EVENTS}, gd as (select mst.gi, gate = 1 is_on, event, (ev.gi - coalesce(max(case when event = 'reentry' then ev.gi end) over (order by ev.gi), 0)) % {EVERY} = 0 rebalance from ev join mst using (d)),
  sl as materialized (select 'gated' spec_id, gi, is_on from gd where event is not null or rebalance union all select 'plain', gi, true from mst where gi % {EVERY} = 0),
  gc as (select sl.spec_id, sl.gi, b.sym, m63, m126 from sl join b on b.g <= sl.gi and sl.gi < b.e where is_on and coalesce(c > s50, false) and m63 is not null),
  gk as (select *, row_number() over (partition by spec_id, gi order by m63 desc, m126 desc nulls last, sym) rk from gc),
  tw as materialized (select spec_id, gi, sym, 1e0/count(*) over (partition by spec_id, gi) w from gk where rk <= {K}), {GRIDPX}, {BOOK}"""


def gated_basket(t):
    """Two specs of one rule: gated daily by the market's confirmed trend, and on the plain schedule."""
    m = t.pin("candles_daily"), t.pin("market_daily")
    master = pin(master_timeline(*m))
    trend = with_indicators(m[1], {"s": ("sma", 50)}).join(master.select("d", "gi"), "d")
    events = O.gate_events(O.confirmed_gate(trend, F.col("c") > F.col("s"), GATE_BARS), EVERY)
    plain = X.rebalance_dates(master, EVERY).select(F.lit("plain").alias("spec_id"), F.col("gi").cast("long").alias("gi"), F.lit(True).alias("on"))
    slots = pin(O.gate_decisions(events).select(F.lit("gated").alias("spec_id"), "gi", "on").unionByName(plain))
    rows = X.decision_rows_at(with_indicators(m[0], SPECS), master, slots, key="sym")
    el = X.eligible(rows, F.col("c") > F.col("s50")).withColumn("score", F.col("m63"))
    chosen = X.top_k(el, K, rule="m126").withColumn("w", X.w_equal()).select(F.col("gi").cast("long").alias("gi"), "sym", "w")
    grid = pin(align_grid(*m, before_listing=False).select("gi", "sym", "px"))
    return pin(X.gated_weights(slots, slots.select("spec_id", "gi").join(chosen, "gi"))), grid


@query("basket_gated", V, f"{GATED} select spec_id, gi, round(eq, 7) eq from bc")
def basket_gated(t):
    w, grid = gated_basket(t)
    return R.basket_returns(w, grid, DEL).select("spec_id", "gi", F.round("eq", 7).alias("eq"))


@query("gated_trades", V, f"{GATED} select spec_id, x, sym, round(old_w, 7) + 0e0 old_w, round(new_w, 7) + 0e0 new_w, side, round(size, 7) + 0e0 size, kind from trades")
def gated_trades(t):
    w, grid = gated_basket(t)
    x = R.basket_trades(R.basket_values(w, grid), w, DEL)
    return x.select("spec_id", "x", "sym", rr("old_w", 7).alias("old_w"), rr("new_w", 7).alias("new_w"), "side", rr("size", 7).alias("size"), "kind")


# a study: the rule against two portfolios of the whole universe that select nothing, and the index
ARMS = f"""{TOP}, uni as (select gi, sym, vol, case when vol > 1e-6 then 1/vol end iv from cand where c > 0),
  ul as (select *, min(iv) over (partition by gi) lo from uni),
  tw as (select 'momentum' spec_id, gi, sym, 1e0/count(*) over (partition by gi) w from top union all select 'universe_equal', gi, sym, 1e0/count(*) over (partition by gi) from uni
         union all select 'universe_invvol', gi, sym, case when lo is null then 1e0/count(*) over (partition by gi) else coalesce(iv, lo)/(sum(iv) over (partition by gi) + (count(*) over (partition by gi) - count(iv) over (partition by gi))*lo) end from ul),
  sl as (select distinct spec_id, gi from tw), {GRIDPX}, {BOOK}, ft as (select max(f) f from (select min(gi) f from bc group by spec_id) q),
  cv as (select spec_id, gi, eq from bc, ft where gi >= f union all select 'index', gi, c from market_daily join mst using (d), ft where gi >= f),
  cr as (select spec_id, gi, eq/lag(eq) over (partition by spec_id order by gi) - 1 r from cv),
  sh as (select spec_id, round((avg(r) - 6.5e-2/2.52e2)/stddev_samp(r)*sqrt(2.52e2), 4) + 0e0 sharpe from cr group by spec_id),
  ed as (select spec_id, sharpe, sharpe - (select sharpe from sh where spec_id = 'index') ei, sharpe - (select max(sharpe) from sh where spec_id like 'universe%') eu from sh)"""


@query("study_arms", V, f"""{ARMS} select spec_id, sharpe, round(ei, 4) + 0e0 edge_index, round(eu, 4) + 0e0 edge_universe,
   case when round(eu, 6) >= 1.5e-1 then 'beats-universe' when round(eu, 6) >= 0 then 'matches-universe' else 'trails-universe' end verdict from ed where spec_id = 'momentum'""")
def study_arms(t):
    m = t.pin("candles_daily"), t.pin("market_daily")
    cand = pin(X.decision_rows(with_indicators(m[0], SPECS), master(t), EVERY))
    mine = X.top_k(X.eligible(cand, F.col("c") > F.col("s50")).withColumn("score", F.col("m63")), K, rule="m126").withColumn("w", X.w_equal())
    every = cand.filter("c > 0")
    parts = {"momentum": mine, "universe_equal": every.withColumn("w", X.w_equal()), "universe_invvol": every.withColumn("w", X.w_invvol())}
    w = pin(reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("spec_id"), F.col("gi").cast("long").alias("gi"), "sym", "w") for n, p in parts.items()]))
    grid = pin(align_grid(*m, before_listing=False).select("gi", "sym", "px"))
    curves = pin(R.basket_returns(w, grid, DEL))
    start = curves.groupBy("spec_id").agg(F.min("gi").alias("f")).agg(F.max("f")).scalar()  # the window that all arms have
    index = m[1].join(master(t), "d").select(F.lit("index").alias("spec_id"), F.col("gi").cast("long").alias("gi"), F.col("c").alias("eq"))
    both = curves.select("spec_id", F.col("gi").cast("long").alias("gi"), "eq").unionByName(index).withColumn("_f", start).filter("gi >= _f").drop("_f")
    board = curve_metrics(both.withColumn("gi", F.date_add(F.lit("2000-01-01").cast("date"), F.col("gi").cast("int"))), by=("spec_id",), ts="gi", names=["sharpe"], digits=4)
    x = G.study_arms(board, ["universe_equal", "universe_invvol"], "index")
    return x.select("spec_id", "sharpe", rr("edge_index", 4).alias("edge_index"), rr("edge_universe", 4).alias("edge_universe"), "verdict")


@query("profit_factor", "fills", """x as (select acct, ikey, floor((price - 1.5e3)*qty*1e2 + 5e-1)/1e2 r from fills),
  g as (select acct, sum(cast(case when r > 0 then r else 0 end as decimal(18,2))) wn, sum(cast(case when r < 0 then -r else 0 end as decimal(18,2))) ls from x group by acct)
  select acct, case when wn = 0 and ls = 0 then null when ls = 0 then 'infinity'::double else round(cast(wn as double)/cast(ls as double), 6) end profit_factor from g""")
def profit_factor(t):
    r = F.floor((F.col("price") - 1.5e3) * F.col("qty") * 1e2 + 5e-1) / 1e2
    x = t.fills.select("acct", r.alias("realised"))
    return R.profit_factor(x).select("acct", F.round("profit_factor", 6).alias("profit_factor"))
