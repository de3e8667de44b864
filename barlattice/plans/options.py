"""Option-chain, payoff and cycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions import options_math as M
from barlattice.operators import options as O
from barlattice.operators.align import asof
from barlattice.operators.returns import cost_model
from barlattice.plans.indicators import STAGE, W, fr
from barlattice.plans.registry import ORACLES, query, rr
from barlattice.session import pin

R = "6.5e-2"


def num(x):
    return repr(float(x)) if "e" in repr(float(x)) else repr(float(x)) + "e0"


def pdf(x):
    return f"(exp(-5e-1*({x})*({x}))/{num(M.ROOT_2PI)})"


def cdf(x):
    t = f"(1/(1 + {num(M.CDF_SCALE)}*abs({x})))"
    poly = "0e0"
    for c in reversed(M.CDF_COEF):
        poly = f"{t}*({num(c)} + {poly})"
    up = f"(1 - {pdf(x)}*{poly})"
    return f"(case when ({x}) >= 0 then {up} else 1 - {up} end)"


def d1(s, k, t, v):
    return f"((ln({s}/{k}) + ({R} + {v}*{v}/2)*{t})/({v}*sqrt({t})))"


def intr(typ, s, k):
    return f"greatest(case when {typ} = 'CE' then {s} - {k} else {k} - {s} end, 0e0)"


def bs(typ, s, k, t, v):
    a = d1(s, k, t, v)
    b = f"({a} - {v}*sqrt({t}))"
    val = (f"case when {typ} = 'CE' then {s}*{cdf(a)} - {k}*exp(-{R}*{t})*{cdf(b)} else {k}*exp(-{R}*{t})*{cdf('-' + b)} - {s}*{cdf('-' + a)} end")
    return f"(case when {t} > 0 and {v} > 0 and {s} > 0 and {k} > 0 then {val} else {intr(typ, s, k)} end)"


def greeks(typ, s, k, t, v):
    a = d1(s, k, t, v)
    b = f"({a} - {v}*sqrt({t}))"
    ok = f"{t} > 0 and {v} > 0 and {s} > 0 and {k} > 0"
    dec = f"-({s}*{pdf(a)}*{v})/(2*sqrt({t}))"
    disc = f"{R}*{k}*exp(-{R}*{t})"
    return {
        "delta": f"(case when {ok} then case when {typ} = 'CE' then {cdf(a)} else {cdf(a)} - 1 end else case when {typ} = 'CE' then case when {s} > {k} then 1e0 else 0e0 end else case when {s} < {k} then -1e0 else 0e0 end end end)",
        "gamma": f"(case when {ok} then {pdf(a)}/({s}*{v}*sqrt({t})) else 0e0 end)",
        "theta": f"(case when {ok} then case when {typ} = 'CE' then {dec} - {disc}*{cdf(b)} else {dec} + {disc}*{cdf('-' + b)} end/3.65e2 else 0e0 end)",
        "vega": f"(case when {ok} then {s}*{pdf(a)}*sqrt({t})/1e2 else 0e0 end)",
    }


G_SQL = greeks("opt_type", "s", "k", "t", "vol")
PR = bs("opt_type", "s", "k", "t", "vol")


@query("chain_price", "chain", f"select quote_id, opt_type, round({PR}, 6) + 0e0 price from chain")
def chain_price(t):
    x = M.with_option(t.chain, F.col("opt_type"), F.col("s"), F.col("k"), F.col("t"), F.col("vol"), price="price")
    return x.select("quote_id", "opt_type", rr("price").alias("price"))


@query("chain_greeks", "chain", "select quote_id, " + ", ".join(f"round({e}, 8) + 0e0 {n}" for n, e in G_SQL.items()) + " from chain")
def chain_greeks(t):
    x = M.with_option(t.chain, F.col("opt_type"), F.col("s"), F.col("k"), F.col("t"), F.col("vol"), greeks=True)
    return x.select("quote_id", *[rr(n, 8).alias(n) for n in M.GREEKS])


IV_BS = bs("b.ty", "b.s", "b.k", "b.t", "((a.lo + a.hi)/2)")
IV = f"""q as (select *, floor(({PR})*1e2 + 5e-1)/1e2 + case when quote_id % 9 = 0 then 1e6 else 0e0 end mp from chain),
  fl as (select *, greatest(case when opt_type = 'CE' then s - k*exp(-{R}*t) else k*exp(-{R}*t) - s end, 0e0) lb,
         {bs('opt_type', 's', 'k', 't', '1.6e2')} top from q),
  iv0 as (select *, list_reduce(list_transform(range(0, 101), lambda i: struct_pack(lo := 1e-4, hi := 5e0, ans := cast(null as double), ty := opt_type, s := s, k := k, t := t, p := mp)),
     lambda a, b: case when a.ans is not null then a else list_transform([{IV_BS}], lambda pr: struct_pack(
        lo := case when pr > b.p then a.lo else (a.lo + a.hi)/2 end, hi := case when pr > b.p then (a.lo + a.hi)/2 else a.hi end,
        ans := case when abs(pr - b.p) < 1e-4 then (a.lo + a.hi)/2 end, ty := b.ty, s := b.s, k := b.k, t := b.t, p := b.p))[1] end) z from fl),
  ivs as (select *, case when mp > 0 and mp >= lb - 1e-6 and top >= mp and mp < 1e6 then floor(coalesce(z.ans, (z.lo + z.hi)/2)*1e4 + 5e-1)/1e4 end iv from iv0)"""


def quotes(t):
    x = M.with_option(t.chain, F.col("opt_type"), F.col("s"), F.col("k"), F.col("t"), F.col("vol"), price="_p")
    return x.withColumn("mp", F.floor(F.col("_p") * 1e2 + 5e-1) / 1e2 + F.when(F.col("quote_id") % 9 == 0, 1e6).otherwise(0e0))


@query("chain_implied_vol", "chain", f"{IV} select quote_id, mp, iv from ivs")
def chain_implied_vol(t):
    q = quotes(t)
    return q.select("quote_id", "mp", M.implied_vol(F.col("opt_type"), F.col("mp"), F.col("s"), F.col("k"), F.col("t")).alias("iv"))


@query("chain_enrich", "chain", f"""nr as (select grp, min_by(k, (abs(k - s), k)) nk from chain where s > 0 group by grp)
  select quote_id, grp, {', '.join(f'round({e}, 8) + 0e0 {n}' for n, e in G_SQL.items())}, coalesce(k = nk, false) is_atm from chain left join nr using (grp)""")
def chain_enrich(t):
    return O.chain_enrich(t.chain).select("quote_id", "grp", *[rr(n, 8).alias(n) for n in G_SQL], "is_atm")


# ---- structures ---------------------------------------------------------------------------------------------------------

_ROWS = ", ".join(
    f"('{n}', {i + 1}, '{ty}', '{sd}', {'null' if st is None else st}, {lo}, {'null' if ex is None else ex})"
    for n, legs in O.TEMPLATES for i, (ty, sd, st, lo, ex) in enumerate(legs))
LEGS = f"""tp(structure, leg, opt_type, side, steps, lots, extra) as (values {_ROWS}),
  lg0 as (select id, spot, step, hdays, cast(iv as double) iv, structure, leg, opt_type, side, lots, case when steps is null then 0e0 else floor(spot/step + 5e-1)*step + steps*step end strike,
          hdays + coalesce(extra, 0) leg_days from spots, tp),
  lg1 as (select *, leg_days/3.65e2 t, iv/1e2 v from lg0),
  lg as (select *, case when opt_type = 'FUT' then spot else {bs('opt_type', 'spot', 'strike', 't', 'v')} end premium, case when side = 'BUY' then 1e0 else -1e0 end sg from lg1)"""
VALB = "case when opt_type = 'FUT' then b.s else " + intr("opt_type", "b.s", "lg.strike") + " end"
VAL = "case when opt_type = 'FUT' then s else " + intr("opt_type", "s", "strike") + " end"


def legs(t, names=None):
    return O.price_legs(O.structure_templates(t.spots, names=names))


def packed(t, names=None):
    return O.pack_legs(legs(t, names))


@query("structure_templates", "spots", f"{LEGS} select id, structure, leg, opt_type, side, strike, lots, leg_days from lg")
def structure_templates(t):
    return O.structure_templates(t.spots).select("id", "structure", "leg", "opt_type", "side", "strike", "lots", "leg_days")


@query("leg_payoff", "spots", f"{LEGS}, x as (select *, spot*1.1e0 s from lg) select id, structure, leg, round(premium, 4) + 0e0 premium, round(sg*({VAL} - premium), 4) + 0e0 payoff from x")
def leg_payoff(t):
    return O.leg_payoff(legs(t), F.col("spot") * 1.1e0).select("id", "structure", "leg", rr("premium", 4).alias("premium"), rr("payoff", 4).alias("payoff"))


@query("payoff_curve", "spots", f"""{LEGS}, w as (select id, structure, any_value(spot) spot, sum(case when opt_type = 'PE' then -sg*lots when opt_type = 'FUT' then sg*lots else 0e0 end) sl,
      min(strike) filter (opt_type <> 'FUT') k0, max(strike) filter (opt_type <> 'FUT') k1 from lg group by 1, 2),
  wl as (select *, case when abs(sl) > 1e-9 then 0e0 else least(spot*7e-1, k0)*9.5e-1 end lo, greatest(spot*1.3e0, k1)*1.05e0 hi from w),
  pt as (select id, structure, lo, hi, unnest(range(0, 241)) point from wl),
  pv as (select p.id, p.structure, p.point, p.lo + (p.hi - p.lo)*p.point/2.4e2 s, opt_type, strike, premium, sg, lots from pt p join lg using (id, structure)),
  pn as (select id, structure, point, any_value(s) s, sum(sg*({VAL} - premium)*lots) pnl from pv group by 1, 2, 3)
  select structure, point, count(*) n, round(avg(pnl), 3) + 0e0 pnl, round(min(pnl), 3) + 0e0 worst, round(max(pnl), 3) + 0e0 best from pn group by 1, 2""")
def payoff_curve(t):
    """All curves of all structures, reported per structure and point."""
    x = O.payoff_profile(packed(t))
    return x.select("structure", F.col("point").cast("bigint").alias("point"), "n", rr("pnl", 3).alias("pnl"), rr("worst", 3).alias("worst"), rr("best", 3).alias("best"))


BP = f"""{LEGS}, fr as (select id, structure, any_value(spot) spot, greatest(any_value(spot), max(case when opt_type = 'FUT' then premium else strike end))*3 + 1e1 far from lg group by 1, 2),
  bp as (select distinct id, structure, s from (select id, structure, 0e0 s from fr union all select id, structure, spot from fr union all select id, structure, far from fr
         union all select id, structure, case when opt_type = 'FUT' then premium else strike end from lg) q where s >= 0),
  bv as (select b.id, b.structure, b.s, sum(sg*({VALB} - premium)*lots) v from bp b join lg using (id, structure) group by 1, 2, 3),
  sl as (select id, structure, sum(case when opt_type = 'PE' then 0e0 else sg*lots end) sl from lg group by 1, 2)"""


@query("payoff_extremes", "spots", f"""{BP} select bv.id, bv.structure, case when any_value(sl) <= 1e-9 then round(max(v), 3) + 0e0 end max_profit,
  case when any_value(sl) >= -1e-9 then round(min(v), 3) + 0e0 end max_loss from bv join sl using (id, structure) group by 1, 2""")
def payoff_extremes(t):
    return O.payoff_extremes(packed(t)).select("id", "structure", rr("max_profit", 3).alias("max_profit"), rr("max_loss", 3).alias("max_loss"))


@query("payoff_unbounded", "spots", f"{BP} select id, structure, sl > 1e-9 unbounded_profit, sl < -1e-9 unbounded_loss from sl")
def payoff_unbounded(t):
    return O.payoff_unbounded(packed(t)).select("id", "structure", "unbounded_profit", "unbounded_loss")


@query("breakevens", "spots", f"""{BP}, sq as (select *, lead(s) over w s2, lead(v) over w v2 from bv window w as (partition by id, structure order by s)),
  be as (select distinct id, structure, floor((s + (s2 - s)*(-v)/(v2 - v))*1e2 + 5e-1)/1e2 breakeven from sq where v*v2 < 0) select * from be""")
def breakevens(t):
    return O.breakevens(packed(t)).select("id", "structure", F.explode("breakevens").alias("breakeven"))


# long call and short put of one strike and premium, and a straddle bought for nothing: zero exactly at the strike, with and without a change of sign
KINKS = f"""lg as (select id, spot, s.structure, s.opt_type, s.sg, (floor(spot/step + 5e-1) + 1)*step strike, s.premium, 1e0 lots
     from spots, (values ('synthetic', 'CE', 1e0, 7e0), ('synthetic', 'PE', -1e0, 7e0), ('free', 'CE', 1e0, 0e0), ('free', 'PE', 1e0, 0e0)) s(structure, opt_type, sg, premium)),
  fr as (select id, structure, any_value(spot) spot, greatest(any_value(spot), max(strike))*3 + 1e1 far from lg group by 1, 2),
  bp as (select distinct id, structure, s from (select id, structure, 0e0 s from fr union all select id, structure, spot from fr union all select id, structure, far from fr union all select id, structure, strike from lg) q),
  nb as (select *, lag(s) over k p, lead(s) over k n from bp window k as (partition by id, structure order by s)),
  bv as (select b.id, b.structure, b.s, b.p, b.n, sum(sg*({VALB} - premium)*lots) v, sum(sg*({VALB.replace("b.s", "((b.p + b.s)/2)")} - premium)*lots) l, sum(sg*({VALB.replace("b.s", "((b.s + b.n)/2)")} - premium)*lots) r
         from nb b join lg using (id, structure) group by all),
  sq as (select *, lead(v) over k v2 from bv window k as (partition by id, structure order by s)),
  be as (select distinct id, structure, floor(x*1e2 + 5e-1)/1e2 breakeven from (select id, structure, s + (n - s)*(-v)/(v2 - v) x from sq where v*v2 < 0
         union all select id, structure, s from sq where p is not null and n is not null and abs(v) <= 1e-9 and ((l > 1e-9 and r < -1e-9) or (l < -1e-9 and r > 1e-9))) q)"""


@query("breakevens_kinks", "spots", f"{KINKS} select * from be")
def breakevens_kinks(t):
    """Zeros exactly at a strike count where the sign changes, and only there."""
    k = (F.floor(F.col("spot") / F.col("step") + 5e-1) + 1) * F.col("step")
    leg = lambda typ, side, p: F.struct(F.lit(typ).alias("opt_type"), F.lit(side).alias("side"), k.alias("strike"), F.lit(p).alias("premium"), F.lit(1e0).alias("units"))
    both = {"synthetic": [("CE", "BUY", 7e0), ("PE", "SELL", 7e0)], "free": [("CE", "BUY", 0e0), ("PE", "BUY", 0e0)]}
    # one small file is one task: the spots are spread before they grow
    x = t.spots.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "id").select("id", "spot", F.inline(F.array(*[F.struct(F.lit(n).alias("structure"), F.array(*[leg(*g) for g in legs]).alias("legs")) for n, legs in both.items()])))
    return O.breakevens(x).select("id", "structure", F.explode("breakevens").alias("breakeven"))


HZ = bs("opt_type", "s", "strike", "lf", "v")


@query("horizon_value", "spots", f"""{LEGS}, fr as (select id, structure, greatest(any_value(spot), max(case when opt_type = 'FUT' then premium else strike end))*3 + 1e1 far,
     min(leg_days) filter (opt_type <> 'FUT') hz from lg group by 1, 2 having count(distinct leg_days) filter (opt_type <> 'FUT') > 1),
  gd as (select id, structure, hz, far*1e-6 + (far - far*1e-6)*unnest(range(0, 601))/6e2 s from fr union select id, structure, hz, strike from fr join lg using (id, structure) where opt_type <> 'FUT'),
  gv as (select id, structure, s, opt_type, strike, premium, sg, lots, (leg_days - hz)/3.65e2 lf, v from gd join lg using (id, structure) where s > 0),
  gp as (select id, structure, s, sum(sg*(case when opt_type = 'FUT' then s when lf <= 1e-9 then {intr('opt_type', 's', 'strike')} else {HZ} end - premium)*lots) pnl from gv group by 1, 2, 3)
  select id, structure, count(*) points, round(max(pnl), 3) + 0e0 max_profit, round(min(pnl), 3) + 0e0 max_loss from gp group by 1, 2""")
def horizon_value(t):
    x = O.horizon_range(packed(t, O.SEVERAL_EXPIRIES))
    return x.select("id", "structure", "points", rr("max_profit", 3).alias("max_profit"), rr("max_loss", 3).alias("max_loss"))


def _refine_sql(stages: int = 5, cuts: int = 16) -> str:
    """The staged search of ``horizon_extremes``: brackets z0 to z{stages}."""
    value = f"sum(sg*(case when opt_type = 'FUT' then s when lf <= 1e-9 then {intr('opt_type', 's', 'strike')} else {HZ} end - premium)*lots)"
    out = ["""g1 as (select id, structure, s, pnl, dir from gp, (values (1), (-1)) w(dir)),
  g2 as (select id, structure, dir, arg_max(struct_pack(s := s, pnl := pnl), (dir*pnl, -s)) z from g1 group by 1, 2, 3),
  z0 as (select g2.id, g2.structure, dir, greatest(far*1e-6, z.s - (far - far*1e-6)/6e2) a, z.s + (far - far*1e-6)/6e2 b, z.pnl bv, z.s at_s from g2 join fr using (id, structure))"""]
    for k in range(stages):
        out.append(f"""c{k} as (select z.*, a + (b - a)*j/{float(cuts)!r}e0 s from z{k} z, (select unnest(range(0, {cuts + 1})) j) q),
  v{k} as (select id, structure, dir, a, b, bv, at_s, s, {value} pnl from (select c.*, opt_type, strike, premium, sg, lots, (leg_days - hz)/3.65e2 lf, v from c{k} c join lg using (id, structure) join fr using (id, structure)) q group by all),
  m{k} as (select id, structure, dir, a, b, bv, at_s, arg_max(struct_pack(s := s, pnl := pnl), (dir*pnl, -s)) z from v{k} group by all),
  z{k + 1} as (select id, structure, dir, greatest(a, z.s - (b - a)/{float(cuts)!r}e0) a, least(b, z.s + (b - a)/{float(cuts)!r}e0) b,
     case when dir*z.pnl > dir*bv then z.pnl else bv end bv, case when dir*z.pnl > dir*bv then z.s else at_s end at_s from m{k})""")
    return ", ".join(out)


HORIZON = ORACLES["horizon_value"]
HORIZON = HORIZON[:HORIZON.rindex("select id, structure, count(*) points")]


@query("horizon_extremes", "", None)
def horizon_extremes(t):
    """Extremes between the grid's points, as a fraction of a paisa."""
    x = O.horizon_extremes(packed(t, O.SEVERAL_EXPIRIES))
    return x.select("id", "structure", rr("max_profit", 3).alias("max_profit"), rr("max_loss", 3).alias("max_loss"))


ORACLES["horizon_extremes"] = f"""{HORIZON.rstrip()}, {_refine_sql()}
  select id, structure, round(max(case when dir = 1 then bv end), 3) + 0e0 max_profit, round(max(case when dir = -1 then bv end), 3) + 0e0 max_loss from z5 group by 1, 2"""


LG_G = greeks("opt_type", "spot", "strike", "t", "v")


@query("net_greeks", "spots", f"{LEGS} select id, structure, " + ", ".join(
    f"round(sum(sg*lots*case when opt_type = 'FUT' then {'1e0' if n == 'delta' else '0e0'} else {e} end), 7) + 0e0 {n}" for n, e in LG_G.items()) + " from lg group by 1, 2")
def net_greeks(t):
    return O.net_greeks(legs(t)).select("id", "structure", *[rr(n, 7).alias(n) for n in LG_G])


@query("net_premium", "spots", f"{LEGS} select id, structure, round(sum(case when opt_type <> 'FUT' then -sg*premium*lots else 0e0 end), 4) + 0e0 net_premium from lg group by 1, 2")
def net_premium(t):
    return O.net_premium(legs(t)).select("id", "structure", rr("net_premium", 4).alias("net_premium"))


PG = greeks("opt_type", "s", "k", "t", "iv")


@query("portfolio_greeks", "chain", f"""{IV}, ps as (select *, quote_id % 7 - 3 qty, case when quote_id % 10 = 0 then 'FUT' else 'OPT' end kind from ivs)
  select grp acct, """ + ", ".join(f"round(sum(case when kind = 'FUT' then qty*{'1e0' if n == 'delta' else '0e0'} when iv is not null then ({e})*qty else 0e0 end), 6) + 0e0 {n}" for n, e in PG.items())
       + " from ps where qty <> 0 group by grp")
def portfolio_greeks(t):
    q = F.col("quote_id")
    pos = quotes(t).select(F.col("grp").alias("acct"), "opt_type", F.col("mp").alias("last"), F.col("s").alias("spot"), "k", "t", (q % 7 - 3).alias("qty"),
                           F.when(q % 10 == 0, "FUT").otherwise("OPT").alias("kind"))
    return O.portfolio_greeks(pos).select("acct", *[rr(n).alias(n) for n in PG])


# ---- cycles -------------------------------------------------------------------------------------------------------------

STEP = 1e0
_CY = ", ".join(f"('{n}', {j}, '{ty}', '{sd}', {m!r}e0, {q})" for n, lg in O.CYCLE_STRUCTURES for j, (ty, sd, m, q) in enumerate(lg))
CYC = f"""{STAGE}, cb as (select sym, d, c, row_number() over ({W}) - 1 i, count(*) over (partition by sym) n, cast(date_diff('day', date '1970-01-01', d) as double) t,
     case when count(c) {fr(21)} = 21 then stddev_pop(lret) {fr(20)}*sqrt(2.52e2) else 1.8e-1 end rv from stage),
  ce0 as (select *, lead(t, 21) over ({W}) x, min(t) over (partition by sym) t0, max(t) over (partition by sym) t1 from cb),
  ce as (select sym, (i - 20)//21 cycle, i, n, c, rv, t et, coalesce(x, greatest(t + 21*greatest((t1 - t0)/(n - 1), 1e0/8.64e7), t1 + greatest((t1 - t0)/(n - 1), 1e0/8.64e7))) xt
         from ce0 where i >= 20 and (i - 20) % 21 = 0 and i + 2 < n),
  ct(structure, leg, opt_type, side, m, lots) as (values {_CY}),
  cl as (select ce.*, structure, leg, opt_type, side, floor(c*m/1e0 + 5e-1)*1e0 strike, lots from ce, ct),
  cg as (select sym, cycle, structure from cl group by 1, 2, 3 having count(distinct strike || ':' || opt_type) = count(*)),
  cy as (select cl.* from cl join cg using (sym, cycle, structure))"""


@query("option_cycles", "candles_daily", f"{CYC} select sym, cycle, i, structure, round(et, 4) entry_t, round(xt, 4) expiry_t, count(*) legs, sum(strike) strikes from cy group by all")
def option_cycles(t):
    x = O.option_cycles(t.candles_daily, STEP)
    return x.select("sym", "cycle", "i", "structure", F.round("entry_t", 4).alias("entry_t"), F.round("expiry_t", 4).alias("expiry_t"), F.size("legs").cast("bigint").alias("legs"),
                    F.aggregate("legs", F.lit(0e0), lambda a, g: a + g["strike"]).alias("strikes"))


OPT = cost_model("index_option")


def marks_sql(premiums):
    half = "greatest(em*5e-3, 5e-2)"
    return f"""{CYC}, pm as (select unnest([{', '.join(num(p) for p in premiums)}]) premium),
  bx as (select cy.*, premium, cb.i b, cb.t bt, cb.c bc, greatest(8e-2, cy.rv*premium) v0, greatest(8e-2, cb.rv*premium) v1,
         greatest(xt - et, 1e0)/3.65e2 tt0, greatest(xt - cb.t, 0e0)/3.65e2 tt1 from cy, pm, cb where cb.sym = cy.sym and cb.i between cy.i and least(cy.i + 21, cy.n - 1)),
  bm as (select *, {bs('opt_type', 'c', 'strike', 'tt0', 'v0')} em, greatest({bs('opt_type', 'bc', 'strike', 'tt1', 'v1')}, 5e-2) mk from bx),
  bf as (select *, case when side = 'BUY' then (em + {half})*(1 + {OPT['buy']!r}e0) else greatest((em - {half})*(1 - {OPT['sell']!r}e0), 1e-2) end paid from bm),
  bk as (select *, case when bt >= xt and side = 'BUY' then 1.25e-3*{intr('opt_type', 'bc', 'strike')}*lots*75 else 0e0 end stt, bt < xt and b = n - 1 closing,
     case when side = 'SELL' then (mk + greatest(mk*5e-3, 5e-2))*(1 + {OPT['buy']!r}e0) else greatest((mk - greatest(mk*5e-3, 5e-2))*(1 - {OPT['sell']!r}e0), 1e-2) end bck from bf),
  marks as (select sym, structure, premium, cycle, b, sum(case when side = 'BUY' then 1e0 else -1e0 end*(mk - paid)*lots*75 - 2e1 - stt) pnl, bool_or(bt >= xt) settled,
     sum(2e1 + stt + case when closing then 2e1 else 0e0 end) fees, sum(case when closing then case when side = 'BUY' then mk - bck else bck - mk end*lots*75 + 2e1 else 0e0 end) cc from bk group by 1, 2, 3, 4, 5)"""


@query("option_cycle_marks", "candles_daily", f"{marks_sql([1.2])} select sym, structure, cycle, b, round(pnl, 4) + 0e0 pnl, settled from marks")
def option_cycle_marks(t):
    x = O.option_cycle_marks(t.candles_daily, STEP)
    return x.select("sym", "structure", "cycle", "b", rr("pnl", 4).alias("pnl"), "settled")


GRID_SQL = f"""{marks_sql([1.0, 1.1, 1.2])}, ls as (select sym, structure, premium, cycle, max_by(pnl - cc, b) p, max_by(fees, b) f from marks group by 1, 2, 3, 4),
  tl as (select sym, structure, premium, sum(p) tp, count(*) cycles, sum(f) fees from ls group by 1, 2, 3),
  ds as (select *, pnl - cc - coalesce(lag(pnl - cc) over (partition by sym, structure, premium, cycle order by b), 0e0) s from marks),
  dt as (select sym, structure, premium, b, sum(s) s from ds group by 1, 2, 3, 4),
  ln as (select sym, d, row_number() over (partition by sym order by d) - 1 b from candles_daily),
  cu as (select tl.sym, tl.structure, tl.premium, ln.d, 1e6 + sum(coalesce(s, 0e0)) over (partition by tl.sym, tl.structure, tl.premium order by ln.b rows between unbounded preceding and current row) eq
         from tl join ln on ln.sym = tl.sym left join dt on dt.sym = tl.sym and dt.structure = tl.structure and dt.premium = tl.premium and dt.b = ln.b),
  cr as (select *, case when lag(eq) over k > 0 then eq/lag(eq) over k - 1 end r, max(eq) over (partition by sym, structure, premium order by d rows between unbounded preceding and current row) pk
         from cu window k as (partition by sym, structure, premium order by d)),
  mt as (select sym, structure, premium, min_by(eq, d) e0, max_by(eq, d) e1, min(eq) lo, date_diff('day', min(d), max(d))/3.6525e2 y, avg(r) m, stddev_samp(r) sd, max(case when pk > 0 then least(1e0, (pk - eq)/pk) else 0e0 end) dd from cr group by 1, 2, 3)"""


@query("vol_premium_grid", "candles_daily", f"""{GRID_SQL} select sym, structure, premium, round(tp, 3) + 0e0 total_pnl, cycles, round(fees, 3) + 0e0 fees, round((e1/e0 - 1)*1e2, 2) + 0e0 total_return_pct,
  round(case when e1 <= 0 then -1e2 else (pow(e1/e0, 1/y) - 1)*1e2 end, 2) + 0e0 cagr_pct,
  round(case when sd = 0 then 0e0 when lo <= 0 then least(0e0, (m - 6.5e-2/2.52e2)/sd*sqrt(2.52e2)) else (m - 6.5e-2/2.52e2)/sd*sqrt(2.52e2) end, 2) + 0e0 sharpe, round(dd*1e2, 2) + 0e0 max_drawdown_pct from tl join mt using (sym, structure, premium)""")
def vol_premium_grid(t):
    bars = t.pin("candles_daily")
    x = O.vol_premium_grid(pin(O.option_cycle_marks(bars, STEP, premium=[1.0, 1.1, 1.2])), bars)
    return x.withColumn("total_pnl", rr("total_pnl", 3)).withColumn("fees", rr("fees", 3))


@query("remark_positions", "candles_daily", f"""{CYC}, rp as (select sym, cycle, structure, leg, opt_type, strike, date '1970-01-01' + cast(floor(xt) as int) - 5 d, xt - (floor(xt) - 5) dl, greatest(8e-2, rv*1.2e0) iv from cy),
  sp as (select rp.*, p.c spot from rp asof left join candles_daily p on rp.sym = p.sym and rp.d >= p.d), tx as (select *, greatest(dl, 0e0)/3.65e2 tt from sp where spot > 0)
  select sym, cycle, structure, leg, round(greatest({bs('opt_type', 'spot', 'strike', 'tt', 'iv')}, 5e-2), 6) mark from tx""")
def remark_positions(t):
    p = t.pin("candles_daily")
    from barlattice.functions.indicators import with_indicators
    from pyspark.sql import Window

    rv = with_indicators(p, {"iv": ("model_iv",)}).select("sym", (F.row_number().over(Window.partitionBy("sym").orderBy("d")) - 1).alias("i"), "iv")
    cyc = O.option_cycles(p, STEP).join(rv, ["sym", "i"])
    pos = cyc.select("sym", "cycle", "structure", "iv", "expiry_t", F.posexplode("legs").alias("leg", "g")).select(
        "sym", "cycle", "structure", F.col("leg").alias("leg"), "iv", "g.opt_type", "g.strike", F.date_add(F.lit("1970-01-01"), F.floor("expiry_t").cast("int") - 5).alias("d"),
        (F.col("expiry_t") - (F.floor("expiry_t") - 5)).alias("days_left"))
    x = asof(pos, p, by=["sym"], ts="d", values=["c"]).withColumnRenamed("c", "spot")
    return O.remark_positions(x).select("sym", "cycle", "structure", "leg", F.round("mark", 6).alias("mark"))
