"""Pair-screening queries on the aligned panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import pairs as P
from barlattice.operators.align import align_grid
from barlattice.operators.returns import cost_model
from barlattice.plans.align import GRID
from barlattice.plans.registry import query, rr
from barlattice.session import pin

LB, EVERY, MINC, MAXP = 60, 63, 5e-2, 3
ENTRY, EXIT, STOP = 1.5e0, 5e-1, 3e0
DEL = cost_model("delivery")
BUY, SELL = repr(DEL["buy"]) + "e0", repr(DEL["sell"]) + "e0"
V = "candles_daily market_daily"

WIN = f"""{GRID}, pg as (select gi, d, sym, px from grid where px is not null and sym <> 'MKT'),
  mx as (select max(gi) m from mst), fm as (select f, case when f + {EVERY} <= m then f + {EVERY} end f_next, m from (select unnest(range({LB}, m + 1, {EVERY})) f, m from mx) q),
  lw0 as (select f, sym, gi, ln(px) lp from fm join pg on pg.gi > f - {LB} and pg.gi <= f),
  lw as (select *, count(*) over (partition by f, sym) n from lw0 qualify n = {LB}),
  lr as (select f, sym, gi, lp, lp - lag(lp) over (partition by f, sym order by gi) r from lw)"""
ST = f"""{WIN}, ps0 as (select a.f, a.sym a, b.sym b, corr(a.r, b.r) rho, regr_slope(a.lp, b.lp) beta from lr a join lr b on a.f = b.f and a.gi = b.gi and a.sym < b.sym group by 1, 2, 3),
  ps as (select * from ps0 where not isnan(rho) and rho >= {MINC}),
  sd as (select ps.f, ps.a, ps.b, x.gi, x.lp - beta*y.lp s from ps join lr x on x.f = ps.f and x.sym = ps.a join lr y on y.f = ps.f and y.sym = ps.b and y.gi = x.gi),
  sl as (select *, lead(s) over (partition by f, a, b order by gi) s1 from sd),
  ph as (select f, a, b, regr_slope(s1, s) filter (s1 is not null) phi from sl group by 1, 2, 3),
  st as (select ps.*, phi from ps join ph using (f, a, b)),
  rk as (select *, rho*(1 - greatest(phi, 0e0)) score from st where beta > 0 and phi > -1 and phi < 9.7e-1),
  rkd as (select *, row_number() over (partition by f order by score desc, a, b) rk from rk)"""
CH = f"""{ST}, gl as (select f, list(struct_pack(a := a, b := b, beta := beta, score := score) order by rk) l from rkd group by f),
  gr as (select f, list_reduce(list_concat([struct_pack(used := cast([] as varchar[]), acc := cast([] as struct(a varchar, b varchar, beta double, score double)[]), p := l[1])],
     list_transform(l, lambda q: struct_pack(used := cast([] as varchar[]), acc := cast([] as struct(a varchar, b varchar, beta double, score double)[]), p := q))),
     lambda x, y: case when len(x.acc) >= {MAXP} or list_contains(x.used, y.p.a) or list_contains(x.used, y.p.b) then x
       else struct_pack(used := list_concat(x.used, [y.p.a, y.p.b]), acc := list_append(x.acc, y.p), p := y.p) end).acc acc from gl),
  ch as (select f, u.a a, u.b b, u.beta beta, u.score score from (select f, unnest(acc) u from gr) q)"""
ZS = f"""{CH}, za as (select ch.f, ch.a, ch.b, ch.beta, fm.f_next, fm.m, x.gi, ln(x.px) - beta*ln(y.px) s from ch join fm using (f)
     join pg x on x.sym = ch.a and x.gi > f - {LB} and x.gi <= coalesce(f_next - 1, m) join pg y on y.sym = ch.b and y.gi = x.gi),
  zb as (select *, case when count(s) over w = {LB} and stddev_pop(s) over w > 0 then (s - avg(s) over w)/stddev_pop(s) over w end z from za
         window w as (partition by f, a, b order by gi rows between {LB - 1} preceding and current row)),
  zs as (select * from zb where gi >= f)"""
SS = f"""{ZS}, s0 as (select *, case when gi - lag(gi) over (partition by a, b order by gi) > 1 then 1 else 0 end nw from zs),
  s1 as (select *, sum(nw) over (partition by a, b order by gi) run from s0),
  s2 as (select *, row_number() over (partition by a, b, run order by gi) q from s1),
  sg as (select a, b, run, list(struct_pack(gi := gi, z := z) order by q) l from s2 group by 1, 2, 3),
  sf as (select a, b, run, l, list_reduce(list_concat([struct_pack(dir := 0, z := cast(null as double), acc := cast([] as int[]))],
      list_transform(l, lambda e: struct_pack(dir := 0, z := e.z, acc := cast([] as int[])))),
      lambda x, y: list_transform([case when y.z is null then x.dir when x.dir = 0 then case when y.z >= {ENTRY} and y.z < {STOP} then -1 when y.z <= -{ENTRY} and y.z > -{STOP} then 1 else 0 end
          else case when abs(y.z) <= {EXIT} or abs(y.z) >= {STOP} then 0 else x.dir end end], lambda d: struct_pack(dir := d, z := y.z, acc := list_append(x.acc, d)))[1]).acc ds from sg),
  stt as (select a, b, run, e.gi gi, e.z z, dir from (select a, b, run, unnest(l) e, unnest(ds) dir from sf) q),
  lg0 as (select a, b, run, gi, dir from stt union all select a, b, run, g + k, 0 from (select a, b, run, max(gi) g from stt group by 1, 2, 3) q, (values (1), (2)) v(k), mx where g + k <= m),
  lgs as (select a, b, run, gi, a sym, dir*1e0/{MAXP} w from lg0 union all select a, b, run, gi, b, -dir*1e0/{MAXP} from lg0)"""


def grid(t):
    return pin(align_grid(t.candles_daily, t.market_daily, before_listing=False).filter("sym <> 'MKT'"))


def stats(t, keep=None):
    g = grid(t)
    return g, P.pair_stats(P.log_window(g, LB, EVERY), MINC, keep=keep, names=g)


def chosen(t):
    g, st = stats(t, 2 * MAXP - 1)
    return g, pin(P.disjoint_pairs(pin(P.scored(st)), MAXP))


def states(t):
    g, ch = chosen(t)
    return g, pin(P.pair_state(P.spread_z(ch, P.formations(g, LB, EVERY), g, LB), ENTRY, EXIT, STOP, EVERY))


@query("log_window", V, f"{WIN} select f, sym, count(*) n, round(avg(lp), 8) mean_log, round(max_by(lp, gi), 8) last_log from lw group by 1, 2")
def log_window(t):
    x = P.log_window(grid(t), LB, EVERY)
    return x.select("f", "sym", F.size("logs").cast("bigint").alias("n"), F.round(F.aggregate("logs", F.lit(0e0), lambda a, v: a + v) / LB, 8).alias("mean_log"),
                    F.round(F.element_at("logs", -1), 8).alias("last_log"))


@query("pair_corr", V, f"{ST} select f, a, b, round(rho, 7) + 0e0 rho from ps")
def pair_corr(t):
    return stats(t)[1].select("f", "a", "b", rr("rho", 7).alias("rho"))


@query("hedge_ratio", V, f"{ST} select f, a, b, round(beta, 6) + 0e0 beta from ps where beta > 0")
def hedge_ratio(t):
    return stats(t)[1].filter("beta > 0").select("f", "a", "b", rr("beta", 6).alias("beta"))


@query("spread_ar1", V, f"{ST} select f, a, b, round(phi, 6) + 0e0 phi from st where beta > 0 and phi > -1 and phi < 9.7e-1")
def spread_ar1(t):
    return P.scored(stats(t)[1]).select("f", "a", "b", rr("phi", 6).alias("phi"))


@query("rank_pairs", V, f"{ST} select f, a, b, round(score, 6) + 0e0 score, rk from rkd")
def rank_pairs(t):
    return P.rank_pairs(stats(t)[1]).select("f", "a", "b", rr("score", 6).alias("score"), "rk")


@query("disjoint_pairs", V, f"{CH} select f, a, b, round(score, 6) + 0e0 score from ch")
def disjoint_pairs(t):
    return chosen(t)[1].select("f", "a", "b", rr("score", 6).alias("score"))


@query("spread_z", V, f"{ZS} select f, gi, a, b, round(z, 5) + 0e0 z from zs")
def spread_z(t):
    g, ch = chosen(t)
    return P.spread_z(ch, P.formations(g, LB, EVERY), g, LB).select("f", "gi", "a", "b", rr("z", 5).alias("z"))


@query("pair_state", V, f"{SS} select gi, a, b, dir from stt")
def pair_state(t):
    return states(t)[1].select("gi", "a", "b", "dir")


@query("pair_events", V, f"""{SS}, pe as (select *, coalesce(lag(dir) over w, 0) p, lead(gi) over w nx from stt window w as (partition by a, b, run order by gi))
  select gi, a, b, case when dir = 1 then 'open long' else 'open short' end event from pe where dir <> 0 and p = 0
  union all select gi, a, b, case when abs(z) >= {STOP} then 'stopped' else 'reverted' end from pe where dir = 0 and p <> 0
  union all select gi + 1, a, b, 'rotated out' from pe, mx where dir <> 0 and nx is null and gi < m""")
def pair_events(t):
    return P.pair_events(states(t)[1], STOP)


@query("pair_returns", V, f"""{SS}, lp as (select lgs.*, pg.px c, pg.d from lgs join pg using (gi, sym)),
  l1 as (select *, coalesce(c/lag(c) over k - 1, 0e0) rt, coalesce(lag(w, 2) over k, 0e0) held, coalesce(lag(w, 1) over k, 0e0) nw, date_diff('day', lag(d) over k, d) gap
         from lp window k as (partition by a, b, run, sym order by gi))
  select gi, d, round(sum(held*rt - case when nw > held then (nw - held)*{BUY} else (held - nw)*{SELL} end - coalesce(greatest(-held, 0e0)*6e-2*gap/3.6525e2, 0e0)), 8) + 0e0 r from l1 group by 1, 2""")
def pair_returns(t):
    g, s = states(t)
    return P.pair_returns(P.pair_legs(s, 1e0, MAXP), g, DEL).select("gi", "d", rr("r", 8).alias("r"))


@query("net_exposure_check", V, f"""{SS} select gi, round(sum(case when w > 0 then w else 0e0 end), 9) + 0e0 long, round(sum(case when w < 0 then -w else 0e0 end), 9) + 0e0 short,
   abs(sum(w)) < 1e-9 neutral from lgs group by gi""")
def net_exposure_check(t):
    _, s = states(t)
    return P.net_exposure_check(P.pair_legs(s, 1e0, MAXP)).select("gi", rr("long", 9).alias("long"), rr("short", 9).alias("short"), "neutral")
