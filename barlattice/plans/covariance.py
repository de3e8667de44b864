"""Covariance and optimiser-weight queries on the momentum picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions.indicators import with_indicators
from barlattice.operators import covariance as C
from barlattice.operators import xsection as X
from barlattice.plans.indicators import W
from barlattice.plans.registry import query, rr
from barlattice.plans.xsection import INV, TOP, K, V, W_SQL, top
from barlattice.session import pin

T, CAP = 60, 3e-1

COV = f"""{TOP}, rx as (select sym, d, row_number() over ({W}) - 1 ri, ret from stage), cho as (select top.gi, top.sym, rx.ri from top join rx on rx.sym = top.sym and rx.d = top.bar_d),
  tl as (select cho.gi, cho.sym, rx.ri - cho.ri u, rx.ret x from cho join rx on rx.sym = cho.sym and rx.ri > cho.ri - {T} and rx.ri <= cho.ri),
  okd as (select gi from cho group by gi having min(ri) >= {T}), td as (select gi, sym, u, x - avg(x) over (partition by gi, sym) x from tl join okd using (gi)),
  cv as (select a.gi, a.sym a, b.sym b, avg(a.x*b.x) s, var_pop(a.x*b.x)/{T} v from td a join td b on a.gi = b.gi and a.u = b.u group by 1, 2, 3),
  dl as (select gi, case when sum(s*s) filter (a <> b) > 1e-18 then greatest(0e0, least(1e0, sum(v) filter (a <> b)/sum(s*s) filter (a <> b))) else 1e0 end delta,
         avg(s) filter (a = b) av from cv group by gi),
  sg as (select cv.*, delta, (1 - delta)*s + case when a = b then delta*s + 1e-6*av else 0e0 end sigma from cv join dl using (gi))"""


def chosen(t):
    return pin(top(t).select("gi", "sym", "ri", "rk", "vol", "score"))


def shrunk(t):
    c = chosen(t)
    rets = with_indicators(t.pin("candles_daily"), {"ret": ("ret",)}).select(
        "sym", (F.row_number().over(Window.partitionBy("sym").orderBy("d")) - 1).alias("ri"), "ret")
    return c, C.cov_long(C.tail_returns(c, rets, T), T)


@query("cov_long", V, f"{COV} select gi, a, b, round(s*1e4, 7) + 0e0 s from cv")
def cov_long(t):
    return shrunk(t)[1].select("gi", "a", "b", rr(F.col("s") * 1e4, 7).alias("s"))


@query("shrink_delta", V, f"{COV} select gi, a, b, round(delta, 6) + 0e0 delta, round(sigma*1e4, 6) + 0e0 sigma from sg")
def shrink_delta(t):
    return C.shrink_delta(shrunk(t)[1]).select("gi", "a", "b", rr("delta", 6).alias("delta"), rr(F.col("sigma") * 1e4, 6).alias("sigma"))


def _rounds(n: int) -> str:
    out = "wf0 as (select gi, sym, case when m > 0 then m else 0e0 end w, false c from mw)"
    for i in range(1, n + 1):
        out += f""", wx{i} as (select gi, sym, c, case when c then w else w*case when fs > 0 and 1e0 - cs > 0 then (1e0 - cs)/fs else 1e0 end end w
     from (select *, coalesce(sum(w) filter (not c) over (partition by gi), 0e0) fs, coalesce(sum(w) filter (c) over (partition by gi), 0e0) cs from wf{i - 1}) q),
  wf{i} as (select gi, sym, case when not c and w > {CAP} + 1e-12 then {CAP} else w end w, c or w > {CAP} + 1e-12 c from wx{i})"""
    return out


CAPPED = f"""{_rounds(8)}
  select wf8.gi, wf8.sym, case when sum(greatest(m, 0e0)) over (partition by wf8.gi) > 0 then round(w, 7) + 0e0 end w from wf8 join mw using (gi, sym)"""
# a date's names numbered from 0; dates may have fewer than K
NUMBERED = f"""{COV}, nm as (select gi, a sym, row_number() over (partition by gi order by a) - 1 i from (select distinct gi, a from sg) q),
  nn as (select gi, count(*) n from nm group by gi)"""


def _eliminate(p: int) -> str:
    """``e0 (gi, i, j, v)``, the right side as column p, to the solution in ``e{p}``; a date with fewer rows skips the steps it lacks."""
    step = """e{k1} as materialized (select t.gi, t.i, t.j, case when d.v is null then t.v when t.i = {k} then t.v/d.v else t.v - f.v*r.v/d.v end v from e{k} t left join e{k} d on d.gi = t.gi and d.i = {k} and d.j = {k}
   left join e{k} r on r.gi = t.gi and r.i = {k} and r.j = t.j left join e{k} f on f.gi = t.gi and f.i = t.i and f.j = {k})"""
    return ", ".join(step.format(k=k, k1=k + 1) for k in range(p))


@query("w_meanvar", V, f"""{NUMBERED}, e0 as materialized (select sg.gi, x.i, y.i j, sigma v from sg join nm x on x.gi = sg.gi and x.sym = sg.a join nm y on y.gi = sg.gi and y.sym = sg.b
     union all select nm.gi, i, {K}, score - min(score) over (partition by nm.gi) + 1e-6 from nm join top on top.gi = nm.gi and top.sym = nm.sym), {_eliminate(K)},
  mw as (select nm.gi, nm.sym, v m from e{K} join nm on nm.gi = e{K}.gi and nm.i = e{K}.i where j = {K}), {CAPPED}""")
def w_meanvar(t):
    c, cov = shrunk(t)
    return C.w_meanvar(C.shrink_delta(cov), c.select("gi", "sym", F.col("score").alias("mu")), cap=CAP).withColumn("w", rr("w", 7))


@query("w_riskparity", V, f"""{NUMBERED}, rw as (select sg.gi, x.i, list(sigma order by sg.b) r from sg join nm x on x.gi = sg.gi and x.sym = sg.a group by 1, 2),
  mm as (select gi, list(r order by i) m, len(list(r)) n from rw group by gi), m0 as (select *, list_transform(range(0, n), lambda k: 1/sqrt(n*list_sum(list_transform(range(1, n + 1), lambda q: m[q][q])))) x from mm),
  cd as (select gi, list_reduce(list_concat([struct_pack(i := 0::bigint, x := x, m := m, n := n)], list_transform(range(0, 150*n), lambda s: struct_pack(i := s % n + 1, x := x, m := m, n := n))),
     lambda a, e: struct_pack(i := e.i, x := list_transform(range(1, a.n + 1), lambda k: case when k <> e.i then a.x[k] else
       (sqrt(pow(list_inner_product(a.m[k], a.x) - a.m[k][k]*a.x[k], 2) + 4*a.m[k][k]/a.n) - (list_inner_product(a.m[k], a.x) - a.m[k][k]*a.x[k]))/(2*a.m[k][k]) end), m := a.m, n := a.n)).x x from m0),
  mw as (select nm.gi, nm.sym, x[nm.i + 1]/list_sum(x) m from cd join nm using (gi)), {CAPPED}""")
def w_riskparity(t):
    return C.w_riskparity(C.shrink_delta(shrunk(t)[1]), cap=CAP).withColumn("w", rr("w", 7))


@query("risk_contributions", V, f"""{COV} {INV}, wi as (select gi, sym, {W_SQL['w_invvol']} w from iv1),
  sw as (select sg.gi, sg.a sym, wa.w*sum(sigma*wb.w) rc from sg join wi wb on wb.gi = sg.gi and wb.sym = sg.b join wi wa on wa.gi = sg.gi and wa.sym = sg.a group by sg.gi, sg.a, wa.w)
  select gi, sym, round(rc/sum(rc) over (partition by gi)*1e2, 5) + 0e0 risk_pct from sw qualify sum(rc) over (partition by gi) > 0 and min(rc/sum_rc) over (partition by gi) >= -1e-9""".replace(
    "select gi, sym, round(rc/sum(rc) over (partition by gi)*1e2, 5) + 0e0 risk_pct from sw qualify sum(rc) over (partition by gi) > 0 and min(rc/sum_rc) over (partition by gi) >= -1e-9",
    "select gi, sym, round(rc/t*1e2, 5) + 0e0 risk_pct from (select *, sum(rc) over (partition by gi) t, min(rc) over (partition by gi) mn from sw) q where t > 0 and mn/t >= -1e-9"))
def risk_contributions(t):
    c, cov = shrunk(t)
    x = c.withColumn("vol", F.when((F.col("gi") % 2 == 0) & (F.col("rk") == 2), F.lit(None)).otherwise(F.col("vol")))
    w = x.select("gi", "sym", X.w_invvol().alias("w"))
    return C.risk_contributions(C.shrink_delta(cov), w).select("gi", "sym", rr("risk_pct", 5).alias("risk_pct"))


@query("cap_weights", V, f"""{TOP}, mw as (select gi, sym, score - 2e-2 m from top), {_rounds(8)}
  select wf8.gi, wf8.sym, case when sum(greatest(m, 0e0)) over (partition by wf8.gi) > 0 then round(w, 8) + 0e0 end w from wf8 join mw using (gi, sym)""")
def cap_weights(t):
    x = top(t).select("gi", "sym", (F.col("score") - 2e-2).alias("w"))
    return C.cap_weights(x, CAP).withColumn("w", rr("w", 8))


@query("weights_fallback", V, f"""{TOP} {INV}, wi as (select gi, sym, {W_SQL['w_invvol']} w from iv1),
  o as (select gi, sym, rk, case when gi % 3 = 0 and rk = 2 then null when gi % 5 = 0 then 1e-1 else 1e0/count(*) over (partition by gi) end o from top),
  j as (select wi.gi, wi.sym, w, o, bool_and(o is not null and o >= 0) over (partition by wi.gi) and sum(o) over (partition by wi.gi) >= 1e0 - 1e-6 good from wi join o using (gi, sym))
  select gi, sym, round(case when good then o else w end, 8) + 0e0 w, not coalesce(good, false) used_fallback from j""")
def weights_fallback(t):
    c = chosen(t)
    x = c.withColumn("vol", F.when((F.col("gi") % 2 == 0) & (F.col("rk") == 2), F.lit(None)).otherwise(F.col("vol")))
    opt = c.select("gi", "sym", F.when((F.col("gi") % 3 == 0) & (F.col("rk") == 2), F.lit(None)).when(F.col("gi") % 5 == 0, 1e-1).otherwise(X.w_equal()).alias("w"))
    y = C.weights_fallback(opt, x.select("gi", "sym", X.w_invvol().alias("w")))
    return y.withColumn("w", rr("w", 8))
