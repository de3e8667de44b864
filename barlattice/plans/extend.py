"""Queries through the extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions import extend as E
from barlattice.functions.signals import strat_sma_cross
from barlattice.operators.returns import weight_returns
from barlattice.plans.indicators import W, ema, sma
from barlattice.plans.registry import query, rr
from barlattice.plans.sources import spec_table
from barlattice.plans.xsection import ELIG, V, elig


def _trailing_stop():
    """In on a close above 100, out after a fall of 3 % from the highest close since entry."""
    held, peak = False, 0.0

    def step(c: float) -> float:
        nonlocal held, peak
        if held:
            peak = max(peak, c)
            if c < peak * 9.7e-1:
                held = False
        elif c > 1e2:
            held, peak = True, c
        return 1.0 if held else 0.0

    return step


E.register_signal("above_ema", lambda: F.when(F.col("c") > F.col("e"), 1e0).otherwise(0e0), {"e": ("ema", 20)})
E.register_fold("trailing_stop", _trailing_stop)


@query("register_signal", "candles_daily", f"i as (select sym, d, c, {ema(20)} e from candles_daily) select sym, d, case when c > e then 1e0 else 0e0 end w from i")
def register_signal(t):
    return E.apply_signal("above_ema", t.candles_daily).select("sym", "d", "w")


@query("register_fold", "candles_daily", """g as (select sym, list(struct_pack(d := d, c := c) order by d) l from candles_daily group by sym),
  f as (select sym, l, list_reduce(list_concat([struct_pack(h := false, p := 0e0, e := l[1], acc := cast([] as double[]))], list_transform(l, lambda e: struct_pack(h := false, p := 0e0, e := e, acc := cast([] as double[])))),
     lambda a, b: list_transform([struct_pack(h := case when a.h then b.e.c >= greatest(a.p, b.e.c)*9.7e-1 else b.e.c > 1e2 end, p := case when a.h then greatest(a.p, b.e.c) else b.e.c end)],
       lambda z: struct_pack(h := z.h, p := z.p, e := b.e, acc := list_append(a.acc, case when z.h then 1e0 else 0e0 end)))[1]).acc acc from g)
  select sym, unnest(list_transform(l, lambda e: e.d)) d, unnest(acc) w from f""")
def register_fold(t):
    return E.apply_signal("trailing_stop", t.candles_daily).select("sym", "d", "w")


@query("rank_source", V, f"{ELIG} select gi, sym, round(coalesce(case when gi % 2 = 0 then m126 end, m63), 8) + 0e0 score from el where coalesce(case when gi % 2 = 0 then m126 end, m63) is not null")
def rank_source(t):
    x = elig(t).withColumnRenamed("m63", "rule")
    scores = x.filter("gi % 2 = 0").select("gi", "sym", F.col("m126").alias("score"))
    return E.rank_source(x.drop("score"), scores).select("gi", "sym", rr("score", 8).alias("score"))


@query("cost_model", "candles_daily", f"""sg as (select sym, d, c, case when f > s then 1e0 else 0e0 end w from (select sym, d, c, {sma(50)} f, {sma(200)} s from candles_daily) q),
  h as (select *, coalesce(c/lag(c) over ({W}) - 1, 0e0) ret, coalesce(lag(w, 2) over ({W}), 0e0) held, coalesce(lag(w, 1) over ({W}), 0e0) nw from sg)
  select sym, d, round(held*ret - case when nw > held then (nw - held)*2e-3 else (held - nw)*3e-3 end, 9) + 0e0 r from h""")
def cost_model(t):
    x = weight_returns(strat_sma_cross(t.candles_daily), E.user_cost_model(2e-3, 3e-3))
    return x.select("sym", "d", rr("r", 9).alias("r"))


@query("spec_rows", "specs", """s as (select spec_id, cast(substr(spec_id, 7) as int) n, score from specs)
  select spec_id, 'name' part, 'Brand#' || ((n + i*3) % 25 + 1) item, cast(null as double) weight from (select *, unnest(range(0, n % 4 + 2)) i from s where n % 3 <> 0) q
  union all select spec_id, 'factor', 'mom', 5e-1 from s union all select spec_id, 'factor', 'vol', -score from s""")
def spec_rows(t):
    fac = F.array(F.struct(F.lit("mom").alias("name"), F.lit(5e-1).alias("weight")), F.struct(F.lit("vol").alias("name"), (-F.col("score")).alias("weight")))
    return E.spec_rows(spec_table(t).withColumn("factors", fac))
