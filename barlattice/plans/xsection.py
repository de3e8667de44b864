"""Cross-section queries: candidates at decision dates, ranks and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions.indicators import with_indicators
from barlattice.operators import xsection as X
from barlattice.operators.align import master_timeline
from barlattice.plans.indicators import STAGE, Z, mom, sma, vol
from barlattice.plans.registry import query, rr

EVERY, K = 21, 5
V = "candles_daily market_daily"
SPECS = {"s50": ("sma", 50), "m63": ("mom", 63), "m126": ("mom", 126), "vol": ("vol", 20), "z50": ("zscore", 50)}

MST = """mst as (select d, row_number() over (order by d) - 1 gi, count(*) over () n from (select d from candles_daily union select d from market_daily) u)"""
CAND = f"""{MST}, {STAGE},
  ind as (select sym, d, c, {sma(50)} s50, {mom(63)} m63, {mom(126)} m126, {vol(20)} vol, {Z} z50 from stage),
  b as (select i.*, gi g, coalesce(lead(gi) over (partition by sym order by gi), n) e from ind i join mst using (d)),
  cand as (select dm.gi, dm.d, b.sym, b.d bar_d, c, s50, m63, m126, vol, z50 from (select gi, d from mst where gi % {EVERY} = 0) dm
           join b on b.g <= dm.gi and dm.gi < b.e)"""
ELIG = f"{CAND}, el as (select *, m63 score from cand where coalesce(c > s50, false))"
TOP = (f"{ELIG}, rk0 as (select *, row_number() over (partition by gi order by score desc, m126 desc nulls last, sym) rk from el where score is not null), "
       f"top as (select * from rk0 where rk <= {K})")


def master(t):
    return master_timeline(t.pin("candles_daily"), t.pin("market_daily"))


def candidates(t):
    return X.decision_rows(with_indicators(t.pin("candles_daily"), SPECS), master(t), EVERY)


def elig(t):
    return X.eligible(candidates(t), F.col("c") > F.col("s50")).withColumn("score", F.col("m63"))


def top(t):
    return X.top_k(elig(t), K, rule="m126")


@query("rebalance_dates", V, f"{MST} select gi, d from mst where gi % {EVERY} = 0")
def rebalance_dates(t):
    return X.rebalance_dates(master(t), EVERY).select("gi", "d")


@query("eligible", V, f"{ELIG} select gi, d, sym, bar_d from el")
def eligible(t):
    return elig(t).select("gi", "d", "sym", "bar_d")


@query("cs_zscore", V, f"""{ELIG} select gi, sym, round((m63 - avg(m63) over (partition by gi))/(case when stddev_pop(m63) over (partition by gi) > 1e-12
   then stddev_pop(m63) over (partition by gi) else 1e0 end), 6) + 0e0 z from el where m63 is not null""")
def cs_zscore(t):
    return elig(t).filter("m63 is not null").select("gi", "sym", rr(X.cs_zscore("m63")).alias("z"))


FW = {"m126": 5e-1, "vol": -3e-1, "z50": 2e-1}
COMP = f"""{CAND}, wm as (select * from cand where m126 is not null and vol is not null and z50 is not null),
  zz as (select *, """ + ", ".join(
    f"({f} - avg({f}) over (partition by gi))/(case when stddev_pop({f}) over (partition by gi) > 1e-12 then stddev_pop({f}) over (partition by gi) else 1e0 end) z_{f}"
    for f in FW) + """ from wm), sc as (select *, 5e-1*z_m126 - 3e-1*z_vol + 2e-1*z_z50 score from zz)"""


@query("factor_composite", V, f"""{COMP} select gi, sym, round(score, 6) + 0e0 score, round(z_vol, 4) + 0e0 z_vol, false dropped from sc
  union all select gi, sym, null, null, true from cand where m126 is null or vol is null or z50 is null""")
def factor_composite(t):
    sc, dropped = X.factor_composite(candidates(t), FW)
    a = sc.select("gi", "sym", rr("score").alias("score"), rr("z_vol", 4).alias("z_vol"), F.lit(False).alias("dropped"))
    z = F.lit(None).cast("double")
    return a.unionByName(dropped.select("gi", "sym", z.alias("score"), z.alias("z_vol"), F.lit(True).alias("dropped")))


@query("top_k", V, f"{TOP} select gi, d, sym, rk, round(score, 8) + 0e0 score from top")
def top_k(t):
    return top(t).select("gi", "d", "sym", "rk", rr("score", 8).alias("score"))


@query("score_fallback", V, f"{CAND} select gi, sym, round(coalesce(m126, m63), 8) + 0e0 score from cand where coalesce(m126, m63) is not null")
def score_fallback(t):
    x = candidates(t).withColumn("model", F.when(F.col("m126").isNull(), float("nan")).otherwise(F.col("m126")))
    x = x.withColumn("score", X.score_fallback(F.col("model"), F.col("m63"))).filter("score is not null")
    return x.select("gi", "sym", rr("score", 8).alias("score"))


W_SQL = {
    "w_equal": "1e0/count(*) over (partition by gi)",
    "w_rank": "1e0*(count(*) over (partition by gi) - rk + 1)/(count(*) over (partition by gi)*(count(*) over (partition by gi) + 1)/2e0)",
    "w_invvol": "coalesce(iv, lo)/(sum(iv) over (partition by gi) + (count(*) over (partition by gi) - count(iv) over (partition by gi))*lo)",
}
INV = """, iv0 as (select *, case when gi % 2 = 0 and rk = 2 then null when vol > 1e-6 then 1/vol end iv from top),
  iv1 as (select *, min(iv) over (partition by gi) lo from iv0)"""


@query("w_equal", V, f"{TOP} select gi, sym, round({W_SQL['w_equal']}, 8) w from top")
def w_equal(t):
    return top(t).select("gi", "sym", rr(X.w_equal(), 8).alias("w"))


@query("w_rank", V, f"{TOP} select gi, sym, round({W_SQL['w_rank']}, 8) w from top")
def w_rank(t):
    return top(t).select("gi", "sym", rr(X.w_rank(), 8).alias("w"))


@query("w_invvol", V, f"{TOP} {INV} select gi, sym, round({W_SQL['w_invvol']}, 8) w from iv1")
def w_invvol(t):
    x = top(t).withColumn("vol", F.when((F.col("gi") % 2 == 0) & (F.col("rk") == 2), F.lit(None)).otherwise(F.col("vol")))
    return x.select("gi", "sym", rr(X.w_invvol(), 8).alias("w"))


@query("risk_off_cash", V, f"""{TOP}, mk as (select gi, c > case when count(c) over (order by d rows between 49 preceding and current row) = 50
     then avg(c) over (order by d rows between 49 preceding and current row) end ok from market_daily join mst using (d)),
  mo as (select dm.gi, (select ok from mk where mk.gi <= dm.gi order by mk.gi desc limit 1) ok from (select gi from mst where gi % {EVERY} = 0) dm)
  select gi, sym, rk from top where gi in (select gi from mo where ok)""")
def risk_off_cash(t):
    mk = X.decision_rows(with_indicators(t.pin("market_daily"), {"s50": ("sma", 50)}), master(t), EVERY)
    ok = mk.select("gi", (F.col("c") > F.col("s50")).alias("ok"))
    return X.risk_off_cash(top(t), ok).select("gi", "sym", "rk")


@query("control_arms", V, f"""{CAND}, a as (select *, arm*vol score from cand, (values (-1), (0), (1)) q(arm) where vol is not null),
  r as (select *, row_number() over (partition by arm, gi order by score desc, sym) rk from a) select cast(arm as int) arm, gi, sym, rk from r where rk <= {K}""")
def control_arms(t):
    return X.control_arms(candidates(t).filter("vol is not null"), F.col("vol"), K).select("arm", "gi", "sym", "rk")


NULLS = """nm as (select distinct sym from candles_daily), sd as (select unnest(range(1, 21)) seed),
  nr as (select seed, sym, row_number() over (partition by seed order by md5(seed || ':' || sym), sym) r from nm, sd),
  npf as (select cast(seed as int) seed, sym from nr where r <= 5)"""


@query("null_portfolios", V, f"{NULLS} select seed, sym from npf")
def null_portfolios(t):
    return X.null_portfolios(t.candles_daily.select("sym").distinct(), 5, 20).select("seed", "sym")


@query("null_percentile", V, f"""{NULLS}, tr as (select sym, max_by(c, d)/min_by(c, d) - 1 tr from candles_daily group by sym),
  dr as (select seed, avg(tr) score from npf join tr using (sym) group by seed), st as (select avg(tr) study from tr)
  select round(study, 8) study, avg(case when score >= study then 1e0 else 0e0 end) share_at_or_above, round(min(score), 8) null_min,
         round(median(score), 8) null_median, round(max(score), 8) null_max from dr, st group by study""")
def null_percentile(t):
    tr = t.candles_daily.groupBy("sym").agg((F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("tr"))
    pf = X.null_portfolios(t.candles_daily.select("sym").distinct(), 5, 20)
    draws = pf.join(tr, "sym").groupBy("seed").agg(F.avg("tr").alias("score"))
    x = X.null_percentile(draws, tr.agg(F.avg("tr").alias("score")))
    return x.select(*[F.round(c, 8).alias(c) for c in x.columns])


@query("decision_log", V, f"""{COMP}, r as (select *, row_number() over (partition by gi order by score desc, sym) rk from sc),
  ch as (select gi, sym, 1e2/count(*) over (partition by gi) wp from r where rk <= {K})
  select r.gi, r.sym, rk, round(score, 4) + 0e0 score, round(vol, 6) vol, ch.sym is not null chosen, round(coalesce(wp, 0e0), 4) weight_pct,
         round(z_m126, 4) + 0e0 z_m126, round(z_z50, 4) + 0e0 z_z50 from r left join ch on r.gi = ch.gi and r.sym = ch.sym""")
def decision_log(t):
    sc, _ = X.factor_composite(candidates(t), FW)
    chosen = X.top_k(sc, K).withColumn("w", X.w_equal())
    x = X.decision_log(sc, chosen)
    return x.select("gi", "sym", "rk", rr("score", 4).alias("score"), F.round("vol", 6).alias("vol"), "chosen", F.round("weight_pct", 4).alias("weight_pct"),
                    rr("z_m126", 4).alias("z_m126"), rr("z_z50", 4).alias("z_z50"))
