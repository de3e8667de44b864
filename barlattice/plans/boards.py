"""Leaderboard and walk-forward queries."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions.indicators import with_indicators
from barlattice.functions.signals import STRATEGIES
from barlattice.operators import ranking as G
from barlattice.operators.metrics import curve_metrics
from barlattice.operators.returns import cost_model, equity_curve, weight_returns
from barlattice.plans.align import TR_COLS, TR_SQL
from barlattice.plans.indicators import STAGE, W, rsi, vol
from barlattice.plans.metrics import ROWS
from barlattice.plans.metrics import SQL as MSQL
from barlattice.plans.registry import query, rr
from barlattice.plans.signals import _last_state

DEL = cost_model("delivery")
BUY, SELL = repr(DEL["buy"]) + "e0", repr(DEL["sell"]) + "e0"

BOARD = f"""{ROWS}, mt as (select spec_id, round({MSQL['sharpe']}, 2) + 0e0 sharpe, round({MSQL['max_drawdown_pct']}, 2) + 0e0 max_drawdown_pct,
                 round(arg_max(eq, d), 2) final_equity from r group by spec_id),
  {TR_SQL}, tr as (select spec_id, {TR_COLS} from x group by spec_id)"""


def board(t):
    c = t.pin("curves")
    pos = c.groupBy("spec_id").agg(F.max_by("eq", "d").alias("e")).select("spec_id", F.when(F.col("e") > 1e7, "long").alias("position"))
    return G.leaderboard(c, pos)


@query("leaderboard", "curves", f"""{BOARD} select mt.*, tr.* exclude (spec_id), case when final_equity > 1e7 then 'long' else 'flat' end as "position",
  row_number() over (order by r1d desc nulls last, rmax desc nulls last, spec_id) rk from mt join tr using (spec_id)""")
def leaderboard(t):
    return board(t)


@query("sort_nulls_last", "curves", f"""{BOARD}, b as (select mt.spec_id, case when hash_ok then null else r5y end v from mt join
   (select *, cast(substr(spec_id, 7) as int) % 4 = 0 hash_ok from tr) t2 on mt.spec_id = t2.spec_id)
   select spec_id, v, row_number() over (order by v desc nulls last, spec_id) rk from b""")
def sort_nulls_last(t):
    b = board(t).select("spec_id", F.when(F.substring("spec_id", 7, 9).cast("int") % 4 != 0, F.col("r5y")).alias("v"))
    return G.sort_nulls_last(b, "v")


XS = f"""xs0 as (select spec_id, d, eq, eq/lag(eq) over (partition by spec_id order by d) - 1 - 6.5e-2/2.52e2 x from curves),
  xs as (select *, case when count(x) over u >= 20 then case when stddev_samp(x) over u > 0 then avg(x) over u/stddev_samp(x) over u*sqrt(2.52e2) else 0e0 end end xs
         from xs0 window u as (partition by spec_id order by d rows between unbounded preceding and current row))"""


@query("expanding_sharpe", "curves", f"{XS} select spec_id, d, round(xs, 6) + 0e0 xs from xs")
def expanding_sharpe(t):
    return G.expanding_sharpe(t.curves).select("spec_id", "d", rr("xs").alias("xs"))


CHAMP = """sl as (select d, row_number() over (order by d) - 1 i from market_daily),
  cg as (select s.spec_id, sl.i, sl.d, last_value(c.eq ignore nulls) over (partition by s.spec_id order by sl.i) a
         from (select distinct spec_id from curves) s cross join sl left join curves c on c.spec_id = s.spec_id and c.d = sl.d),
  ca as (select *, min(i) over (partition by spec_id) fi, a/lag(a) over (partition by spec_id order by i) rel,
                a/lag(a) over (partition by spec_id order by i) - 1 - 6.5e-2/2.52e2 x from cg where a is not null),
  cs as (select *, case when count(x) over u >= 20 then avg(x) over u/stddev_samp(x) over u*sqrt(2.52e2) end xs from ca
         window u as (partition by spec_id order by i rows between unbounded preceding and current row)),
  ok as (select * from cs where i - fi >= 252 and xs is not null), s0 as (select min(i) s from ok),
  best as (select i, arg_min(spec_id, (-xs, spec_id)) pick from ok, s0 where (i - s) % 63 = 0 group by i),
  tl as (select sl.i, sl.d, best.pick from sl join s0 on sl.i >= s left join best on best.i = sl.i),
  fo as (select *, last_value(pick ignore nulls) over (order by i rows between unbounded preceding and 1 preceding) followed from tl),
  tr0 as (select fo.*, cs.rel from fo left join cs on cs.i = fo.i and cs.spec_id = fo.followed),
  champ as (select i gi, d, pick, followed, exp(sum(ln(coalesce(rel, 1e0))) over (order by i rows between unbounded preceding and current row)) eq from tr0)"""


@query("champion_walk_forward", "curves market_daily", f"{CHAMP} select gi, d, pick, followed, round(eq, 7) eq from champ")
def champion(t):
    return G.champion_walk_forward(t.curves, t.market_daily).withColumn("eq", F.round("eq", 7))


@query("follow_timeline", "curves market_daily", f"""{CHAMP}, pk as (select d, pick, lag(pick) over (order by d) p from champ where pick is not null)
  select d, pick, (select count(distinct pick) from champ) followed_count, (select count(pick) from champ) switches from pk where p is null or p <> pick""")
def follow_timeline(t):
    return G.follow_timeline(G.champion_walk_forward(t.curves, t.market_daily))


@query("benchmark_rebased", "curves market_daily", """c as (select spec_id, min(d) t0, max(d) t1, min_by(eq, d) e0, max_by(eq, d) e1 from curves group by spec_id),
  x as (select c.*, b0.c b0, b1.c b1 from c asof join market_daily b0 on c.t0 >= b0.d asof join market_daily b1 on c.t1 >= b1.d)
  select spec_id, round((e1/e0 - 1)*1e2, 4) + 0e0 return_pct, round((b1/b0 - 1)*1e2, 4) + 0e0 bench_pct,
         case when date_diff('day', t0, t1) >= 365 then round((e1/e0 - 1)*1e2 - (b1/b0 - 1)*1e2, 4) + 0e0 end edge_pct from x""")
def benchmark_rebased(t):
    x = G.benchmark_rebased(t.curves, t.market_daily)
    return x.select("spec_id", *[rr(c, 4).alias(c) for c in ("return_pct", "bench_pct", "edge_pct")])


@query("benchmark_series", "curves market_daily", """x as (select c.*, b.c p from curves c asof left join (select * from market_daily where day(d) % 5 <> 0) b on c.d >= b.d),
  f as (select spec_id, min_by(eq, d) e0, first(p order by d) p0 from x group by spec_id)
  select spec_id, d, eq, round(coalesce(e0*p/p0, e0), 6) + 0e0 bench_eq from x join f using (spec_id)""")
def benchmark_series(t):
    """The benchmark lacks every fifth day of the month: gaps are carried."""
    x = G.benchmark_series(t.curves, t.market_daily.filter(F.dayofmonth("d") % 5 != 0))
    return x.select("spec_id", "d", "eq", rr("bench_eq", 6).alias("bench_eq"))


@query("common_window", "curves market_daily", """o as (select * from market_daily where d >= date '1996-06-01'), x as (select c.*, b.c p from curves c asof join o b on c.d >= b.d where eq > 0),
  g as (select spec_id, min(d) started, max(d) t1, min_by(eq, d) e0, max_by(eq, d) e1, min_by(p, d) p0, max_by(p, d) p1 from x group by spec_id)
  select spec_id, started, round((e1/e0 - 1)*1e2, 2) + 0e0 return_pct, round((p1/p0 - 1)*1e2, 2) + 0e0 other_pct, round(round((e1/e0 - 1)*1e2, 2) - round((p1/p0 - 1)*1e2, 2), 2) + 0e0 edge_pct
  from g where date_diff('day', started, t1) >= 365""")
def common_window(t):
    """A second benchmark that starts years after the curves."""
    x = G.common_window(t.curves, t.market_daily.filter("d >= date '1996-06-01'"))
    return x.select("spec_id", "started", *[(F.col(c) + F.lit(0e0)).alias(c) for c in ("return_pct", "other_pct", "edge_pct")])


@query("track_live_split", "fills", "select acct, ikey, d, ok, ln, pk, qty, side, price, d > date '1999-06-30' live from fills")
def track_live_split(t):
    return G.track_live_split(t.fills, "1999-06-30")


SP = """f as (select spec_id, kind, archetype, score*1e3 + bars raw from specs)"""


@query("fitness_rank", "specs", f"{SP} select spec_id, round(raw, 4) raw, row_number() over (order by raw desc, spec_id) rk from f")
def fitness_rank(t):
    x = t.specs.select("spec_id", G.fitness(F.col("score"), F.col("bars")).alias("raw"))
    return G.ordered(x, [F.desc("raw"), F.asc("spec_id")]).withColumn("raw", F.round("raw", 4))


@query("shared_fitness", "specs", f"""{SP}, b as (select *, rank() over (partition by archetype order by raw desc) - 1 better from f),
  s as (select *, raw/(1 + 5e-1*better) shared from b)
  select spec_id, kind, archetype, round(raw, 4) raw, better, round(shared, 4) shared, row_number() over (order by shared desc, spec_id) rk from s""")
def shared_fitness(t):
    x = t.specs.select("spec_id", "kind", "archetype", G.fitness(F.col("score"), F.col("bars")).alias("raw"))
    y = G.shared_fitness(x)
    return y.withColumn("raw", F.round("raw", 4)).withColumn("shared", F.round("shared", 4))


@query("dedupe_specs", "", """s as (select p_partkey spec_id, p_size % 4 k, case when p_size % 3 = 0 then null else 'm' || (p_size % 2) end rank_op,
    list_transform(range(0, 3), lambda i: 'B' || ((p_size + i) % 6)) uni from part)
  select min(spec_id) spec_id, k, rank_op from s group by k, rank_op, list_sort(uni)""")
def dedupe_specs(t):
    uni = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("B"), ((F.col("p_size") + F.when(F.col("p_partkey") % 2 == 0, i).otherwise(2 - i)) % 6).cast("string")))
    s = t.part.select(F.col("p_partkey").alias("spec_id"), (F.col("p_size") % 4).alias("k"),
                      F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("m"), (F.col("p_size") % 2).cast("string"))).alias("rank_op"), uni.alias("universe"))
    return G.dedupe_specs(s, ["universe"], ["k", "rank_op"]).select("spec_id", "k", "rank_op")


# ---- sweeps -------------------------------------------------------------------------------------------------------------

STRATS_SQL = f"""{STAGE}, ix as (select sym, d, c, ret, chg, row_number() over ({W}) rn, {rsi(14)} rs, {vol(20)} vo,
     case when count(c) over a50 = 50 then avg(c) over a50 end f, case when count(c) over a200 = 200 then avg(c) over a200 end s,
     max(c) over ({W} rows between 20 preceding and 1 preceding) h, min(c) over ({W} rows between 20 preceding and 1 preceding) l,
     lag(c,1) over ({W}) p1, lag(c,2) over ({W}) p2, lag(c,3) over ({W}) p3 from stage
     window a50 as ({W} rows between 49 preceding and current row), a200 as ({W} rows between 199 preceding and current row)),
  wide as (select sym, d, c, 1e0 buy_hold, case when f > s then 1e0 else 0e0 end sma_cross,
     case when rs is null then 0e0 else cast({_last_state('rs < 35', 'rs > 65')} as double) end rsi_reversion,
     cast({_last_state('rn > 20 and c >= h', 'rn > 20 and c <= l')} as double) donchian,
     case when vo > 0 then least(1e0, 1e-2/vo) else 0e0 end vol_target,
     cast({_last_state('c > p1 and p1 > p2 and p2 > p3', 'c < p1')} as double) three_up,
     case when (((rn + 7) * 7919 + 7) % 1009) % 2 = 0 then 1e0 else 0e0 end coin_flip from ix),
  tall as (unpivot wide on buy_hold, sma_cross, rsi_reversion, donchian, vol_target, three_up, coin_flip into name strategy value w),
  h0 as (select *, coalesce(c/lag(c) over z - 1, 0e0) rt, coalesce(lag(w,2) over z, 0e0) held, coalesce(lag(w,1) over z, 0e0) nw from tall
         window z as (partition by strategy, sym order by d)),
  h1 as (select *, held*rt - case when nw > held then (nw - held)*{BUY} else (held - nw)*{SELL} end r from h0),
  h2 as (select strategy, sym, d, exp(sum(ln(1 + r)) over (partition by strategy, sym order by d rows between unbounded preceding and current row)) eq from h1),
  h3 as (select *, eq/lag(eq) over (partition by strategy, sym order by d) - 1 q, max(eq) over (partition by strategy, sym order by d rows between unbounded preceding and current row) pk from h2),
  sweep as (select strategy, sym, round((arg_max(eq, d)/arg_min(eq, d) - 1)*1e2, 3) + 0e0 total_return_pct,
     round(case when count(q) < 2 or stddev_samp(q) = 0 then 0e0 else (avg(q) - 6.5e-2/2.52e2)/stddev_samp(q)*sqrt(2.52e2) end, 3) + 0e0 sharpe,
     round(max((pk - eq)/pk)*1e2, 3) + 0e0 max_drawdown_pct from h3 group by strategy, sym)"""


def sweep(t):
    """Every strategy on every symbol: one pass adds all weight columns, then they are stacked."""
    x = t.candles_daily.select("sym", "d", "c")
    for name, fn in STRATEGIES.items():
        x = fn(x).withColumnRenamed("w", f"w_{name}")
    tall = x.select("sym", "d", "c", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"w_{n}").alias("w")) for n in STRATEGIES])))
    curve = equity_curve(weight_returns(tall, DEL, key=("strategy", "sym")), by=("strategy", "sym"))
    return curve_metrics(curve, by=("strategy", "sym"), names=["total_return_pct", "sharpe", "max_drawdown_pct"], digits=3)


@query("symbol_strategy_sweep", "candles_daily", f"{STRATS_SQL} select * from sweep")
def symbol_strategy_sweep(t):
    return sweep(t)


@query("robust_rank", "candles_daily", f"""{STRATS_SQL}, m as (select strategy, median(total_return_pct) med_return, median(sharpe) med_sharpe, max(max_drawdown_pct) worst_dd from sweep group by strategy)
  select strategy, round(med_return, 3) + 0e0 med_return, round(med_sharpe, 3) + 0e0 med_sharpe, worst_dd,
    cast((select count(*) from m r where r.strategy in ('buy_hold', 'coin_flip') and m.med_return > r.med_return) as int) beats,
    row_number() over (order by med_return desc, strategy) rk from m""")
def robust_rank(t):
    x = G.robust_rank(sweep(t), ["buy_hold", "coin_flip"])
    return x.withColumn("med_return", rr("med_return", 3)).withColumn("med_sharpe", rr("med_sharpe", 3))


@query("study_verdict", "candles_daily", f"""{STRATS_SQL}, p as (select sym, max(case when strategy = 'sma_cross' then sharpe end) st,
     max(case when strategy = 'buy_hold' then sharpe end) ix, max(case when strategy in ('coin_flip', 'vol_target') then sharpe end) hard from sweep group by sym)
  select sym, round(st - ix, 4) + 0e0 edge_index, round(st - hard, 4) + 0e0 edge_universe,
     case when round(st - hard, 6) >= 1.5e-1 then 'beats-universe' when round(st - hard, 6) >= 0 then 'matches-universe' else 'trails-universe' end verdict from p""")
def study_verdict(t):
    s = F.col("strategy")
    p = sweep(t).groupBy("sym").agg(F.max(F.when(s == "sma_cross", F.col("sharpe"))).alias("st"), F.max(F.when(s == "buy_hold", F.col("sharpe"))).alias("ix"),
                                    F.max(F.when(s.isin("coin_flip", "vol_target"), F.col("sharpe"))).alias("hard"))
    return p.select("sym", rr(F.col("st") - F.col("ix"), 4).alias("edge_index"), rr(F.col("st") - F.col("hard"), 4).alias("edge_universe"),
                    G.study_verdict(F.round(F.col("st") - F.col("hard"), 6)).alias("verdict"))


FACTORS = (5e-1, 7.5e-1, 1.25e0, 1.5e0)
CELLS = [("base", 1e0, 20, 80)] + [("fast", f, max(2, round(20 * f)), 80) for f in FACTORS] + [("slow", f, 20, max(2, round(80 * f))) for f in FACTORS]


def _grid_sql():
    lens = sorted({n for _, _, a, b in CELLS for n in (a, b)})
    avg = ", ".join(f"case when count(c) over ({W} rows between {n-1} preceding and current row) = {n} then avg(c) over ({W} rows between {n-1} preceding and current row) end m{n}" for n in lens)
    cells = " union all ".join(f"select sym, d, c, '{p}' param, {f!r}e0 factor, case when m{a} > m{b} then 1e0 else 0e0 end w from ms" for p, f, a, b in CELLS)
    key = "partition by param, factor, sym order by d"
    return f"""ms as (select sym, d, c, {avg} from market_daily), bh as (select sym, d, c, 'bench' param, 0e0 factor, 1e0 w from market_daily),
  cl as ({cells} union all select * from bh),
  h0 as (select *, coalesce(c/lag(c) over ({key}) - 1, 0e0) rt, coalesce(lag(w,2) over ({key}), 0e0) held, coalesce(lag(w,1) over ({key}), 0e0) nw from cl),
  h1 as (select *, held*rt - case when nw > held then (nw - held)*{BUY} else (held - nw)*{SELL} end r from h0),
  h2 as (select param, factor, sym, d, exp(sum(ln(1 + r)) over ({key} rows between unbounded preceding and current row)) eq from h1),
  h3 as (select *, eq/lag(eq) over ({key}) - 1 q, max(eq) over ({key} rows between unbounded preceding and current row) pk from h2),
  gm as (select param, factor, round((avg(q) - 6.5e-2/2.52e2)/stddev_samp(q)*sqrt(2.52e2), 3) + 0e0 sharpe, round(max((pk - eq)/pk)*1e2, 3) + 0e0 max_drawdown_pct from h3 group by param, factor)
  select param, factor, sharpe, max_drawdown_pct, sharpe >= (select sharpe from gm where param = 'bench') holds from gm where param <> 'bench'"""


@query("perturbation_grid", "market_daily", _grid_sql())
def perturbation_grid(t):
    lens = sorted({n for _, _, a, b in CELLS for n in (a, b)})
    x = with_indicators(t.market_daily, {f"m{n}": ("sma", n) for n in lens})
    cells = [F.struct(F.lit(p).alias("param"), F.lit(f).alias("factor"), F.when(F.col(f"m{a}") > F.col(f"m{b}"), 1e0).otherwise(0e0).alias("w")) for p, f, a, b in CELLS]
    cells.append(F.struct(F.lit("bench").alias("param"), F.lit(0e0).alias("factor"), F.lit(1e0).alias("w")))
    tall = x.select("sym", "d", "c", F.inline(F.array(*cells)))
    by = ("param", "factor", "sym")
    m = curve_metrics(equity_curve(weight_returns(tall, DEL, key=by), by=by), by=("param", "factor", "sym"), names=["sharpe", "max_drawdown_pct"], digits=3)
    bench = F.max(F.when(F.col("param") == "bench", F.col("sharpe"))).over(Window.partitionBy("sym"))
    return m.withColumn("_b", bench).filter("param <> 'bench'").select("param", "factor", "sharpe", "max_drawdown_pct", (F.col("sharpe") >= F.col("_b")).alias("holds"))
