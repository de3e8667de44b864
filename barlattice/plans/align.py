"""Alignment, as-of and thinning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import align as A
from barlattice.plans.registry import query, rr

W = "partition by sym order by d"
WS = "partition by spec_id order by d"

GRID = """mst as (select d, row_number() over (order by d) - 1 gi from (select d from candles_daily union select d from market_daily) u),
  cells as (select s.sym, m.gi, m.d, p.c from (select distinct sym from candles_daily) s cross join mst m
            left join candles_daily p on p.sym = s.sym and p.d = m.d),
  grid as (select gi, d, sym, last_value(c ignore nulls) over (partition by sym order by gi) px,
                  count(c) over (partition by sym order by gi) - 1 real_idx from cells)"""


@query("align_grid", "candles_daily market_daily", f"{GRID} select gi, d, sym, px, real_idx from grid")
def align_grid(t):
    return A.align_grid(t.candles_daily, t.market_daily)


MONTH_ENDS = """k as (select sym, last_day(m) d from (select distinct sym, cast(date_trunc('month', d) as date) m from candles_daily) q)"""


@query("asof_close", "candles_daily", f"""{MONTH_ENDS}
  select k.sym, k.d, p.c from k asof left join candles_daily p on k.sym = p.sym and k.d >= p.d""")
def asof_close(t):
    keys = t.candles_daily.select("sym", F.last_day("d").alias("d")).distinct()
    return A.asof_close(keys, t.candles_daily).select("sym", "d", "c")


@query("asof_order_ticks", "limit_orders ticks", """x as (select acct, ts, max_by(price, event_id) price from ticks group by acct, ts)
  select o.order_id, x.price seen from limit_orders o asof left join x on o.acct = x.acct and o.ts >= x.ts""")
def asof_order_ticks(t):
    """Latest tick of the account when each order is placed; an account of any size is cut into ranges."""
    x = A.asof(t.limit_orders, t.ticks, by=["acct"], ts="ts", values=["price"], split=True, tie=["event_id"])
    return x.select("order_id", F.col("price").alias("seen"))


@query("slice_window", "candles_daily", f"""x as (select sym, d, c, row_number() over ({W}) i from candles_daily where d <= date '1996-12-31'),
  f as (select *, min(case when d >= date '1995-06-01' then i end) over (partition by sym) f from x)
  select sym, d, c, i >= f is_scored from f where i >= f - 60""")
def slice_window(t):
    return A.slice_window(t.candles_daily, "1995-06-01", "1996-12-31", 60).select("sym", "d", "c", "is_scored")


@query("clip_panel", "candles_daily", """select sym, d, c, d >= date '1995-06-01' is_scored from candles_daily
  where d between date '1995-01-01' and date '1996-12-31'""")
def clip_panel(t):
    return A.clip_panel(t.candles_daily, "1995-01-01", "1995-06-01", "1996-12-31").select("sym", "d", "c", "is_scored")


@query("holdout_guard", "candles_daily", """select max(d) last_ts, date '1996-12-31' cutoff, max(d) > date '1996-12-31' locked from candles_daily""")
def holdout_guard(t):
    return A.holdout_guard(t.candles_daily, "1996-12-31")


def _tr(days):
    return (f"case when max(age) >= {days} then round((max_by(eq, d)/max_by(case when age >= {days} then eq end, "
            f"case when age >= {days} then d end) - 1)*1e2, 2) + 0e0 end")


TR_SQL = f"""x as (select spec_id, d, eq, date_diff('day', d, max(d) over (partition by spec_id)) age, lag(eq) over ({WS}) pe from curves)"""
TR_COLS = ("round((max_by(eq, d)/max_by(pe, d) - 1)*1e2, 2) + 0e0 r1d, "
           + ", ".join(f"{_tr(repr(v))} {n}" for n, v in A.TRAILING.items())
           + ", round((max_by(eq, d)/min_by(eq, d) - 1)*1e2, 2) + 0e0 rmax")


@query("trailing_returns", "curves", f"{TR_SQL} select spec_id, {TR_COLS} from x group by spec_id")
def trailing_returns(t):
    return A.trailing_returns(t.curves)


DS = """pts as (select unnest(range(0, 120)) k)"""


@query("downsample", "curves", f"""{DS}, x as (select *, row_number() over ({WS}) - 1 i, count(*) over (partition by spec_id) n from curves),
  k as (select distinct spec_id, cast(floor(k*((n - 1)/1.19e2) + 5e-1) as bigint) i from x, pts where n > 120 and i < 120 and k < 120)
  select spec_id, d, eq from x where n <= 120 union all select x.spec_id, d, eq from x join k using (spec_id, i)""")
def downsample(t):
    return A.downsample(t.curves, 120).select("spec_id", "d", "eq")


TIERS = f"""{DS}, tl as (select unnest([3.1e1, 3.66e2, 1.83e3, 1e9]) tier_days),
  x0 as (select spec_id, d, eq, row_number() over (partition by spec_id order by d desc) b,
                date_diff('day', d, max(d) over (partition by spec_id)) age from curves),
  x1 as (select spec_id, tier_days, d, eq from x0, tl where age <= tier_days or b <= 2),
  x as (select *, row_number() over (partition by spec_id, tier_days order by d) - 1 i,
               count(*) over (partition by spec_id, tier_days) n from x1),
  sz as (select distinct spec_id, tier_days, n from x where n > 120),
  kk as (select spec_id, tier_days, cast(floor(k*((n - 1)/1.19e2) + 5e-1) as bigint) i from sz, pts),
  tiers as (select spec_id, tier_days, d, floor(eq + 5e-1) eq from x where n <= 120
            union all select spec_id, tier_days, d, floor(eq + 5e-1) eq from x join kk using (spec_id, tier_days, i))"""


@query("curve_tiers", "curves", f"{TIERS} select * from tiers")
def curve_tiers(t):
    return A.curve_tiers(t.curves, 120)


@query("curve_window", "curves", f"""{TIERS}, wn(win, ms) as (values ('1W', 7e0), ('1M', 3.1e1), ('1Y', 3.66e2), ('5Y', 1.83e3), ('10Y', 3.66e3), ('MAX', null)),
  sp as (select spec_id, date_diff('day', min(d), max(d)) span from tiers group by spec_id),
  pl as (select spec_id, win, case when ms <= span*1.05e0 then ms end ms from sp, wn),
  pt as (select *, case when ms <= 3.1e1 then 3.1e1 when ms <= 3.66e2 then 3.66e2 when ms <= 1.83e3 then 1.83e3 else 1e9 end tier_days from pl),
  j as (select spec_id, win, ms, d, eq, row_number() over (partition by spec_id, win order by d desc) b,
               date_diff('day', d, max(d) over (partition by spec_id, win)) age from tiers join pt using (spec_id, tier_days))
  select spec_id, win, d, eq from j where ms is null or age <= ms or b <= 2""")
def curve_window(t):
    wins = {"1W": 7e0, "1M": 3.1e1, "1Y": 3.66e2, "5Y": 1.83e3, "10Y": 3.66e3, "MAX": None}
    return A.curve_window(A.curve_tiers(t.curves, 120), wins).select("spec_id", "win", "d", "eq")


@query("compact_curve", "curves", f"""x as (select *, row_number() over ({WS}) - 1 i, count(*) over (partition by spec_id) n from curves)
  select spec_id, d, eq from x where n <= 500 or i >= n // 2 or i % 2 = 0""")
def compact_curve(t):
    return A.compact_curve(t.curves, 500).select("spec_id", "d", "eq")


@query("throttle_resample", "ticks", """select acct, time_bucket(interval '30 seconds', ts) slot, max_by(price, (ts, event_id)) price
  from ticks group by 1, 2""")
def throttle(t):
    return A.throttle_resample(t.ticks)


@query("ticks_to_bars", "ticks", """select sym, time_bucket(interval '1 hour', ts) ts, min_by(price, (ts, event_id)) o, max(price) h, min(price) l,
  max_by(price, (ts, event_id)) c, count(*) v from ticks group by 1, 2""")
def bars(t):
    return A.ticks_to_bars(t.ticks)


@query("range_change", "candles_daily", """b as (select sym, min_by(c, d) b from candles_daily where d >= date '1996-01-01' group by sym),
  q as (select sym, max_by(c, d) ltp from candles_daily group by sym)
  select sym, round(ltp - b, 4) + 0e0 change, round((ltp - b)/b*1e2, 6) + 0e0 change_pct from q left join b using (sym)""")
def range_change(t):
    q = t.candles_daily.groupBy("sym").agg(F.max_by("c", "d").alias("ltp"))
    x = A.range_change(q, t.candles_daily.filter("d >= date '1996-01-01'"))
    return x.select("sym", rr("change", 4).alias("change"), rr("change_pct").alias("change_pct"))
