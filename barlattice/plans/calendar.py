"""Calendar and symbol-string queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions import calendar as K
from barlattice.plans.registry import query, rr

TEST_HOLIDAYS = ("2024-01-10", "2024-01-26")

STATE = """lt as (select event_id, ts + interval 330 minute l from ticks),
  mm as (select event_id, dayofweek(l) wd, strftime(l, '%Y-%m-%d') ds, hour(l)*60 + minute(l) m from lt),
  st as (select event_id, case when wd in (0, 6) then 'Weekend' when ds in ('2024-01-10', '2024-01-26') then 'Exchange holiday'
         when m >= 540 and m < 555 then 'Pre-open session' when m >= 555 and m < 930 then 'Regular session' else 'Outside trading hours' end reason from mm)"""


@query("market_state", "ticks", f"""{STATE} select event_id, case reason when 'Pre-open session' then 'PREOPEN' when 'Regular session' then 'REGULAR'
   else 'CLOSED' end state, reason = 'Regular session' is_open, reason from st""")
def market_state(t):
    return t.ticks.select("event_id", K.market_state(F.col("ts"), TEST_HOLIDAYS).alias("m")).select("event_id", "m.*")


@query("ist_date", "ticks", "select event_id, cast(ts + interval 330 minute as date) d from ticks")
def ist_date(t):
    return t.ticks.select("event_id", K.ist_date(F.col("ts")).alias("d"))


RAW = ("case p_partkey % 7 when 0 then 'nifty' when 1 then 'BANKNIFTY' when 2 then 'p{}.ns' when 3 then 'p{}.bo' when 4 then 'p{}.bse' "
       "when 5 then '^p{}' else 'p{}' end")
RAW_DUCK = "case p_partkey % 7 " + " ".join(
    f"when {i} then {e}" for i, e in enumerate(["'nifty'", "'BANKNIFTY'", "'p' || p_partkey || '.ns'", "'p' || p_partkey || '.bo'",
                                                "'p' || p_partkey || '.bse'", "'^p' || p_partkey"])) + " else 'p' || p_partkey end"


@query("vendor_symbol", "", f"""r as (select p_partkey id, upper({RAW_DUCK}) s from part)
  select id, case s when 'NIFTY' then '^NSEI' when 'BANKNIFTY' then '^NSEBANK' else
    case when s like '%.NS' or s like '%.BO' or s like '^%' then s when s like '%.BSE' then replace(s, '.BSE', '.BO') else s || '.NS' end end vendor from r""")
def vendor_symbol(t):
    return t.part.select(F.col("p_partkey").alias("id"), K.vendor_symbol(F.expr(RAW_DUCK)).alias("vendor"))


@query("parse_data_key", "", """select o_orderkey id, case when o_orderkey % 3 = 0 then '60m' when o_orderkey % 3 = 1 then '15m' else '1d' end as "interval",
   'C' || o_custkey symbol from orders""")
def parse_data_key(t):
    k = F.expr("case when o_orderkey % 3 = 0 then '60m:C' || o_custkey when o_orderkey % 3 = 1 then '15m:C' || o_custkey else 'C' || o_custkey end")
    return t.orders.select(F.col("o_orderkey").alias("id"), K.parse_data_key(k).alias("p")).select("id", "p.*")


@query("interval_ms", "", """select p_partkey id, case p_partkey % 4 when 0 then p_size*60000 when 1 then p_size*3600000 else 3600000 end ms from part""")
def interval_ms(t):
    iv = F.expr("case p_partkey % 4 when 0 then p_size || 'm' when 1 then p_size || 'h' when 2 then '1d' else null end")
    return t.part.select(F.col("p_partkey").alias("id"), K.interval_ms(iv).alias("ms"))


@query("archetype", "", """p as (select p_partkey id, p_partkey % 6 a, p_size % 10 b, p_partkey % 3 m from part)
  select id, case a when 0 then 'fno' when 1 then 'pairs' when 2 then case when m = 0 then 'benchmark' else 'eq' end
    when 3 then 'ml-' || case when m = 0 then 'ridge' else 'gbm' end when 4 then case when m = 0 then 'factor' else
      case when b in (0, 1, 2) then 'momentum' when b in (3, 4, 5) then 'lowvol' when b in (6, 7) then 'breakout' else 'meanrev' end end
    else 'basket' end archetype from p""")
def archetype(t):
    x = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("a"), (F.col("p_size") % 10).alias("b"), (F.col("p_partkey") % 3).alias("m"))
    ops = ["mom", "macd", "slope", "vol", "volratio", "*", "distHigh", "high", "rsi", "zscore"]
    op = F.when(F.col("a") == 4, F.element_at(F.array(*[F.lit(o) for o in ops]), F.col("b") + 1)).otherwise("sma")
    kind = F.when(F.col("a") == 0, "FNO").when(F.col("a") == 1, "PAIRS").when(F.col("a") == 2, "EQ").otherwise("BASKET")
    return x.select("id", K.archetype(kind, F.col("m") != 0, F.lit(True), F.when(F.col("a") == 3, F.when(F.col("m") == 0, "ridge").otherwise("gbm")),
                                      (F.col("a") == 4) & (F.col("m") == 0), op).alias("archetype"))


@query("expiry_ladder", "candles_daily", """u as (select distinct d from candles_daily), k as (select unnest(range(0, 3)) k)
  select d, k, strftime(date_trunc('month', d) + to_months(cast(k + case when day(d) >= 25 then 1 else 0 end as int)) + interval 24 day, '%d-%b-%Y') expiry from u, k""")
def expiry_ladder(t):
    return K.expiry_ladder(t.candles_daily.select("d").distinct())


@query("years_to_expiry", "candles_daily", """u as (select distinct d from candles_daily)
  select d, round(greatest((epoch_ms(cast(date_trunc('month', d) + interval 24 day as timestamp)) + 36000000 - epoch_ms(cast(d as timestamp)))/3.1536e10, 5e-1/3.65e2), 9) y from u""")
def years_to_expiry(t):
    d = t.candles_daily.select("d").distinct()
    label = F.date_format(F.date_add(F.trunc("d", "month"), 24), "dd-MMM-yyyy")
    return d.select("d", rr(K.years_to_expiry(label, F.col("d").cast("timestamp")), 9).alias("y"))
