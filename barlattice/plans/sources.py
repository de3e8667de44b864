"""Source, sink and log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlattice.plans.registry import query, rr
from barlattice.session import shared_dir
from barlattice.sources import io

UP = "floor({}*1e2+5e-1)/1e2"


def chart_documents(ohlc):
    """One JSON document per (series, year), in the vendor's parallel-array shape."""
    g = ohlc.withColumn("y", F.year("d")).groupBy("sym", "y").agg(F.array_sort(F.collect_list(F.struct(
        F.unix_seconds(F.col("d").cast("timestamp")).alias("t"), "o", "h", "l", "c", "v", "a"))).alias("z"))
    quote = F.struct(*[F.col(f"z.{k}").alias(n) for k, n in
                       (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])
    return g.select(F.to_json(F.struct(
        F.col("sym").alias("symbol"), F.col("z.t").alias("timestamp"), F.struct(
            F.array(quote).alias("quote"), F.array(F.struct(F.col("z.a").alias("adjclose"))).alias("adjclose")).alias("indicators")),
        {"ignoreNullFields": "false"}).alias("value"))


@query("read_chart_json", "ohlc_daily", """select upper(sym) sym, epoch_ms(cast(d as timestamp)) t, floor(o*1e2+5e-1)/1e2 o, floor(h*1e2+5e-1)/1e2 h,
    floor(l*1e2+5e-1)/1e2 l, floor(c*1e2+5e-1)/1e2 c, v, case when day(d) <> 5 then floor((floor(c*9.5e-1*1e4+5e-1)/1e4)*1e4+5e-1)/1e4 end a
    from ohlc_daily where day(d) <> 13""")
def read_chart_json(t):
    src = t.ohlc_daily.withColumn("a", F.when(F.dayofmonth("d") != 5, io.half_up(F.col("c") * 9.5e-1, 4))) \
        .withColumn("c", F.when(F.dayofmonth("d") != 13, F.col("c")))
    return io.read_chart_json(t.spark, written(t, chart_documents(src)))


def written(t, docs):
    """The documents as JSON-lines files in the shared folder."""
    path = f"{shared_dir(t.spark)}/vendor-{uuid.uuid4().hex}"
    docs.select("value").write.text(path)
    return path


def chain_documents(chain):
    """One JSON document per block of quotes, both legs on every strike row; some fields are not numbers."""
    leg = F.struct(F.col("s").cast("string").alias("lastPrice"), (F.col("quote_id") * 3).cast("string").alias("openInterest"),
                   (F.col("quote_id") % 11 - 5).cast("string").alias("changeinOpenInterest"), F.lit("12").alias("totalTradedVolume"),
                   F.when(F.col("quote_id") % 7 == 0, "-").otherwise(F.col("vol").cast("string")).alias("impliedVolatility"),
                   F.lit(None).cast("string").alias("bidprice"), F.col("k").cast("string").alias("askPrice"))
    ce, pe = F.col("opt_type") == "CE", F.col("opt_type") == "PE"
    row = F.struct(F.col("quote_id").alias("n"), F.col("k").alias("strikePrice"),
                   F.concat(F.lit("2"), (F.col("quote_id") % 3).cast("string"), F.lit("-Jan-2026")).alias("expiryDate"),
                   F.when(ce, leg).alias("CE"), F.when(pe, leg).alias("PE"))
    g = chain.groupBy(F.floor(F.col("quote_id") / 200).alias("blk")).agg(F.array_sort(F.collect_list(row)).alias("data"))
    exp = F.when(F.col("blk") % 2 == 0, F.array(F.lit("20-Jan-2026"), F.lit("21-Jan-2026"))) \
        .otherwise(F.array(F.lit("22-Jan-2026"), F.lit("20-Jan-2026")))
    return g.select("blk", F.to_json(F.struct(F.concat(F.lit("S"), F.col("blk").cast("string")).alias("symbol"), F.struct(
        exp.alias("expiryDates"), F.lit(1e3).alias("underlyingValue"), "data").alias("records"))).alias("value"))


@query("read_option_chain_json", "chain", """q as (select *, quote_id // 200 blk, '2' || (quote_id % 3) || '-Jan-2026' e from chain),
  r as (select *, case when blk % 2 = 0 then '21-Jan-2026' else '22-Jan-2026' end want from q)
  select 'S' || blk symbol, e expiry, k strike, opt_type, max_by(s, quote_id) ltp, cast(max(quote_id)*3 as double) oi,
         cast(max(quote_id) % 11 - 5 as double) change_oi, 1.2e1 volume,
         max_by(case when quote_id % 7 = 0 then 0e0 else vol end, quote_id) iv, 0e0 bid, k ask, 1e3 underlying
  from r where e = want group by blk, e, k, opt_type""")
def read_option_chain_json(t):
    return io.read_option_chain_json(t.spark, written(t, chain_documents(t.chain)), "21-Jan-2026")


@query("quote_snapshot", "ticks", """dd as (select sym, cast(ts as date) d, max_by(price, (ts, event_id)) p from ticks group by 1, 2),
  r as (select *, row_number() over (partition by sym order by d desc) k from dd),
  q as (select sym, max(case when k = 1 then p end) ltp, max(case when k = 2 then p end) prev_close from r group by sym)
  select sym, ltp, prev_close, round(ltp - prev_close, 4) + 0e0 change, round((ltp - prev_close)/prev_close*1e2, 6) + 0e0 change_pct from q""")
def quote_snapshot(t):
    return io.quote_snapshot(t.ticks).select("sym", "ltp", "prev_close", rr("change", 4).alias("change"), rr("change_pct").alias("change_pct"))


@query("write_read_candles", "candles_daily", """select sym, d, case when sym = 'Brand#1' then c + 1e0 else c end c, v, '1d' as "interval"
   from candles_daily where sym in ('Brand#1', 'Brand#2', 'Brand#7')""")
def write_read_candles(t):
    """Store the panel, rewrite one symbol in place, read three symbols back (partition-pruned)."""
    path = f"{shared_dir(t.spark)}/candles-{uuid.uuid4().hex}"
    src = t.candles_daily.withColumn("interval", F.lit("1d"))
    io.write_candles(src, path)
    io.write_candles(src.filter("sym = 'Brand#1'").withColumn("c", F.col("c") + 1e0), path)
    return io.read_candles(t.spark, path, "1d", ["Brand#1", "Brand#2", "Brand#7"]).select("sym", "d", "c", "v", "interval")


@query("source_fallback", "candles_daily", """x as (select *, day(d) dom from candles_daily)
  select sym, d, case when dom % 3 = 0 then c when dom % 3 = 1 then c - 1e0 else 1e2 end c,
         case when dom % 3 = 0 then 'live' when dom % 3 = 1 then 'stale' else 'synthetic' end source,
         case when dom % 3 = 1 then greatest(date_diff('day', d, date '1998-01-01'), 0)*86400000 end stale_age_ms from x""")
def source_fallback(t):
    p = t.candles_daily.select("sym", "d", "c")
    dom = F.dayofmonth("d")
    return io.source_fallback(
        [("live", p.filter(dom % 3 == 0)), ("stale", p.filter(dom % 3 <= 1).withColumn("c", F.col("c") - 1e0)),
         ("synthetic", p.withColumn("c", F.lit(1e2)))], ["sym", "d"], F.lit("1998-01-01").cast("date"))


@query("merge_history_live", "candles_daily", """select sym, d, case when d >= date '1996-01-01' then c + 1e0 else c end c from candles_daily
  where sym <> 'Brand#9'""")
def merge_history_live(t):
    p = t.candles_daily.select("sym", "d", "c")
    back = p.filter("d < date '1997-01-01' and sym <> 'Brand#9'")
    live = p.filter("d >= date '1996-01-01'").withColumn("c", F.col("c") + 1e0)
    return io.merge_history_live(back, live)


@query("append_once_log", "advice", "select d, sym, rk, qty from advice where d > coalesce((select max(d) from advice where d < date '1996-01-01'), date '1900-01-01')")
def append_once_log(t):
    a = t.advice
    return io.append_once_log(a.filter("d < date '1996-01-01'"), a).select("d", "sym", "rk", "qty")


def log_entries(t):
    """The suggestion log as nested entries, some of them malformed or out of order."""
    g = t.advice.groupBy("d", "eligible", "equity").agg(F.array_sort(F.collect_list(F.struct(
        F.col("sym").alias("symbol"), F.when((F.month("d") != 5) | (F.col("rk") != 3), F.col("qty")).alias("qty"), "price", "weight"))).alias("targets"))
    m = F.month("d")
    date = F.when(m == 3, F.date_format("d", "yyyy/MM/dd")).when(m == 8, F.date_format(F.add_months("d", -2), "yyyy-MM-dd")) \
        .otherwise(F.date_format("d", "yyyy-MM-dd"))
    return g.select(F.lit("bot").alias("bot"), F.datediff("d", F.lit("1970-01-01")).cast("bigint").alias("pos"), date.alias("date"),
                    F.datediff("d", F.lit("1970-01-01")).cast("bigint").alias("t"), F.when(m != 10, F.col("eligible")).alias("eligible"),
                    F.when(m == 4, -F.col("equity")).otherwise(F.col("equity")).alias("equity"), "targets")


@query("sanitize_log", "advice", r"""g as (select d, eligible, equity, count(*) legs, bool_or(month(d) = 5 and rk = 3) badleg from advice group by d, eligible, equity),
  e as (select d, case when month(d) = 8 then strftime(d - interval 2 month, '%Y-%m-%d') else strftime(d, '%Y-%m-%d') end as "date", legs
        from g where month(d) not in (3, 4, 10) and not badleg),
  s as (select *, max("date") over (order by d rows between unbounded preceding and 1 preceding) seen from e)
  select "date", date_diff('day', date '1970-01-01', d) t, legs from s where seen is null or "date" > seen""")
def sanitize_log(t):
    return io.sanitize_log(log_entries(t)).select("date", "t", F.size("targets").cast("bigint").alias("legs"))


def snapshots(orders):
    k, z = F.col("o_orderkey"), F.lit(None).cast("double")
    inst = F.struct(F.when(k % 5 == 0, "XX").when(k % 3 == 0, "OPT").when(k % 3 == 1, "EQ").otherwise("FUT").alias("kind"),
                    F.lit("ABC").alias("symbol"), F.when(k % 4 == 0, "").otherwise("25-Jan-2026").alias("expiry"),
                    F.when(k % 9 == 0, -1e0).otherwise(1e2).alias("strike"), F.lit("CE").alias("optType"), F.when(k % 8 == 0, -2e0).alias("lotSize"))
    pos = F.create_map(F.lit("P1"), F.struct(F.when(k % 6 != 0, 1e1).alias("qty"), F.lit(5e0).alias("avgPrice"), inst.alias("instrument")))
    order = F.struct(F.when(k % 2 == 0, "PENDING").otherwise("FILLED").alias("status"), F.when(k % 10 == 0, "HOLD").otherwise("BUY").alias("side"),
                     F.when(k % 14 == 0, 0e0).otherwise(5e0).alias("qty"), F.when(k % 22 == 0, -1e0).otherwise(F.col("o_totalprice")).alias("limitPrice"),
                     F.when(k % 26 == 0, 0e0).otherwise(1e0).alias("lots"), inst.alias("instrument"))
    doc = F.struct(F.when(k % 7 != 0, F.col("o_totalprice")).alias("cash"), F.lit(1e6).alias("initialCash"), F.lit(0e0).alias("realised"),
                   F.create_map(F.lit("A"), F.when(k % 11 == 0, 0e0).otherwise(1e0)).alias("lastPrices"),
                   F.array(F.struct(F.lit(1e0).alias("t"), F.when(k % 13 != 0, 2e0).alias("c"))).alias("equityCurve"),
                   F.struct(F.lit(1.2e1).alias("futuresMarginPct"), F.when(k % 17 != 0, 1e1).alias("shortOptionSpanPct"),
                            F.lit(6.5e-2).alias("riskFreeRate")).alias("settings"), pos.alias("positions"), F.array(order).alias("orders"))
    return orders.select(k.alias("id"), F.to_json(doc).alias("doc"))


_RULES = [
    ("k % 7 = 0", "cash_fields", "'cash holds no usable number'"),
    ("k % 17 = 0", "settings", "'settings.shortOptionSpanPct holds no usable number'"),
    ("k % 11 = 0", "last_price", "'price A'"), ("k % 13 = 0", "equity_curve", "'curve entry'"),
    ("k % 6 = 0", "position_numbers", "'position P1'"), ("k % 5 = 0", "position_instrument", "'position P1'"),
    ("k % 5 <> 0 and k % 3 <> 1 and k % 4 = 0", "position_expiry", "'position P1'"),
    ("k % 5 <> 0 and k % 3 = 0 and k % 9 = 0", "position_option", "'position P1'"),
]
_OR = [("k % 5 = 0", "order_instrument"), ("k % 5 <> 0 and k % 3 <> 1 and k % 4 = 0", "order_expiry"),
       ("k % 5 <> 0 and k % 3 = 0 and k % 9 = 0", "order_option"), ("k % 8 = 0", "order_lot_size"), ("k % 14 = 0", "order_qty"),
       ("k % 22 = 0", "order_limit"), ("k % 10 = 0", "order_side"), ("k % 26 = 0", "order_lots")]
_RULES += [(f"k % 2 = 0 and {c}", r, "'pending order ' || case when k % 10 = 0 then 'HOLD' else 'BUY' end") for c, r in _OR]


@query("snapshot_validate", "", "o as (select o_orderkey k from orders) " + " union all ".join(
    f"select k id, '{r}' rule, {m} message from o where {c}" for c, r, m in _RULES))
def snapshot_validate(t):
    return io.snapshot_validate(snapshots(t.orders))


def spec_table(t):
    n = F.substring("spec_id", 7, 9).cast("int")
    uni = F.transform(F.sequence(F.lit(0), n % 4 + 1), lambda i: F.concat(F.lit("Brand#"), ((n + i * 3) % 25 + 1).cast("string")))
    return t.specs.withColumn("n", n).select(
        "spec_id", F.when(n % 3 == 0, "EQ").when(n % 3 == 1, "BASKET").otherwise("PAIRS").alias("kind"), F.col("spec_id").alias("symbol"),
        F.when(n % 5 == 0, "60m").alias("interval"), F.when(n % 3 != 0, uni).alias("universe"), "archetype", "score")


@query("symbol_sources", "specs", """s as (select spec_id, cast(substr(spec_id, 7) as int) n from specs),
  u as (select case when n % 3 <> 0 then list_transform(range(0, n % 4 + 2), lambda i: 'Brand#' || ((n + i*3) % 25 + 1)) else [spec_id] end l,
               case when n % 5 = 0 then '60m' else '1d' end iv from s)
  select distinct symbol, "interval" from (select unnest(l) symbol, iv as "interval" from u union all select 'MKT', '1d')""")
def symbol_sources(t):
    return io.symbol_sources(spec_table(t))


@query("data_fingerprint", "candles_daily", """select sym, min(d) first_ts, max(d) last_ts, count(*) n, min_by(c, d) first_c, max_by(c, d) last_c
  from candles_daily group by sym""")
def data_fingerprint(t):
    return io.data_fingerprint(t.candles_daily)
