"""Ledger queries over fills, ticks and resting orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions.calendar import ist_date
from barlattice.operators import ledger as L
from barlattice.plans.registry import query, rr, tr, tr_sql
from barlattice.session import pin

FEE = 1.6e-3
FOLD = """fo as (select acct, ikey, list(struct_pack(d := d, ok := ok, ln := ln, pk := pk, side := side, s := case when side = 'BUY' then qty else -qty end, p := price)
       order by d, ok, ln, pk) l from fills group by acct, ikey),
  ff as (select acct, ikey, l, list_reduce(list_concat([struct_pack(q := 0::bigint, a := 0e0, r := 0e0, e := l[1], acc := cast([] as struct(inc double, avg double, cl boolean)[]))],
       list_transform(l, lambda e: struct_pack(q := 0::bigint, a := 0e0, r := 0e0, e := e, acc := cast([] as struct(inc double, avg double, cl boolean)[])))),
     lambda x, y: list_transform([struct_pack(
         inc := case when x.q <> 0 and sign(x.q) <> sign(y.e.s) then least(abs(y.e.s), abs(x.q))*sign(x.q)*(y.e.p - x.a) else 0e0 end,
         avg := case when x.q = 0 or sign(x.q)*sign(x.q + y.e.s) < 0 then y.e.p when sign(x.q) = sign(y.e.s) then (x.a*abs(x.q) + y.e.p*abs(y.e.s))/abs(x.q + y.e.s) else x.a end,
         cl := x.q <> 0 and sign(x.q) <> sign(y.e.s))],
       lambda z: struct_pack(q := x.q + y.e.s, a := z.avg, r := x.r + z.inc, e := y.e, acc := list_append(x.acc, z)))[1]) z from fo),
  pos as (select acct, ikey, z.q qty, case when z.q <> 0 then z.a else 0e0 end avg_price, z.r realised from ff),
  rf as (select acct, ikey, e, c.inc realised, c.avg avg_after, c.cl closing from (select acct, ikey, unnest(l) e, unnest(z.acc) c from ff) u)"""


@query("fold_fills", "fills", f"{FOLD} select acct, ikey, cast(qty as bigint) qty, {tr_sql('avg_price', 5)} avg_price, {tr_sql('realised', 2)} realised from pos")
def fold_fills(t):
    return L.fold_fills(t.fills).select("acct", "ikey", "qty", tr("avg_price", 5).alias("avg_price"), tr("realised", 2).alias("realised"))


@query("realised_by_fill", "fills", f"""{FOLD} select acct, ikey, e.d d, e.ok ok, e.ln ln, e.pk pk, e.side side, closing, {tr_sql('realised', 3)} realised, {tr_sql('avg_after', 6)} avg_after from rf""")
def realised_by_fill(t):
    return L.realised_by_fill(t.fills).select("acct", "ikey", "d", "ok", "ln", "pk", "side", "closing", tr("realised", 3).alias("realised"), tr("avg_after", 6).alias("avg_after"))


FLOW = f"""{FOLD}, fw as (select acct, ikey, e, case when ikey like 'FUT%' then realised when e.side = 'SELL' then e.p*abs(e.s) else -e.p*abs(e.s) end flow from rf)"""


@query("cash_balance", "fills", f"""{FLOW}, rn as (select acct, 1e6 + sum(flow) over (partition by acct order by e.d, ikey, e.ok, e.ln, e.pk rows between unbounded preceding and current row) cash, flow from fw)
  select acct, {tr_sql('min(cash)', 2)} min_cash, {tr_sql('max(cash)', 2)} max_cash, {tr_sql('1e6 + sum(flow)', 2)} final_cash, count(*) fills from rn group by acct""")
def cash_balance(t):
    sizes = L.key_sizes(t.fills, ["acct"])
    flows = L.cash_flow(L.realised_by_fill(t.fills, sizes=sizes)).select("acct", "d", "ikey", "ok", "ln", "pk", "flow")
    x = L.cash_balance(flows, sizes=sizes)
    return x.groupBy("acct").agg(tr(F.min("cash"), 2).alias("min_cash"), tr(F.max("cash"), 2).alias("max_cash"), tr(1e6 + F.sum("flow"), 2).alias("final_cash"), F.count("*").alias("fills"))


MTM = f"""{FLOW}, la as (select ikey, max_by(price, (d, ok, ln, pk, acct)) last from fills group by ikey),
  mm as (select pos.*, last, case when qty <> 0 then (last - avg_price)*qty else 0e0 end unrealised,
         case when qty = 0 then 0e0 when ikey like 'FUT%' then (last - avg_price)*qty else last*qty end val from pos join la using (ikey))"""


def marked(t):
    pos = pin(L.fold_fills(t.fills, last=True))
    return L.mark_to_market(pos, L.last_prices(pos))


@query("mark_to_market", "fills", f"{MTM} select acct, ikey, {tr_sql('unrealised', 2)} unrealised, {tr_sql('val', 2)} as \"value\" from mm")
def mark_to_market(t):
    return marked(t).select("acct", "ikey", tr("unrealised", 2).alias("unrealised"), tr("value", 2).alias("value"))


@query("margin_estimate", "fills", f"""{MTM} select acct, round(sum(case when qty = 0 then 0e0 when ikey like 'FUT%' then abs(qty)*last*1.2e-1
   when qty < 0 and ikey like 'OPT%' then abs(qty)*last + abs(qty)*(last*2e1)*1e-1 when qty < 0 then abs(qty)*last else 0e0 end), 2) + 0e0 blocked from mm group by acct""")
def margin_estimate(t):
    return L.margin_estimate(marked(t), F.col("last") * 2e1).withColumn("blocked", rr("blocked", 2))


@query("pnl_identity", "fills", f"""{MTM}, fe as (select acct, sum(cast(qty*price as decimal(18,2)))*cast({FEE} as double) fee from fills group by acct),
  aa as (select acct, sum(realised) r, sum(unrealised) u, sum(val) h from mm group by acct), cc as (select acct, sum(flow) f from fw group by acct)
  select acct, round(1e6 + f - fee + h, 1) + 0e0 equity, round(r + u - fee, 1) + 0e0 pnl, abs(r + u - fee - (f - fee + h)) > 1e-2 broken from aa join cc using (acct) join fe using (acct)""")
def pnl_identity(t):
    pos = pin(L.fold_fills(t.fills, last=True))
    amount = F.col("qty") * F.col("price")
    traded = t.fills.groupBy("acct", "ikey").agg(F.sum(F.when(F.col("side") == "SELL", 1e0).otherwise(-1e0) * amount).alias("v"), F.sum(amount.cast("decimal(18,2)")).alias("amount"))
    same = [pos[c].eqNullSafe(traded[c]) for c in ("acct", "ikey")]
    x = pin(pos.join(traded, same).select(pos["acct"], pos["ikey"], "realised", "v", "amount"))
    flows = x.withColumn("flow", F.when(L.kind() == "FUT", F.col("realised")).otherwise(F.col("v")))
    fees = x.groupBy("acct").agg((F.sum("amount").cast("double") * FEE).alias("fee"))  # decimals: exact in any order
    x = L.pnl_identity(L.mark_to_market(pos, L.last_prices(pos)), flows, fees)
    return x.select("acct", rr("equity", 1).alias("equity"), rr("pnl", 1).alias("pnl"), "broken")


@query("day_pnl", "ticks", """select acct, cast(ts + interval 330 minute as date) as "day", min_by(price, (ts, event_id)) as "open", max_by(price, (ts, event_id)) as "last",
   round(max_by(price, (ts, event_id)) - min_by(price, (ts, event_id)), 2) + 0e0 pnl from ticks group by 1, 2""")
def day_pnl(t):
    return L.day_pnl(t.ticks, ist_date(F.col("ts"))).withColumn("pnl", rr("pnl", 2))


@query("contributions", "fills", f"""{MTM}, tt as (select acct, sum(abs(val)) tv from mm group by acct), rs as (select acct, ikey, sum(realised) r from rf group by 1, 2)
  select acct, ikey, {tr_sql('r', 2)} realised, round(coalesce(case when tv > 0 then abs(val)/tv*1e2 else 0e0 end, 0e0), 6) + 0e0 weight_pct from rs left join mm using (acct, ikey) left join tt using (acct)""")
def contributions(t):
    pos = pin(L.fold_fills(t.fills, last=True))  # a position's realised result is the sum over its fills
    x = L.contributions(pos, L.mark_to_market(pos, L.last_prices(pos)))
    return x.select("acct", "ikey", tr("realised", 2).alias("realised"), rr("weight_pct", 6).alias("weight_pct"))


@query("pending_reservation", "fills", """lv as (select acct, ikey, sum(case when side = 'BUY' then qty else -qty end) q from fills where d < date '2000-01-01' group by 1, 2),
  pd as (select *, case when side = 'BUY' then qty else -qty end s from fills where d >= date '2000-01-01'),
  th as (select pd.*, coalesce(q, 0) + coalesce(sum(s) over (partition by pd.acct, pd.ikey order by d, ok, ln, pk rows between unbounded preceding and 1 preceding), 0) have
         from pd left join lv on lv.acct = pd.acct and lv.ikey = pd.ikey),
  nq as (select *, case when have = 0 or sign(have) = sign(s) then qty else qty - least(qty, abs(have)) end n from th)
  select acct, round(sum(case when ikey like 'FUT%' then n*price*1.2e-1 when ikey like 'OPT%' and side = 'SELL' then n*price + n*(price*2e1)*1e-1 else n*price end), 2) + 0e0 reserved from nq group by acct""")
def pending_reservation(t):
    f = t.fills
    live = f.filter("d < date '2000-01-01'").groupBy("acct", "ikey").agg(F.sum(L.signed()).alias("qty"))
    return L.pending_reservation(f.filter("d >= date '2000-01-01'"), live, F.col("price") * 2e1).withColumn("reserved", rr("reserved", 2))


@query("instrument_key", "chain", """select quote_id, case quote_id % 3 when 0 then 'EQ:S' || grp when 1 then 'FUT:S' || grp || ':25-Jan-2026'
   else 'OPT:S' || grp || ':25-Jan-2026:' || cast(k as varchar) || ':' || opt_type end ikey from chain""")
def instrument_key(t):
    q = F.col("quote_id")
    kd = F.when(q % 3 == 0, "EQ").when(q % 3 == 1, "FUT").otherwise("OPT")
    return t.chain.select("quote_id", L.instrument_key(kd, F.concat(F.lit("S"), F.col("grp").cast("string")), F.lit("25-Jan-2026"), F.col("k"), F.col("opt_type")).alias("ikey"))


@query("limit_first_cross", "limit_orders ticks", """m as (select o.order_id, min_by(t.event_id, (t.ts, t.event_id)) cross_id, min_by(t.price, (t.ts, t.event_id)) px
     from limit_orders o join ticks t on t.acct = o.acct and t.ts > o.ts and case when o.side = 'BUY' then t.price <= o.limit_price else t.price >= o.limit_price end group by 1)
  select order_id, acct, cross_id, case when px is not null then case when side = 'BUY' then least(limit_price, px) else greatest(limit_price, px) end end fill_price
  from (select o.*, m.cross_id, m.px from limit_orders o left join m using (order_id)) q""")
def limit_first_cross(t):
    return L.limit_first_cross(t.limit_orders, t.ticks)


@query("bracket_first_touch", "limit_orders ticks", """b as (select order_id id, acct, ts, side = 'BUY' is_long, limit_price*case when side = 'BUY' then 5e-1 else 1.5e0 end stop,
     limit_price*case when side = 'BUY' then 1.5e0 else 5e-1 end target from limit_orders),
  h as (select b.id, b.acct, t.event_id, t.ts, t.price, case when is_long then t.price <= stop else t.price >= stop end hs from b join ticks t on t.acct = b.acct and t.ts > b.ts
     and (case when is_long then t.price <= stop else t.price >= stop end or case when is_long then t.price >= target else t.price <= target end))
  select acct, id, case when arg_min(hs, (ts, event_id)) then 'stop' else 'target' end exit, min_by(event_id, (ts, event_id)) cross_id, min_by(price, (ts, event_id)) cross_price from h group by 1, 2""")
def bracket_first_touch(t):
    lng = F.col("side") == "BUY"
    b = t.limit_orders.select("acct", F.col("order_id").alias("id"), "ts", lng.alias("is_long"), (F.col("limit_price") * F.when(lng, 5e-1).otherwise(1.5e0)).alias("stop"),
                              (F.col("limit_price") * F.when(lng, 1.5e0).otherwise(5e-1)).alias("target"))
    return L.bracket_first_touch(b, t.ticks)
