"""Book-diff and forward-log queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.operators import rebalance as B
from barlattice.operators.returns import cost_model
from barlattice.plans.registry import query, rr
from barlattice.session import pin

DEL = cost_model("delivery")
BUY, SELL = repr(DEL["buy"]) + "e0", repr(DEL["sell"]) + "e0"
SCALE = 1.3e0

ORD = f"""ob as (select acct, ikey, current_qty from_qty, cast(floor(target_qty*{SCALE}/lot + 5e-1)*lot as bigint) to_qty, px, lot from acct_books),
  ord as (select * from ob where from_qty <> to_qty and px > 0)"""
FLIP = f"""{ORD}, fl as (select acct, ikey, px, lot, 1 leg, from_qty, case when from_qty*to_qty < 0 then 0 else to_qty end to_qty from ord
     union all select acct, ikey, px, lot, 2, 0, to_qty from ord where from_qty*to_qty < 0),
  sp as (select *, case when to_qty > from_qty then 'BUY' else 'SELL' end side, cast(floor(abs(to_qty - from_qty)/lot + 5e-1) as bigint) lots from fl),
  spl as (select *, case when not (from_qty = 0 or (sign(to_qty) = sign(from_qty) and abs(to_qty) > abs(from_qty))) then 0 when side = 'SELL' then 1 else 2 end prio
          from sp where lots >= 1)"""


def orders(t):
    return B.rebalance_orders(t.acct_books, SCALE)


def split(t):
    x = B.split_flips(orders(t))
    return x.withColumn("prio", B.order_priority())


@query("rebalance_orders", "acct_books", f"{ORD} select * from ord")
def rebalance_orders(t):
    b = t.acct_books
    both = B.join_books(b.filter("target_qty <> 0").select("acct", "ikey", "target_qty", F.col("px").alias("p1"), F.col("lot").alias("l1")),
                        b.filter("current_qty <> 0").select("acct", "ikey", "current_qty", F.col("px").alias("p2"), F.col("lot").alias("l2")))
    return B.rebalance_orders(both.withColumn("px", F.coalesce("p1", "p2")).withColumn("lot", F.coalesce("l1", "l2")), SCALE)


@query("split_flips", "acct_books", f"{FLIP} select acct, ikey, px, lot, leg, from_qty, to_qty, side, lots from spl")
def split_flips(t):
    return B.split_flips(orders(t))


@query("order_priority", "acct_books", f"{FLIP} select acct, ikey, leg, side, prio, row_number() over (partition by acct order by prio, ikey, leg) seq from spl")
def order_priority(t):
    return split(t).select("acct", "ikey", "leg", "side", "prio", F.row_number().over(Window.partitionBy("acct").orderBy("prio", "ikey", "leg")).alias("seq"))


@query("afford_clip", "acct_books", f"""{FLIP}, o0 as (select acct, prio, ikey, leg, side, lots*lot q, px p from spl),
  g as (select acct, list(struct_pack(prio := prio, ikey := ikey, leg := leg, side := side, q := q, p := p) order by prio, ikey, leg) o from o0 group by acct),
  f as (select acct, o, list_reduce(list_concat([struct_pack(cash := 5e5 + acct*1e3, n := 0::bigint, o := o[1], can := 0::bigint, acc := [struct_pack(filled := 0::bigint, capped := false, skipped := false, cash_after := 0e0)])],
     list_transform(o, lambda q: struct_pack(cash := 0e0, n := 0::bigint, o := q, can := 0::bigint, acc := [struct_pack(filled := 0::bigint, capped := false, skipped := false, cash_after := 0e0)]))),
     lambda a, b: list_transform([list_transform([cast(floor(greatest(a.cash, 0e0)/(b.o.p*(1 + {BUY}))) as bigint)], lambda can: struct_pack(can := can,
           n := case when b.o.side = 'BUY' then least(b.o.q, can) else b.o.q end))[1]], lambda z: list_transform([case when z.n < 1 then a.cash when b.o.side = 'BUY' then a.cash - z.n*b.o.p - z.n*b.o.p*{BUY}
           else a.cash + z.n*b.o.p - z.n*b.o.p*{SELL} end], lambda c: struct_pack(cash := c, n := z.n, o := b.o, can := z.can,
           acc := list_append(a.acc, struct_pack(filled := case when z.n >= 1 then z.n else 0 end, capped := b.o.side = 'BUY' and b.o.q > z.can, skipped := z.n < 1, cash_after := c))))[1])[1]).acc[2:] acc from g),
  u as (select acct, unnest(o) o, unnest(acc) r from f)
  select acct, o.prio prio, o.ikey ikey, o.leg leg, o.side side, o.q shares, r.filled filled, r.capped capped, r.skipped skipped, round(r.cash_after, 4) + 0e0 cash_after from u""")
def afford_clip(t):
    o = split(t).withColumn("shares", F.col("lots") * F.col("lot"))
    cash = t.acct_books.select("acct").distinct().withColumn("cash", 5e5 + F.col("acct") * 1e3)
    x = B.afford_clip(o, cash, DEL["buy"], DEL["sell"])
    return x.withColumn("cash_after", rr("cash_after", 4))


@query("holdings_signature", "acct_books", """select acct, coalesce(string_agg(ikey || ':' || current_qty, '|' order by ikey || ':' || current_qty) filter (current_qty <> 0), 'cash') signature
  from acct_books group by acct""")
def holdings_signature(t):
    return B.holdings_signature(t.acct_books.withColumnRenamed("current_qty", "qty"))


@query("sync_check", "acct_books", """h as (select acct, ikey, current_qty q from acct_books where current_qty <> 0 and acct % 5 <> 1),
  g as (select acct, ikey, target_qty q from acct_books where target_qty <> 0 and acct % 7 <> 1)
  select coalesce(h.acct, g.acct) acct, coalesce(h.ikey, g.ikey) ikey, case when g.acct is null then 'foreign' when h.acct is null then 'missing' else 'flipped' end issue
  from h full join g on h.acct = g.acct and h.ikey = g.ikey where g.acct is null or h.acct is null or sign(h.q) <> sign(g.q)""")
def sync_check(t):
    b = t.acct_books
    return B.sync_check(b.filter("acct % 5 <> 1").select("acct", "ikey", F.col("current_qty").alias("qty")),
                        b.filter("acct % 7 <> 1").select("acct", "ikey", F.col("target_qty").alias("qty")))


@query("advice_eligible", "acct_books", """l as (select acct, ikey, target_qty qty, px, case when acct % 11 = 0 then -1e0 else 1e6 end equity,
     case acct % 6 when 0 then 'FNO' when 1 then 'PAIRS' else 'BASKET' end kind, case when acct % 9 = 2 and ikey = 'FUT:R' then 'OPT' else 'EQ' end inst from acct_books),
  v as (select acct, case when any_value(kind) = 'FNO' then 'options strategy' when any_value(kind) = 'PAIRS' then 'pairs strategy'
     when bool_or(qty <> 0 and inst <> 'EQ') then 'derivative legs' when bool_or(qty < 0) then 'short positions' end reason from l where equity > 0 group by acct)
  select v.acct, reason is null eligible, reason, l.ikey, floor(l.qty*l.px/l.equity*1e6 + 5e-1)/1e6 weight
  from v left join l on reason is null and l.acct = v.acct and l.qty <> 0 and l.px > 0""")
def advice_eligible(t):
    a = F.col("acct")
    legs = t.acct_books.select("acct", "ikey", F.col("target_qty").alias("qty"), "px", F.when(a % 11 == 0, -1e0).otherwise(1e6).alias("equity"),
                               F.when(a % 6 == 0, "FNO").when(a % 6 == 1, "PAIRS").otherwise("BASKET").alias("kind"),
                               F.when((a % 9 == 2) & (F.col("ikey") == "FUT:R"), "OPT").otherwise("EQ").alias("inst"))
    v = B.advice_eligible(legs)
    return v.join(B.advice_targets(legs, v).select("acct", "ikey", "weight"), "acct", "left")


ENT = """en as (select d, any_value(eligible) eligible, row_number() over (order by d) - 1 eno from advice group by d),
  ef as (select *, last_value(case when eligible then d end ignore nulls) over (order by d rows between unbounded preceding and current row) eff from en),
  bk as (select eno, ef.d, a.sym, a.weight from ef join advice a on a.d = ef.eff)"""


def entries(t):
    return t.pin("advice").select("d", "eligible").distinct()


@query("effective_book", "advice", f"{ENT} select eno, d, sym, weight from bk")
def effective_book(t):
    return B.effective_targets(B.effective_book(entries(t)), t.pin("advice"))


@query("weight_diff", "advice", f"""{ENT}, x as (select coalesce(a.eno, b.eno + 1) eno, coalesce(a.sym, b.sym) sym, b.weight w0, a.weight w1
    from bk a full join bk b on a.eno = b.eno + 1 and a.sym = b.sym), mx as (select max(eno) m from bk),
  k as (select *, case when w0 is null then 'new' when w1 is null then 'exit' when (w1 - w0)*1e2 > 5e-1 then 'increase' when (w1 - w0)*1e2 < -5e-1 then 'trim' end change from x, mx where eno <= m)
  select eno, sym, w0, w1, change from k where change is not null""")
def weight_diff(t):
    bk = pin(B.effective_targets(B.effective_book(entries(t)), t.pin("advice")))
    prev = bk.withColumn("eno", F.col("eno") + 1).filter(F.col("eno") <= bk.agg(F.max("eno")).scalar())
    return B.weight_diff(prev, bk)


SC = f"""sx as (select coalesce(a.eno, b.eno + 1) eno, coalesce(a.weight, 0e0) - coalesce(b.weight, 0e0) dw from bk a full join bk b on a.eno = b.eno + 1 and a.sym = b.sym),
  sc as (select eno, sum(case when dw > 0 then dw*{BUY} else -dw*{SELL} end) cost from sx where eno <= (select max(eno) from bk) group by eno)"""


@query("switch_cost", "advice", f"{ENT}, {SC} select eno, round(cost, 8) + 0e0 cost from sc")
def switch_cost(t):
    bk = B.effective_targets(B.effective_book(entries(t)), t.pin("advice"))
    return B.switch_cost(bk, DEL["buy"], DEL["sell"]).withColumn("cost", rr("cost", 8))


@query("score_log", "advice candles_daily market_daily", f"""{ENT}, {SC},
  pp as (select sym, d, c from candles_daily union all select sym, d, c from market_daily),
  ek as (select ef.eno, ef.d, s.sym from ef cross join (select distinct sym from pp) s),
  at0 as (select ek.eno, ek.sym, pp.c from ek asof left join pp on ek.sym = pp.sym and ek.d >= pp.d),
  rl as (select a.eno + 1 eno, a.sym, b.c/a.c - 1 g from at0 a join at0 b on b.eno = a.eno + 1 and a.sym = b.sym where a.c > 0 and b.c > 0),
  po as (select bk.eno + 1 eno, sum(weight*g) r from bk join rl on rl.eno = bk.eno + 1 and rl.sym = bk.sym group by 1),
  un as (select eno, avg(g) u from rl where sym <> 'MKT' group by eno), ix as (select eno, g n from rl where sym = 'MKT'),
  jn as (select ef.eno, ef.d, coalesce(r, 0e0) r, coalesce(u, 0e0) u, coalesce(n, 0e0) n, coalesce(cost, 0e0) cost from ef left join po using (eno) left join un using (eno)
         left join ix using (eno) left join sc using (eno)),
  gr as (select eno, d, exp(sum(ln((1 + r)*(1 - cost))) over w) adv, exp(sum(ln(1 + n)) over w) mk, exp(sum(ln(1 + u)) over w) un, sum(cost) over w cp from jn
         window w as (order by eno rows between unbounded preceding and current row))
  select eno, d, round(adv, 6) adv, round(mk, 6) market, round(un, 6) universe, round(cp, 7) + 0e0 cost_paid,
     round(case when eno > 0 then 1 - adv/greatest(max(case when eno > 0 then adv end) over (order by eno rows between unbounded preceding and current row), 1e0) else 0e0 end, 6) + 0e0 drawdown from gr""")
def score_log(t):
    t.pin("candles_daily")  # the log is derived from the same panel
    x = B.score_log(entries(t), t.pin("advice"), t.pin("candles_daily"), t.pin("market_daily"), DEL["buy"], DEL["sell"])
    return x.select("eno", "d", *[F.round(c, 6).alias(c) for c in ("adv", "market", "universe")], rr("cost_paid", 7).alias("cost_paid"), rr("drawdown").alias("drawdown"))


# two logs at once: every entry, and those of quarter ends
LOGS = """lx as (select 'all' lg, * from advice union all select 'quarter', * from advice where month(d) % 3 = 0),
  en as (select lg, d, any_value(eligible) eligible, row_number() over (partition by lg order by d) - 1 eno from lx group by lg, d),
  ef as (select *, last_value(case when eligible then d end ignore nulls) over (partition by lg order by d rows between unbounded preceding and current row) eff from en),
  bk as (select ef.lg, eno, ef.d, a.sym, a.weight from ef join lx a on a.d = ef.eff and a.lg = ef.lg)"""
LOG_COST = f"""mx as (select lg, max(eno) m from bk group by lg),
  sx as (select coalesce(a.lg, b.lg) lg, coalesce(a.eno, b.eno + 1) eno, coalesce(a.weight, 0e0) - coalesce(b.weight, 0e0) dw from bk a full join bk b on a.lg = b.lg and a.eno = b.eno + 1 and a.sym = b.sym),
  sc as (select lg, eno, sum(case when dw > 0 then dw*{BUY} else -dw*{SELL} end) cost from sx join mx using (lg) where eno <= m group by lg, eno)"""


def logs(t):
    x = t.pin("advice")
    return pin(x.withColumn("lg", F.lit("all")).unionByName(x.filter(F.month("d") % 3 == 0).withColumn("lg", F.lit("quarter"))))


@query("effective_books", "advice", f"{LOGS} select lg, eno, d, sym, weight from bk")
def effective_books(t):
    x = logs(t)
    return B.effective_targets(B.effective_book(x.select("lg", "d", "eligible").distinct(), by=("lg",)), x, by=("lg",))


@query("score_logs", "advice candles_daily market_daily", f"""{LOGS}, {LOG_COST},
  pp as (select sym, d, c from candles_daily union all select sym, d, c from market_daily),
  ek as (select ef.lg, ef.eno, ef.d, s.sym from ef cross join (select distinct sym from pp) s),
  at0 as (select ek.lg, ek.eno, ek.sym, pp.c from ek asof left join pp on ek.sym = pp.sym and ek.d >= pp.d),
  rl as (select a.lg, a.eno + 1 eno, a.sym, b.c/a.c - 1 g from at0 a join at0 b on b.lg = a.lg and b.eno = a.eno + 1 and a.sym = b.sym where a.c > 0 and b.c > 0),
  po as (select bk.lg, bk.eno + 1 eno, sum(weight*g) r from bk join rl on rl.lg = bk.lg and rl.eno = bk.eno + 1 and rl.sym = bk.sym group by 1, 2),
  un as (select lg, eno, avg(g) u from rl where sym <> 'MKT' group by lg, eno), ix as (select lg, eno, g n from rl where sym = 'MKT'),
  jn as (select ef.lg, ef.eno, ef.d, coalesce(r, 0e0) r, coalesce(u, 0e0) u, coalesce(n, 0e0) n, coalesce(cost, 0e0) cost from ef left join po using (lg, eno) left join un using (lg, eno)
         left join ix using (lg, eno) left join sc using (lg, eno)),
  gr as (select lg, eno, d, exp(sum(ln((1 + r)*(1 - cost))) over w) adv, exp(sum(ln(1 + n)) over w) mk, exp(sum(ln(1 + u)) over w) un, sum(cost) over w cp from jn
         window w as (partition by lg order by eno rows between unbounded preceding and current row))
  select lg, eno, d, round(adv, 6) adv, round(mk, 6) market, round(un, 6) universe, round(cp, 7) + 0e0 cost_paid,
     round(case when eno > 0 then 1 - adv/greatest(max(case when eno > 0 then adv end) over (partition by lg order by eno rows between unbounded preceding and current row), 1e0) else 0e0 end, 6) + 0e0 drawdown from gr""")
def score_logs(t):
    x = logs(t)
    y = B.score_log(x.select("lg", "d", "eligible").distinct(), x, t.pin("candles_daily"), t.pin("market_daily"), DEL["buy"], DEL["sell"], by=("lg",))
    return y.select("lg", "eno", "d", *[F.round(c, 6).alias(c) for c in ("adv", "market", "universe")], rr("cost_paid", 7).alias("cost_paid"), rr("drawdown").alias("drawdown"))
