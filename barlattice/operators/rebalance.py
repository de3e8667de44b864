"""Book diffs, order lists and the forward suggestion log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.align import align_intervals, at_slots, master_timeline
from barlattice.session import pin


def rebalance_orders(books: DataFrame, scale: float, *, by=("acct", "ikey"), lot="lot", px="px") -> DataFrame:
    """From/to quantities of every leg that must change; targets scaled and rounded to whole lots.

    ``books``: (by, current_qty, target_qty, px, lot); an instrument missing on one side counts as 0 there.
    """
    cur, tgt = F.coalesce("current_qty", F.lit(0)), F.coalesce("target_qty", F.lit(0))
    to = (F.floor(tgt * scale / F.col(lot) + 5e-1) * F.col(lot)).cast("bigint")
    x = books.select(*by, cur.alias("from_qty"), to.alias("to_qty"), px, lot)
    return x.filter((F.col("from_qty") != F.col("to_qty")) & (F.col(px) > 0))


def join_books(target: DataFrame, current: DataFrame, *, by=("acct", "ikey")) -> DataFrame:
    """Target and held legs side by side (full outer)."""
    return target.join(current, list(by), "full")


def split_flips(orders: DataFrame, *, lot="lot") -> DataFrame:
    """A sign flip becomes a close to flat and an open of the other side; orders below one lot vanish."""
    f, t = F.col("from_qty"), F.col("to_qty")
    leg = lambda a, b, n: F.struct(F.lit(n).alias("leg"), a.cast("bigint").alias("from_qty"), b.cast("bigint").alias("to_qty"))
    legs = F.when(f * t < 0, F.array(leg(f, F.lit(0), 1), leg(F.lit(0), t, 2))).otherwise(F.array(leg(f, t, 1)))
    rest = [c for c in orders.columns if c not in ("from_qty", "to_qty")]
    x = orders.select(*rest, F.inline(legs))
    lots = F.floor(F.abs(F.col("to_qty") - F.col("from_qty")) / F.col(lot) + 5e-1).cast("bigint")
    side = F.when(F.col("to_qty") > F.col("from_qty"), "BUY").otherwise("SELL")
    return x.withColumn("side", side).withColumn("lots", lots).filter("lots >= 1")


def order_priority() -> Column:
    """0: frees funds, 1: opens a short, 2: opens a long."""
    f, t = F.col("from_qty"), F.col("to_qty")
    opens = (f == 0) | ((F.signum(t) == F.signum(f)) & (F.abs(t) > F.abs(f)))
    return F.when(~opens, 0).when(F.col("side") == "SELL", 1).otherwise(2)


def afford_clip(orders: DataFrame, cash: DataFrame, buy_rate: float, sell_rate: float, *, by="acct", order=("prio", "ikey", "leg"),
                qty="shares", px="px") -> DataFrame:
    """Run an account's orders in sequence against its cash: buys are clipped to what is left, sells add to it.

    ``cash``: (by, cash).  The fold runs per account over one book's orders, at most two per instrument.
    """
    rows = orders.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "side", F.col(qty).alias("q"), F.col(px).alias("p")))).alias("o"))
    x = rows.join(cash, by)

    def step(a, o):
        buy = o["side"] == "BUY"
        can = F.floor(F.greatest(a["cash"], F.lit(0e0)) / (o["p"] * (1 + buy_rate))).cast("bigint")
        n = F.when(buy, F.least(o["q"], can)).otherwise(o["q"])
        done = n >= 1
        val = n * o["p"]
        cash = F.when(~done, a["cash"]).when(buy, a["cash"] - val - val * buy_rate).otherwise(a["cash"] + val - val * sell_rate)
        got = F.struct(F.when(done, n).otherwise(0).cast("bigint").alias("filled"), (buy & (o["q"] > can)).alias("capped"),
                       (~done).alias("skipped"), cash.alias("cash_after"))
        return F.struct(cash.alias("cash"), F.concat(a["out"], F.array(got)).alias("out"))

    empty = F.array().cast("array<struct<filled: bigint, capped: boolean, skipped: boolean, cash_after: double>>")
    out = F.aggregate("o", F.struct(F.col("cash").cast("double").alias("cash"), empty.alias("out")), step, lambda a: a["out"])
    z = x.select(by, F.inline(F.arrays_zip("o", out.alias("r"))))
    return z.select(by, *[F.col(f"o.{c}").alias(c) for c in order], "o.side", F.col("o.q").alias(qty), "r.*")


def holdings_signature(books: DataFrame, *, by="acct", key="ikey", qty="qty") -> DataFrame:
    """Sorted ``key:qty`` list of a book, ``cash`` if it is empty."""
    leg = F.when(F.col(qty) != 0, F.concat_ws(":", F.col(key), F.col(qty).cast("string")))
    s = F.array_join(F.array_sort(F.collect_list(leg)), "|")
    return books.groupBy(by).agg(F.when(F.length(s) == 0, "cash").otherwise(s).alias("signature"))


def sync_check(held: DataFrame, target: DataFrame, *, by="acct", key="ikey", qty="qty") -> DataFrame:
    """Legs out of step: held but not targeted, targeted but not held, or held on the other side."""
    h, t = held.filter(F.col(qty) != 0), target.filter(F.col(qty) != 0)
    foreign = h.join(t, [by, key], "left_anti").select(by, key, F.lit("foreign").alias("issue"))
    missing = t.join(h, [by, key], "left_anti").select(by, key, F.lit("missing").alias("issue"))
    both = h.select(by, key, F.col(qty).alias("_h")).join(t.select(by, key, F.col(qty).alias("_t")), [by, key])
    flipped = both.filter(F.signum("_h") != F.signum("_t")).select(by, key, F.lit("flipped").alias("issue"))
    return foreign.unionByName(missing).unionByName(flipped)


def weight_diff(prev: DataFrame, today: DataFrame, *, by=("eno",), key="sym") -> DataFrame:
    """New, increased, trimmed (by more than half a point) and exited names between two entries."""
    x = prev.select(*by, key, F.col("weight").alias("w0")).join(today.select(*by, key, F.col("weight").alias("w1")), [*by, key], "full")
    d = (F.col("w1") - F.col("w0")) * 1e2
    kind = F.when(F.col("w0").isNull(), "new").when(F.col("w1").isNull(), "exit").when(d > 5e-1, "increase").when(d < -5e-1, "trim")
    return x.withColumn("change", kind).filter("change is not null")


def advice_eligible(legs: DataFrame, *, by="acct") -> DataFrame:
    """Can the book be mirrored with plain delivery orders?  (by, eligible, reason); unusable equity is left out."""
    x = legs.filter((F.col("equity") > 0) & (F.abs(F.col("equity")) < float("inf")))
    g = x.groupBy(by).agg(F.first("kind").alias("_k"), F.bool_or((F.col("qty") != 0) & (F.col("inst") != "EQ")).alias("_d"),
                          F.bool_or(F.col("qty") < 0).alias("_s"))
    reason = (F.when(F.col("_k") == "FNO", "options strategy").when(F.col("_k") == "PAIRS", "pairs strategy")
              .when(F.col("_d"), "derivative legs").when(F.col("_s"), "short positions"))
    return g.select(by, reason.isNull().alias("eligible"), reason.alias("reason"))


def advice_targets(legs: DataFrame, verdict: DataFrame, *, by="acct") -> DataFrame:
    """Target weights of the eligible books, as a share of their equity."""
    x = legs.join(verdict.filter("eligible").select(by), by, "left_semi").filter("qty <> 0 and px > 0")
    return x.select(by, "ikey", "qty", "px", (F.floor(F.col("qty") * F.col("px") / F.col("equity") * 1e6 + 5e-1) / 1e6).alias("weight"))


# ---- forward log -----------------------------------------------------------------------------------------------------

def _log_window(by):
    """One log's rows, one per log date; a single log is one group."""
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def effective_book(entries: DataFrame, *, by=(), ts="d") -> DataFrame:
    """Entries of every log (``by``) numbered ``eno`` with ``eff``, the date of the last eligible entry up to them (null before the first).

    One row per log date; the book itself is joined on ``eff`` by the callers.
    """
    w = _log_window(by).orderBy(ts)
    eff = F.last(F.when(F.col("eligible"), F.col(ts)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return entries.select(*by, ts, "eligible", (F.row_number().over(w) - 1).alias("eno"), eff.alias("eff"))


def effective_targets(eff: DataFrame, targets: DataFrame, *, by=(), ts="d", key="sym") -> DataFrame:
    t = targets.select(*by, F.col(ts).alias("eff"), key, "weight")
    return eff.join(t, [*by, "eff"]).select(*by, "eno", ts, key, "weight")


def switch_cost(books: DataFrame, buy_rate: float, sell_rate: float, *, by=(), key="sym") -> DataFrame:
    """Cost of moving into entry ``eno`` from the entry before it (from cash for the first)."""
    new = books.select(*by, "eno", key, F.col("weight").alias("w1"))
    old = books.select(*by, (F.col("eno") + 1).alias("eno"), key, F.col("weight").alias("w0"))
    if by:
        old = old.join(books.groupBy(*by).agg(F.max("eno").alias("_last")), list(by))
    else:
        old = old.withColumn("_last", books.agg(F.max("eno")).scalar())
    x = new.join(old.filter("eno <= _last").drop("_last"), [*by, "eno", key], "full").fillna(0e0, ["w0", "w1"])
    d = F.col("w1") - F.col("w0")
    return x.groupBy(*by, "eno").agg(F.sum(F.when(d > 0, d * buy_rate).otherwise(-d * sell_rate)).alias("cost"))


def score_log(entries: DataFrame, targets: DataFrame, panel: DataFrame, market: DataFrame, buy_rate: float, sell_rate: float,
              *, by=(), ts="d", key="sym") -> DataFrame:
    """Forward track of every log (``by``) net of switching costs, against the market and the equal-weight universe.

    Entry i's book earns the close-to-close return to entry i+1; a name without both closes counts as cash.
    """
    on = [*by, "eno"]
    eff = pin(effective_book(entries, by=by, ts=ts))
    books = pin(effective_targets(eff, targets, by=by, ts=ts, key=key))
    # prices as intervals, read at the logs' dates only
    both = panel.select(key, ts, "c").unionByName(market.select(key, ts, "c"))
    master = pin(master_timeline(both, entries, ts=ts))
    slots = eff.select(*by, ts, "eno").join(master, ts).select(*by, "gi", "eno")
    at = at_slots(align_intervals(both, master, key=key, ts=ts), slots, master).join(slots, "gi").select(*by, "eno", key, F.when(F.col("c") > 0, F.col("c")).alias("c"))
    w = Window.partitionBy(*by, key).orderBy("eno")
    rel = pin(at.select(*by, (F.col("eno") + 1).alias("eno"), key, (F.lead("c").over(w) / F.col("c") - 1).alias("g")).filter("g is not null"))
    mk = market.select(key).distinct()
    held = books.select(*by, (F.col("eno") + 1).alias("eno"), key, "weight").join(rel, [*on, key])
    port = held.groupBy(*on).agg(F.sum(F.col("weight") * F.col("g")).alias("r"))
    uni = rel.join(mk, key, "left_anti").groupBy(*on).agg(F.avg("g").alias("u"))
    idx = rel.join(mk, key, "left_semi").groupBy(*on).agg(F.max("g").alias("n"))
    cost = switch_cost(books, buy_rate, sell_rate, by=by, key=key)
    x = eff.select(*by, "eno", ts).join(port, on, "left").join(uni, on, "left").join(idx, on, "left").join(cost, on, "left") \
        .fillna(0e0, ["r", "u", "n", "cost"])
    run = _log_window(by).orderBy("eno").rowsBetween(Window.unboundedPreceding, 0)
    grow = lambda e: F.exp(F.sum(F.ln(e)).over(run))
    y = x.select(*by, "eno", ts, grow((1 + F.col("r")) * (1 - F.col("cost"))).alias("adv"), grow(1 + F.col("n")).alias("market"),
                 grow(1 + F.col("u")).alias("universe"), F.sum("cost").over(run).alias("cost_paid"))
    peak = F.greatest(F.max(F.when(F.col("eno") > 0, F.col("adv"))).over(run), F.lit(1e0))
    return y.withColumn("drawdown", F.when(F.col("eno") > 0, 1 - F.col("adv") / peak).otherwise(0e0))
