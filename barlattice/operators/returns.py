"""Target weights to bar returns net of costs, curves and trade statistics.

A weight decided on bar i trades at bar i+1's close, so bar j earns the weight decided at j-2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# fixed values: statutory and exchange rates per side
STT_DELIVERY, STAMP_DELIVERY, EXCHANGE, GST, TURNOVER_FEE = 1e-3, 1.5e-4, 2.97e-5, 1.8e-1, 1e-6
STT_INTRADAY, STAMP_INTRADAY, OPTION_EXCHANGE, BORROW_PA = 2.5e-4, 3e-5, 3.503e-3, 6e-2
OPTION_HALF_SPREAD, OPTION_TICK = 5e-3, 5e-2


def cost_model(kind: str, *, slippage_bps: float | None = None, flat_bps: float = 10) -> dict[str, float]:
    """All-in rates of one side: ``{"buy", "sell", "borrow"}`` as fractions of traded value."""
    ex = EXCHANGE * (1 + GST)
    if kind == "delivery":
        slip = (5 if slippage_bps is None else slippage_bps) / 1e4
        return {"buy": STT_DELIVERY + STAMP_DELIVERY + ex + TURNOVER_FEE + slip,
                "sell": STT_DELIVERY + ex + TURNOVER_FEE + slip, "borrow": BORROW_PA}
    if kind == "intraday":
        slip = (3 if slippage_bps is None else slippage_bps) / 1e4
        return {"buy": STAMP_INTRADAY + ex + TURNOVER_FEE + slip,
                "sell": STT_INTRADAY + ex + TURNOVER_FEE + slip, "borrow": 0e0}
    if kind == "index_option":
        ox = OPTION_EXCHANGE * (1 + GST)
        return {"buy": STAMP_INTRADAY + ox + TURNOVER_FEE, "sell": STT_DELIVERY + ox + TURNOVER_FEE, "borrow": 0e0}
    if kind == "flat":
        return {"buy": flat_bps / 1e4, "sell": flat_bps / 1e4, "borrow": 0e0}
    raise ValueError(f"unknown cost model {kind}")


KINDS = ("delivery", "intraday", "index_option", "flat")


def cost_rates(df: DataFrame) -> DataFrame:
    """One row per input row and cost kind, with that kind's rates (a four-row literal, no join)."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(m["buy"])).alias("buy_rate"),
                              F.lit(float(m["sell"])).alias("sell_rate"), F.lit(float(m["borrow"])).alias("borrow_rate"))
                     for k in KINDS for m in [cost_model(k)]])
    return df.select("*", F.inline(rows))


def fill_price(side: Column, px: Column, model: dict) -> Column:
    return F.when(side == "BUY", px * (1 + model["buy"])).otherwise(px * (1 - model["sell"]))


def option_fill_price(side: Column, px: Column, model: dict) -> Column:
    half = F.greatest(px * OPTION_HALF_SPREAD, F.lit(OPTION_TICK))
    return F.when(side == "BUY", (px + half) * (1 + model["buy"])) \
        .otherwise(F.greatest((px - half) * (1 - model["sell"]), F.lit(1e-2)))


def borrow_fee(df: DataFrame, rate_pa: float = BORROW_PA, *, key="sym", ts="d", w="w", out="fee") -> DataFrame:
    """Fee of a short weight over the calendar gap to the previous bar (365.25 days a year)."""
    win = Window.partitionBy(key).orderBy(ts)
    gap = F.date_diff(F.col(ts), F.lag(ts).over(win))
    short = F.greatest(-F.lag(w).over(win), F.lit(0e0))
    return df.withColumn(out, F.coalesce(short * rate_pa * gap / 3.6525e2, F.lit(0e0)))


def weight_returns(df: DataFrame, model: dict, *, key=("sym",), ts="d", px="c", w="w") -> DataFrame:
    """Net bar return ``r`` and charged ``cost`` of holding the decided weights ``w``."""
    win = Window.partitionBy(*key).orderBy(ts)
    zero = F.lit(0e0)
    ret = F.coalesce(F.col(px) / F.nullif(F.lag(px).over(win), zero) - 1, zero)
    held = F.coalesce(F.lag(w, 2).over(win), zero)
    new = F.coalesce(F.lag(w, 1).over(win), zero)
    turn = new - held
    cost = F.when(turn > 0, turn * model["buy"]).otherwise(-turn * model["sell"])
    return df.select("*", held.alias("held"), cost.alias("cost"), (held * ret - cost).alias("r"))


def equity_curve(df: DataFrame, *, by=("sym",), ts="d", r="r", out="eq", start: float = 1e0) -> DataFrame:
    """Compounded curve; a bar return of -100 % or worse wipes it for good."""
    win = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max(F.when(F.col(r) <= -1, 1).otherwise(0)).over(win) == 1
    grown = F.exp(F.sum(F.when(F.col(r) > -1, F.ln(1 + F.when(F.col(r) > -1, F.col(r)).otherwise(0e0)))).over(win))
    return df.withColumn(out, F.when(dead, 0e0).otherwise(start * grown))


def participation_flags(trades: DataFrame, bars: DataFrame, cap: float = 1e-1, *, key="sym", ts="d") -> DataFrame:
    """Per series: fills checked against traded volume and fills above ``cap`` of it."""
    b = bars.select(key, ts, F.col("v").alias("_v"), F.col("c").alias("_c"))
    x = trades.join(b, [key, ts])
    has = F.col("_v") > 0
    return x.groupBy(key).agg(
        F.count(F.when(has, 1)).alias("checked"),
        F.count(F.when(has & (F.col("value") > cap * F.col("_v") * F.col("_c")), 1)).alias("flagged"))


def profit_factor(trades: DataFrame, by=("acct",), realised="realised") -> DataFrame:
    win = F.sum(F.when(F.col(realised) > 0, F.col(realised)).otherwise(0e0))
    loss = F.sum(F.when(F.col(realised) < 0, -F.col(realised)).otherwise(0e0))
    pf = F.when((win == 0) & (loss == 0), F.lit(None).cast("double")) \
        .when(loss == 0, F.lit(float("inf"))).otherwise(win / F.nullif(loss, F.lit(0e0)))
    return trades.groupBy(*by).agg(pf.alias("profit_factor"))


def turnover_per_year(trades: DataFrame, curve: DataFrame, *, by="sym", ts="d", value="value", eq="eq") -> DataFrame:
    """Traded value / 2 / average equity / years, per curve."""
    traded = trades.groupBy(by).agg(F.sum(F.abs(F.col(value))).alias("_tv"))
    c = curve.groupBy(by).agg(F.avg(eq).alias("_ae"), (F.date_diff(F.max(ts), F.min(ts)) / 3.6525e2).alias("_y"))
    ok = (F.col("_ae") > 0) & (F.col("_y") > 0)
    return c.join(traded, by, "left").select(
        by, F.when(ok, F.coalesce(F.col("_tv"), F.lit(0e0)) / 2 / F.col("_ae") / F.col("_y")).alias("turnover"))


# ---- baskets: decide, trade one bar later, hold with drift -----------------------------------------------------------

def _periods(weights: DataFrame, grid: DataFrame, by) -> DataFrame:
    """Decision list with the executing bar (decision + 1), the bar of the next execution or the grid's end, and whether there is a next one."""
    w = Window.partitionBy(*by).orderBy("gi")
    dec = weights.select(*by, "gi").distinct().withColumn("_last", grid.agg(F.max("gi")).scalar())
    x = dec.withColumn("_x", F.col("gi") + 1).withColumn("_next", F.lead("gi").over(w) + 1)
    x = x.withColumn("_end", F.least(F.coalesce(F.col("_next"), F.col("_last")), F.col("_last"))) \
        .withColumn("_rolled", F.coalesce(F.col("_next") <= F.col("_last"), F.lit(False)))
    return x.filter(F.col("_x") <= F.col("_last"))


def basket_values(weights: DataFrame, grid: DataFrame, *, by=("spec_id",)) -> DataFrame:
    """Drifted value of every held name at every bar of its holding period.

    ``weights``: (by, gi, sym, w) decided at grid slot gi; a decision without names is a row with sym null.
    ``grid``: (gi, sym, px).  Output: (by, dec, x, end, rolled, gi, sym, w, wv) with wv = w * price / price at execution; ``rolled``
    tells a holding that the spec's own next decision replaces from one that is open at the grid's end.
    """
    per = _periods(weights, grid, by)
    held = weights.filter(F.col("sym").isNotNull() & (F.col("w") != 0)).join(per, [*by, "gi"]) \
        .select(*by, F.col("gi").alias("dec"), F.col("_x").alias("x"), F.col("_end").alias("end"), F.col("_rolled").alias("rolled"), "sym", "w")
    slots = held.withColumn("gi", F.explode(F.sequence("x", "end")))
    v = slots.join(grid.select("gi", "sym", "px"), ["gi", "sym"])
    w = Window.partitionBy(*by, "dec", "sym").orderBy("gi").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return v.withColumn("wv", F.col("w") * F.col("px") / F.nullif(F.first("px").over(w), F.lit(0e0)))


def basket_trades(values: DataFrame, weights: DataFrame, model: dict, *, by=("spec_id",)) -> DataFrame:
    """Trades at each execution of a spec: drifted old weight against new weight (a dropped name goes to 0).

    A holding still open at the grid's end is not sold; a decision on the last bar never executes.
    """
    gross = F.sum(F.col("wv") - F.col("w")).over(Window.partitionBy(*by, "dec", "gi"))
    ends = values.withColumn("_v", 1 + gross).filter((F.col("gi") == F.col("end")) & F.col("rolled")) \
        .select(*by, F.col("end").alias("x"), "sym", (F.col("wv") / F.col("_v")).alias("old_w"))
    new = values.filter(F.col("gi") == F.col("x")).select(*by, "x", "sym", F.col("w").alias("new_w"))
    t = ends.join(new, [*by, "x", "sym"], "full").fillna(0e0, ["old_w", "new_w"])
    d = F.col("new_w") - F.col("old_w")
    kind = F.when(F.col("old_w") == 0, "entry").when(F.col("new_w") == 0, "exit").when(d > 0, "add").otherwise("trim")
    return t.withColumn("side", F.when(d > 0, "BUY").otherwise("SELL")).withColumn("size", F.abs(d)).withColumn("kind", kind) \
        .withColumn("cost", F.when(d > 0, d * model["buy"]).otherwise(-d * model["sell"])).filter("size > 0")


def basket_returns(weights: DataFrame, grid: DataFrame, model: dict, *, by=("spec_id",)) -> DataFrame:
    """Net curve of a basket: (by, gi, eq), starting with 1 at the first execution before its cost; a basket worth nothing stays at 0."""
    values = basket_values(weights, grid, by=by)
    per = _periods(weights, grid, by) \
        .select(*by, F.col("gi").alias("dec"), F.col("_x").alias("x"), F.col("_end").alias("end"))
    bar = values.groupBy(*by, "dec", "gi").agg((1 + F.sum(F.col("wv") - F.col("w"))).alias("v"))
    slots = per.withColumn("gi", F.explode(F.sequence("x", "end"))).join(bar, [*by, "dec", "gi"], "left").fillna(1e0, ["v"])
    cost = basket_trades(values, weights, model, by=by).groupBy(*by, "x").agg(F.sum("cost").alias("cost"))
    steps = slots.filter(F.col("gi") == F.col("end")).select(*by, "dec", "x", F.col("v").alias("_pv")) \
        .join(cost, [*by, "x"], "left").fillna(0e0, ["cost"])
    w = Window.partitionBy(*by).orderBy("dec")
    grown = F.coalesce(F.sum(F.ln("_pv")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0e0)) \
        + F.sum(F.ln(1 - F.col("cost"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.max(F.when(F.col("_pv") <= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1
    spent = F.max(F.when(F.col("cost") >= 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    base = steps.withColumn("_b", F.when(gone | spent, 0e0).otherwise(F.exp(grown))).select(*by, "dec", "_b")
    out = slots.filter((F.col("gi") > F.col("x"))).join(base, [*by, "dec"]).select(*by, "gi", (F.col("_b") * F.greatest("v", F.lit(0e0))).alias("eq"))
    return out


def final_holdings(weights: DataFrame, *, by=("spec_id",)) -> DataFrame:
    """Latest target weights per spec, largest first, as ``sym:percent`` entries."""
    last = weights.groupBy(*by).agg(F.max("gi").alias("gi"))
    x = weights.filter("sym is not null and w > 0").join(last, [*by, "gi"], "left_semi")
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "sym", "w"))).alias("h"))
    return g.select(*by, F.transform("h", lambda h: F.struct(h["sym"].alias("sym"), (h["w"] * 1e2).alias("pct"))).alias("holdings"))
