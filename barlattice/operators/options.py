"""Option structures, payoffs and cycles as chain-wide jobs.

A structure has at most a handful of legs, so its legs travel as one array: payoffs, extremes and break-evens are
row-wise expressions with a single shuffle (packing) or none (templates).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from barlattice.functions import leg_arrays as A
from barlattice.functions.indicators import with_indicators
from barlattice.functions.options_math import GREEKS, RATE, implied_vol, intrinsic, with_option
from barlattice.operators.metrics import curve_metrics
from barlattice.operators.returns import cost_model, option_fill_price

SPOTS_PER_TASK = 20_000  # some 700,000 legs: a task packs them in memory, however many spots there are
# fixed values: named structures as (name, legs); leg = (type, side, steps from the money, lots, days after the near expiry)
TEMPLATES = (
    ("long_call", (("CE", "BUY", 0, 1, None),)),
    ("long_put", (("PE", "BUY", 0, 1, None),)),
    ("short_call", (("CE", "SELL", 0, 1, None),)),
    ("short_put", (("PE", "SELL", 0, 1, None),)),
    ("straddle", (("CE", "BUY", 0, 1, None), ("PE", "BUY", 0, 1, None))),
    ("strangle", (("CE", "BUY", 2, 1, None), ("PE", "BUY", -2, 1, None))),
    ("bull_call_spread", (("CE", "BUY", 0, 1, None), ("CE", "SELL", 2, 1, None))),
    ("bear_put_spread", (("PE", "BUY", 0, 1, None), ("PE", "SELL", -2, 1, None))),
    ("iron_condor", (("PE", "BUY", -3, 1, None), ("PE", "SELL", -1, 1, None), ("CE", "SELL", 1, 1, None), ("CE", "BUY", 3, 1, None))),
    ("covered_call", (("FUT", "BUY", None, 1, None), ("CE", "SELL", 1, 1, None))),
    ("long_call_butterfly", (("CE", "BUY", -1, 1, None), ("CE", "SELL", 0, 2, None), ("CE", "BUY", 1, 1, None))),
    ("call_ratio_spread", (("CE", "BUY", 0, 1, None), ("CE", "SELL", 2, 2, None))),
    ("collar", (("FUT", "BUY", None, 1, None), ("PE", "BUY", -1, 1, None), ("CE", "SELL", 1, 1, None))),
    ("calendar_call", (("CE", "SELL", 0, 1, 0), ("CE", "BUY", 0, 1, 30))),
    ("diagonal_call", (("CE", "SELL", 0, 1, 0), ("CE", "BUY", 1, 1, 30))),
)


def atm(spot: Column, step: Column) -> Column:
    return F.floor(spot / step + 5e-1) * step


# structures whose options expire on several days
SEVERAL_EXPIRIES = tuple(name for name, legs in TEMPLATES if len({extra or 0 for typ, *_, extra in legs if typ != "FUT"}) > 1)


def structure_templates(spots: DataFrame, lot_size: int = 1, key: str = "id", names: tuple[str, ...] | None = None) -> DataFrame:
    """Every named structure (or those in ``names``) on every (spot, step): one row per leg.

    The spots are spread by ``key`` before they grow forty-fold, so that packing by (key, structure) moves nothing; the parts grow with the rows.  The templates are one
    constant array, strikes and days come after it: written out per leg they made the stage's method longer than the 8,000 bytes that the JVM
    compiles, and pricing was interpreted.
    """
    parts = max(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-spots.count() // SPOTS_PER_TASK))
    rows = ", ".join(
        f"named_struct('structure', '{name}', 'leg', {i + 1}, 'opt_type', '{typ}', 'side', '{side}', '_steps', cast({'null' if steps is None else steps} as int), "
        f"'lots', {lots}, 'lot_size', {lot_size}, '_extra', {extra or 0})"
        for name, legs in TEMPLATES if names is None or name in names for i, (typ, side, steps, lots, extra) in enumerate(legs))
    x = spots.repartition(parts, key).withColumn("_atm", atm(F.col("spot"), F.col("step")))
    strike = F.when(F.col("_steps").isNull(), 0e0).otherwise((F.col("_atm") + F.col("_steps") * F.col("step")).cast("double"))
    return x.select("*", F.expr(f"inline(array({rows}))")).select(
        *spots.columns, "structure", "leg", "opt_type", "side", strike.alias("strike"), "lots", "lot_size", (F.col("hdays") + F.col("_extra")).cast("bigint").alias("leg_days"))


def price_legs(legs: DataFrame, rate: float = RATE) -> DataFrame:
    """Adds ``premium``: the model price of an option leg (``iv`` in percent), the spot for a future."""
    x = with_option(legs, F.col("opt_type"), F.col("spot"), F.col("strike"), F.col("leg_days") / 3.65e2, F.col("iv") / 1e2, price="premium", r=rate)
    return x.withColumn("premium", F.when(F.col("opt_type") == "FUT", F.col("spot")).otherwise(F.col("premium")))


def pack_legs(legs: DataFrame, by=("id", "structure")) -> DataFrame:
    """One row per structure with its legs as an array (a future without entry price enters at the spot)."""
    prem = F.when((F.col("opt_type") == "FUT") & ~F.coalesce(F.col("premium") > 0, F.lit(False)), F.col("spot")).otherwise(F.col("premium"))
    leg = F.struct("leg", "opt_type", "side", "strike", prem.alias("premium"), (F.col("lots") * F.col("lot_size")).alias("units"), "leg_days", "iv")
    return legs.groupBy(*by).agg(F.first("spot").alias("spot"), F.array_sort(F.collect_list(leg)).alias("legs"))


def _sign(x) -> Column:
    return F.when(x["side"] == "BUY", 1e0).otherwise(-1e0)


def _expiry_value(x, s) -> Column:
    return F.when(x["opt_type"] == "FUT", s).otherwise(intrinsic(x["opt_type"], s, x["strike"]))


def payoff_at(legs: Column, s: Column) -> Column:
    """Expiry P&L of packed legs at underlying price ``s``."""
    return F.aggregate(legs, F.lit(0e0), lambda a, x: a + _sign(x) * (_expiry_value(x, s) - x["premium"]) * x["units"])


def leg_payoff(df: DataFrame, s: Column) -> DataFrame:
    """Per-unit expiry payoff of each leg row at price ``s``."""
    val = F.when(F.col("opt_type") == "FUT", s).otherwise(intrinsic(F.col("opt_type"), s, F.col("strike")))
    return df.withColumn("payoff", F.when(F.col("side") == "BUY", 1e0).otherwise(-1e0) * (val - F.col("premium")))


def _options(legs):
    return F.filter(legs, lambda x: x["opt_type"] != "FUT")


def payoff_curve(packed: DataFrame, points: int = 240, compiled_legs: int = 4) -> DataFrame:
    """P&L on points + 1 evenly spaced spots; the window reaches down to 0 when the payoff still slopes there.

    Structures of up to ``compiled_legs`` legs have them as plain columns before the points multiply the rows, so their payoff is compiled arithmetic.
    Longer ones are opened leg by leg and summed by point.
    """
    strikes = F.transform(_options(F.col("legs")), lambda x: x["strike"])
    slope = F.aggregate("legs", F.lit(0e0), lambda a, x: a + F.when(x["opt_type"] == "PE", -_sign(x) * x["units"])
                        .when(x["opt_type"] == "FUT", _sign(x) * x["units"]).otherwise(0e0))
    lo = F.when(F.abs(slope) > 1e-9, 0e0).otherwise(F.least(F.col("spot") * 7e-1, F.array_min(strikes)) * 9.5e-1)
    hi = F.greatest(F.col("spot") * 1.3e0, F.array_max(strikes)) * 1.05e0
    rest = [c for c in packed.columns if c != "legs"]

    def at_points(x: DataFrame) -> DataFrame:
        x = x.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points))))
        return x.withColumn("s", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / float(points))

    legs = [F.get("legs", F.lit(i)) for i in range(compiled_legs)]
    few = packed.filter(F.size("legs") <= compiled_legs).select(
        *rest, lo.alias("_lo"), hi.alias("_hi"),
        *[F.when(g.isNull(), 0e0).otherwise(_sign(g) * g["units"]).alias(f"_q{i}") for i, g in enumerate(legs)],
        *[F.coalesce(g["opt_type"], F.lit("FUT")).alias(f"_t{i}") for i, g in enumerate(legs)],
        *[F.coalesce(g["strike"], F.lit(0e0)).alias(f"_k{i}") for i, g in enumerate(legs)],
        *[F.coalesce(g["premium"], F.lit(0e0)).alias(f"_p{i}") for i, g in enumerate(legs)])
    val = " + ".join(f"_q{i} * (case _t{i} when 'FUT' then s when 'CE' then greatest(s - _k{i}, 0e0) else greatest(_k{i} - s, 0e0) end - _p{i})" for i in range(compiled_legs))
    few = at_points(few).select(*rest, "point", "s", F.expr(val).alias("pnl"))
    many = packed.filter(F.size("legs") > compiled_legs).select(*rest, lo.alias("_lo"), hi.alias("_hi"), F.explode("legs").alias("_g"))
    g = F.col("_g")
    one = _sign(g) * (F.when(g["opt_type"] == "FUT", F.col("s")).otherwise(intrinsic(g["opt_type"], F.col("s"), g["strike"])) - g["premium"]) * g["units"]
    many = at_points(many).groupBy(*rest, "point", "s").agg(F.sum(one).alias("pnl"))
    return few.unionByName(many)


def payoff_profile(packed: DataFrame, points: int = 240, by=("structure",)) -> DataFrame:
    """The curves of ``payoff_curve`` summed up per ``by`` and point: (by, point, n, pnl, worst, best).

    Tasks add whole curves as arrays and send one row per group and point, so the points of single curves are never rows.
    """

    def rows(batches):
        held: dict[tuple, list[np.ndarray]] = {}

        def out():
            keys = list(held)
            at = pa.array(np.repeat(np.arange(len(keys)), points + 1))
            cols = [pa.array([k[i] for k in keys], types[i]).take(at) for i in range(len(by))]
            nums = [pa.array(np.concatenate([held[k][i] for k in keys]), from_pandas=True) for i in range(5)]
            batch = pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(points + 1), len(keys)), pa.int32()), *nums], names)
            held.clear()
            return batch

        for b in batches:
            types = [b.schema.field(c).type for c in by]
            legs = A.Legs(b)
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            code = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            codes = np.array([code[k] for k in keys], dtype=np.int64)
            order, groups = np.argsort(codes, kind="stable"), list(code)
            for cut in A.slices(len(order), points + 1):
                rows_ = order[cut]
                v = A.curve(legs.rows(rows_), points)
                starts = np.flatnonzero(np.r_[True, np.diff(codes[rows_]) != 0])
                for a, z in zip(starts, [*starts[1:], len(rows_)], strict=True):
                    k, w = groups[codes[rows_[a]]], v[a:z]
                    good = ~np.isnan(w)
                    low, high = np.fmin.reduce(w, axis=0), np.fmax.reduce(w, axis=0)
                    new = [np.full(points + 1, z - a), good.sum(axis=0), np.where(good, w, 0e0).sum(axis=0), low, high]
                    old = held.get(k)
                    held[k] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.fmin(old[3], low), np.fmax(old[4], high)]
            if len(held) > 1000:
                yield out()
        if held:
            yield out()

    schema = StructType([*(packed.schema[c] for c in by), *StructType.fromDDL("point int, n bigint, valued bigint, total double, worst double, best double").fields])
    names = schema.names
    x = packed.select(*by, *[c for c in ("spot", "legs") if c not in by]).mapInArrow(rows, schema)
    return x.groupBy(*by, "point").agg(F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("valued"), F.lit(0))).alias("pnl"), F.min("worst").alias("worst"), F.max("best").alias("best"))


def right_slope(legs: Column) -> Column:
    return F.aggregate(legs, F.lit(0e0), lambda a, x: a + F.when(x["opt_type"] == "PE", 0e0).otherwise(_sign(x) * x["units"]))


def payoff_unbounded(packed: DataFrame) -> DataFrame:
    sl = right_slope(F.col("legs"))
    return packed.withColumn("unbounded_profit", sl > 1e-9).withColumn("unbounded_loss", sl < -1e-9)


def with_breakpoints(packed: DataFrame) -> DataFrame:
    """Adds ``pts``: sorted distinct prices where the expiry payoff can bend, and ``far`` beyond all of them."""
    strikes = F.transform(_options(F.col("legs")), lambda x: x["strike"])
    entries = F.transform(F.filter("legs", lambda x: (x["opt_type"] == "FUT") & (x["premium"] > 0)), lambda x: x["premium"])
    kinks = F.concat(strikes, entries)
    far = F.greatest(F.col("spot"), F.coalesce(F.array_max(kinks), F.lit(0e0))) * 3 + 1e1
    x = packed.withColumn("far", far)
    pts = F.concat(F.array(F.lit(0e0), F.col("spot"), F.col("far")), kinks)
    return x.withColumn("pts", F.array_sort(F.array_distinct(F.filter(pts, lambda p: p >= 0))))


def payoff_extremes(packed: DataFrame) -> DataFrame:
    """Largest profit and loss at the breakpoints; null stands for unbounded."""
    x = payoff_unbounded(with_breakpoints(packed))
    x = x.withColumn("_v", F.transform("pts", lambda p: payoff_at(F.col("legs"), p)))
    return x.withColumn("max_profit", F.when(~F.col("unbounded_profit"), F.array_max("_v"))) \
            .withColumn("max_loss", F.when(~F.col("unbounded_loss"), F.array_min("_v"))).drop("_v")


def breakevens(packed: DataFrame) -> DataFrame:
    """Distinct zero crossings (two decimals): inside segments, and at kinks where the sign flips."""

    def rows(batches):
        for b in batches:
            n, found = A.breakevens(A.Legs(b))
            at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(found))], [*b.schema.names, "breakevens"])

    return packed.mapInArrow(rows, StructType([*packed.schema.fields, StructField("breakevens", ArrayType(DoubleType()))]))


def _several_expiries(packed: DataFrame, by) -> DataFrame:
    days = F.transform(_options(F.col("legs")), lambda x: x["leg_days"])
    return packed.filter(F.size(F.array_distinct(days)) > 1).select(*by, "spot", "legs")


def _by_batch(x: DataFrame, by, columns: str, width: int, fn) -> DataFrame:
    """``fn(legs) -> arrays`` over slices of the structures: one row per structure with ``by`` and ``columns``."""

    def rows(batches):
        for b in batches:
            legs, parts = A.Legs(b), []
            for cut in A.slices(len(legs.spot), width):
                parts.append(fn(legs.rows(cut)))
            if parts:
                cols = [pa.array(np.concatenate(c), from_pandas=True) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), *cols], names)

    schema = StructType([*(x.schema[c] for c in by), *StructType.fromDDL(columns).fields])
    names = schema.names
    return x.mapInArrow(rows, schema)


def horizon_grid(packed: DataFrame, points: int = 600, rate: float = RATE, by=("id", "structure")) -> DataFrame:
    """P&L of multi-expiry structures at their nearest expiry, on a dense grid plus every strike: (by, s, pnl)."""
    x = _several_expiries(packed, by)

    def rows(batches):
        for b in batches:
            legs = A.Legs(b)
            for cut in A.slices(len(legs.spot), points + 1):
                h = A.Horizon(legs.rows(cut), points, rate)
                s = h.grid()
                there = ~np.isnan(s)
                at = pa.array(np.repeat(np.arange(cut.start, cut.stop), there.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in by), pa.array(s[there]), pa.array(h.at(s)[there], from_pandas=True)], [*by, "s", "pnl"])

    return x.mapInArrow(rows, StructType([*(x.schema[c] for c in by), StructField("s", DoubleType()), StructField("pnl", DoubleType())]))


def horizon_range(packed: DataFrame, points: int = 600, rate: float = RATE, by=("id", "structure")) -> DataFrame:
    """Points of ``horizon_grid`` with its highest and lowest P&L: (by, points, max_profit, max_loss); no grid row leaves its task."""

    def one(legs):
        h = A.Horizon(legs, points, rate)
        s = h.grid()
        v = h.at(s)
        return (~np.isnan(s)).sum(axis=1), np.fmax.reduce(v, axis=1), np.fmin.reduce(v, axis=1)

    return _by_batch(_several_expiries(packed, by), by, "points bigint, max_profit double, max_loss double", points + 1, one)


def horizon_extremes(packed: DataFrame, points: int = 600, rate: float = RATE, by=("id", "structure"), stages: int = 5, cuts: int = 16) -> DataFrame:
    """(by, max_profit, at_max, max_loss, at_min): the grid's extremes, refined between its points.

    The best point of the grid and its neighbours bracket an extreme.  Each stage cuts every bracket into ``cuts`` parts and keeps the two
    around the best price; brackets shrink by ``cuts / 2`` a stage.  The best value seen anywhere counts.
    """
    return _by_batch(_several_expiries(packed, by), by, "max_profit double, at_max double, max_loss double, at_min double", points + 1,
                     lambda legs: A.Horizon(legs, points, rate).extremes(stages, cuts))


def net_greeks(legs: DataFrame, by=("id", "structure"), rate: float = RATE) -> DataFrame:
    """Signed sum of greeks; a future counts delta 1 per unit; every leg uses its own days."""
    x = with_option(legs, F.col("opt_type"), F.col("spot"), F.col("strike"), F.col("leg_days") / 3.65e2, F.col("iv") / 1e2, greeks=True, r=rate)
    q = F.when(F.col("side") == "BUY", 1e0).otherwise(-1e0) * F.col("lots") * F.col("lot_size")
    fut = F.col("opt_type") == "FUT"
    return x.groupBy(*by).agg(*[F.sum(q * F.when(fut, 1e0 if n == "delta" else 0e0).otherwise(F.col(n))).alias(n) for n in GREEKS])


def net_premium(legs: DataFrame, by=("id", "structure")) -> DataFrame:
    """Credit (+) or debit (-) of the option legs."""
    v = F.when(F.col("side") == "SELL", 1e0).otherwise(-1e0) * F.col("premium") * F.col("lots") * F.col("lot_size")
    return legs.groupBy(*by).agg(F.sum(F.when(F.col("opt_type") != "FUT", v).otherwise(0e0)).alias("net_premium"))


def chain_enrich(chain: DataFrame, *, grp="grp", rate: float = RATE) -> DataFrame:
    """Chain with greeks per quote and the at-the-money flag (nearest strike, the lower on a tie; none without spot).

    The nearest strike per chain is an aggregate joined back, so a chain may be of any size.
    """
    near = chain.filter("s > 0").groupBy(grp).agg(F.min_by("k", F.struct(F.abs(F.col("k") - F.col("s")), F.col("k"))).alias("_k"))
    x = with_option(chain, F.col("opt_type"), F.col("s"), F.col("k"), F.col("t"), F.col("vol"), greeks=True, r=rate).join(near, grp, "left")
    return x.withColumn("is_atm", F.coalesce(F.col("k") == F.col("_k"), F.lit(False))).drop("_k")


# ---- option-selling cycles -------------------------------------------------------------------------------------------

HOLD, FIRST = 21, 20
BROKERAGE, SETTLE_STT = 2e1, 1.25e-3

# fixed values: short structures of a monthly cycle as (name, legs); leg = (type, side, strike / spot, lots)
CYCLE_STRUCTURES = (
    ("short_straddle", (("CE", "SELL", 1e0, 1), ("PE", "SELL", 1e0, 1))),
    ("short_strangle", (("CE", "SELL", 1.04e0, 1), ("PE", "SELL", 9.6e-1, 1))),
    ("iron_condor", (("CE", "SELL", 1.03e0, 1), ("CE", "BUY", 1.06e0, 1), ("PE", "SELL", 9.7e-1, 1), ("PE", "BUY", 9.4e-1, 1))),
)


def option_cycles(bars: DataFrame, strike_step: float, *, key="sym", ts="d") -> DataFrame:
    """Monthly cycles per series: (sym, cycle, i, entry_d, expiry_d in days, structure, legs).

    Entries sit on bars 20 + 21 k with two more bars to come.  An expiry past the data is extrapolated from the mean
    bar gap.  A structure whose legs collapse onto one (strike, type) is left out.
    """
    w, whole = Window.partitionBy(key).orderBy(ts), Window.partitionBy(key)
    day = F.unix_date(ts).cast("double")
    x = bars.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)) \
        .withColumn("_t", day).withColumn("_x", F.lead(day, HOLD).over(w))
    x = x.withColumn("_t0", F.min("_t").over(whole)).withColumn("_t1", F.max("_t").over(whole))
    x = x.filter((F.col("i") >= FIRST) & ((F.col("i") - FIRST) % HOLD == 0) & (F.col("i") + 2 < F.col("n")))
    gap = F.greatest((F.col("_t1") - F.col("_t0")) / (F.col("n") - 1), F.lit(1e0 / 8.64e7))
    exp = F.coalesce("_x", F.greatest(F.col("_t") + HOLD * gap, F.col("_t1") + gap))
    structs = F.array(*[F.struct(F.lit(name).alias("structure"), F.array(*[
        F.struct(F.lit(t).alias("opt_type"), F.lit(s).alias("side"), (F.floor(F.col("c") * m / strike_step + 5e-1) * strike_step).cast("double").alias("strike"), F.lit(q).alias("lots"))
        for t, s, m, q in legs]).alias("legs")) for name, legs in CYCLE_STRUCTURES])
    y = x.select(key, ((F.col("i") - FIRST) / HOLD).cast("bigint").alias("cycle"), "i", "n", F.col("_t").alias("entry_t"), exp.alias("expiry_t"),
                 F.col("c").alias("entry_c"), F.inline(structs))
    spots = F.transform("legs", lambda g: F.concat_ws(":", g["strike"].cast("string"), g["opt_type"]))
    return y.filter(F.size(F.array_distinct(spots)) == F.size("legs"))


def option_cycle_marks(bars: DataFrame, strike_step: float, *, premium: list[float] = [1.2e0], lot_size: int = 75, key="sym", ts="d",
                       rate: float = RATE) -> DataFrame:
    """P&L of every cycle at every bar it lives: (sym, structure, premium, cycle, i, pnl, settled, fees, close_cost).

    Legs are sold or bought at model price with half spread and charges, marked to model (floor 0.05) and settled at
    intrinsic value on the expiry bar.  A cycle's bars are generated from its index and joined by equality.  ``fees``: brokerage and settlement tax up to
    the bar; ``close_cost``: on the series' last bar, what closing a cycle that is still open costs: spread, charges and brokerage.
    """
    w = Window.partitionBy(key).orderBy(ts)
    marks = with_indicators(bars.select(key, ts, "c"), {"_rv": ("realized_vol", 20)}, key=key, ts=ts) \
        .select(key, (F.row_number().over(w) - 1).alias("b"), F.unix_date(ts).cast("double").alias("bt"), F.col("c").alias("bc"), "_rv")
    cyc = option_cycles(bars, strike_step, key=key, ts=ts)
    ends = F.least(F.col("i") + HOLD, F.col("n") - 1)
    entry = marks.select(key, F.col("b").alias("i"), F.col("_rv").alias("_erv"))
    prem = F.explode(F.array(*[F.lit(p) for p in premium])).alias("premium")
    cyc = cyc.join(entry, [key, "i"]).select("*", prem).withColumn("leg", F.explode("legs"))
    left = F.greatest(F.col("expiry_t") - F.col("entry_t"), F.lit(1e0)) / 3.65e2
    cyc = with_option(cyc, F.col("leg.opt_type"), F.col("entry_c"), F.col("leg.strike"), left, F.greatest(F.lit(8e-2), F.col("_erv") * F.col("premium")),
                      price="_entry", r=rate)
    cyc = cyc.withColumn("leg", F.col("leg").withField("entry", F.col("_entry"))).drop("legs", "_entry")
    x = cyc.withColumn("b", F.explode(F.sequence("i", ends))).join(marks, [key, "b"])
    floor = F.lit(8e-2)
    typ, k, units = F.col("leg.opt_type"), F.col("leg.strike"), F.col("leg.lots") * lot_size
    t1 = F.greatest(F.col("expiry_t") - F.col("bt"), F.lit(0e0)) / 3.65e2
    x = with_option(x, typ, F.col("bc"), k, t1, F.greatest(floor, F.col("_rv") * F.col("premium")), price="_mark", r=rate)
    paid, mark = option_fill_price(F.col("leg.side"), F.col("leg.entry"), cost_model("index_option")), F.greatest(F.col("_mark"), F.lit(5e-2))
    settled = F.col("bt") >= F.col("expiry_t")
    stt = F.when(settled & (F.col("leg.side") == "BUY"), SETTLE_STT * intrinsic(typ, F.col("bc"), k) * units).otherwise(0e0)
    sign = F.when(F.col("leg.side") == "BUY", 1e0).otherwise(-1e0)
    pnl = sign * (mark - paid) * units - BROKERAGE - stt
    back = option_fill_price(F.when(F.col("leg.side") == "BUY", "SELL").otherwise("BUY"), mark, cost_model("index_option"))
    closing = ~settled & (F.col("b") == F.col("n") - 1)
    return x.groupBy(key, "structure", "premium", "cycle", "b").agg(
        F.sum(pnl).alias("pnl"), F.bool_or(settled).alias("settled"), F.sum(BROKERAGE + stt + F.when(closing, BROKERAGE).otherwise(0e0)).alias("fees"),
        F.sum(F.when(closing, sign * (mark - back) * units + BROKERAGE).otherwise(0e0)).alias("close_cost"))


def cycle_curve(marks: DataFrame, bars: DataFrame, cash: float = 1e6, *, key="sym", ts="d") -> DataFrame:
    """Equity of every series, structure and premium at every bar: cash, closed cycles and the open one at its mark; the last bar pays its closing."""
    spec = [key, "structure", "premium"]
    net = F.col("pnl") - F.col("close_cost")
    step = net - F.coalesce(F.lag(net).over(Window.partitionBy(*spec, "cycle").orderBy("b")), F.lit(0e0))
    steps = marks.withColumn("_s", step).groupBy(*spec, "b").agg(F.sum("_s").alias("_s"))
    line = bars.select(key, ts, (F.row_number().over(Window.partitionBy(key).orderBy(ts)) - 1).alias("b"))
    x = marks.select(*spec).distinct().join(line, key).join(steps, [*spec, "b"], "left")
    run = Window.partitionBy(*spec).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    return x.select(*spec, ts, (cash + F.sum(F.coalesce("_s", F.lit(0e0))).over(run)).alias("eq"))


def vol_premium_grid(marks: DataFrame, bars: DataFrame, cash: float = 1e6, *, key="sym", ts="d") -> DataFrame:
    """Per series, structure and premium: total P&L after closing what is open at the end, cycles, fees, and return, CAGR, Sharpe and drawdown of the curve."""
    spec = [key, "structure", "premium"]
    last = marks.groupBy(*spec, "cycle").agg(F.max_by(F.struct((F.col("pnl") - F.col("close_cost")).alias("p"), "fees"), "b").alias("z"))
    total = last.groupBy(*spec).agg(F.sum("z.p").alias("total_pnl"), F.count("*").alias("cycles"), F.sum("z.fees").alias("fees"))
    curve = cycle_curve(marks, bars, cash, key=key, ts=ts)
    return total.join(curve_metrics(curve, by=tuple(spec), ts=ts, names=["total_return_pct", "cagr_pct", "sharpe", "max_drawdown_pct"]), spec)


def remark_positions(pos: DataFrame, rate: float = RATE) -> DataFrame:
    """New mark of option positions from the latest underlying and their stamped volatility (floor 0.05).

    ``pos``: opt_type, spot (null: left out), strike, days_left, iv.
    """
    x = with_option(pos.filter("spot > 0 and iv > 0"), F.col("opt_type"), F.col("spot"), F.col("strike"),
                    F.greatest(F.col("days_left"), F.lit(0e0)) / 3.65e2, F.col("iv"), price="mark", r=rate)
    return x.withColumn("mark", F.greatest("mark", F.lit(5e-2)))


def portfolio_greeks(pos: DataFrame, *, by="acct", rate: float = RATE) -> DataFrame:
    """Net greeks of held futures and options per account; an option's volatility is recovered from its last price."""
    x = pos.filter("qty <> 0 and kind <> 'EQ'")
    x = x.withColumn("_iv", F.when(F.col("kind") == "OPT", implied_vol(F.col("opt_type"), F.col("last"), F.col("spot"), F.col("k"), F.col("t"), rate)))
    x = with_option(x, F.col("opt_type"), F.col("spot"), F.col("k"), F.col("t"), F.col("_iv"), greeks=True, r=rate)
    fut, ok = F.col("kind") == "FUT", F.col("_iv").isNotNull()
    return x.groupBy(by).agg(*[F.sum(F.when(fut, F.col("qty") * (1e0 if n == "delta" else 0e0)).when(ok, F.col(n) * F.col("qty")).otherwise(0e0)).alias(n) for n in GREEKS])
