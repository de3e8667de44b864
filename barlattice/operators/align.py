"""Alignment, as-of joins, slicing and thinning of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.scan import pin_chunks, prefix

# fixed values: window lengths in days
TRAILING = {"r1w": 7e0, "r1m": 3.044e1, "r1y": 3.6525e2, "r3y": 1.09575e3, "r5y": 1.82625e3, "r10y": 3.6525e3}
TIER_DAYS = (31e0, 3.66e2, 1.83e3, 1e9)
CASH = 1e6


def _calendar_block(frame: DataFrame, ts: str) -> Column:
    """Blocks of neighbouring timestamps: months, or thousands of a number."""
    if frame.schema[ts].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return F.date_trunc("month", F.col(ts).cast("timestamp"))
    return F.floor(F.col(ts) / 1000)


def numbered(points: DataFrame, ts: str, out: str = "gi", total: str | None = None) -> DataFrame:
    """Distinct points of a timeline, numbered from 0: rows of a block by a window, blocks by their counts; no task sees all points."""
    x = points.withColumn("_b", _calendar_block(points, ts))
    blocks = x.groupBy("_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy("_b")  # one row per block
    blocks = blocks.select("_b", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
                           F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(ts)) - 1
    x = x.withColumn("_i", at).join(blocks, "_b")
    return x.select(*points.columns, (F.col("_i") + F.col("_o")).cast("int").alias(out), *([F.col("_n").cast("int").alias(total)] if total else []))


def master_timeline(*panels: DataFrame, ts="d") -> DataFrame:
    """Distinct timestamps of all panels, numbered: (ts, gi, n)."""
    x = panels[0].select(ts)
    for p in panels[1:]:
        x = x.unionByName(p.select(ts))
    return numbered(x.distinct(), ts, total="n")


def align_intervals(panel: DataFrame, master: DataFrame, *, key="sym", ts="d", px="c") -> DataFrame:
    """Every series on the common timeline, one row per bar: (key, px, gi, real_idx, _end), valid for the slots gi to _end - 1.

    An as-of panel in as many rows as there are bars; ``at_slots`` reads it where it is needed.
    """
    w = Window.partitionBy(key).orderBy("gi")
    x = panel.select(key, ts, px).join(master, ts)
    return x.select(key, px, "gi", (F.row_number().over(w) - 1).alias("real_idx"), F.coalesce(F.lead("gi").over(w), F.col("n")).alias("_end"))


def at_slots(intervals: DataFrame, slots: DataFrame, master: DataFrame) -> DataFrame:
    """The intervals' values at the slots asked for: the columns of ``intervals`` with ``gi`` of the slot; one row per series and slot inside.

    Each grid slot knows how many slots asked for lie before it, so an interval's slots are a range of numbers: equality joins only.
    """
    asked = slots.select("gi").distinct()
    marks = master.select("gi", "n").join(asked.withColumn("_hit", F.lit(1)), "gi", "left").withColumn("_b", F.floor(F.col("gi") / 4096))
    blocks = marks.groupBy("_b").agg(F.count("_hit").alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4,096 slots
    blocks = blocks.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.count("_hit").over(Window.partitionBy("_b").orderBy("gi").rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("_k", inside).join(blocks, "_b").select("gi", "_hit", (F.col("_k") + F.col("_o")).alias("_k"))
    whole = asked.agg(F.count("*")).scalar()
    cols = [c for c in intervals.columns if c not in ("gi", "_end")]
    x = intervals.join(marks.select("gi", F.col("_k").alias("_from")), "gi")
    x = x.join(marks.select(F.col("gi").alias("_end"), F.col("_k").alias("_to")), "_end", "left").withColumn("_to", F.coalesce("_to", whole))
    x = x.filter(F.col("_to") > F.col("_from")).select(*cols, F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_k"))
    return x.join(marks.filter("_hit = 1").select("gi", "_k"), "_k").select("gi", *cols)


def align_grid(panel: DataFrame, market: DataFrame | None = None, *, key="sym", ts="d", px="c",
               before_listing: bool = True) -> DataFrame:
    """Every series on the common timeline: price carried forward, ``real_idx`` of the bar it comes from.

    Each bar fills the grid slots up to the next bar of its series, so there is neither a cross join nor a fill window.
    """
    master = master_timeline(*([panel] if market is None else [panel, market]), ts=ts)
    x = align_intervals(panel, master, key=key, ts=ts, px=px)
    cells = x.select(key, F.explode(F.sequence("gi", F.col("_end") - 1)).alias("gi"), F.col(px).alias("px"), "real_idx")
    if before_listing:
        lead = x.filter((F.col("real_idx") == 0) & (F.col("gi") > 0))
        cells = cells.unionByName(lead.select(key, F.explode(F.sequence(F.lit(0), F.col("gi") - 1)).alias("gi"),
                                              F.lit(None).cast("double").alias("px"), F.lit(-1).alias("real_idx")))
    return cells.join(master.select("gi", ts), "gi").select("gi", ts, key, "px", "real_idx")


def asof(left: DataFrame, right: DataFrame, *, by: list[str], ts: str, values: list[str], split: bool = False,
         tie: list[str] | None = None) -> DataFrame:
    """Left rows with the right ``values`` of the latest row at or before their timestamp (null if none).

    Both sides are stacked and scanned once in time order; ``split`` cuts hot keys into range partitions.
    ``tie`` orders right rows of equal timestamp.
    """
    tie = tie or []
    cols = list(left.columns)
    val = F.struct(*[F.col(v) for v in values])
    lft = left.select(*by, ts, F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(tie)],
                      F.struct(*cols).alias("_l"), F.lit(None).cast(right.select(val.alias("v")).schema["v"].dataType).alias("_v"))
    rgt = right.select(*by, ts, F.lit(0).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(tie)],
                       F.lit(None).cast(left.select(F.struct(*cols).alias("l")).schema["l"].dataType).alias("_l"), val.alias("_v"))
    x = lft.unionByName(rgt)
    order = [ts, "_side", *[f"_o{i}" for i in range(len(tie))]]
    if split:
        x = prefix(pin_chunks(x, by, order), by, order, lasts={"_last": F.col("_v")})
    else:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return x.filter("_side = 1").select(*[F.col(f"_l.{c}").alias(c) for c in cols], *[F.col(f"_last.{v}").alias(v) for v in values])


def asof_close(keys: DataFrame, series: DataFrame, *, key="sym", ts="d", px="c", split=True) -> DataFrame:
    """Close at or before each key's time; null before the start or when not positive."""
    x = asof(keys, series, by=[key], ts=ts, values=[px], split=split)
    return x.withColumn(px, F.when(F.col(px) > 0, F.col(px)))


def slice_window(df, start=None, end=None, warmup_bars=0, *, key="sym", ts="d") -> DataFrame:
    """Bars of [start, end] plus ``warmup_bars`` bars before; ``is_scored`` marks the window itself."""
    x = df if end is None else df.filter(F.col(ts) <= F.lit(end).cast("date"))
    w = Window.partitionBy(key).orderBy(ts)
    x = x.withColumn("_i", F.row_number().over(w))
    inside = F.lit(True) if start is None else F.col(ts) >= F.lit(start).cast("date")
    first = F.min(F.when(inside, F.col("_i"))).over(Window.partitionBy(key))
    return x.withColumn("_f", first).filter(F.col("_i") >= F.col("_f") - warmup_bars) \
            .withColumn("is_scored", F.col("_i") >= F.col("_f")).drop("_i", "_f")


def clip_panel(df, warmup_from, start, end, *, ts="d") -> DataFrame:
    """Date clip of staggered series; scoring starts at the first common bar at or after ``start``."""
    x = df.filter(F.col(ts).between(F.lit(warmup_from).cast("date"), F.lit(end).cast("date")))
    return x.withColumn("is_scored", F.col(ts) >= F.lit(start).cast("date"))


def holdout_guard(df, cutoff, allow: bool = False, *, ts="d") -> DataFrame:
    """One row: last bar, cutoff, and whether the holdout would be touched without leave."""
    cut = F.lit(cutoff).cast("date")
    return df.agg(F.max(ts).alias("last_ts")).select(
        "last_ts", cut.alias("cutoff"), ((F.col("last_ts") > cut) & F.lit(not allow)).alias("locked"))


def trailing_returns(curve, *, by="spec_id", ts="d", eq="eq", cash=CASH, digits=2) -> DataFrame:
    """Percent return over each trailing window; null where history is too short."""
    whole = Window.partitionBy(by)
    w = Window.partitionBy(by).orderBy(ts)
    x = curve.select(by, ts, eq, F.max(ts).over(whole).alias("_lt"), F.lag(eq).over(w).alias("_pe"))
    age = F.date_diff("_lt", ts)
    last = F.max_by(eq, ts)

    def pct(base: Column) -> Column:
        v = F.when(base > 0, (last / F.nullif(base, F.lit(0e0)) - 1) * 1e2).otherwise((last - base) / cash * 1e2)
        return F.round(v, digits) + F.lit(0e0)

    prev = F.coalesce(F.max_by("_pe", ts), F.min_by(eq, ts))
    return x.groupBy(by).agg(
        pct(prev).alias("r1d"),
        *[F.when(F.max(age) >= days, pct(F.max_by(F.when(age >= days, F.col(eq)), F.when(age >= days, F.col(ts))))).alias(n)
          for n, days in TRAILING.items()],
        pct(F.min_by(eq, ts)).alias("rmax"))


def keep_index(i: Column, n: Column, points: int) -> Column:
    """Is 0-based index ``i`` of ``n`` among the points round(k (n-1)/(points-1))?  A filter, no join."""
    step = (n - 1) / F.lit(float(points - 1))
    lo, hi = F.floor(i / step), F.ceil(i / step)
    return (n <= points) | (F.floor(lo * step + 5e-1) == i) | (F.floor(hi * step + 5e-1) == i)


def downsample(curve, points, *, by=("spec_id",), ts="d") -> DataFrame:
    """At most ``points`` rows per curve, evenly spaced by index, endpoints kept."""
    w, whole = Window.partitionBy(*by).orderBy(ts), Window.partitionBy(*by)
    x = curve.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    return x.filter(keep_index(F.col("_i"), F.col("_n"), points)).drop("_i", "_n")


def curve_tiers(curve, points, *, by="spec_id", ts="d", eq="eq") -> DataFrame:
    """Trailing slices of increasing length, each thinned to ``points``, never fewer than two rows."""
    back = Window.partitionBy(by).orderBy(F.col(ts).desc())
    x = curve.select(by, ts, eq, F.row_number().over(back).alias("_b"),
                     F.date_diff(F.max(ts).over(Window.partitionBy(by)), ts).alias("_age"))
    tier = F.explode(F.array(*[F.lit(t) for t in TIER_DAYS])).alias("tier_days")
    x = x.select("*", tier).filter((F.col("_age") <= F.col("tier_days")) | (F.col("_b") <= 2))
    y = downsample(x, points, by=(by, "tier_days"), ts=ts)
    return y.select(by, "tier_days", ts, F.floor(F.col(eq) + 5e-1).cast("double").alias(eq))


def curve_window(tiers, windows: dict[str, float | None], *, by="spec_id", ts="d") -> DataFrame:
    """Points of the finest tier covering each window, cut to it; too long windows fall back to everything.

    A window is ``name -> days`` (None: everything).
    """
    span = tiers.groupBy(by).agg(F.date_diff(F.max(ts), F.min(ts)).alias("_span"))
    wins = F.explode(F.array(*[F.struct(F.lit(n).alias("win"), F.lit(d).cast("double").alias("_ms"))
                               for n, d in windows.items()]))
    plan = span.select(by, "_span", wins.alias("w")).select(
        by, F.col("w.win").alias("win"), F.when(F.col("w._ms") <= F.col("_span") * 1.05e0, F.col("w._ms")).alias("_ms"))
    cover = F.element_at(F.filter(F.array(*[F.lit(t) for t in TIER_DAYS]), lambda t: t >= F.coalesce(F.col("_ms"), F.lit(TIER_DAYS[-1]))), 1)
    plan = plan.withColumn("tier_days", cover)
    x = tiers.join(plan, [by, "tier_days"])
    back = Window.partitionBy(by, "win").orderBy(F.col(ts).desc())
    last = F.max(ts).over(Window.partitionBy(by, "win"))
    x = x.withColumn("_b", F.row_number().over(back)).withColumn("_age", F.date_diff(last, ts))
    return x.filter(F.col("_ms").isNull() | (F.col("_age") <= F.col("_ms")) | (F.col("_b") <= 2)).drop("_b", "_age", "_ms")


def compact_curve(curve, n_max, *, by="spec_id", ts="d") -> DataFrame:
    """Curves longer than ``n_max`` keep every second point of their older half."""
    w, whole = Window.partitionBy(by).orderBy(ts), Window.partitionBy(by)
    x = curve.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    keep = (F.col("_n") <= n_max) | (F.col("_i") >= F.floor(F.col("_n") / 2)) | (F.col("_i") % 2 == 0)
    return x.filter(keep).drop("_i", "_n")


def throttle_resample(df, seconds=30, *, key="acct", ts="ts", value="price", tie="event_id") -> DataFrame:
    """Last value of each fixed slot (slots are aligned to the clock, not to the first sample)."""
    slot = F.window(F.col(ts), f"{seconds} seconds")
    return df.groupBy(key, slot.alias("_w")).agg(F.max_by(value, F.struct(ts, tie)).alias(value)) \
             .select(key, F.col("_w.start").alias("slot"), value)


def ticks_to_bars(df, interval="1 hour", *, key="sym", ts="ts", price="price", tie="event_id") -> DataFrame:
    """Open, high, low, close and tick count per bar; aggregated map-side, so a hot symbol is no problem."""
    o = F.struct(ts, tie)
    g = df.groupBy(key, F.window(F.col(ts), interval).alias("_w")).agg(
        F.min_by(price, o).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"),
        F.max_by(price, o).alias("c"), F.count(price).alias("v"))
    return g.select(key, F.col("_w.start").alias("ts"), "o", "h", "l", "c", "v")


def range_change(quotes, bars, *, key="sym", ts="d", ltp="ltp") -> DataFrame:
    """Move of the latest price against the first plotted close; null without bars."""
    base = bars.groupBy(key).agg(F.min_by("c", ts).alias("_b"))
    x = quotes.join(base, key, "left")
    ok = F.col("_b") != 0
    return x.select(key, F.when(ok, F.col(ltp) - F.col("_b")).alias("change"),
                    F.when(ok, (F.col(ltp) - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0e0)) * 1e2).alias("change_pct"))
