"""Leaderboards, fitness and walk-forward selection over curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.align import align_grid, asof, numbered, trailing_returns
from barlattice.operators.metrics import RF, curve_metrics
from barlattice.operators.scan import CHUNK, pin_chunks, prefix
from barlattice.session import pin

MIN_RETURNS, MIN_HISTORY, REPICK = 20, 252, 63


def leaderboard(curve: DataFrame, position: DataFrame | None = None, *, by="spec_id", ts="d", eq="eq") -> DataFrame:
    """Summary, trailing returns and position label per spec, ranked by last-bar then lifetime return."""
    m = curve_metrics(curve, by=(by,), ts=ts, eq=eq, names=["sharpe", "max_drawdown_pct", "final_equity"])
    x = m.join(trailing_returns(curve, by=by, ts=ts, eq=eq), by)
    x = x.withColumn("position", F.lit("flat")) if position is None else \
        x.join(position, by, "left").withColumn("position", F.coalesce("position", F.lit("flat")))
    return ordered(x, [F.desc_nulls_last("r1d"), F.desc_nulls_last("rmax"), F.asc(by)])


def ordered(board: DataFrame, order: list[Column], out="rk") -> DataFrame:
    """Numbers a board by a total order: range partitions in that order, numbers inside each, and one count per partition in front."""
    cut = pin(board).repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = cut.groupBy(CHUNK).agg(F.count("*").alias("_n")).select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    x = cut.withColumn(out, F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order))).join(counts, CHUNK)
    return x.select(*board.columns, (F.col(out) + F.col("_o")).cast("int").alias(out))


def sort_nulls_last(board: DataFrame, column: str, descending: bool = True, *, name="spec_id") -> DataFrame:
    """Any column in either direction; rows without a value come last, ties by name."""
    c = F.col(column)
    return ordered(board, [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(name).asc()])


def expanding_sharpe(curve: DataFrame, *, by="spec_id", ts="d", eq="eq", rf=RF) -> DataFrame:
    """Excess Sharpe from the start to each bar; null with fewer than 20 returns, 0 without variation."""
    w = Window.partitionBy(by).orderBy(ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prev = F.lag(eq).over(w)
    x = curve.withColumn("_x", F.when(prev > 0, F.col(eq) / F.nullif(prev, F.lit(0e0)) - 1 - rf / 252))
    sd = F.stddev_samp("_x").over(run)
    v = F.when(sd > 0, F.avg("_x").over(run) / F.nullif(sd, F.lit(0e0)) * F.lit(2.52e2 ** 0.5)).otherwise(0e0)
    return x.withColumn("xs", F.when(F.count("_x").over(run) >= MIN_RETURNS, v)).drop("_x")


def _repicks(bars: DataFrame, repick: int, last: int) -> DataFrame:
    """Bars on which a pick is made: the first eligible one, then each time the first eligible one at least ``repick`` bars later.

    ``bars``: (i, ok) of the whole timeline.  Every bar points to the next pick after a pick on it; the picks are what the first one reaches, found by
    doubling the pointers: as many rounds as the number of picks has binary digits, each an equality join over the timeline.
    """
    w = Window.partitionBy(F.floor(F.col("i") / 4096)).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    local = bars.withColumn("_b", F.floor(F.col("i") / 4096)).withColumn("_next", F.min(F.when(F.col("ok"), F.col("i"))).over(w))
    behind = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per 4,096 bars
    blocks = local.groupBy("_b").agg(F.min("_next").alias("_f")).select("_b", F.min("_f").over(behind).alias("_after"))
    first = pin(local.join(blocks, "_b").select("i", F.coalesce("_next", "_after").alias("to")).filter("to is not null"))  # first eligible bar from i on
    jump = pin(first.select((F.col("i") - repick).alias("i"), "to").filter("i >= 0"))
    reached = first.agg(F.min("to").alias("i")).filter("i is not null")
    for _ in range(max(1, (last // repick + 1).bit_length())):
        more = reached.join(jump, "i").select(F.col("to").alias("i"))
        reached = pin(reached.union(more).distinct())
        jump = pin(jump.join(jump.select(F.col("i").alias("to"), F.col("to").alias("_t")), "to").select("i", F.col("_t").alias("to")))
    return reached


def champion_walk_forward(curves: DataFrame, bench: DataFrame, *, by="spec_id", ts="d", eq="eq", repick=REPICK,
                          min_history=MIN_HISTORY) -> DataFrame:
    """Follow the best point-in-time Sharpe, re-picked every ``repick`` bars: (gi, ts, pick, followed, ret, eq).

    Curves are aligned to the benchmark's timeline.  Bar i earns the return of the curve picked before it.  A re-pick that finds no candidate is tried
    again at the next bar.
    """
    grid = align_grid(curves, bench.select(ts, F.lit(None).alias(by)), key=by, ts=ts, px=eq, before_listing=False)
    slots = pin(numbered(bench.select(ts).distinct(), ts, "i"))
    g = grid.filter(F.col(by).isNotNull()).join(slots, ts).select("i", ts, by, F.col("px").alias("a"))
    g = g.withColumn("first_i", F.min(F.when(F.col("a") > 0, F.col("i"))).over(Window.partitionBy(by)))
    w = Window.partitionBy(by).orderBy("i")
    g = expanding_sharpe(g, by=by, ts="i", eq="a").withColumn("rel", F.when(F.lag("a").over(w) > 0, F.col("a") / F.lag("a").over(w)))
    g = pin(g)  # read by the pick and by the return branch
    cand = g.filter((F.col("a") > 0) & (F.col("i") - F.col("first_i") >= min_history) & F.col("xs").isNotNull())
    # highest Sharpe wins, the first curve on a tie
    best = pin(cand.groupBy("i").agg(F.min_by(by, F.struct(-F.col("xs"), F.col(by))).alias("best")))
    last = slots.agg(F.max("i").alias("n")).first()["n"] or 0  # one row
    picks = _repicks(slots.join(best.select("i", F.lit(True).alias("ok")), "i", "left").select("i", F.coalesce("ok", F.lit(False)).alias("ok")), repick, last)
    t = slots.join(picks.join(best, "i").select("i", F.col("best").alias("pick")), "i", "left").withColumn("_all", F.lit(0))
    # bars of the calendar: the last pick and the grown value are split scans
    t = prefix(pin_chunks(t, ["_all"], ["i"]), ["_all"], ["i"], lasts={"_cur": F.col("pick")}).drop(CHUNK)
    t = t.filter("_cur is not null").join(t.select((F.col("i") + 1).alias("i"), F.col("_cur").alias("followed")), "i", "left")
    t = t.join(g.select("i", F.col(by).alias("followed"), "rel"), ["i", "followed"], "left").withColumn("_g", F.ln(F.coalesce("rel", F.lit(1e0))))
    t = prefix(pin_chunks(t, ["_all"], ["i"]), ["_all"], ["i"], sums={"_logs": F.col("_g")})
    return t.select(F.col("i").alias("gi"), ts, "pick", "followed", F.exp("_logs").alias("eq"))


def follow_timeline(track: DataFrame, *, ts="d") -> DataFrame:
    """Collapsed picks, with the number of distinct picks and of re-picks; the pick before is the one followed on the bar of the new one."""
    picks = track.filter("pick is not null")
    distinct, count = picks.agg(F.countDistinct("pick")).scalar(), picks.agg(F.count("*")).scalar()
    x = picks.filter(F.col("followed").isNull() | (F.col("followed") != F.col("pick")))
    return x.select(ts, "pick", distinct.alias("followed_count"), count.alias("switches"))


def benchmark_series(curves: DataFrame, bench: DataFrame, *, by="spec_id", ts="d", eq="eq", px="c") -> DataFrame:
    """The benchmark beside every curve, rebased to the curve's first value: (by, ts, eq, bench_eq).

    A date on which the benchmark has no price carries its last one; before its first price there is nothing to rebase and the curve's start stands.
    """
    cols = [by, ts, eq]
    x = asof(curves.select(*cols, F.lit(0).alias("_k")), bench.filter(F.col(px) > 0).select(F.lit(0).alias("_k"), ts, F.col(px).alias("_p")), by=["_k"], ts=ts, values=["_p"], split=True)
    first = x.groupBy(by).agg(F.min_by(eq, ts).alias("_e0"), F.min_by("_p", ts).alias("_p0"))
    return x.join(first, by).select(*cols, F.coalesce(F.col("_e0") * F.col("_p") / F.col("_p0"), F.col("_e0")).alias("bench_eq"))


def common_window(curves: DataFrame, other: DataFrame, *, by="spec_id", ts="d", eq="eq", px="c", min_days=365) -> DataFrame:
    """Every curve against a second benchmark over the window that both have: (by, started, return_pct, other_pct, edge_pct).

    The window starts at the curve's first bar on which the second benchmark has a price and ends at the curve's last; shorter than ``min_days`` says
    nothing and is left out.
    """
    x = asof(curves.select(by, ts, eq, F.lit(0).alias("_k")), other.filter(F.col(px) > 0).select(F.lit(0).alias("_k"), ts, F.col(px).alias("_p")), by=["_k"], ts=ts, values=["_p"], split=True)
    both = x.filter(F.col("_p").isNotNull() & (F.col(eq) > 0))
    g = both.groupBy(by).agg(F.min(ts).alias("started"), F.max(ts).alias("_t1"), *[f(c, ts).alias(n) for c, f, n in ((eq, F.min_by, "_e0"), (eq, F.max_by, "_e1"), ("_p", F.min_by, "_p0"), ("_p", F.max_by, "_p1"))])
    own, its = F.round((F.col("_e1") / F.col("_e0") - 1) * 1e2, 2), F.round((F.col("_p1") / F.col("_p0") - 1) * 1e2, 2)
    return g.filter(F.date_diff("_t1", "started") >= min_days).select(by, "started", own.alias("return_pct"), its.alias("other_pct"), F.round(own - its, 2).alias("edge_pct"))


def benchmark_rebased(curves: DataFrame, bench: DataFrame, *, by="spec_id", ts="d", eq="eq", px="c", min_days=365) -> DataFrame:
    """Per curve: own and benchmark return from its first bar, and the edge; the edge needs a year in common."""
    c = curves.groupBy(by).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.min_by(eq, ts).alias("e0"), F.max_by(eq, ts).alias("e1"))
    # the benchmark as of every distinct end date (dates of the calendar), then two equality joins
    b = bench.select(F.lit(0).alias("_k"), F.col(ts).alias("_t"), F.col(px).alias("_p")).filter("_p > 0")
    ends = c.select(F.lit(0).alias("_k"), F.col("t0").alias("_t")).union(c.select(F.lit(0), "t1")).distinct()
    at = asof(ends, b, by=["_k"], ts="_t", values=["_p"])
    x = c.join(at.select(F.col("_t").alias("t0"), F.col("_p").alias("b0")), "t0").join(at.select(F.col("_t").alias("t1"), F.col("_p").alias("b1")), "t1")
    ret, bret = (F.col("e1") / F.col("e0") - 1) * 1e2, (F.col("b1") / F.col("b0") - 1) * 1e2
    ok = F.date_diff("t1", "t0") >= min_days
    return x.select(by, ret.alias("return_pct"), bret.alias("bench_pct"), F.when(ok, ret - bret).alias("edge_pct"))


def track_live_split(trades: DataFrame, boundary: str, *, ts="d") -> DataFrame:
    """Every trade, tagged live when after the deployment boundary."""
    return trades.withColumn("live", F.col(ts) > F.lit(boundary).cast("date"))


def fitness(sharpe: Column, total_return_pct: Column) -> Column:
    return sharpe * 1e3 + total_return_pct


def shared_fitness(specs: DataFrame, *, raw="raw", kind="kind", arch="archetype", name="spec_id") -> DataFrame:
    """Raw fitness divided by 1 + half the number of better rows of the same class; unchanged without multi-name kinds."""
    multi = specs.agg(F.coalesce(F.max(F.col(kind).isin("BASKET", "PAIRS")), F.lit(False))).scalar()
    better = F.rank().over(Window.partitionBy(arch).orderBy(F.col(raw).desc())) - 1
    x = specs.withColumn("_m", multi).withColumn("better", better)
    x = x.withColumn("shared", F.when(F.col("_m"), F.col(raw) / (1 + 5e-1 * F.col("better"))).otherwise(F.col(raw))).drop("_m")
    return ordered(x, [F.col("shared").desc(), F.col(name).asc()])


def dedupe_specs(specs: DataFrame, arrays: list[str], scalars: list[str], *, order="spec_id") -> DataFrame:
    """One spec per canonical key (sorted arrays, explicit nulls); the first by ``order`` stays."""
    key = F.to_json(F.struct(*[F.array_sort(F.col(a)).alias(a) for a in arrays], *scalars), {"ignoreNullFields": "false"})
    cols = specs.columns
    return specs.withColumn("_k", F.sha2(key, 256)).groupBy("_k").agg(F.min_by(F.struct(*cols), order).alias("z")).select("z.*")


def robust_rank(board: DataFrame, references: list[str], *, by="strategy") -> DataFrame:
    """Median return and Sharpe and worst drawdown of a strategy over symbols, and how many references it beats."""
    m = board.groupBy(by).agg(F.median("total_return_pct").alias("med_return"), F.median("sharpe").alias("med_sharpe"),
                              F.max("max_drawdown_pct").alias("worst_dd"))
    refs = m.filter(F.col(by).isin(*references)).agg(F.collect_list("med_return"))  # one value per reference
    x = m.withColumn("_rr", refs.scalar())
    beats = F.size(F.filter("_rr", lambda v: F.col("med_return") > v))
    return ordered(x.withColumn("beats", beats).drop("_rr"), [F.col("med_return").desc(), F.col(by).asc()])


def study_arms(board: DataFrame, controls: list[str], index: str, *, by="spec_id", value="sharpe") -> DataFrame:
    """Every arm of a study but its controls and the index: edge over the index and over the harder control, and the verdict on the latter."""
    at = lambda names: board.filter(F.col(by).isin(*names)).agg(F.max(value)).scalar()
    arms = board.filter(~F.col(by).isin(*controls, index))
    x = arms.withColumn("edge_index", F.col(value) - at([index])).withColumn("edge_universe", F.col(value) - at(controls))
    return x.select(by, value, "edge_index", "edge_universe", study_verdict(F.round("edge_universe", 6)).alias("verdict"))


def study_verdict(edge: Column) -> Column:
    return F.when(edge >= 1.5e-1, "beats-universe").when(edge >= 0, "matches-universe").otherwise("trails-universe")
