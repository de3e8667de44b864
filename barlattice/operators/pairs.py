"""Pair screening and spread states on the aligned grid.

Pair statistics are computed in tiles: the universe is cut into blocks of names, each tile compares two blocks with
matrix arithmetic and emits only the pairs that pass the filters, for a choice of disjoint pairs only each name's best.
No join enumerates pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.returns import weight_returns
from barlattice.operators.scan import CHUNK, pin_chunks, prefix
from barlattice.session import pin

PHI_MAX = 9.7e-1


def formations(grid: DataFrame, lookback: int, every: int) -> DataFrame:
    """Formation slots: lookback, lookback + every, ... with the slot of the next one (null at the end)."""
    last = grid.agg(F.max("gi").cast("int").alias("m"))
    f = last.filter(F.col("m") >= lookback).select("m", F.explode(F.sequence(F.lit(lookback), F.col("m"), F.lit(every))).alias("f"))
    return f.select("f", F.when(F.col("f") + every <= F.col("m"), F.col("f") + every).alias("f_next"), "m")


def log_window(grid: DataFrame, lookback: int, every: int, *, key="sym") -> DataFrame:
    """Per formation and name the last ``lookback`` log prices, oldest first; names with a gap are left out.

    A slot serves at most ceil(lookback / every) formations, found by arithmetic instead of a range join.
    """
    k0 = F.greatest(F.ceil((F.col("gi") - lookback) / every), F.lit(0))
    k1 = F.floor((F.col("gi") - 1) / every)
    x = grid.filter("px > 0 and gi >= 1").filter(k1 >= k0).withColumn("_k", F.explode(F.sequence(k0, k1))).withColumn("f", (lookback + every * F.col("_k")).cast("int"))
    # a formation past the end of the grid cannot collect a full window and falls out below
    x = x.filter((F.col("gi") <= F.col("f")) & (F.col("gi") > F.col("f") - lookback))
    g = x.groupBy("f", key).agg(F.array_sort(F.collect_list(F.struct("gi", F.ln("px").alias("v")))).alias("z"))
    return g.filter(F.size("z") == lookback).select("f", key, F.transform("z", lambda e: e["v"]).alias("logs"))


PAIR_ROWS = 1 << 14  # pairs of a tile whose spreads are held at once


def _mutual(a: np.ndarray, b: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Which pairs (in the order score desc, a, b) are among the first ``keep`` of both their names."""
    def rank(of: np.ndarray) -> np.ndarray:
        order = np.argsort(of, kind="stable")
        start = np.flatnonzero(np.diff(of[order], prepend=-1))
        out = np.empty(len(of), np.int64)
        out[order] = np.arange(len(of)) - np.repeat(start, np.diff(start, append=len(of)))
        return out

    # a name of two blocks stands on both sides, so its pairs are counted over both
    names = np.concatenate([a, b])
    both = rank(names[np.arange(2 * len(a)).reshape(2, -1).T.ravel()]).reshape(-1, 2)
    return (both < keep).all(axis=1)


def _tile(pdf: pd.DataFrame, min_corr: float, keep: int | None) -> pd.DataFrame:
    pdf = pdf.sort_values("sym", kind="stable")
    bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    names, blk = pdf["sym"].to_numpy(), pdf["blk"].to_numpy()
    logs = np.vstack(pdf["logs"].to_numpy())
    rets = np.diff(logs, axis=1)
    dev = rets - rets.mean(axis=1, keepdims=True)
    norm = np.sqrt((dev * dev).sum(axis=1))
    with np.errstate(all="ignore"):
        rho = np.where(np.outer(norm, norm) > 0, dev @ dev.T / np.outer(norm, norm), 0.0)
    ok = np.triu(rho >= min_corr, 1)
    if bi != bj:
        ok &= blk[:, None] != blk[None, :]
    ia, ib = np.nonzero(ok)
    ld = logs - logs.mean(axis=1, keepdims=True)
    var = (ld * ld).sum(axis=1)
    beta, phi = np.empty(len(ia)), np.empty(len(ia))
    for lo in range(0, len(ia), PAIR_ROWS):
        s = slice(lo, lo + PAIR_ROWS)
        u, v = ia[s], ib[s]
        with np.errstate(all="ignore"):
            beta[s] = np.where(var[v] > 1e-12, np.einsum("ij,ij->i", ld[u], ld[v]) / var[v], np.nan)
            sp = logs[u] - beta[s, None] * logs[v]
            x, y = sp[:, :-1], sp[:, 1:]
            xd = x - x.mean(axis=1, keepdims=True)
            vx = (xd * xd).sum(axis=1)
            phi[s] = np.where(vx > 1e-12, (xd * (y - y.mean(axis=1, keepdims=True))).sum(axis=1) / vx, np.nan)
    rho = rho[ia, ib]
    if keep is not None:
        with np.errstate(all="ignore"):
            fit = np.flatnonzero((beta > 0) & (phi > -1) & (phi < PHI_MAX))
        score = rho[fit] * (1 - np.maximum(phi[fit], 0.0))
        fit = fit[np.lexsort((ib[fit], ia[fit], -score))]
        fit = fit[_mutual(ia[fit], ib[fit], score, keep)]
        ia, ib, rho, beta, phi = ia[fit], ib[fit], rho[fit], beta[fit], phi[fit]
    out = pd.DataFrame({"f": pdf["f"].iloc[0], "a": names[ia], "b": names[ib], "rho": rho, "beta": beta, "phi": phi})
    return out.astype({"f": "int32"})


def pair_stats(windows: DataFrame, min_corr: float, *, key="sym", names_per_block: int = 512, keep: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """(f, a, b, rho, beta, phi) of all pairs a < b with return correlation >= ``min_corr``.

    ``keep``: only pairs that can be traded and are among the best ``keep`` of both their names inside a tile leave it; the best ``keep`` of a name
    over all tiles are among them.  ``names``: a frame whose names are counted to size the blocks, by default ``windows``.
    """
    count = (windows if names is None else names).agg(F.approx_count_distinct(key)).scalar()
    x = windows.select("f", F.col(key).alias("sym"), "logs").withColumn("_n", F.greatest(F.lit(1), F.ceil(count / names_per_block)).cast("int"))
    x = x.withColumn("blk", F.pmod(F.xxhash64("sym"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    x = x.select("f", "sym", "logs", "blk", F.least("blk", "_o").alias("bi"), F.greatest("blk", "_o").alias("bj"))
    st = x.groupBy("f", "bi", "bj").applyInPandas(
        lambda pdf: _tile(pdf, min_corr, keep), "f int, a string, b string, rho double, beta double, phi double")
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return st.select("f", "a", "b", "rho", nan("beta"), nan("phi"))


def scored(stats: DataFrame) -> DataFrame:
    """Pairs with a positive hedge ratio and a mean-reverting spread, with their score."""
    x = stats.filter((F.col("beta") > 0) & (F.col("phi") > -1) & (F.col("phi") < PHI_MAX))
    return x.withColumn("score", F.col("rho") * (1 - F.greatest(F.col("phi"), F.lit(0e0))))


def rank_pairs(stats: DataFrame) -> DataFrame:
    """Scored pairs numbered per formation; the numbering is a split prefix sum, so a formation's pairs may be any number."""
    x = pin(scored(stats).withColumn("_down", -F.col("score")))
    order = ["_down", "a", "b"]
    return prefix(pin_chunks(x, ["f"], order), ["f"], order, sums={"rk": F.lit(1)}).drop(CHUNK, "_down")


def disjoint_pairs(cands: DataFrame, max_pairs: int) -> DataFrame:
    """Best pairs per formation, every name used once: the first ``max_pairs`` of the greedy choice by score, then names.

    Before its k-th pick the greedy rule has used 2 (k - 1) names, so a pair picked is among the first ``2 * max_pairs - 1`` of both its names: others go.
    Of what is left a pick blocks ``4 * max_pairs - 4`` other pairs at most, so the first ``max_pairs * (4 * max_pairs - 3)`` hold all picks.  Both bounds come
    from the number of picks alone; the rule itself then runs over that short list.
    """
    cols = [c for c in cands.columns if c != "rk"]
    x = cands.select(*cols)
    keep = 2 * max_pairs - 1
    of = x.select("f", "a", "b", "score", F.explode(F.array("a", "b")).alias("_name"))
    w = Window.partitionBy("f", "_name").orderBy(F.desc("score"), "a", "b")
    both = of.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).groupBy("f", "a", "b", "score").agg(F.count("*").alias("_n")).filter("_n = 2")
    w = Window.partitionBy("f").orderBy(F.desc("score"), "a", "b")
    short = both.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max_pairs * (2 * keep - 1)).select("f", "a", "b", "_k")
    lists = short.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("_k", "a", "b"))).alias("z"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<a:string,b:string>>").alias("got"))
    free = lambda s, p: (F.size(s["got"]) < max_pairs) & ~F.array_contains(s["used"], p["a"]) & ~F.array_contains(s["used"], p["b"])
    take = lambda s, p: F.struct(F.concat(s["used"], F.array(p["a"], p["b"])).alias("used"), F.concat(s["got"], F.array(F.struct(p["a"].alias("a"), p["b"].alias("b")))).alias("got"))
    picks = lists.select("f", F.posexplode(F.aggregate("z", start, lambda s, p: F.when(free(s, p), take(s, p)).otherwise(s), lambda s: s["got"])).alias("pick", "p"))
    picks = picks.select("f", (F.col("pick") + 1).alias("pick"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    return x.join(picks, ["f", "a", "b"]).select(*cols, "pick")


def spread_z(chosen: DataFrame, forms: DataFrame, grid: DataFrame, lookback: int) -> DataFrame:
    """z of each active pair's spread at every bar until the next formation, in its own trailing window."""
    px = grid.filter("px > 0").select("gi", "sym", F.ln("px").alias("lp"))
    x = chosen.select("f", "a", "b", "beta").join(forms, "f")  # formations: one row per cadence step
    end = F.coalesce(F.col("f_next") - 1, F.col("m"))
    x = x.withColumn("gi", F.explode(F.sequence(F.col("f") - lookback + 1, end)))
    x = x.join(px.select("gi", F.col("sym").alias("a"), F.col("lp").alias("_la")), ["gi", "a"], "left") \
         .join(px.select("gi", F.col("sym").alias("b"), F.col("lp").alias("_lb")), ["gi", "b"], "left")
    x = x.withColumn("_s", F.col("_la") - F.col("beta") * F.col("_lb"))
    w = Window.partitionBy("f", "a", "b").orderBy("gi").rowsBetween(-(lookback - 1), 0)
    sd = F.stddev_pop("_s").over(w)
    z = F.when((F.count("_s").over(w) == lookback) & (sd > 0), (F.col("_s") - F.avg("_s").over(w)) / F.nullif(sd, F.lit(0e0)))
    return x.withColumn("z", z).filter(F.col("gi") >= F.col("f")).select("f", "gi", "a", "b", "beta", "z", "f_next", "m")


def pair_state(zs: DataFrame, entry: float, exit_: float, stop: float, every: int) -> DataFrame:
    """Direction of each pair: opened at entry <= |z| < stop against the spread, closed at |z| <= exit or >= stop.

    With exit < entry < stop the state is the first opening since the last closing bar.  It survives a re-formation
    that selects the pair again; a pair that drops out starts a new run.
    """
    if not exit_ < entry < stop:
        raise ValueError("needs exit < entry < stop")
    w = Window.partitionBy("a", "b").orderBy("gi")
    gap = F.coalesce(F.col("gi") - F.lag("gi").over(w), F.lit(0)) > 1
    x = zs.withColumn("_new", F.when(gap, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w))
    rw = Window.partitionBy("a", "b", "run").orderBy("gi")
    z = F.col("z")
    x = x.withColumn("_reset", F.when((F.abs(z) <= exit_) | (F.abs(z) >= stop), 1).otherwise(0)).withColumn("_seg", F.sum("_reset").over(rw))
    opening = F.when((z >= entry) & (z < stop), -1).when((z <= -entry) & (z > -stop), 1)
    sw = Window.partitionBy("a", "b", "run", "_seg").orderBy("gi").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_open", opening)
    return x.withColumn("dir", F.coalesce(F.first("_open", ignorenulls=True).over(sw), F.lit(0))).drop("_new", "_reset", "_seg", "_open")


def pair_events(states: DataFrame, stop: float) -> DataFrame:
    """Openings and closings with their reason; a pair still open when its run ends is rotated out one bar later."""
    w = Window.partitionBy("a", "b", "run").orderBy("gi")
    prev = F.coalesce(F.lag("dir").over(w), F.lit(0))
    x = states.withColumn("_p", prev).withColumn("_last", F.lead("gi").over(w).isNull())
    kind = F.when((F.col("dir") != 0) & (F.col("_p") == 0), F.when(F.col("dir") == 1, "open long").otherwise("open short")) \
        .when((F.col("dir") == 0) & (F.col("_p") != 0), F.when(F.abs("z") >= stop, "stopped").otherwise("reverted"))
    a = x.withColumn("event", kind).filter("event is not null").select("gi", "a", "b", "event")
    out = x.filter((F.col("dir") != 0) & F.col("_last") & (F.col("gi") < F.col("m"))).select(
        (F.col("gi") + 1).alias("gi"), "a", "b", F.lit("rotated out").alias("event"))
    return a.unionByName(out)


def pair_legs(states: DataFrame, gross: float, max_pairs: int) -> DataFrame:
    """Dollar-neutral leg weights per bar; two closing bars follow each run so that the exit is traded."""
    w = Window.partitionBy("a", "b", "run").orderBy("gi")
    x = states.select("a", "b", "run", "gi", "m", "dir", F.lead("gi").over(w).isNull().alias("_last"))
    pad = x.filter("_last").select("a", "b", "run", F.explode(F.sequence(F.col("gi") + 1, F.col("gi") + 2)).alias("gi"), "m", F.lit(0).alias("dir")).filter("gi <= m")
    x = x.drop("_last").unionByName(pad)
    part = gross / max_pairs
    legs = F.array(F.struct(F.col("a").alias("sym"), (F.col("dir") * part).alias("w")), F.struct(F.col("b").alias("sym"), (-F.col("dir") * part).alias("w")))
    return x.select("a", "b", "run", "gi", F.inline(legs))


def pair_returns(legs: DataFrame, grid: DataFrame, model: dict) -> DataFrame:
    """Net return of the whole book per bar: both legs pay costs, the short one pays borrow over the calendar gap."""
    x = legs.join(grid.select("gi", "sym", "d", F.col("px").alias("c")), ["gi", "sym"])
    key = ("a", "b", "run", "sym")
    x = x.withColumn("_k", F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    r = weight_returns(x, model, key=("_k",), ts="gi")
    w = Window.partitionBy("_k").orderBy("gi")
    gap = F.date_diff("d", F.lag("d").over(w))
    fee = F.coalesce(F.greatest(-F.col("held"), F.lit(0e0)) * model["borrow"] * gap / 3.6525e2, F.lit(0e0))
    return r.withColumn("fee", fee).groupBy("gi", "d").agg(F.sum(F.col("r") - F.col("fee")).alias("r"))


def net_exposure_check(legs: DataFrame) -> DataFrame:
    """Long and short exposure per bar; a dollar-neutral book has them equal."""
    g = legs.groupBy("gi").agg(F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0e0)).alias("long"),
                               F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0e0)).alias("short"))
    return g.withColumn("neutral", F.abs(F.col("long") - F.col("short")) < 1e-9)
