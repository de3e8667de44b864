"""Cleaning of bar series.  All work is per series; a series has at most one row per bar of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIG_MOVE, GLITCH_BARS, RETURN_BAND, FLAT_RUN, EARLY = 4e-1, 4, 1.5e-1, 10, 6e-1


def _w(key, ts):
    return Window.partitionBy(key).orderBy(ts)


def valid_bars(df: DataFrame, *, ts="d", c="c") -> DataFrame:
    """Rows with a timestamp and a finite positive close."""
    x = F.col(c)
    return df.filter(F.col(ts).isNotNull() & x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")))


def to_adjusted(df: DataFrame, *, key="sym", share=9e-1) -> DataFrame:
    """Series with at least ``share`` positive adjusted closes switch to them (raw kept in ``craw``), others stay."""
    has = F.coalesce(F.col("a") > 0, F.lit(False))
    x = df.withColumn("_adj", F.avg(F.when(has, 1e0).otherwise(0e0)).over(Window.partitionBy(key)) >= share)
    x = x.filter(~F.col("_adj") | has)
    return x.withColumn("craw", F.when(F.col("_adj"), F.col("c"))) \
            .withColumn("c", F.when(F.col("_adj"), F.col("a")).otherwise(F.col("c"))).drop("_adj")


def drop_bad_prints(df: DataFrame, *, key="sym", ts="d") -> DataFrame:
    """Drop short glitches: after a > 40 % move, the bars before the first of the next three that is back within 15 %.

    A glitch that starts inside another one is not judged again.  Only rows where a glitch can start are folded: they
    form clusters that cannot influence each other, each a handful of rows.
    """
    w = _w(key, ts)
    c = F.col("c")

    def near(k):
        x = F.lead("c", k).over(w)
        return (x > 0) & (F.abs(x / F.nullif(c, F.lit(0e0)) - 1) <= RETURN_BAND)

    nxt = F.lead("c", 1).over(w)
    jumped = (c > 0) & (nxt > 0) & (F.abs(nxt / F.nullif(c, F.lit(0e0)) - 1) > BIG_MOVE)
    back = F.when(near(2), 2)
    for k in range(3, GLITCH_BARS + 1):
        back = back.when(near(k), k)
    rows = df.withColumn("_rn", F.row_number().over(w)).withColumn("_to", F.when(jumped, F.col("_rn") + back))
    starts = rows.filter("_to is not null").select(key, "_rn", "_to")
    by_rn = Window.partitionBy(key).orderBy("_rn")
    reach = F.max("_to").over(by_rn.rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("_new", F.when(reach > F.col("_rn"), 0).otherwise(1)) \
                   .withColumn("_cl", F.sum("_new").over(by_rn))
    packed = starts.groupBy(key, "_cl").agg(F.array_sort(F.collect_list(F.struct("_rn", "_to"))).alias("s"))
    live = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("rows")),
        lambda a, j: F.when(j["_rn"] >= a["at"], F.struct(
            j["_to"].alias("at"), F.concat(a["rows"], F.sequence(j["_rn"] + 1, j["_to"] - 1)).alias("rows"))).otherwise(a),
        lambda a: a["rows"])
    gone = packed.select(key, F.explode(live).alias("_rn"))
    return rows.join(gone, [key, "_rn"], "left_anti").select(*df.columns)


def first_good(df: DataFrame, *, key="sym", ts="d", frozen=True, steps=True) -> DataFrame:
    """Rows numbered ``_i`` from 0 with the first trusted index ``_good`` and the series length ``_n``."""
    w, whole = _w(key, ts), Window.partitionBy(key)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole)) \
          .withColumn("_p", F.lag("c").over(w)).withColumn("_c0", F.first("c").over(w))
    early = F.col("_n") * EARLY
    good = F.lit(0)
    if frozen:
        end = F.coalesce(F.min(F.when(F.col("c") != F.col("_c0"), F.col("_i"))).over(whole), F.col("_n"))
        good = F.greatest(good, F.when(end > FLAT_RUN, end).otherwise(0))
    if steps:
        bad = (F.col("_i") > 0) & ~F.coalesce(F.col("c") > 0, F.lit(False)) & (F.col("_i") + 1 < early)
        jump = (F.col("c") > 0) & (F.col("_p") > 0) & (F.col("_i") < early) & \
               (F.abs(F.col("c") / F.nullif(F.col("_p"), F.lit(0e0)) - 1) > BIG_MOVE)
        at = F.max(F.when(bad, F.col("_i") + 1).when(jump, F.col("_i"))).over(whole)
        good = F.greatest(good, F.coalesce(at, F.lit(0)))
    return x.withColumn("_good", good)


def _trim(df, **kw):
    x = first_good(df, **kw)
    cut = (F.col("_good") > 0) & (F.col("_good") < F.col("_n") * EARLY)
    return x.filter(~cut | (F.col("_i") >= F.col("_good"))).select(*df.columns)


def trim_frozen_lead(df, *, key="sym", ts="d"):
    """Drop a leading run of at least ten repeats of the first close."""
    return _trim(df, key=key, ts=ts, steps=False)


def trim_early_step(df, *, key="sym", ts="d"):
    """Start at the last > 40 % step (or after the last non-positive print) within the first 60 % of a series."""
    return _trim(df, key=key, ts=ts, frozen=False)


def sanitize(df, *, key="sym", ts="d"):
    return _trim(drop_bad_prints(df, key=key, ts=ts), key=key, ts=ts)


def trailing_suspect_jump(df, *, key="sym", ts="d") -> DataFrame:
    """Per series: does a > 40 % move sit in its last four bars?"""
    w, back = _w(key, ts), Window.partitionBy(key).orderBy(F.col(ts).desc())
    p = F.lag("c").over(w)
    x = df.select(key, ((p > 0) & (F.col("c") > 0) & (F.abs(F.col("c") / F.nullif(p, F.lit(0e0)) - 1) > BIG_MOVE)).alias("_j"),
                  F.row_number().over(back).alias("_b"))
    return x.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_b") <= GLITCH_BARS, F.col("_j"))), F.lit(False)).alias("suspect"))


def last_session(df, *, key="sym", ts="ts") -> DataFrame:
    """Only the rows of each series' most recent UTC day.

    The last day per key is an aggregate (partial sums before the shuffle), joined back; no window over raw ticks.
    """
    last = df.groupBy(key).agg(F.to_date(F.max(ts)).alias("_last"))
    return df.join(last, key).filter(F.to_date(ts) == F.col("_last")).drop("_last")


def min_history(df, n: int, since=None, *, key="sym", ts="d", source: str | None = None) -> DataFrame:
    """Drop series with fewer than ``n`` bars, starting after ``since``, or tagged synthetic."""
    x = df if source is None else df.filter(~F.col(source).startswith("synthetic"))
    keep = x.groupBy(key).agg(F.count("*").alias("_n"), F.min(ts).alias("_f")).filter(F.col("_n") >= n)
    if since is not None:
        keep = keep.filter(F.col("_f") <= F.lit(since).cast("date"))
    return x.join(keep.select(key), key, "left_semi")


def clean_report(before: DataFrame, after: DataFrame, *, key="sym") -> DataFrame:
    b, a = before.groupBy(key).agg(F.count("*").alias("rows_in")), after.groupBy(key).agg(F.count("*").alias("rows_out"))
    x = b.join(a, key, "left").withColumn("rows_out", F.coalesce("rows_out", F.lit(0)))
    return x.withColumn("dropped", F.col("rows_in") - F.col("rows_out"))
