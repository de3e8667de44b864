"""Cross-sectional ranking, factor scores and weights per decision date.

A decision date holds one row per listed name, so its group is bounded by the size of the universe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.operators.align import at_slots


def rebalance_dates(master: DataFrame, every: int) -> DataFrame:
    """Bars of the common timeline whose index is a multiple of ``every`` (the first included)."""
    return master.filter(F.col("gi") % every == 0)


def decision_rows(bars: DataFrame, master: DataFrame, every: int, *, key="sym", ts="d") -> DataFrame:
    """Every listed name at every decision date, with the columns of its own latest bar.

    A bar covers the grid slots up to the next bar of its series; only the decision slots inside are produced.
    ``gi``/``ts`` become those of the decision, ``bar_d``/``ri`` those of the bar.
    """
    w = Window.partitionBy(key).orderBy("_g")
    x = bars.join(master.select(ts, F.col("gi").alias("_g"), "n"), ts)
    x = x.withColumn("ri", F.row_number().over(w) - 1).withColumn("_e", F.coalesce(F.lead("_g").over(w), F.col("n")))
    first, last = F.ceil(F.col("_g") / every), F.ceil(F.col("_e") / every) - 1
    x = x.filter(last >= first).withColumn("gi", F.explode(F.sequence(first * every, last * every, F.lit(every).cast("bigint"))))
    x = x.withColumnRenamed(ts, "bar_d").drop("_g", "_e", "n")
    return x.join(master.select("gi", ts), "gi")


def decision_rows_at(bars: DataFrame, master: DataFrame, slots: DataFrame, *, key="sym", ts="d") -> DataFrame:
    """``decision_rows`` at any decision slots (a frame with ``gi``): every listed name with the columns of its latest bar."""
    w = Window.partitionBy(key).orderBy("gi")
    x = bars.join(master, ts).withColumn("ri", F.row_number().over(w) - 1).withColumn("_end", F.coalesce(F.lead("gi").over(w), F.col("n")))
    return at_slots(x.withColumnRenamed(ts, "bar_d").drop("n"), slots, master).join(master.select("gi", ts), "gi")


def gated_weights(decisions: DataFrame, chosen: DataFrame, *, by=("spec_id",)) -> DataFrame:
    """Weights of specs whose decisions may say cash: ``decisions`` (by, gi, on), ``chosen`` (by, gi, sym, w) for those that are on.

    A decision that is off, or finds no name, is one row without a name: the book is sold at the next bar and stays in cash.
    """
    names = chosen.join(decisions.filter("on").select(*by, "gi"), [*by, "gi"], "left_semi")
    return decisions.select(*by, "gi").join(names.select(*by, "gi", "sym", "w"), [*by, "gi"], "left")


def eligible(rows: DataFrame, gate: Column) -> DataFrame:
    """Rows whose own latest bar passes the predicate (unknown fails)."""
    return rows.filter(F.coalesce(gate, F.lit(False)))


def cs_zscore(x: str, by=("gi",)) -> Column:
    """Population z-score across the names of a date; a dead factor scores 0 for everyone."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return (F.col(x) - F.avg(x).over(w)) / F.when(sd > 1e-12, sd).otherwise(1e0)


def factor_composite(rows: DataFrame, weights: dict[str, float], *, by=("gi",)) -> tuple[DataFrame, DataFrame]:
    """(scored, dropped): weighted sum of z-scores over the names that have every factor; the others."""
    has = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in weights])
    warm = rows.filter(has)
    z = warm.select("*", *[cs_zscore(f, by).alias(f"z_{f}") for f in weights])
    score = reduce(lambda a, b: a + b, [F.col(f"z_{f}") * wt for f, wt in weights.items()])
    return z.withColumn("score", score), rows.filter(~has)


def score_fallback(model: Column, rule: Column) -> Column:
    """Model score when finite, else the rule's."""
    ok = model.isNotNull() & ~F.isnan(model) & (F.abs(model) < float("inf"))
    return F.when(ok, model).otherwise(rule)


def ranked(rows: DataFrame, *, by=("gi",), score="score", rule=None, key="sym") -> DataFrame:
    """Adds ``rk``: best score first, then rule score, then name; rows without a score are left out."""
    order = [F.col(score).desc(), *([F.desc_nulls_last(rule)] if rule else []), F.col(key).asc()]
    s = F.col(score)
    return rows.filter(s.isNotNull() & ~F.isnan(s.cast("double"))) \
        .withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, k: int, **kw) -> DataFrame:
    return ranked(rows, **kw).filter(F.col("rk") <= k)


def w_equal(by=("gi",), gross=1e0) -> Column:
    return F.lit(gross) / F.count("*").over(Window.partitionBy(*by))


def w_rank(by=("gi",), gross=1e0) -> Column:
    """Linear weights: the best of m names gets m parts, the last one part."""
    m = F.count("*").over(Window.partitionBy(*by))
    return gross * (m - F.col("rk") + 1) / (m * (m + 1) / 2e0)


def w_invvol(by=("gi",), gross=1e0, vol="vol") -> Column:
    """Inverse volatility; a missing or tiny volatility takes the smallest inverse; none usable: equal."""
    w = Window.partitionBy(*by)
    inv = F.when(F.col(vol) > 1e-6, 1 / F.nullif(F.col(vol), F.lit(0e0)))
    low = F.min(inv).over(w)
    lacking = F.count("*").over(w) - F.count(inv).over(w)
    total = F.sum(inv).over(w) + lacking * low
    return F.when(low.isNull(), F.lit(gross) / F.count("*").over(w)).otherwise(gross * F.coalesce(inv, low) / total)


def risk_off_cash(rows: DataFrame, market_ok: DataFrame) -> DataFrame:
    """Only decision dates on which the market predicate holds: ``market_ok`` is (gi, ok)."""
    on = market_ok.filter(F.coalesce(F.col("ok"), F.lit(False))).select("gi")
    return rows.join(on, "gi", "left_semi")


def control_arms(rows: DataFrame, signal: Column, k: int) -> DataFrame:
    """The same basket with the signal negated, removed and kept, picked per arm."""
    x = rows.withColumn("_s", signal).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("arm"))
    return top_k(x.withColumn("score", F.col("arm") * F.col("_s")), k, by=("arm", "gi")).drop("_s")


def null_portfolios(names: DataFrame, n: int, seeds: int, *, key="sym") -> DataFrame:
    """Seeded random n-name portfolios: names ordered by a hash of (seed, name)."""
    x = names.select(key, F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    x = x.withColumn("_h", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(key))))
    w = Window.partitionBy("seed").orderBy("_h", key)
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_h", "_r")


def null_percentile(draws: DataFrame, study: DataFrame, *, score="score") -> DataFrame:
    """Where the study's score stands among the draws: shares and order statistics."""
    x = draws.withColumn("study", study.select(score).scalar())
    return x.groupBy("study").agg(
        F.avg(F.when(F.col(score) >= F.col("study"), 1e0).otherwise(0e0)).alias("share_at_or_above"),
        F.min(score).alias("null_min"), F.median(score).alias("null_median"), F.max(score).alias("null_max"))


def decision_log(candidates: DataFrame, chosen: DataFrame, *, by=("gi",), key="sym") -> DataFrame:
    """Every candidate with rank, score, volatility, and its weight when chosen."""
    c = chosen.select(*by, key, F.col("w").alias("_w"))
    x = ranked(candidates, by=by).join(c, [*by, key], "left")
    return x.withColumn("chosen", F.col("_w").isNotNull()).withColumn("weight_pct", F.coalesce(F.col("_w") * 1e2, F.lit(0e0))).drop("_w")
