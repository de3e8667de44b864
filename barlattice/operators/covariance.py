"""Covariance of the chosen names per decision date and the weights built on it.

Only the k chosen names of a date are compared with each other (k is a setting), so the blocks are k x k; the dates
spread over the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_returns(chosen: DataFrame, rets: DataFrame, T: int, *, by=("gi",), key="sym") -> DataFrame:
    """The last T own-bar returns of every chosen name, by position: (by, sym, u, x).

    Dates on which some name lacks the history are left out.  ``chosen``: (by, sym, ri); ``rets``: (sym, ri, ret).
    """
    c = chosen.select(*by, key, "ri", F.explode(F.sequence(F.lit(0), F.lit(T - 1))).alias("u"))
    x = c.withColumn("ri", F.col("ri") - (T - 1) + F.col("u")).join(rets.select(key, "ri", F.col("ret").alias("x")), [key, "ri"], "left")
    w = Window.partitionBy(*by)
    x = x.withColumn("_all", F.count("*").over(w) == F.count("x").over(w))
    return x.filter("_all").select(*by, key, "u", "x")


def cov_long(tails: DataFrame, T: int, *, by=("gi",), key="sym") -> DataFrame:
    """Population covariance ``s`` of every ordered pair of a date's names and ``v``, the variance of its estimate."""
    w = Window.partitionBy(*by, key)
    x = tails.withColumn("x", F.col("x") - F.avg("x").over(w))
    a = x.select(*by, "u", F.col(key).alias("a"), F.col("x").alias("_xa"))
    b = x.select(*by, "u", F.col(key).alias("b"), F.col("x").alias("_xb"))
    p = a.join(b, [*by, "u"]).withColumn("_p", F.col("_xa") * F.col("_xb"))  # k x k per date and position
    return p.groupBy(*by, "a", "b").agg(F.avg("_p").alias("s"), (F.var_pop("_p") / T).alias("v"))


def shrink_delta(cov: DataFrame, *, by=("gi",)) -> DataFrame:
    """Adds the shrinkage intensity ``delta`` of the date and the shrunk covariance ``sigma``."""
    w = Window.partitionBy(*by)
    off = F.col("a") != F.col("b")
    num, den = F.sum(F.when(off, F.col("v"))).over(w), F.sum(F.when(off, F.col("s") * F.col("s"))).over(w)
    delta = F.when(den > 1e-18, F.greatest(F.lit(0e0), F.least(F.lit(1e0), num / F.nullif(den, F.lit(0e0))))).otherwise(1e0)
    avg = F.avg(F.when(~off, F.col("s"))).over(w)
    x = cov.withColumn("delta", delta).withColumn("_av", F.when(avg != 0, avg).otherwise(1e-8))
    sigma = (1 - F.col("delta")) * F.col("s") + F.when(off, 0e0).otherwise(F.col("delta") * F.col("s") + 1e-6 * F.col("_av"))
    return x.withColumn("sigma", sigma).drop("_av")


def _square(pdf: pd.DataFrame):
    names = sorted(pdf["a"].unique())
    m = pdf.pivot(index="a", columns="b", values="sigma").loc[names, names].to_numpy()
    return names, m


def _equal_risk(m: np.ndarray, sweeps: int = 500) -> np.ndarray | None:
    """The long-only point where ``x_i (m x)_i`` is the same for all names: minimum of ``x'mx/2 - mean(ln x)`` by coordinate descent.

    Each coordinate has a closed form, the positive root of ``m_ii x^2 + b x - 1/n = 0``; for a positive definite matrix the minimum is unique.
    """
    n, var = len(m), np.diag(m)
    if not np.isfinite(m).all() or not (var > 0).all():
        return None
    x = 1 / np.sqrt(var.sum() * np.ones(n))
    for _ in range(sweeps):
        before = x.copy()
        for i in range(n):
            b = m[i] @ x - var[i] * x[i]
            x[i] = (np.sqrt(b * b + 4 * var[i] / n) - b) / (2 * var[i])
        if np.abs(x - before).max() <= 1e-13 * np.abs(x).max():
            break
    parts = x * (m @ x)
    return x / x.sum() if np.isfinite(x).all() and np.allclose(parts, parts.mean(), rtol=1e-6) else None


def _mean_variance(m: np.ndarray, mu: np.ndarray) -> np.ndarray | None:
    """Solution of ``m w = mu`` with ``mu`` shifted above 0; equal ``mu`` where a name has none."""
    v = mu - mu.min() + 1e-6 if np.isfinite(mu).all() else np.ones(len(mu))
    try:
        raw = np.linalg.solve(m, v)
    except np.linalg.LinAlgError:
        return None
    return raw if np.isfinite(raw).all() else None


def _solve_weights(shrunk: DataFrame, kind: str, gross: float, cap: float, mu: DataFrame | None, by) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    x = shrunk.select(*by, "a", "b", "sigma")
    if mu is not None:
        x = x.join(mu.select(*by, F.col("sym").alias("a"), "mu"), [*by, "a"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _square(pdf)
        if kind == "meanvar":
            raw = _mean_variance(m, pdf.drop_duplicates("a").set_index("a").loc[names, "mu"].to_numpy(dtype=float, na_value=np.nan))
        else:
            raw = _equal_risk(m)
        vals = np.full(len(names), np.nan) if raw is None else raw
        out = pd.DataFrame({"sym": names, "w": pd.Series(vals).astype("Float64").where(~np.isnan(vals), pd.NA)})
        return out.assign(**{k: pdf[k].iloc[0] for k in by})[[*by, "sym", "w"]]

    keys = ", ".join(f"{k} {shrunk.schema[k].dataType.simpleString()}" for k in by)
    raw = x.groupBy(*by).applyInPandas(solve, f"{keys}, sym string, w double")
    return cap_weights(raw, cap, gross=gross, by=tuple(by))


def w_meanvar(shrunk, mu, *, gross=1e0, cap=1e0, by="gi") -> DataFrame:
    """Long-only mean-variance weights (null for a group without a solution); a name without ``mu`` makes its group's ``mu`` equal."""
    return _solve_weights(shrunk, "meanvar", gross, cap, mu, by)


def w_riskparity(shrunk, *, gross=1e0, cap=1e0, by="gi") -> DataFrame:
    """Equal-risk-contribution weights (null for a group whose matrix has no such point)."""
    return _solve_weights(shrunk, "riskparity", gross, cap, None, by)


def risk_contributions(shrunk: DataFrame, weights: DataFrame, *, by=("gi",), key="sym") -> DataFrame:
    """Share of portfolio variance per name in percent; a date with a negative share is left out."""
    b = weights.select(*by, F.col(key).alias("b"), F.col("w").alias("_wb"))
    a = weights.select(*by, F.col(key).alias("a"), F.col("w").alias("_wa"))
    x = shrunk.join(b, [*by, "b"]).groupBy(*by, "a").agg(F.sum(F.col("sigma") * F.col("_wb")).alias("_sw")).join(a, [*by, "a"])
    w = Window.partitionBy(*by)
    rc = F.col("_wa") * F.col("_sw")
    x = x.withColumn("_p", F.sum(rc).over(w)).withColumn("share", rc / F.nullif(F.col("_p"), F.lit(0e0)))
    x = x.withColumn("_min", F.min("share").over(w)).filter((F.col("_p") > 0) & (F.col("_min") >= -1e-9))
    return x.select(*by, F.col("a").alias(key), (F.col("share") * 1e2).alias("risk_pct"))


def cap_weights(raw: DataFrame, cap: float, *, gross=1e0, by=("gi",), key="sym", w="w", rounds=8) -> DataFrame:
    """Water-filling: negatives to 0, scale to ``gross``, cut at ``cap`` and hand the excess to the others."""
    lim = (cap if 0 < cap < 1 else 1e0) * gross
    v = F.when((F.col(w) > 0) & ~F.isnan(w) & (F.col(w) < float("inf")), F.col(w)).otherwise(0e0)
    g = raw.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), v.cast("double").alias("w"), F.lit(False).alias("c")))).alias("z"))

    def total(z: Column, capped: bool) -> Column:
        return F.aggregate(z, F.lit(0e0), lambda a, e: a + F.when(e["c"] == F.lit(capped), e["w"]).otherwise(0e0))

    def one(z: Column, _i: Column) -> Column:
        free, left = total(z, False), gross - total(z, True)
        scale = F.when((free > 0) & (left > 0), left / F.nullif(free, F.lit(0e0))).otherwise(1e0)

        def upd(e):
            n = F.when(e["c"], e["w"]).otherwise(e["w"] * scale)
            over = ~e["c"] & (n > lim + 1e-12)
            return F.struct(e["k"].alias("k"), F.when(over, lim).otherwise(n).alias("w"), (e["c"] | over).alias("c"))

        return F.transform(z, upd)

    # a round without a new cap only rescales by 1, so running all rounds equals stopping early
    z = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("z"), one)
    x = g.select(*by, F.explode(z).alias("e"), total(F.col("z"), False).alias("_t"))
    return x.select(*by, F.col("e.k").alias(key), F.when(F.col("_t") > 0, F.col("e.w")).alias("w"))


def weights_fallback(opt: DataFrame, fallback: DataFrame, *, gross=1e0, by=("gi",), key="sym") -> DataFrame:
    """Optimised weights of a date if all are finite and >= 0 and sum to gross, else the fallback's."""
    w = Window.partitionBy(*by)
    x = fallback.select(*by, key, F.col("w").alias("_f")).join(opt.select(*by, key, F.col("w").alias("_o")), [*by, key], "left")
    ok = F.col("_o").isNotNull() & ~F.isnan(F.coalesce("_o", F.lit(0e0))) & (F.col("_o") >= 0)
    good = F.min(F.when(ok, 1).otherwise(0)).over(w) == 1
    x = x.withColumn("used_fallback", ~(good & (F.sum("_o").over(w) >= gross - 1e-6)))
    return x.select(*by, key, F.when(F.col("used_fallback"), F.col("_f")).otherwise(F.col("_o")).alias("w"), "used_fallback")
