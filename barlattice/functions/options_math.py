"""European option values and greeks; implied volatility as an Arrow-batched function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: coefficients of the five-term normal-distribution polynomial
CDF_SCALE = 0.2316419
CDF_COEF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
RATE = 6.5e-2
ROOT_2PI = math.sqrt(2 * math.pi)


def intrinsic(typ: Column, s: Column, k: Column) -> Column:
    return F.greatest(F.when(typ == "CE", s - k).otherwise(k - s), F.lit(0e0))


def with_option(df: DataFrame, typ: Column, s: Column, k: Column, t: Column, v: Column, *, price: str | None = None,
                greeks: bool = False, r: float = RATE) -> DataFrame:
    """Adds the model value under the name ``price`` and/or delta, gamma, theta (per day), vega (per point).

    Where time, volatility, spot or strike is not positive the value is intrinsic and the greeks are a step.  The
    pieces of the formula are columns of successive projections: each is used several times, so the optimiser keeps
    them apart and the generated code stays small enough to compile.
    """
    keep, z = list(df.columns), F.lit(0e0)
    c = {n: F.col(f"_{n}") for n in "y s k t v ok rt df1 d1 d2 u1 u2 f1 f2 p1 p2 n1 n2".split()}
    x = df.select("*", typ.alias("_y"), s.alias("_s"), k.alias("_k"), t.alias("_t"), v.alias("_v"))
    x = x.select("*", F.coalesce((c["t"] > 0) & (c["v"] > 0) & (c["s"] > 0) & (c["k"] > 0), F.lit(False)).alias("_ok"),
                 F.sqrt(F.greatest(c["t"], z)).alias("_rt"), (c["k"] * F.exp(-r * c["t"])).alias("_df1"))
    x = x.select("*", F.when(c["ok"], (F.ln(c["s"] / F.nullif(c["k"], z)) + (r + c["v"] * c["v"] / 2) * c["t"])
                             / F.nullif(c["v"] * c["rt"], z)).alias("_d1"))
    x = x.select("*", (c["d1"] - c["v"] * c["rt"]).alias("_d2"))
    x = x.select("*", *[(1 / (1 + CDF_SCALE * F.abs(c[f"d{i}"]))).alias(f"_u{i}") for i in (1, 2)],
                 *[(F.exp(-5e-1 * c[f"d{i}"] * c[f"d{i}"]) / ROOT_2PI).alias(f"_f{i}") for i in (1, 2)])

    def tail(i: int) -> Column:
        u, poly = c[f"u{i}"], F.lit(0e0)
        for a in reversed(CDF_COEF):
            poly = u * (F.lit(a) + poly)
        return c[f"f{i}"] * poly

    x = x.select("*", *[tail(i).alias(f"_p{i}") for i in (1, 2)])
    x = x.select("*", *[F.when(c[f"d{i}"] >= 0, 1 - c[f"p{i}"]).otherwise(c[f"p{i}"]).alias(f"_n{i}") for i in (1, 2)])
    call, out = c["y"] == "CE", []
    if price:
        val = F.when(call, c["s"] * c["n1"] - c["df1"] * c["n2"]).otherwise(c["df1"] * (1 - c["n2"]) - c["s"] * (1 - c["n1"]))
        out.append(F.when(c["ok"], val).otherwise(intrinsic(c["y"], c["s"], c["k"])).alias(price))
    if greeks:
        decay = -(c["s"] * c["f1"] * c["v"]) / F.nullif(2 * c["rt"], z)
        step = F.when(call, F.when(c["s"] > c["k"], 1e0).otherwise(0e0)).otherwise(F.when(c["s"] < c["k"], -1e0).otherwise(0e0))
        carry = F.when(call, decay - r * c["df1"] * c["n2"]).otherwise(decay + r * c["df1"] * (1 - c["n2"]))
        out += [F.when(c["ok"], F.when(call, c["n1"]).otherwise(c["n1"] - 1)).otherwise(step).alias("delta"),
                F.when(c["ok"], c["f1"] / F.nullif(c["s"] * c["v"] * c["rt"], z)).otherwise(z).alias("gamma"),
                F.when(c["ok"], carry / 3.65e2).otherwise(z).alias("theta"),
                F.when(c["ok"], c["s"] * c["f1"] * c["rt"] / 1e2).otherwise(z).alias("vega")]
    return x.select(*keep, *out)


GREEKS = ("delta", "gamma", "theta", "vega")


# ---- implied volatility ----------------------------------------------------------------------------------------------

def _np_cdf(x):
    t = 1 / (1 + CDF_SCALE * np.abs(x))
    poly = np.zeros_like(x)
    for c in reversed(CDF_COEF):
        poly = t * (c + poly)
    upper = 1 - np.exp(-0.5 * x * x) / ROOT_2PI * poly
    return np.where(x >= 0, upper, 1 - upper)


def _np_price(call, s, k, t, r, v):
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    disc = k * np.exp(-r * t)
    return np.where(call, s * _np_cdf(d1) - disc * _np_cdf(d2), disc * _np_cdf(-d2) - s * _np_cdf(-d1))


def solve_iv(call, price, s, k, t, r):
    """Bisection on a whole batch: at most 100 halvings, the bracket doubled up to 160; NaN where no answer exists."""
    with np.errstate(all="ignore"):
        ok = (price > 0) & (t > 0) & (s > 0) & (k > 0)
        disc = k * np.exp(-r * t)
        floor = np.maximum(0.0, np.where(call, s - disc, disc - s))
        ok &= price >= floor - 1e-6
        lo, hi = np.full(price.shape, 1e-4), np.full(price.shape, 5.0)
        for _ in range(20):
            low = ok & (_np_price(call, s, k, t, r, hi) < price) & (hi < 100)
            if not low.any():
                break
            hi = np.where(low, hi * 2, hi)
        ok &= ~(_np_price(call, s, k, t, r, hi) < price)
        out, open_ = np.full(price.shape, np.nan), ok.copy()
        for _ in range(100):
            if not open_.any():
                break
            mid = (lo + hi) / 2
            p = _np_price(call, s, k, t, r, mid)
            hit = open_ & (np.abs(p - price) < 1e-4)
            out = np.where(hit, mid, out)
            open_ &= ~hit
            up = open_ & (p > price)
            hi, lo = np.where(up, mid, hi), np.where(open_ & ~up, mid, lo)
        out = np.where(open_, (lo + hi) / 2, out)
        return np.floor(out * 1e4 + 0.5) / 1e4


def implied_vol(typ: Column, price: Column, s: Column, k: Column, t: Column, r: float = RATE) -> Column:
    """Implied volatility to four decimals, null where the price is out of reach."""

    @F.pandas_udf("double")
    def iv(typ: pd.Series, price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        args = [x.to_numpy(dtype="float64", na_value=np.nan) for x in (price, s, k, t)]
        out = solve_iv((typ == "CE").to_numpy(), *args, r)
        return pd.Series(out).astype("Float64").where(~np.isnan(out), pd.NA)

    return iv(typ, price, s, k, t)
