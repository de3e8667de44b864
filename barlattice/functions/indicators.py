"""Indicator columns over an ordered series of closes.

Every builder takes the series window (partitioned by series, ordered by time) and returns a Column.  An indicator is
null until its window is full.  All share one window, so Spark sorts a series once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

C, RET, CHG, LRET = "c", "_ret", "_chg", "_lret"


def last_rows(w: WindowSpec, n: int, shift: int = 0) -> WindowSpec:
    return w.rowsBetween(-(n - 1) - shift, -shift)


def full(x: str, fn: Callable[[str], Column], w: WindowSpec, n: int, shift: int = 0) -> Column:
    """``fn(x)`` over the last n rows, null unless n values are there."""
    f = last_rows(w, n, shift)
    return F.when(F.count(x).over(f) == n, fn(x).over(f))


def ret(w, x=C):
    p = F.lag(x).over(w)
    return F.col(x) / F.nullif(p, F.lit(0e0)) - 1


def chg(w, x=C):
    return F.col(x) - F.lag(x).over(w)


def logret(w, x=C):
    p = F.lag(x).over(w)
    return F.when((p > 0) & (F.col(x) > 0), F.ln(F.col(x) / p))


def price(w):
    return F.col(C)


def sma(w, n):
    return full(C, F.avg, w, n)


def ema(w, n, x=C):
    """Finite exponential average: seeded by the oldest of the last n values, rolled to the newest; plain arithmetic over the last n values."""
    k = 2e0 / (n + 1)
    back = lambda j: F.lag(x, j).over(w) if j else F.col(x)
    roll = back(n - 1)
    for j in range(n - 2, -1, -1):
        roll = back(j) * k + roll * (1 - k)
    return F.when(F.count(x).over(last_rows(w, n)) == n, roll)


def rsi(w, n=14):
    f = last_rows(w, n)
    gain = F.sum(F.greatest(F.col(CHG), F.lit(0e0))).over(f)
    loss = F.sum(F.greatest(-F.col(CHG), F.lit(0e0))).over(f)
    val = F.when(loss == 0, F.lit(1e2)).otherwise(1e2 - 1e2 / (1 + gain / F.nullif(loss, F.lit(0e0))))
    return F.when(F.count(CHG).over(f) == n, val)


def mom(w, n):
    base = F.lag(C, n).over(w)
    return F.when(base > 0, F.col(C) / base - 1)


def high(w, n):
    """Highest of the n closes before today; a partial window counts."""
    return F.max(C).over(w.rowsBetween(-n, -1))


def low(w, n):
    return F.min(C).over(w.rowsBetween(-n, -1))


def vol(w, n):
    return full(RET, F.stddev_pop, w, n)


def macd_line(w, fast, slow):
    return ema(w, fast) - ema(w, slow)


def atr_close(w, n):
    f = last_rows(w, n)
    return F.when(F.count(CHG).over(f) == n, F.avg(F.abs(F.col(CHG))).over(f))


def close_std(w, n):
    return full(C, F.stddev_pop, w, n)


def dist_high(w, n):
    return F.col(C) / F.nullif(full(C, F.max, w, n), F.lit(0e0)) - 1


def slope(w, n):
    return sma(w, n) / F.nullif(full(C, F.avg, w, n, shift=1), F.lit(0e0)) - 1


def volratio(w, a, b):
    den = vol(w, b)
    return F.when(den > 0, vol(w, a) / den)


def zscore(w, n):
    sd = close_std(w, n)
    return F.when(sd > 0, (F.col(C) - sma(w, n)) / sd)


def regime(w, n):
    m = sma(w, n)
    return F.when(m.isNotNull(), F.when(F.col(C) > m, 1e0).otherwise(0e0))


def realized_vol(w, n=20):
    """Annualised population std of log returns over n bars; 0.18 while unwarm."""
    f = last_rows(w, n)
    warm = (F.count(C).over(last_rows(w, n + 1)) == n + 1) & (F.count(LRET).over(f) >= 2)
    return F.when(warm, F.stddev_pop(LRET).over(f) * (2.52e2 ** 0.5)).otherwise(1.8e-1)


def model_iv(w, premium=1.2e0, floor=8e-2, n=20):
    return F.greatest(F.lit(floor), realized_vol(w, n) * premium)


def mom_12_1(w, long=252, short=21):
    return (1 + mom(w, long)) / F.nullif(1 + mom(w, short), F.lit(0e0)) - 1


# name -> builder(w, *args)
INDICATORS: dict[str, Callable[..., Column]] = {
    "ret": ret, "price": price, "sma": sma, "ema": ema, "rsi": rsi, "mom": mom, "high": high, "low": low, "vol": vol,
    "macd_line": macd_line, "atr_close": atr_close, "close_std": close_std, "dist_high": dist_high, "slope": slope,
    "volratio": volratio, "zscore": zscore, "regime": regime, "realized_vol": realized_vol, "model_iv": model_iv,
    "mom_12_1": mom_12_1,
}

# rows an indicator looks back, from its arguments
LOOKBACK = {
    "ret": lambda: 1, "price": lambda: 0, "macd_line": lambda f, s: s, "macd_hist": lambda f, s, g: s + g,
    "volratio": lambda a, b: b + 1, "mom_12_1": lambda a=252, b=21: a, "model_iv": lambda *a: 22,
    "realized_vol": lambda n=20: n + 2, "slope": lambda n: n + 1, "rsi": lambda n=14: n + 1,
}
_STAGED = {"rsi": (CHG,), "atr_close": (CHG,), "vol": (RET,), "volratio": (RET,), "realized_vol": (LRET,),
           "model_iv": (LRET,)}
_STAGE = {CHG: chg, RET: ret, LRET: logret}


def lookback(spec: tuple) -> int:
    name, *args = spec
    return LOOKBACK.get(name, lambda n: n + 1)(*args)


def with_indicators(df: DataFrame, specs: dict[str, tuple], *, key: str = "sym", ts: str = "d",
                    split_rows: int | None = None) -> DataFrame:
    """Add indicator columns: ``{"s50": ("sma", 50), "hist": ("macd_hist", 12, 26, 9)}``.

    ``split_rows`` cuts long series (ticks, seconds bars) into pieces with a look-back margin; the values are the same.
    """
    names = list(df.columns)
    by = [key]
    if split_rows:
        from barlattice.operators.scan import split_frames

        df = split_frames(df, key, ts, max(lookback(s) for s in specs.values()), split_rows)
        by = [key, "_piece"]
    w = Window.partitionBy(*by).orderBy(ts)
    need = sorted({s for n, *_ in specs.values() for s in _STAGED.get(n, ())})
    if need:
        df = df.select("*", *[_STAGE[s](w).alias(s) for s in need])
    plain = {o: s for o, s in specs.items() if s[0] != "macd_hist"}
    lines = {o: s for o, s in specs.items() if s[0] == "macd_hist"}
    df = df.select("*", *[INDICATORS[n](w, *a).alias(o) for o, (n, *a) in plain.items()],
                   *[F.when(F.count(C).over(last_rows(w, s)) == s, macd_line(w, f, s)).alias(f"_ln_{o}")
                     for o, (_, f, s, _g) in lines.items()])
    for o, (_, _f, s, g) in lines.items():
        warm = F.count(C).over(last_rows(w, s + g)) == s + g
        df = df.withColumn(o, F.when(warm, F.col(f"_ln_{o}") - ema(w, g, f"_ln_{o}")))
    if split_rows:
        df = df.filter(~F.col("_halo"))
    return df.select(*names, *specs)


# the eight learning features, by name
FEATURES: dict[str, tuple] = {
    "mom21": ("mom", 21), "mom63": ("mom", 63), "mom126": ("mom", 126), "rsi14": ("rsi", 14),
    "dist_high": ("dist_high", 252), "volratio": ("volratio", 20, 63), "sma_slope": ("slope", 50),
    "zscore50": ("zscore", 50),
}


def feature_vector(df: DataFrame, *, key: str = "sym", ts: str = "d") -> DataFrame:
    """All eight features per bar; a bar lacking any of them is left out."""
    out = with_indicators(df, FEATURES, key=key, ts=ts)
    return out.na.drop(subset=list(FEATURES))
