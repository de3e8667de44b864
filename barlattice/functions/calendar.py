"""Trading-calendar and symbol-string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IST_MINUTES = 330

# fixed values: full-day exchange closures of 2026
HOLIDAYS = (
    "2026-01-15", "2026-01-26", "2026-03-03", "2026-03-26", "2026-03-31", "2026-04-03", "2026-04-14", "2026-05-01", "2026-05-28", "2026-06-26",
    "2026-09-14", "2026-10-02", "2026-10-20", "2026-11-10", "2026-11-24", "2026-12-25",
)

# fixed values: index names and vendor codes
INDEX_CODES = {"NIFTY": "^NSEI", "BANKNIFTY": "^NSEBANK", "FINNIFTY": "^CNXFIN", "SENSEX": "^BSESN"}


def ist(ts: Column) -> Column:
    return ts + F.expr(f"interval {IST_MINUTES} minutes")


def ist_date(ts: Column) -> Column:
    return F.to_date(ist(ts))


def market_state(ts: Column, holidays: list[str] | tuple[str, ...] = tuple(HOLIDAYS)) -> Column:
    """struct(state, is_open, reason) of the session at ``ts`` (UTC)."""
    local = ist(ts)
    minute = F.hour(local) * 60 + F.minute(local)
    weekend = F.dayofweek(local).isin(1, 7)
    closed = F.date_format(local, "yyyy-MM-dd").isin(*holidays)

    def state(s, o, r):
        return F.struct(F.lit(s).alias("state"), F.lit(o).alias("is_open"), F.lit(r).alias("reason"))

    return (F.when(weekend, state("CLOSED", False, "Weekend"))
            .when(closed, state("CLOSED", False, "Exchange holiday"))
            .when((minute >= 540) & (minute < 555), state("PREOPEN", False, "Pre-open session"))
            .when((minute >= 555) & (minute < 930), state("REGULAR", True, "Regular session"))
            .otherwise(state("CLOSED", False, "Outside trading hours")))


def vendor_symbol(sym: Column) -> Column:
    """Friendly ticker to vendor ticker: index codes, suffixes kept or mapped, exchange suffix by default."""
    s = F.upper(sym)
    out = F.when(F.lit(False), s)
    for k, v in INDEX_CODES.items():
        out = out.when(s == k, v)
    return (out.when(s.endswith(".NS") | s.endswith(".BO") | s.startswith("^"), s)
            .when(s.endswith(".BSE"), F.regexp_replace(s, r"\.BSE$", ".BO")).otherwise(F.concat(s, F.lit(".NS"))))


def parse_data_key(k: Column) -> Column:
    """``60m:SYM`` to struct(interval, symbol); a bare symbol is daily."""
    at = F.instr(k, ":")
    return F.when(at > 0, F.struct(F.substr(k, F.lit(1), at - 1).alias("interval"), F.substr(k, at + 1).alias("symbol"))) \
        .otherwise(F.struct(F.lit("1d").alias("interval"), k.alias("symbol")))


def interval_ms(iv: Column) -> Column:
    n = F.regexp_extract(iv, r"^(\d+)(m|h)$", 1)
    u = F.regexp_extract(iv, r"^(\d+)(m|h)$", 2)
    return F.when(F.coalesce(F.length(n), F.lit(0)) > 0,
                  n.try_cast("bigint") * F.when(u == "h", 3_600_000).otherwise(60_000)).otherwise(F.lit(3_600_000).cast("bigint"))


# fixed values: class of a rank operator
RANK_CLASSES = {
    "mom": "momentum", "macd": "momentum", "slope": "momentum", "vol": "lowvol", "volratio": "lowvol", "*": "lowvol", "/": "lowvol",
    "distHigh": "breakout", "high": "breakout", "rsi": "meanrev", "zscore": "meanrev",
}


def _class_of(rank_op: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in RANK_CLASSES.items() for x in pair]), rank_op)


def archetype(kind, has_entry, has_weight, ml_model, has_factors, rank_op) -> Column:
    """Class of a spec by kind, model and rank operator."""
    return (F.when(kind.isNull(), "other").when(kind == "FNO", "fno").when(kind == "PAIRS", "pairs")
            .when((kind == "EQ") & ~has_entry & has_weight, "benchmark").when(kind == "EQ", "eq")
            .when(ml_model.isNotNull(), F.concat(F.lit("ml-"), ml_model)).when(has_factors, "factor")
            .otherwise(F.coalesce(_class_of(rank_op), F.lit("basket"))))


def expiry_ladder(df: DataFrame, *, date="d", count=3) -> DataFrame:
    """The next monthly expiries (the 25th; rolled on the 25th itself) of every date."""
    first = F.trunc(date, "month")
    off = F.when(F.dayofmonth(date) >= 25, 1).otherwise(0)
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")
    x = df.select(date, k)
    e = F.date_add(F.add_months(first, off + F.col("k")), 24)
    return x.select(date, F.col("k").cast("bigint").alias("k"), F.date_format(e, "dd-MMM-yyyy").alias("expiry"))


def years_to_expiry(label: Column, now: Column) -> Column:
    """Years from ``now`` to 10:00 UTC of a ``dd-Mon-yyyy`` label, at least half a day; a week if unreadable."""
    norm = F.initcap(label)
    ts = F.when(norm.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_timestamp(norm, F.lit("d-MMM-yyyy")))
    ms = (F.unix_millis(ts) + 36_000_000) - F.unix_millis(now.cast("timestamp"))
    return F.greatest(F.coalesce(ms, F.lit(604_800_000)) / 3.1536e10, F.lit(5e-1 / 3.65e2))
