"""Readers of vendor documents, the columnar candle store, source merging and log checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---- vendor documents ------------------------------------------------------------------------------------------------
# fixed values: field names of the vendors' documents (schemas, _LEG, _FIELDS below)

CHART_SCHEMA = """symbol string, timestamp array<bigint>,
 indicators struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>,
                                       volume: array<bigint>>>,
                   adjclose: array<struct<adjclose: array<double>>>>"""

_LEG = ("struct<lastPrice: string, openInterest: string, changeinOpenInterest: string, totalTradedVolume: string, "
        "impliedVolatility: string, bidprice: string, askPrice: string>")
CHAIN_SCHEMA = f"""symbol string, records struct<expiryDates: array<string>, underlyingValue: double,
 data: array<struct<strikePrice: double, expiryDate: string, CE: {_LEG}, PE: {_LEG}>>>"""


def half_up(x: Column, digits: int) -> Column:
    p = float(10 ** digits)
    return F.floor(x * p + 5e-1) / p


def parse_chart(docs: DataFrame) -> DataFrame:
    """Documents of parallel arrays to bar rows; rows without close or timestamp are skipped."""
    q = F.col("indicators.quote")[0]
    adj = F.col("indicators.adjclose")[0]["adjclose"]
    rows = F.arrays_zip(F.col("timestamp").alias("t"), q["open"].alias("o"), q["high"].alias("h"), q["low"].alias("l"),
                        q["close"].alias("c"), q["volume"].alias("v"), adj.alias("a"))
    x = docs.select(F.upper("symbol").alias("sym"), F.inline(rows).alias("t", "o", "h", "l", "c", "v", "a"))
    x = x.filter("c is not null and t is not null")
    return x.select("sym", (F.col("t") * 1000).alias("t"), *[half_up(F.col(k), 2).alias(k) for k in "ohlc"], "v",
                    F.when(F.col("a") > 0, half_up(F.col("a"), 4)).alias("a"))


def read_chart_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_chart(spark.read.schema(CHART_SCHEMA).option("multiLine", "false").json(path))


_FIELDS = {"ltp": "lastPrice", "oi": "openInterest", "change_oi": "changeinOpenInterest", "volume": "totalTradedVolume",
           "iv": "impliedVolatility", "bid": "bidprice", "ask": "askPrice"}


def parse_chain(docs: DataFrame, expiry: str | None = None, *keep: str) -> DataFrame:
    """Option-chain documents to one row per (strike, type) of the chosen expiry; unusable numbers count as 0."""
    listed = F.col("records.expiryDates")
    first = F.get(listed, F.lit(0))
    chosen = first if expiry is None else F.when(F.array_contains(listed, expiry), F.lit(expiry)).otherwise(first)
    x = docs.select(*keep, "symbol", F.col("records.underlyingValue").alias("underlying"), chosen.alias("expiry"),
                    F.posexplode("records.data").alias("pos", "r")).filter(F.col("r.expiryDate") == F.col("expiry"))
    legs = F.array(F.struct(F.lit("CE").alias("opt_type"), F.col("r.CE").alias("leg")),
                   F.struct(F.lit("PE").alias("opt_type"), F.col("r.PE").alias("leg")))
    y = x.select(*keep, "symbol", "underlying", "expiry", F.col("r.strikePrice").alias("strike"), "pos", F.inline(legs)) \
         .filter("leg is not null")

    def num(f):
        v = F.col(f"leg.{f}").try_cast("double")
        return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(0e0))

    g = y.groupBy(*keep, "symbol", "expiry", "strike", "opt_type").agg(
        F.max_by(F.struct("underlying", *[num(f).alias(n) for n, f in _FIELDS.items()]), "pos").alias("z"))
    return g.select(*keep, "symbol", "expiry", "strike", "opt_type", "z.*")


def read_option_chain_json(spark: SparkSession, path: str, expiry: str | None = None) -> DataFrame:
    return parse_chain(spark.read.schema(CHAIN_SCHEMA).json(path), expiry)


# ---- quotes and merged sources ---------------------------------------------------------------------------------------

def quote_snapshot(ticks: DataFrame, *, key="sym", ts="ts", price="price", tie="event_id") -> DataFrame:
    """Latest price, previous day's close and the change; both changes are 0 without a positive previous close."""
    day = ticks.filter(F.col(price).isNotNull() & ~F.isnan(price)) \
        .groupBy(key, F.to_date(ts).alias("_d")).agg(F.max_by(price, F.struct(ts, tie)).alias("_p"))
    w = Window.partitionBy(key).orderBy(F.col("_d").desc())
    x = day.withColumn("_k", F.row_number().over(w)).filter("_k <= 2").groupBy(key).agg(
        F.max(F.when(F.col("_k") == 1, F.col("_p"))).alias("ltp"), F.max(F.when(F.col("_k") == 2, F.col("_p"))).alias("prev_close"))
    ok = F.coalesce(F.col("prev_close") > 0, F.lit(False))
    diff = F.col("ltp") - F.col("prev_close")
    return x.select(key, "ltp", "prev_close", F.when(ok, diff).otherwise(0e0).alias("change"),
                    F.when(ok, diff / F.nullif(F.col("prev_close"), F.lit(0e0)) * 1e2).otherwise(0e0).alias("change_pct"))


def write_candles(df: DataFrame, path: str, *, ts="d") -> None:
    """Columnar store partitioned by (interval, sym); only the partitions present in ``df`` are replaced."""
    (df.repartition("interval", "sym", F.year(ts)).sortWithinPartitions("interval", "sym", ts).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("interval", "sym").parquet(path))


STORE_SCHEMA = "d date, c double, v bigint, interval string, sym string"


def read_candles(spark: SparkSession, path: str, interval: str | None = None, syms: list[str] | None = None,
                 schema: str = STORE_SCHEMA) -> DataFrame:
    """Stored bars, re-validated; interval and symbols prune partitions.

    The schema is given because partition inference would read the interval ``1d`` as the number 1.0.
    """
    from barlattice.operators.clean import valid_bars

    df = spark.read.schema(schema).parquet(path)
    if interval is not None:
        df = df.filter(F.col("interval") == interval)
    if syms is not None:
        df = df.filter(F.col("sym").isin(*syms))
    return valid_bars(df)


def source_fallback(sources: list[tuple[str, DataFrame]], keys: list[str], now: Column, *, ts="d") -> DataFrame:
    """Per key the row of the first source that has one, tagged with the source and its age in ms (>= 0 for stale)."""
    parts = [df.withColumn("source", F.lit(n)).withColumn("_prio", F.lit(i)) for i, (n, df) in enumerate(sources)]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    vals = [c for c in x.columns if c not in (*keys, "_prio")]
    y = x.groupBy(*keys).agg(F.min_by(F.struct(*vals), "_prio").alias("z")).select(*keys, "z.*")
    age = F.greatest(F.date_diff(now, F.col(ts)).cast("bigint") * 86_400_000, F.lit(0))
    return y.withColumn("stale_age_ms", F.when(F.col("source") == "stale", age))


def merge_history_live(backfill: DataFrame, live: DataFrame, *, key="sym", ts="d") -> DataFrame:
    """One row per (series, time), live wins; a series without backfill is dropped.  Of several live rows of one time the largest, column by column, stands."""
    x = backfill.withColumn("_p", F.lit(0)).unionByName(live.join(backfill.select(key).distinct(), key, "left_semi")
                                                        .withColumn("_p", F.lit(1)))
    vals = [c for c in backfill.columns if c not in (key, ts)]
    return x.groupBy(key, ts).agg(F.max(F.struct("_p", *vals)).alias("z")).select(key, ts, *[F.col(f"z.{v}") for v in vals])


# ---- logs ------------------------------------------------------------------------------------------------------------

def append_once_log(log: DataFrame, entry: DataFrame, *, date="d") -> DataFrame:
    """Entries strictly later than the last logged date."""
    last = log.agg(F.max(date)).scalar()
    return entry.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")


def sanitize_log(log: DataFrame, *, by="bot", order="pos") -> DataFrame:
    """Well-formed entries with strictly ascending dates; one bad leg drops its entry."""
    fine = F.forall("targets", lambda p: p["symbol"].isNotNull() & p["qty"].isNotNull() & (p["price"] > 0) & p["weight"].isNotNull())
    ok = (F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("t").isNotNull() & F.col("eligible").isNotNull()
          & (F.col("equity") > 0) & F.col("targets").isNotNull() & F.coalesce(fine, F.lit(False)))
    x = log.filter(F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_seen", F.max("date").over(w))
    return x.filter(F.col("_seen").isNull() | (F.col("date") > F.col("_seen"))).drop("_seen")


# ---- portfolio snapshots ---------------------------------------------------------------------------------------------

# fixed values: field names of a snapshot
_INST = "kind: string, symbol: string, expiry: string, strike: double, optType: string, lotSize: double"
SNAPSHOT_SCHEMA = f"""cash double, initialCash double, realised double, lastPrices map<string, double>,
 equityCurve array<struct<t: double, c: double>>, settings struct<futuresMarginPct: double, shortOptionSpanPct: double, riskFreeRate: double>,
 positions map<string, struct<qty: double, avgPrice: double, instrument: struct<{_INST}>>>,
 orders array<struct<status: string, side: string, qty: double, limitPrice: double, lots: double, instrument: struct<{_INST}>>>"""


def snapshot_validate(docs: DataFrame, *, id_col="id", json_col="doc") -> DataFrame:
    """Every broken rule of every portfolio snapshot: (id, rule, message)."""
    s = F.from_json(json_col, SNAPSHOT_SCHEMA)
    x = docs.select(id_col, s.alias("s"))

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def yes(v: Column) -> Column:
        return F.coalesce(v, F.lit(False))

    def bad(test: Column, rule: str, message: Column) -> Column:
        return F.when(test, F.array(F.struct(F.lit(rule).alias("rule"), message.alias("message")))).otherwise(F.array())

    def inst_bad(i):
        return ~yes(i["kind"].isin("EQ", "FUT", "OPT") & (F.length(i["symbol"]) > 0))

    def expiry_bad(i):
        return ~inst_bad(i) & i["kind"].isin("FUT", "OPT") & ~yes(F.length(i["expiry"]) > 0)

    def option_bad(i):
        return ~inst_bad(i) & (i["kind"] == "OPT") & ~yes((i["strike"] > 0) & i["optType"].isin("CE", "PE"))

    def each(arr: Column, rule: str, test, text) -> Column:
        return F.transform(F.filter(arr, test), lambda e: F.struct(F.lit(rule).alias("rule"), text(e).alias("message")))

    pos = F.map_entries("s.positions")
    prices = F.map_entries("s.lastPrices")
    orders = F.filter("s.orders", lambda o: o["status"] == "PENDING")
    checks = [bad(~yes(finite(F.col(f"s.{f}"))), "cash_fields", F.lit(f"{f} holds no usable number"))
              for f in ("cash", "initialCash", "realised")]
    checks += [bad(~yes(finite(F.col(f"s.settings.{f}"))), "settings", F.lit(f"settings.{f} holds no usable number"))
               for f in ("futuresMarginPct", "shortOptionSpanPct", "riskFreeRate")]

    def at(e):
        return F.concat(F.lit("position "), e["key"])

    def order_text(o):
        return F.concat(F.lit("pending order "), F.coalesce(o["side"], F.lit("?")))

    checks += [
        each(prices, "last_price", lambda e: ~yes(finite(e["value"]) & (e["value"] > 0)), lambda e: F.concat(F.lit("price "), e["key"])),
        each(F.col("s.equityCurve"), "equity_curve", lambda e: ~yes(finite(e["t"]) & finite(e["c"])), lambda e: F.lit("curve entry")),
        each(pos, "position_numbers", lambda e: ~yes(finite(e["value"]["qty"]) & finite(e["value"]["avgPrice"])), at),
        each(pos, "position_instrument", lambda e: inst_bad(e["value"]["instrument"]), at),
        each(pos, "position_expiry", lambda e: yes(expiry_bad(e["value"]["instrument"])), at),
        each(pos, "position_option", lambda e: yes(option_bad(e["value"]["instrument"])), at),
        each(orders, "order_instrument", lambda o: inst_bad(o["instrument"]), order_text),
        each(orders, "order_expiry", lambda o: yes(expiry_bad(o["instrument"])), order_text),
        each(orders, "order_option", lambda o: yes(option_bad(o["instrument"])), order_text),
        each(orders, "order_lot_size", lambda o: o["instrument"]["lotSize"].isNotNull() & ~yes(o["instrument"]["lotSize"] > 0), order_text),
        each(orders, "order_qty", lambda o: ~yes(finite(o["qty"]) & (o["qty"] > 0)), order_text),
        each(orders, "order_limit", lambda o: ~yes(finite(o["limitPrice"]) & (o["limitPrice"] > 0)), order_text),
        each(orders, "order_side", lambda o: ~yes(o["side"].isin("BUY", "SELL")), order_text),
        each(orders, "order_lots", lambda o: ~yes(finite(o["lots"]) & (o["lots"] >= 1)), order_text),
    ]
    none = F.array().cast("array<struct<rule: string, message: string>>")
    found = F.concat(*[F.coalesce(c.cast("array<struct<rule: string, message: string>>"), none) for c in checks])
    return x.select(id_col, F.inline(found).alias("rule", "message"))


# ---- inventory -------------------------------------------------------------------------------------------------------

def symbol_sources(specs: DataFrame, benchmark: str = "MKT") -> DataFrame:
    """Distinct (symbol, interval) a table of specs needs; multi-name specs are exploded, the benchmark is always there."""
    multi = F.col("kind").isin("BASKET", "PAIRS") & F.col("universe").isNotNull()
    x = specs.select(F.explode(F.when(multi, F.col("universe")).otherwise(F.array("symbol"))).alias("symbol"),
                     F.coalesce("interval", F.lit("1d")).alias("interval"))
    one = specs.sparkSession.range(1).select(F.lit(benchmark).alias("symbol"), F.lit("1d").alias("interval"))
    return x.unionByName(one).distinct()


def data_fingerprint(df: DataFrame, *, key="sym", ts="d") -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"),
                               F.min_by("c", ts).alias("first_c"), F.max_by("c", ts).alias("last_c"))
