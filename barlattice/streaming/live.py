"""Structured Streaming counterparts: bars, sliding ranges, alerts, positions, matched orders, logs and boards.

Event time carries a watermark; rows behind it are dropped, bars come out once complete.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlattice.functions.calendar import market_state
from barlattice.operators.align import CASH, TRAILING
from barlattice.operators.ledger import ORDER, _first_at_or_below, fold_fills
from barlattice.session import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_stores = {"lock": threading.Lock(), "users": 0, "before": None}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that the stateful operators need, while queries start and run; the session's own setting comes back after the last one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    with _stores["lock"]:
        if not _stores["users"]:
            _stores["before"] = spark.conf.get(name, None)
            spark.conf.set(name, ROCKS)
        _stores["users"] += 1
    try:
        yield
    finally:
        with _stores["lock"]:
            _stores["users"] -= 1
            if not _stores["users"]:
                if _stores["before"] is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, _stores["before"])


def run_to_table(stream: DataFrame, name: str, mode: str = "append", out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Runs a stream over what is available into Parquet in the shared folder and reads it back."""
    spark = stream.sparkSession
    out = out or fresh_path(spark, name)
    with rocksdb(spark):
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", ckpt or fresh_path(spark, name + "-ckpt")).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, fn, name: str, ckpt: str | None = None) -> None:
    """Runs ``fn(batch, batch_id)`` over what is available."""
    with rocksdb(stream.sparkSession):
        q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt or fresh_path(stream.sparkSession, name + "-ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination()


def tick_stream(spark: SparkSession, path: str, schema: str, delay: str = "1 hour", files_per_batch: int | None = None) -> DataFrame:
    """Ticks (event_id, ts, sym, acct, price) with a watermark on ``ts``."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    raw = r.parquet(path)
    x = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sym"), F.col("user_id").alias("acct"), F.col("value").alias("price"))
    return x.withWatermark("ts", delay)


def stream_bars(ticks: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count per bar; a bar appears once its end is behind the watermark."""
    o = F.struct("ts", "event_id")
    g = ticks.groupBy("sym", F.window("ts", interval).alias("w")).agg(
        F.min_by("price", o).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", o).alias("c"), F.count("price").alias("v"))
    return g.select("sym", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


def stream_sliding(ticks: DataFrame, size: str = "12 hours", slide: str = "1 hour") -> DataFrame:
    """Rolling high, low and mean per symbol."""
    g = ticks.groupBy("sym", F.window("ts", size, slide).alias("w")).agg(
        F.max("price").alias("hi"), F.min("price").alias("lo"), F.avg("price").alias("mean"), F.count("*").alias("n"))
    return g.select("sym", F.col("w.end").alias("at"), "hi", "lo", "mean", "n")


def stream_dedupe(ticks: DataFrame, keys=("sym", "ts")) -> DataFrame:
    """One row per key within the watermark; later repeats and rows behind it are dropped.

    By default a symbol has one tick per time; where several ticks may share it, the event id belongs to ``keys``.
    """
    return ticks.dropDuplicatesWithinWatermark(list(keys))


def stream_session_filter(ticks: DataFrame, holidays) -> DataFrame:
    return ticks.filter(market_state(F.col("ts"), holidays)["is_open"])


def stream_equity_samples(ticks: DataFrame, seconds: int = 30) -> DataFrame:
    """Last account value of each slot."""
    g = ticks.groupBy("acct", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("value"))
    return g.select("acct", F.col("w.start").alias("slot"), "value")


def stream_day_start(ticks: DataFrame) -> DataFrame:
    """First account value of each local trading day (the day starts at 18:30 UTC)."""
    g = ticks.groupBy("acct", F.window("ts", "1 day", "1 day", "1110 minutes").alias("w")).agg(F.min_by("price", F.struct("ts", "event_id")).alias("value"))
    return g.select("acct", F.to_date(F.col("w.start") + F.expr("interval 330 minutes")).alias("day"), "value")


# ---- stateful operators ----------------------------------------------------------------------------------------------

def _new_highs(x: pd.DataFrame) -> pd.DataFrame:
    """Rows above all earlier ones of their (sym, side), by time and event id; ``lo`` is the highest before, NaN for the first."""
    x = x.sort_values(["sym", "side", "ts", "event_id"], kind="stable", ignore_index=True)
    x["lo"] = x.groupby(["sym", "side"])["hi"].cummax().groupby([x["sym"], x["side"]]).shift()
    return x[x["lo"].isna() | (x["hi"] > x["lo"])]


class _Extremes(StatefulProcessor):
    """The highest value of a (sym, side) so far; emits the steps by which a batch raises it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._top = handle.getValueState("top", "top double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in rows:  # what no longer rises is dropped part by part
            held = _new_highs(pdf if held is None else pd.concat([held, pdf], ignore_index=True))
        if self._top.exists():
            top = self._top.get()[0]
            held = held[held["hi"] > top]
            held = held.assign(lo=held["lo"].fillna(top).clip(lower=top))
        if len(held):
            self._top.update((float(held["hi"].iloc[-1]),))
            yield held[["sym", "side", "lo", "hi", "event_id", "price"]]

    def close(self) -> None:
        pass


def stream_extremes(ticks: DataFrame) -> DataFrame:
    """(sym, side, lo, hi, event_id, price): each tick that is the highest (side 1) or lowest (side -1, negated) of its symbol so far.

    ``(lo, hi]`` are the levels it is the first to reach; over all batches these ranges don't overlap.  Every input task reduces its ticks to its own new
    highs and lows before they travel, so a hot symbol sends a few rows from each task.  Needs the RocksDB state store (``run_*`` set it).
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = pd.concat([pdf.assign(side=1, hi=pdf["price"]), pdf.assign(side=-1, hi=-pdf["price"])], ignore_index=True)
            yield _new_highs(both)[["sym", "side", "ts", "event_id", "price", "hi"]]

    x = ticks.filter("price > 0 and sym is not null").select("sym", "ts", "event_id", "price")
    x = x.mapInPandas(local, "sym string, side int, ts timestamp, event_id bigint, price double, hi double")
    return x.groupBy("sym", "side").transformWithStateInPandas(_Extremes(), "sym string, side int, lo double, hi double, event_id bigint, price double", "Append", "None")


def _bucket(level: Column) -> Column:
    """Eighths of an octave; levels from 2 ** -50 to 2 ** 100, what lies outside is in the outermost ones."""
    return F.floor(F.log2(F.least(F.greatest(level, F.lit(2.0**-50)), F.lit(2.0**100))) * 8).cast("int")


def alerts_batch(alerts: DataFrame, path: str):
    """Per batch of ``stream_extremes``: the alerts first reached, (alert_id, event_id, price), under the batch id; an alert fires once.

    ``alerts``: (alert_id, sym, op, level), a static table.  Alerts are indexed by buckets of their level; a batch opens the buckets that its new
    highs and lows cross.  Inside a bucket one ordered pass finds each alert's step, so rows add up and nothing is paired.
    """
    side = F.when(F.col("op") == "above", 1).otherwise(-1)
    indexed = alerts.select("alert_id", "sym", side.alias("side"), (side * F.col("level")).alias("v"), _bucket(F.col("level")).alias("bucket"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/steps/batch={batch_id}")  # the state is read once
        step = spark.read.schema(batch.schema).parquet(f"{path}/steps/batch={batch_id}")
        up = F.col("side") == 1
        low, high = F.when(up, F.coalesce("lo", F.lit(0e0))).otherwise(-F.col("hi")), F.when(up, F.col("hi")).otherwise(F.coalesce(-F.col("lo"), F.lit(2.0**101)))
        step = step.withColumn("bucket", F.explode(F.sequence(_bucket(low), _bucket(high))))
        spec = ["sym", "side", "bucket"]
        wanted = indexed.join(step.select(*spec).distinct(), spec, "left_semi")
        rec = F.struct("lo", "event_id", "price")
        rows = wanted.select(*spec, "v", F.lit(0).alias("kind"), "alert_id", F.lit(None).cast("struct<lo:double,event_id:bigint,price:double>").alias("rec"))
        rows = rows.unionByName(step.select(*spec, F.col("hi").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("alert_id"), rec.alias("rec")))
        w = Window.partitionBy(*spec).orderBy(F.desc("v"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        fired = rows.withColumn("rec", F.last("rec", ignorenulls=True).over(w)).filter("kind = 0 and rec is not null and (rec.lo is null or rec.lo < v)")
        fired.select("alert_id", "rec.event_id", "rec.price").write.mode("overwrite").parquet(f"{path}/fired/batch={batch_id}")

    return write


def fired_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/fired").parquet(f"{path}/fired").drop("batch")


COMPACT_EVERY = 16  # batches from one whole snapshot of positions to the next


def _positions_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The newest row of every key before a batch: the last snapshot and the batches since."""
    x = spark.read.schema("acct bigint, ikey string, qty bigint, avg_price double, realised double, fills bigint, batch bigint").option("basePath", path).parquet(path)
    x = x.filter((F.col("batch") < batch_id) & (F.col("batch") >= batch_id // COMPACT_EVERY * COMPACT_EVERY - 1))
    newest = x.groupBy("acct", "ikey").agg(F.max_by(F.struct("qty", "avg_price", "realised", "fills"), "batch").alias("z"))
    return newest.select("acct", "ikey", "z.*")


def positions_batch(path: str):
    """Per batch of fills: the new position of every key it touches, under the batch id; every 16th batch holds all keys.

    A position is carried into a batch as one opening fill of its quantity at its average price, so a batch is folded like any ledger: split
    over pieces whatever the keys are, with affine summaries composed in order.  Batches follow in the order of their fills.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        shared_dir(spark)
        new = batch.select("acct", "ikey", *ORDER, "side", "qty", "price", F.lit(1).alias("_o")).checkpoint()
        seen = new.groupBy("acct", "ikey").agg(F.count("*").alias("_n"))
        if batch_id:
            old = _positions_before(spark, path, batch_id)
            held = old.filter("qty <> 0").join(seen, ["acct", "ikey"], "left_semi")
            opening = held.select("acct", "ikey", *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in ORDER], F.when(F.col("qty") > 0, "BUY").otherwise("SELL").alias("side"),
                                  F.abs("qty").alias("qty"), F.col("avg_price").alias("price"), F.lit(0).alias("_o"))
            new = new.unionByName(opening)
        pos = fold_fills(new, order=("_o", *ORDER)).join(seen, ["acct", "ikey"])
        if not batch_id:
            out = pos.select("acct", "ikey", "qty", "avg_price", "realised", F.col("_n").alias("fills"))
        else:
            how = "full" if (batch_id + 1) % COMPACT_EVERY == 0 else "left"
            was = old.select("acct", "ikey", F.col("qty").alias("_q"), F.col("avg_price").alias("_a"), F.col("realised").alias("_r"), F.col("fills").alias("_f"))
            out = pos.join(was, ["acct", "ikey"], how).select(
                "acct", "ikey", F.coalesce("qty", "_q").alias("qty"), F.coalesce("avg_price", "_a").alias("avg_price"),
                (F.coalesce("realised", F.lit(0e0)) + F.coalesce("_r", F.lit(0e0))).alias("realised"), (F.coalesce("_n", F.lit(0)) + F.coalesce("_f", F.lit(0))).alias("fills"))
        out.select("acct", "ikey", F.col("qty").cast("bigint"), "avg_price", "realised", "fills").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_positions(spark: SparkSession, path: str) -> DataFrame:
    """Current position of every key; ``fills`` counts the fills seen."""
    last = spark.read.option("basePath", path).parquet(path).agg(F.max("batch").alias("n")).first()["n"]  # one row
    return _positions_before(spark, path, last + 1)


class _Book(StatefulProcessor):
    """Resting limit orders of one account; an order leaves the state when a tick of a later time crosses it, so late ticks fill no younger order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getListState("open", "id bigint, level double, down boolean, placed bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "kind", "id"], kind="stable").reset_index(drop=True)
        old = list(self._open.get())
        order = (pdf["kind"] == 1).to_numpy()
        time = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        px = np.where(order, np.nan, pdf["price"].to_numpy(dtype=float))
        ids = np.array([o[0] for o in old] + pdf["id"][order].tolist(), dtype="int64")
        level = np.array([o[1] for o in old] + pdf["price"][order].tolist(), dtype=float)
        down = np.array([o[2] for o in old] + pdf["down"][order].tolist(), dtype=bool)
        placed = np.array([o[3] for o in old] + time[order].tolist(), dtype="int64")
        start = np.concatenate([np.searchsorted(time, placed[:len(old)], side="right"), np.nonzero(order)[0] + 1]).astype(int)
        hit = np.full(len(ids), len(pdf))
        for flag, sign in ((True, 1.0), (False, -1.0)):
            m = down == flag
            if m.any():
                v = np.where(np.isnan(px), np.inf, sign * px)
                hit[m] = _first_at_or_below(v, start[m], sign * level[m])
        done = hit < len(pdf)
        rest = [(int(i), float(lv), bool(dn), int(at)) for i, lv, dn, at, f in zip(ids, level, down, placed, done) if not f]
        if rest:
            self._open.put(rest)
        else:
            self._open.clear()
        if done.any():
            at = hit[done]
            tick = px[at]
            fill = np.where(down[done], np.minimum(level[done], tick), np.maximum(level[done], tick))
            yield pd.DataFrame({"order_id": ids[done], "acct": int(key[0]), "cross_id": pdf["id"].to_numpy()[at], "fill_price": fill})

    def close(self) -> None:
        pass


def stream_first_cross(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Fills of resting limit orders as ticks arrive: (order_id, acct, cross_id, fill_price)."""
    t = ticks.select("acct", "ts", F.lit(0).alias("kind"), F.col("event_id").alias("id"), "price", F.lit(False).alias("down"))
    o = orders.select("acct", "ts", F.lit(1).alias("kind"), F.col("order_id").alias("id"), F.col("limit_price").alias("price"), (F.col("side") == "BUY").alias("down"))
    return t.union(o).groupBy("acct").transformWithStateInPandas(_Book(), "order_id bigint, acct bigint, cross_id bigint, fill_price double", "Append", "None")


# ---- foreachBatch sinks ----------------------------------------------------------------------------------------------

def append_log_batch(path: str, date="date"):
    """Appends the entries of a batch whose date is later than the last one logged; a replayed batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        one = batch.groupBy(date).agg(F.min("entry").alias("entry"))
        try:
            log = spark.read.schema(one.schema).parquet(path)
        except Exception as ex:  # noqa: BLE001 - the first batch has no log yet
            if "PATH_NOT_FOUND" not in str(ex):
                raise
            log = spark.createDataFrame([], one.schema)
        last = log.agg(F.max(date)).scalar()
        new = one.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")
        new.write.mode("append").parquet(path)

    return write


# ---- boards ----------------------------------------------------------------------------------------------------------

class _Curve(StatefulProcessor):
    """Summary of one symbol's daily curve.

    Days older than the last ``open_days`` are closed: of them first value, peak and largest drawdown are kept, and the values of the longest trailing
    window.  Open days still change with rows of a later time.
    """

    def __init__(self, open_days: int):
        self._open_days = open_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sum = handle.getValueState("sum", "version bigint, first double, peak double, worst double, upto bigint")
        self._days = handle.getListState("days", "day bigint, ts bigint, event_id bigint, eq double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version, first, peak, worst, upto = self._sum.get() if self._sum.exists() else (0, None, None, 0.0, None)
        days = pd.DataFrame(list(self._days.get()), columns=["day", "ts", "event_id", "eq"]).astype({"day": "int64", "ts": "int64", "event_id": "int64", "eq": "float64"})
        for pdf in rows:
            new = pdf[["day", "ts", "event_id", "eq"]]
            new = new if upto is None else new[new["day"] > upto]
            days = _last_of_day(pd.concat([days, new], ignore_index=True))
        if days.empty:
            return
        day, eq = days["day"].to_numpy(), days["eq"].to_numpy()
        shut = day[-1] - self._open_days
        fresh = (day <= shut) if upto is None else (day > upto) & (day <= shut)
        later = day > shut
        first = float(eq[0]) if first is None and fresh.any() else first
        peak, worst = _drawdown(peak, worst, eq[fresh])
        now_worst = _drawdown(peak, worst, eq[later])[1]
        upto = int(shut) if fresh.any() or upto is not None else None
        out = {"sym": key[0], "version": version + 1, "first": float(eq[0]) if first is None else first, "last": float(eq[-1]), "before": float(eq[-2]) if len(eq) > 1 else float(eq[0]), "worst": now_worst}
        for name, age in TRAILING.items():
            old = np.flatnonzero(day[-1] - day >= age)
            out[name] = float(eq[old[-1]]) if len(old) else None
        keep = np.flatnonzero(day[-1] - day >= max(TRAILING.values()))
        self._days.put([(int(a), int(b), int(c), float(d)) for a, b, c, d in days.iloc[keep[-1] if len(keep) else 0:].itertuples(index=False)])
        self._sum.update((version + 1, first, peak, float(worst), upto))
        yield pd.DataFrame([out])

    def close(self) -> None:
        pass


def _last_of_day(x: pd.DataFrame) -> pd.DataFrame:
    return x.sort_values(["day", "ts", "event_id"], kind="stable").drop_duplicates("day", keep="last", ignore_index=True)


def _drawdown(peak: float | None, worst: float, eq: np.ndarray) -> tuple[float | None, float]:
    """Peak and largest drawdown after more values of a curve."""
    if not len(eq):
        return peak, worst
    tops = np.maximum.accumulate(eq if peak is None else np.maximum(eq, peak))
    with np.errstate(all="ignore"):
        down = np.where(tops > 0, np.minimum(1.0, (tops - eq) / tops), 0.0)
    return float(tops[-1]), max(worst, float(down.max()))


def stream_leaderboard(ticks: DataFrame, open_days: int = 2) -> DataFrame:
    """Per batch the new board row of every symbol it touches: (sym, version, max_drawdown_pct, final_equity, r1d, trailing returns, rmax).

    State is one summary per symbol: a batch reads its own rows and the summaries it changes.  Input tasks send one row per symbol and day.
    Rows of a day that has been closed (``open_days`` before the symbol's last) come too late and are left out.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["sym", "day", "ts", "event_id"], kind="stable").drop_duplicates(["sym", "day"], keep="last")

    x = ticks.filter("sym is not null").select("sym", F.unix_date(F.to_date("ts")).cast("bigint").alias("day"), F.unix_micros("ts").alias("ts"), "event_id", F.col("price").alias("eq"))
    x = x.mapInPandas(local, "sym string, day bigint, ts bigint, event_id bigint, eq double")
    bases = ", ".join(f"{n} double" for n in TRAILING)
    x = x.groupBy("sym").transformWithStateInPandas(_Curve(open_days), f"sym string, version bigint, first double, last double, before double, worst double, {bases}", "Append", "None")
    two = lambda v: F.round(v, 2) + F.lit(0e0)
    return x.select("sym", "version", two(F.col("worst") * 1e2).alias("max_drawdown_pct"), two(F.col("last")).alias("final_equity"), pct_from("before").alias("r1d"),
                    *[F.when(F.col(n).isNotNull(), pct_from(n)).alias(n) for n in TRAILING], pct_from("first").alias("rmax"))


def pct_from(base: str, last: str = "last", cash: float = CASH) -> Column:
    b, v = F.col(base), F.col(last)
    return F.round(F.when(b > 0, (v / F.nullif(b, F.lit(0e0)) - 1) * 1e2).otherwise((v - b) / cash * 1e2), 2) + F.lit(0e0)


def latest_board(updates: DataFrame) -> DataFrame:
    """The newest row of every symbol."""
    cols = [c for c in updates.columns if c not in ("sym", "version")]
    return updates.groupBy("sym").agg(F.max_by(F.struct(*cols), "version").alias("z")).select("sym", "z.*")


def symbols_of_interest(watch: DataFrame, positions: DataFrame, alerts: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct symbols watched, held, with an open alert or a resting order."""
    x = watch.select("sym")
    for df in (positions, alerts, orders):
        x = x.union(df.select("sym"))
    return x.filter("sym is not null").distinct()
