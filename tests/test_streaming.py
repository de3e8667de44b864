"""Streams fed file by file against their batch twins."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from barlattice.operators import ledger
from barlattice.operators.align import ticks_to_bars
from barlattice.plans.live import EVENT_SCHEMA, NTZ
from barlattice.streaming import live as S

T0 = dt.datetime(2024, 1, 1)
ROW = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def files(spark, batches):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), u, s, float(v), "") for e, m, u, s, v in rows], ROW).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, delay="10 minutes"):
    return S.tick_stream(spark, path, EVENT_SCHEMA, delay, files_per_batch=1)


def test_bars_batch_twin_and_late_rows(spark):
    b1 = [(1, 0, 1, "A", 10), (2, 30, 1, "A", 12), (3, 59, 1, "A", 11), (4, 130, 1, "A", 20)]
    b2 = [(6, 140, 1, "A", 21)]
    b3 = [(5, 10, 1, "A", 99), (7, 400, 1, "A", 5)]  # the row at minute 10 is behind the watermark
    out = S.run_to_table(S.stream_bars(stream(spark, files(spark, [b1, b2, b3]))), "bars").withColumn("ts", F.col("ts").cast(NTZ))
    got = {r["ts"]: (r["o"], r["h"], r["l"], r["c"], r["v"]) for r in out.collect()}
    on_time = spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), s, float(v)) for e, m, _, s, v in b1 + b2 + b3[1:]], "event_id bigint, ts timestamp_ntz, sym string, price double")
    want = {r["ts"]: (r["o"], r["h"], r["l"], r["c"], r["v"]) for r in ticks_to_bars(on_time).collect()}
    assert got[T0] == (10, 12, 10, 11, 3)
    assert all(want[k] == v for k, v in got.items()) and len(got) >= 2


def test_dedupe_across_batches(spark):
    b1, b2 = [(1, 0, 1, "A", 10), (2, 1, 1, "A", 11)], [(1, 0, 1, "A", 10), (3, 2, 1, "A", 12)]
    assert sorted(r["event_id"] for r in S.run_to_table(S.stream_dedupe(stream(spark, files(spark, [b1, b2]))), "d").collect()) == [1, 2, 3]


def alerts_of(spark, batches, alerts):
    path = S.fresh_path(spark, "alerts")
    frame = spark.createDataFrame(alerts, "alert_id bigint, sym string, op string, level double")
    S.run_batches(S.stream_extremes(stream(spark, files(spark, batches))), S.alerts_batch(frame, path), "alerts")
    return sorted((r["alert_id"], r["event_id"], r["price"]) for r in S.fired_alerts(spark, path).collect())


def test_alerts_fire_once(spark):
    alerts = [(1, "A", "above", 11.0), (2, "A", "below", 1.0), (3, "A", "above", -5.0), (4, "A", "below", -5.0), (5, None, "above", 1.0)]
    b = [[(1, 0, 1, "A", 10), (2, 2, 1, "A", 13), (3, 1, 1, "A", 12)], [(4, 5, 1, "A", 15)]]
    assert alerts_of(spark, b, alerts) == [(1, 3, 12.0), (3, 1, 10.0)]


def test_alerts_of_a_hot_symbol_equal_the_batch_twin(spark):
    """Many ticks of one symbol in five batches, ties, levels of equal value, late ticks: the earliest hit of the first batch with one."""
    rnd = random.Random(3)
    batches, n = [], 0
    for k in range(5):
        rows = []
        for _ in range(400):
            n += 1
            rows.append((n, rnd.randint(0, 50) + 40 * k - (100 if rnd.random() < .1 else 0), 1, "HOT" if rnd.random() < .8 else rnd.choice("AB"), rnd.choice([0, -3, round(50 * 1.3 ** rnd.gauss(0, 2), 1)])))
        batches.append(rows)
    alerts = [(i, rnd.choice(["HOT", "HOT", "A", "C"]), rnd.choice(["above", "below"]), rnd.choice([round(50 * 1.5 ** rnd.gauss(0, 3), 1), 50.0])) for i in range(600)]
    want = []
    for i, sym, op, level in alerts:
        for rows in batches:
            hits = sorted((m, e, v) for e, m, _, s, v in rows if s == sym and v > 0 and (v >= level if op == "above" else v <= level))
            if hits:
                want.append((i, hits[0][1], float(hits[0][2])))
                break
    assert alerts_of(spark, batches, alerts) == want and 100 < len(want) < 600


def test_steps_do_not_grow_with_ticks_times_alerts(spark):
    """What travels: new highs and lows, not ticks; what an ordered pass holds: steps and the alerts of opened buckets."""
    rnd = random.Random(5)
    rows = [(i, i // 20, 1, "A", 100 + rnd.random()) for i in range(4000)]
    steps = S.run_to_table(S.stream_extremes(stream(spark, files(spark, [rows[:2000], rows[2000:]]))), "steps")
    assert steps.count() < 80
    spans = steps.filter("side = 1").orderBy("hi").select("lo", "hi").collect()
    assert spans[0]["lo"] is None and all(a["hi"] == b["lo"] for a, b in zip(spans, spans[1:]))


def test_positions_over_batches_equal_fold(spark, monkeypatch):
    from tests.test_identities import fills_fixture

    monkeypatch.setattr(S, "COMPACT_EVERY", 3)  # snapshots in between
    rows, df = fills_fixture(spark, 200, 21)
    want = {(r["acct"], r["ikey"]): r for r in ledger.fold_fills(df).collect()}
    for size in (50, 17):
        path, out = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), S.fresh_path(spark, "pos")
        for lo in range(0, 200, size):
            df.filter((F.col("ok") >= lo) & (F.col("ok") < lo + size)).coalesce(1).write.mode("append").parquet(path)
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        S.run_batches(src, S.positions_batch(out), "pos")
        got = {(r["acct"], r["ikey"]): r for r in S.latest_positions(spark, out).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            g = got[k]
            assert g["qty"] == r["qty"] and abs(g["realised"] - r["realised"]) < 1e-6 and abs(g["avg_price"] - r["avg_price"]) < 1e-6
            assert g["fills"] == sum((a, i) == k for a, i, *_ in rows)


def test_a_repeated_batch_of_positions_changes_nothing(spark):
    from tests.test_identities import fills_fixture

    _, df = fills_fixture(spark, 90, 4)
    out = S.fresh_path(spark, "pos")
    write = S.positions_batch(out)
    write(df.filter("ok < 40"), 0)
    for _ in range(2):
        write(df.filter("ok >= 40"), 1)
    got = {(r["acct"], r["ikey"]): r["qty"] for r in S.latest_positions(spark, out).collect()}
    assert got == {(r["acct"], r["ikey"]): r["qty"] for r in ledger.fold_fills(df).collect()}


def test_orders_rest_across_batches(spark):
    b = [[(1, 0, 7, "order", 50), (2, 1, 7, "tick", 60)], [(3, 2, 7, "tick", 45), (4, 3, 7, "tick", 40)]]
    tk = stream(spark, files(spark, b))
    o = tk.filter("sym = 'order'").select(F.col("event_id").alias("order_id"), "acct", "ts", F.lit("BUY").alias("side"), F.col("price").alias("limit_price"))
    out = S.run_to_table(S.stream_first_cross(o, tk.filter("sym = 'tick'")), "x").collect()
    assert [(r["order_id"], r["cross_id"], r["fill_price"]) for r in out] == [(1, 3, 45)]


def test_late_ticks_fill_no_younger_order(spark):
    b = [[(1, 0, 7, "order", 50), (2, 30, 7, "order", 50), (3, 31, 7, "tick", 60)], [(4, 10, 7, "tick", 45)], [(5, 40, 7, "tick", 44)]]
    tk = stream(spark, files(spark, b))
    o = tk.filter("sym = 'order'").select(F.col("event_id").alias("order_id"), "acct", "ts", F.lit("BUY").alias("side"), F.col("price").alias("limit_price"))
    out = S.run_to_table(S.stream_first_cross(o, tk.filter("sym = 'tick'")), "x").collect()
    assert sorted((r["order_id"], r["cross_id"]) for r in out) == [(1, 4), (2, 5)]


def test_log_is_free_of_repeats(spark):
    path = S.fresh_path(spark, "log")
    fn = S.append_log_batch(path)
    e = lambda *d: spark.createDataFrame([(dt.date(2024, 1, x), i) for i, x in enumerate(d)], "date date, entry bigint")
    fn(e(1, 2, 2), 0)
    fn(e(1, 2, 2), 0)
    fn(e(2, 3), 1)
    assert sorted(r["date"].day for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_board_updates_touched_symbols(spark):
    day = 24 * 60
    b = [[(1, 0, 1, "A", 10), (2, day, 1, "A", 12), (3, 0, 1, "B", 5)], [(4, 2 * day, 1, "A", 6)]]
    updates = S.run_to_table(S.stream_leaderboard(stream(spark, files(spark, b))), "board")
    got = {r["sym"]: (r["final_equity"], r["max_drawdown_pct"]) for r in S.latest_board(updates).collect()}
    assert got == {"A": (6.0, 50.0), "B": (5.0, 0.0)}
    assert sorted((r["sym"], r["version"]) for r in updates.collect()) == [("A", 1), ("A", 2), ("B", 1)]  # B is not written again


def test_board_equals_the_batch_metrics(spark):
    """A year and a half of daily values over seven batches, corrections of the last days, against the metrics of the whole curve."""
    from barlattice.operators.align import trailing_returns
    from barlattice.operators.metrics import curve_metrics

    rnd, day, n, batches = random.Random(6), 24 * 60, 0, []
    for k in range(7):
        rows = []
        for d in range(80 * k, 80 * k + 80):
            for s in "AB":
                if rnd.random() < .8:
                    n += 1
                    rows.append((n, d * day + rnd.randint(0, 1400), 1, s, round(100 + 40 * rnd.gauss(0, 1), 2)))
        for s in "AB":  # a later row of the last day seen before
            last = max((m // day for b in batches for _, m, _, x, _ in b if x == s), default=None)
            if last is not None:
                n += 1
                rows.append((n, last * day + 1439, 1, s, 77.0 + k))
        rnd.shuffle(rows)
        batches.append(rows)
    rows = [r for b in batches for r in b]
    ticks = spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), s, float(v)) for e, m, _, s, v in rows], "event_id bigint, ts timestamp, sym string, price double")
    curve = ticks.groupBy("sym", F.to_date("ts").alias("d")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("eq"))
    want = curve_metrics(curve, by=("sym",), names=["max_drawdown_pct", "final_equity"]).join(trailing_returns(curve, by="sym"), "sym")
    got = S.latest_board(S.run_to_table(S.stream_leaderboard(stream(spark, files(spark, batches))), "board"))
    key = lambda df: {r["sym"]: r.asDict() for r in df.collect()}
    assert key(got) == key(want) and key(got)["A"]["r1y"] is not None and key(got)["A"]["r3y"] is None
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # the session keeps its own


def test_board_leaves_out_rows_of_closed_days(spark):
    day = 24 * 60
    b = [[(1, 0, 1, "A", 10), (2, 5 * day, 1, "A", 10)], [(3, day, 1, "A", 1e6), (4, 4 * day, 1, "A", 20), (5, 6 * day, 1, "A", 15)]]
    got = S.latest_board(S.run_to_table(S.stream_leaderboard(stream(spark, files(spark, b))), "board")).first()
    assert (got["max_drawdown_pct"], got["final_equity"], got["r1d"], got["rmax"]) == (50.0, 15.0, 50.0, 50.0)  # 10, 20, 10, 15


def test_dedupe_query_keeps_ticks_that_share_symbol_and_time(spark):
    from barlattice.plans.registry import QUERIES

    sf = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(1, 0, 1, "A", 10), (2, 0, 2, "A", 11), (3, 0, 1, "B", 10)]
    spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m), u, s, float(v), "") for e, m, u, s, v in rows], ROW).write.parquet(f"{sf}/events.parquet")
    assert sorted(r["event_id"] for r in QUERIES["stream_dedupe"](spark, sf).collect()) == [1, 2, 3]
