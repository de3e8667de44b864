"""Hand-computed values, identities and brute-force comparisons on small fixtures."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlattice.functions import indicators as I
from barlattice.functions import options_math as M
from barlattice.functions import signals as S
from barlattice.operators import clean, covariance, learning, ledger, metrics, options, pairs, returns, scan, xsection
from barlattice.sources import io

D0 = dt.date(2015, 1, 1)


def series(spark, closes, sym="A"):
    return spark.createDataFrame([(sym, D0 + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)], "sym string, d date, c double")


def col(df, name="w", order="d"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def walk(n, seed, vol=0.01):
    rnd, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        c *= 1 + rnd.gauss(0, vol)
        out.append(c)
    return out


# ---- indicators and signals ------------------------------------------------------------------------------------------

def test_indicator_values(spark):
    x = I.with_indicators(series(spark, [1, 2, 3, 4, 5, 6]), {"s": ("sma", 3), "e": ("ema", 3), "h": ("high", 3), "r": ("rsi", 3), "m": ("mom", 2)})
    assert col(x, "s") == [None, None, 2, 3, 4, 5]
    assert col(x, "e")[2] == pytest.approx((1 * .5 + 2 * .5) * .5 + 3 * .5)
    assert col(x, "h") == [None, 1, 2, 3, 4, 5]
    assert col(x, "r") == [None, None, None, 100, 100, 100]
    assert col(x, "m")[2] == 2


def test_split_frames_equal_whole(spark):
    df = series(spark, walk(600, 1), "HOT").unionByName(series(spark, walk(50, 2), "COLD"))
    specs = {"s": ("sma", 20), "v": ("vol", 20), "m": ("macd_hist", 5, 9, 4), "z": ("zscore", 30)}
    a = {(r["sym"], r["d"]): r for r in I.with_indicators(df, specs).collect()}
    b = {(r["sym"], r["d"]): r for r in I.with_indicators(df, specs, split_rows=64).collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        for n in specs:
            assert (r[n] is None) == (b[k][n] is None)
            assert r[n] is None or r[n] == pytest.approx(b[k][n], rel=1e-9, abs=1e-12)


def test_prefix_matches_window(spark):
    rows = [("HOT" if i % 3 else "C%d" % (i % 7), i, (i * 37) % 11 - 5) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    p = scan.prefix(scan.pin_chunks(df, ["k"], ["i"]), ["k"], ["i"], sums={"s": F.col("v")}, maxs={"m": F.col("v")},
                    lasts={"l": F.when(F.col("v") > 3, F.col("i"))})
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    q = df.select("k", "i", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.last(F.when(F.col("v") > 3, F.col("i")), True).over(w).alias("l"))
    key = lambda r: (r["k"], r["i"], r["s"], r["m"], r["l"])
    assert sorted(map(key, p.collect()), key=str) == sorted(map(key, q.collect()), key=str)
    assert p.select("_chunk").distinct().count() > 2


def test_hold_state_toggle(spark):
    rnd = random.Random(3)
    flags = [(rnd.random() < .4, rnd.random() < .4) for _ in range(200)]
    df = spark.createDataFrame([("A", D0 + dt.timedelta(days=i), e, x) for i, (e, x) in enumerate(flags)], "sym string, d date, e boolean, x boolean")
    got = col(S.hold_state(df, F.col("e"), F.col("x")), "pos")
    pos, want = 0, []
    for e, x in flags:
        pos = (1 if e else 0) if pos == 0 else (0 if x else 1)
        want.append(pos)
    assert got == want


def test_safe_functions_null(spark):
    r = spark.range(1).select(S.safe_min(F.lit(1e0), F.lit(None).cast("double")).alias("a"), S.safe_div(F.lit(1e0), F.lit(0e0)).alias("b"),
                              S.clamp(F.lit(5e0), F.lit(0e0), F.lit(1e0)).alias("c"), S.is_true(F.lit(None).cast("boolean")).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (None, None, 1, False)


# ---- cleaning shapes -------------------------------------------------------------------------------------------------

def keep(df):
    return [r["c"] for r in clean.sanitize(df).orderBy("d").collect()]


@pytest.mark.parametrize("shape,closes,want", [
    ("clean", [100 + i % 3 for i in range(60)], None),
    ("crash that stays", [100] * 5 + [101] * 40 + [50] * 30, None),
    ("glitch", [100, 101, 10, 10, 102] + [103 + i % 2 for i in range(40)], [100, 101, 102] + [103 + i % 2 for i in range(40)]),
    ("frozen lead", [100] * 15 + [101 + i % 5 for i in range(60)], [101 + i % 5 for i in range(60)]),
    ("early step", [25 + i % 2 for i in range(20)] + [100 + i % 3 for i in range(60)], [100 + i % 3 for i in range(60)]),
])
def test_cleaning(spark, shape, closes, want):
    assert keep(series(spark, closes)) == [float(c) for c in (want or closes)]


def test_late_step_is_kept(spark):
    closes = [100 + i % 3 for i in range(80)] + [40 + i % 2 for i in range(6)]
    assert keep(series(spark, closes)) == [float(c) for c in closes]
    assert not clean.trailing_suspect_jump(series(spark, closes)).first()["suspect"]
    assert clean.trailing_suspect_jump(series(spark, closes[:82])).first()["suspect"]


def test_overlapping_glitches_match_scan(spark):
    rnd = random.Random(11)
    closes = []
    for _ in range(400):
        closes.append(100.0 * rnd.choice([1, 1, 1, .4, .35, 2.2, 1.02]))
    want, i = [], 0
    while i < len(closes):
        want.append(closes[i])
        nxt = i + 1
        if i + 1 < len(closes) and abs(closes[i + 1] / closes[i] - 1) > .4:
            back = [j for j in range(i + 2, min(i + 5, len(closes))) if abs(closes[j] / closes[i] - 1) <= .15]
            nxt = back[0] if back else nxt
        i = nxt
    got = [r["c"] for r in clean.drop_bad_prints(series(spark, closes)).orderBy("d").collect()]
    assert got == want


# ---- metrics and returns ---------------------------------------------------------------------------------------------

def test_wiped_account(spark):
    c = series(spark, [100, 120, 0, -5]).select(F.col("sym").alias("spec_id"), "d", F.col("c").alias("eq"))
    r = metrics.curve_metrics(c, names=["sharpe", "sortino", "cagr_pct", "max_drawdown_pct"]).first()
    assert r["sharpe"] <= 0 and r["sortino"] <= 0 and r["cagr_pct"] == -100 and r["max_drawdown_pct"] == 100


def test_flat_curve(spark):
    c = series(spark, [100] * 5).select(F.col("sym").alias("spec_id"), "d", F.col("c").alias("eq"))
    r = metrics.curve_metrics(c, names=["sharpe", "total_return_pct", "max_drawdown_pct"]).first()
    assert tuple(r)[1:] == (0, 0, 0)


def test_cost_rates():
    m = returns.cost_model("delivery")
    assert m["buy"] * 1e4 == pytest.approx(16.86, abs=.01) and m["sell"] * 1e4 == pytest.approx(15.36, abs=.01)


def test_one_bar_lag(spark):
    df = series(spark, [100, 110, 121, 133.1]).withColumn("w", F.lit(1e0))
    r = col(returns.weight_returns(df, {"buy": 0, "sell": 0, "borrow": 0}), "r")
    assert r[:2] == [0, 0] and r[2] == pytest.approx(.1) and r[3] == pytest.approx(.1)


def test_equity_wipe(spark):
    df = series(spark, [0, .1, -1.5, .2]).withColumnRenamed("c", "r")
    assert col(returns.equity_curve(df), "eq")[2:] == [0, 0]


# ---- cross-section ---------------------------------------------------------------------------------------------------

def test_weights_sum_to_gross(t):
    from barlattice.plans.xsection import top

    x = top(t)
    for w in (xsection.w_equal(gross=.8), xsection.w_rank(gross=.8), xsection.w_invvol(gross=.8)):
        for r in x.withColumn("w", w).groupBy("gi").agg(F.sum("w").alias("s")).collect():
            assert r["s"] == pytest.approx(.8)


def test_dead_factor_is_zero(spark):
    df = spark.createDataFrame([(0, "A", 5.0), (0, "B", 5.0)], "gi int, sym string, f double")
    assert [r["z"] for r in df.select(xsection.cs_zscore("f").alias("z")).collect()] == [0, 0]


# ---- options ---------------------------------------------------------------------------------------------------------

def test_parity_greeks_and_iv(spark):
    rnd = random.Random(5)
    rows = [(i, 100.0, rnd.uniform(70, 130), rnd.uniform(.05, 1.5), rnd.uniform(.1, .6)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s double, k double, t double, v double")
    c = [F.col(x) for x in "sktv"]
    x = M.with_option(df, F.lit("CE"), *c, price="ce", greeks=True)
    x = M.with_option(x.drop(*M.GREEKS), F.lit("PE"), *c, price="pe", greeks=True)
    up = M.with_option(x.select("*", (F.col("s") + 1e-3).alias("s2")), F.lit("PE"), F.col("s2"), *c[1:], price="pe2")
    up = up.withColumn("iv", M.implied_vol(F.lit("CE"), F.col("ce"), *c[:3]))
    for r in up.collect():
        assert r["ce"] - r["pe"] == pytest.approx(r["s"] - r["k"] * math.exp(-M.RATE * r["t"]), abs=1e-6)
        assert r["delta"] == pytest.approx((r["pe2"] - r["pe"]) / 1e-3, abs=2e-3)
        if r["ce"] - max(0, r["s"] - r["k"] * math.exp(-M.RATE * r["t"])) > .05:
            assert r["iv"] == pytest.approx(r["v"], abs=2e-3)


def test_iv_out_of_reach(spark):
    df = spark.createDataFrame([(1e6, 100.0, 100.0, .5), (-1.0, 100.0, 100.0, .5), (5.0, 100.0, 100.0, 0.0)], "p double, s double, k double, t double")
    assert [r[0] for r in df.select(M.implied_vol(F.lit("CE"), *[F.col(x) for x in "pskt"])).collect()] == [None] * 3


def test_structures(spark):
    spots = spark.createDataFrame([(1, 1000.0, 50.0, 30, 20.0)], "id int, spot double, step double, hdays int, iv double")
    p = options.pack_legs(options.price_legs(options.structure_templates(spots)))
    ext = {r["structure"]: r for r in options.payoff_extremes(p).collect()}
    assert len(ext) == len(options.TEMPLATES) == 15
    assert ext["long_call"]["unbounded_profit"] and not ext["long_call"]["unbounded_loss"]
    assert ext["short_call"]["unbounded_loss"] and ext["short_call"]["max_loss"] is None
    assert not ext["short_put"]["unbounded_loss"] and ext["short_put"]["max_loss"] == pytest.approx(-1000 + ext["short_put"]["max_profit"], abs=1e-6)
    be = {r["structure"]: r["breakevens"] for r in options.breakevens(p).collect()}
    assert len(be["straddle"]) == 2 and len(be["long_call"]) == 1 and len(be["iron_condor"]) == 2


def test_horizon_extremes_equal_dense_brute_force(spark):
    """Calendar spreads: extremes within 1e-6 of the best of a million prices."""
    legs = [("a", "CE", "SELL", 100.0, 3.0, 25.0, 10), ("a", "CE", "BUY", 100.0, 5.0, 25.0, 40), ("b", "PE", "SELL", 95.0, 2.0, 30.0, 7), ("b", "PE", "BUY", 90.0, 2.5, 33.0, 35), ("b", "CE", "BUY", 111.0, 1.0, 20.0, 35),
            ("b", "CE", "SELL", 130.0, 1.0, 20.0, 35), ("c", "PE", "SELL", 20.0, 0.1, 20.0, 5), ("c", "CE", "BUY", 90.0, 12.0, 25.0, 60), ("c", "CE", "SELL", 103.0, 5.0, 25.0, 60),
            ("c", "CE", "SELL", 104.0, 5.0, 25.0, 60), ("c", "CE", "BUY", 115.0, 2.0, 25.0, 60)]  # c peaks between two grid points
    rows = spark.createDataFrame([(1, g, o, s, k, p, v, d, 100.0) for g, o, s, k, p, v, d in legs], "id int, structure string, opt_type string, side string, strike double, premium double, iv double, leg_days int, spot double")
    packed = rows.groupBy("id", "structure").agg(F.first("spot").alias("spot"), F.collect_list(F.struct("opt_type", "side", "strike", "premium", F.lit(50e0).alias("units"), "iv", "leg_days")).alias("legs"))
    dense = {r["structure"]: r for r in options.horizon_grid(packed, 1_000_000).groupBy("structure").agg(F.max("pnl").alias("max_profit"), F.min("pnl").alias("max_loss")).collect()}
    coarse = {r["structure"]: r for r in options.horizon_grid(packed).groupBy("structure").agg(F.max("pnl").alias("max_profit"), F.min("pnl").alias("max_loss")).collect()}
    for r in options.horizon_extremes(packed).collect():
        for name in ("max_profit", "max_loss"):
            assert r[name] == pytest.approx(dense[r["structure"]][name], abs=1e-6)
    assert any(abs(coarse[g]["max_profit"] - dense[g]["max_profit"]) > 1e-4 or abs(coarse[g]["max_loss"] - dense[g]["max_loss"]) > 1e-4 for g in dense)  # the grid alone is not enough


# ---- ledger ----------------------------------------------------------------------------------------------------------

def fills_fixture(spark, n=600, seed=9):
    rnd = random.Random(seed)
    rows = [(1 if rnd.random() < .7 else rnd.randint(2, 4), rnd.choice(["EQ:A", "FUT:R", "OPT:N"]), D0 + dt.timedelta(days=i // 4), i, 1, 1, rnd.choice(["BUY", "SELL"]),
             rnd.randint(1, 9), round(rnd.uniform(90, 110), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "acct bigint, ikey string, d date, ok bigint, ln int, pk bigint, side string, qty bigint, price double")


def replay(rows):
    book, out = {}, []
    for a, k, *_rest, side, q, p in rows:
        qty, avg, real = book.get((a, k), (0, 0.0, 0.0))
        s = q if side == "BUY" else -q
        inc = 0.0
        if qty and (qty > 0) != (s > 0):
            inc = min(abs(s), abs(qty)) * (1 if qty > 0 else -1) * (p - avg)
            avg = p if (qty + s) * qty < 0 else avg
        elif qty:
            avg = (avg * abs(qty) + p * abs(s)) / abs(qty + s)
        else:
            avg = p
        book[(a, k)] = (qty + s, avg, real + inc)
        out.append(inc)
    return book, out


def test_fold_fills_hot_account(spark):
    rows, df = fills_fixture(spark)
    book, incs = replay(rows)
    for r in ledger.fold_fills(df).collect():
        q, a, real = book[(r["acct"], r["ikey"])]
        assert r["qty"] == q and r["realised"] == pytest.approx(real, abs=1e-6)
        assert r["avg_price"] == pytest.approx(a if q else 0, abs=1e-9)
    by = {r["ok"]: r["realised"] for r in ledger.realised_by_fill(df).collect()}
    assert all(by[i] == pytest.approx(v, abs=1e-6) for i, v in enumerate(incs))


def test_pnl_identity(spark):
    _, df = fills_fixture(spark, seed=10)
    flows = ledger.cash_flow(ledger.realised_by_fill(df))
    marked = ledger.mark_to_market(ledger.fold_fills(df), ledger.last_prices(df))
    fees = df.groupBy("acct").agg((F.sum(F.col("qty") * F.col("price")) * 1e-3).alias("fee"))
    assert ledger.pnl_identity(marked, flows, fees).filter("broken").count() == 0


def test_folds_over_many_pieces(spark, monkeypatch):
    """Pieces of a few fills: blocks, pieces and groups of pieces of one key are all passed through."""
    monkeypatch.setattr(ledger, "PIECE_ROWS", 5)
    monkeypatch.setattr(ledger, "FANOUT", 3)
    rows, df = fills_fixture(spark, seed=21)
    book, incs = replay(rows)
    for r in ledger.fold_fills(df).collect():
        q, a, real = book[(r["acct"], r["ikey"])]
        assert r["qty"] == q and r["realised"] == pytest.approx(real, abs=1e-6) and r["avg_price"] == pytest.approx(a if q else 0, abs=1e-9)
    by = {r["ok"]: r["realised"] for r in ledger.realised_by_fill(df).collect()}
    assert len(by) == len(rows) and all(by[i] == pytest.approx(v, abs=1e-6) for i, v in enumerate(incs))


def _first_later(ticks, orders):
    """Brute force: order -> first tick of its account in a later piece that reaches the level."""
    out = {}
    for a, i, down, level, chunk in orders:
        out[i] = next((tid for ta, tid, _, p, c in ticks if ta == a and c > chunk and (p <= level if down else p >= level)), None)
    return out


@pytest.mark.parametrize("pieces,fanout", [(10_000, 64), (300, 3), (1, 64)])
def test_crossings_in_later_pieces(spark, monkeypatch, pieces, fanout):
    """One account over many pieces, another one over every fifth of them; falling and rising records, orders in pieces without ticks."""
    monkeypatch.setattr(ledger, "FANOUT", fanout)
    rnd = random.Random(pieces)
    t0 = dt.datetime(2024, 1, 1)
    ticks = []
    for c in range(pieces):
        for a in (1, 2) if c % 5 == 0 else (1,):
            for k in range(3):
                ticks.append((a, len(ticks), t0 + dt.timedelta(seconds=10 * c + k), round(50 + 40 * math.sin(c / pieces * 9) - (k if c % 2 else -k) + rnd.random(), 3), c))
    orders = [(rnd.choice([1, 1, 2]), i, rnd.random() < .5, rnd.choice([8.0, 9.3, 12.0, 30.0, 50.0, 70.0, 88.0, 91.5, 93.0]), rnd.randrange(pieces)) for i in range(200)]
    x = spark.createDataFrame(ticks, "acct bigint, id bigint, ts timestamp, price double, _chunk int")
    o = spark.createDataFrame([(a, i, d, lv if d else -lv, c) for a, i, d, lv, c in orders], "acct bigint, id bigint, down boolean, lv double, chunk int")
    got = {r["id"]: r["cross_id"] for r in ledger.later_pieces(o, x).collect()}
    assert got == _first_later(ticks, orders)


def test_a_piece_of_falling_prices(spark, monkeypatch):
    """Every tick of the piece found is a record of its own."""
    monkeypatch.setattr(ledger, "FANOUT", 4)
    t0 = dt.datetime(2024, 1, 1)
    ticks = [(1, k, t0 + dt.timedelta(seconds=k), 1000.0 - k, k // 100) for k in range(400)]
    orders = [(1, i, True, 1000.0 - 2 * i, 0) for i in range(200)]
    x = spark.createDataFrame(ticks, "acct bigint, id bigint, ts timestamp, price double, _chunk int")
    got = {r["id"]: r["cross_id"] for r in ledger.later_pieces(spark.createDataFrame(orders, "acct bigint, id bigint, down boolean, lv double, chunk int"), x).collect()}
    assert got == _first_later(ticks, orders)


def test_first_cross_brute_force(spark):
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    ticks = [(1 if rnd.random() < .8 else 2, i, t0 + dt.timedelta(seconds=rnd.randint(0, 3000)), round(rnd.uniform(1, 100), 1)) for i in range(1500)]
    orders = [(rnd.choice([1, 1, 2]), i, t0 + dt.timedelta(seconds=rnd.randint(0, 3000)), rnd.choice([2.0, 5.0, 50.0, 95.0, 99.0]), rnd.random() < .5) for i in range(300)]
    for piece_rows in (50_000, 40):
        got = {r["id"]: r["cross_id"] for r in ledger.first_cross(
            spark.createDataFrame(orders, "acct bigint, id bigint, ts timestamp, level double, down boolean"),
            spark.createDataFrame(ticks, "acct bigint, id bigint, ts timestamp, price double"), piece_rows).collect()}
        assert len(got) == len(orders)
        for a, i, ts, level, down in orders:
            c = sorted((tt, ti) for ta, ti, tt, p in ticks if ta == a and tt > ts and (p <= level if down else p >= level))
            assert got[i] == (c[0][1] if c else None)


# ---- pairs, covariance, learning ------------------------------------------------------------------------------------

def test_pair_tiles_equal_one_tile(spark):
    rnd = np.random.default_rng(2)
    rows = [(60, f"S{i:02d}", np.log(100 * np.exp(np.cumsum(rnd.normal(0, .01, 60)))).tolist()) for i in range(23)]
    w = spark.createDataFrame(rows, "f int, sym string, logs array<double>")
    a = {(r["a"], r["b"]): r for r in pairs.pair_stats(w, -1.0).collect()}
    b = {(r["a"], r["b"]): r for r in pairs.pair_stats(w, -1.0, names_per_block=5).collect()}
    assert len(a) == 23 * 22 // 2 and a.keys() == b.keys()
    logs = {s: np.array(v) for _, s, v in rows}
    for (x, y), r in a.items():
        assert r["rho"] == pytest.approx(np.corrcoef(np.diff(logs[x]), np.diff(logs[y]))[0, 1], abs=1e-9)
        assert r["beta"] == pytest.approx(np.polyfit(logs[y], logs[x], 1)[0], rel=1e-6)
        assert b[(x, y)]["phi"] == pytest.approx(r["phi"], rel=1e-9)


def test_disjoint_pairs_equal_the_greedy_rule(spark):
    """Tile lists, name lists and the short list against the plain rule over all pairs; two hub names, tied scores."""
    rnd = np.random.default_rng(8)
    base = np.cumsum(rnd.normal(0, .01, (5, 60)), axis=1)
    rows = []
    for f in (60, 120):
        for i in range(40):
            x = base[i % 5] * (1 + .1 * (i % 3)) + rnd.normal(0, .004 * (1 + i % 4), 60) * (i > 1)
            rows.append((f, f"S{i:02d}", (4 + x).tolist()))
    rows += [(f, s + "x", v) for f, s, v in rows if s in ("S03", "S04")]  # copies: ties in score
    w = spark.createDataFrame(rows, "f int, sym string, logs array<double>")
    every = pairs.rank_pairs(pairs.pair_stats(w, 0.05)).collect()
    for f in (60, 120):
        mine = sorted((r for r in every if r["f"] == f), key=lambda r: (-r["score"], r["a"], r["b"]))
        assert [r["rk"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) > 100
    for picks in (1, 3, 7, 30):
        want = set()
        for f in (60, 120):
            used = set()
            for r in sorted((r for r in every if r["f"] == f), key=lambda r: r["rk"]):
                if len(used) < 2 * picks and r["a"] not in used and r["b"] not in used:
                    used |= {r["a"], r["b"]}
                    want.add((f, r["a"], r["b"], len(used) // 2))
        for block in (512, 9):
            st = pairs.pair_stats(w, 0.05, names_per_block=block, keep=2 * picks - 1)
            assert {(r["f"], r["a"], r["b"], r["pick"]) for r in pairs.disjoint_pairs(pairs.scored(st), picks).collect()} == want
            if block == 512:  # each of 42 names leaves its tile 2 * picks - 1 times at most
                assert st.count() <= 2 * 42 * (2 * picks - 1) / 2


def test_champion_retries_a_bar_without_candidate(spark):
    """The only curve is worth nothing on re-pick bars: the pick is made at the next bar with a candidate, and the next one counts from there."""
    from barlattice.operators import ranking

    rnd, n = np.random.default_rng(5), 140
    days = [D0 + dt.timedelta(days=i) for i in range(n)]
    eq = {s: 100 * np.exp(np.cumsum(rnd.normal(0, .01, n))) for s in "AB"}
    gone = {50, 51, 52, 83, 84}  # min_history 30 and repick 20: picks fall on 30, 50 -> 53, 73, 93, ...
    rows = [(s, d, 0.0 if i in gone else float(v[i])) for s, v in eq.items() for i, d in enumerate(days)]
    bench = spark.createDataFrame([(d,) for d in days], "d date")
    got = ranking.champion_walk_forward(spark.createDataFrame(rows, "spec_id string, d date, eq double"), bench, repick=20, min_history=30).orderBy("gi").collect()
    assert [r["gi"] for r in got] == list(range(30, n))
    assert [r["gi"] for r in got if r["pick"]] == [30, 53, 73, 93, 113, 133]
    want, held = 0.0, None
    for r in got:
        i = r["gi"]
        if held and i not in gone and i - 1 not in gone:
            want += math.log(eq[held][i] / eq[held][i - 1])
        assert r["followed"] == held
        held = r["pick"] or held
    assert got[-1]["eq"] > 0


def test_repicks_by_pointer_doubling(spark):
    from barlattice.operators import ranking

    rnd = random.Random(2)
    for n, step in ((9000, 63), (500, 1), (10, 63)):
        ok = [rnd.random() < .3 for _ in range(n)]
        got = sorted(r["i"] for r in ranking._repicks(spark.createDataFrame(list(enumerate(ok)), "i int, ok boolean"), step, n - 1).collect())
        want, at = [], 0
        while (at := next((i for i in range(at, n) if ok[i]), None)) is not None:
            want.append(at)
            at += step
        assert got == want


def test_intervals_read_at_slots_equal_the_grid(spark):
    from barlattice.operators import align

    rnd = random.Random(8)
    rows = [(s, D0 + dt.timedelta(days=i), float(i)) for s in "ABC" for i in range(400) if rnd.random() < .3 and (s != "C" or i > 200)]
    panel = spark.createDataFrame(rows, "sym string, d date, c double")
    master = align.master_timeline(panel)
    assert [r["gi"] for r in master.orderBy("d").collect()] == list(range(master.count()))
    for wanted in ([0, 5, 6, 7, 100], [], list(range(master.count()))):
        slots = spark.createDataFrame([(g,) for g in wanted], "gi int")
        got = sorted((r["gi"], r["sym"], r["c"], r["real_idx"]) for r in align.at_slots(align.align_intervals(panel, master), slots, master).collect())
        grid = align.align_grid(panel, before_listing=False).filter(F.col("gi").isin(wanted)).collect()
        assert got == sorted((r["gi"], r["sym"], r["px"], r["real_idx"]) for r in grid)


def test_boards_are_numbered_over_partitions(spark):
    """Ties, nulls last in both directions, more rows than one partition."""
    from barlattice.operators import ranking

    rnd = random.Random(12)
    rows = [(f"s{i:04d}", None if rnd.random() < .1 else float(rnd.randint(-40, 40))) for i in range(1500)]
    board = spark.createDataFrame(rows, "spec_id string, v double").repartition(7)
    for down in (True, False):
        got = {r["spec_id"]: r["rk"] for r in ranking.sort_nulls_last(board, "v", down).collect()}
        order = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[0]))
        assert got == {n: i + 1 for i, (n, _) in enumerate(order)}


def test_open_cycle_pays_its_closing(spark):
    """Only a cycle still open on the last bar pays spread, charges and brokerage of closing; the curve ends at cash plus all net results."""
    bars = series(spark, walk(20 + 21 * 3 + 9, 5), "X")
    marks = options.option_cycle_marks(bars, 1.0, premium=[1.0, 1.2]).collect()
    last = max(r["b"] for r in marks)
    paying = [r for r in marks if r["close_cost"] > 0]
    assert paying and all(r["b"] == last and not r["settled"] for r in paying)
    assert {r["cycle"] for r in paying} == {max(r["cycle"] for r in marks)}
    net = {}
    for r in marks:
        k = r["structure"], r["premium"], r["cycle"]
        if k not in net or r["b"] > net[k][0]:
            net[k] = r["b"], r["pnl"] - r["close_cost"], r["fees"]
    frame = options.option_cycle_marks(bars, 1.0, premium=[1.0, 1.2])
    for r in options.vol_premium_grid(frame, bars).collect():
        mine = [v for (s, p, _), v in net.items() if (s, p) == (r["structure"], r["premium"])]
        assert r["total_pnl"] == pytest.approx(sum(v[1] for v in mine)) and r["fees"] == pytest.approx(sum(v[2] for v in mine)) and r["cycles"] == len(mine)
        assert r["total_return_pct"] == pytest.approx(r["total_pnl"] / 1e4, abs=6e-3)


def test_rebased_benchmarks(spark):
    from barlattice.operators import ranking

    day = lambda i: D0 + dt.timedelta(days=i)
    curves = spark.createDataFrame([("a", day(i), 100.0 + i) for i in range(10, 500)] + [("b", day(i), 50.0) for i in range(0, 40)], "spec_id string, d date, eq double")
    bench = spark.createDataFrame([(day(i), 10.0 + i) for i in range(5, 500) if i not in (12, 13)], "d date, c double")
    got = {(r["spec_id"], r["d"]): r["bench_eq"] for r in ranking.benchmark_series(curves, bench).collect()}
    assert got["a", day(10)] == 110 and got["a", day(11)] == pytest.approx(110 * 21 / 20)
    assert got["a", day(12)] == got["a", day(13)] == got["a", day(11)]  # gaps carry the last price
    assert got["b", day(0)] == 50  # no price yet
    late = spark.createDataFrame([(day(i), 20.0 + i) for i in range(100, 500)], "d date, c double")
    row = ranking.common_window(curves, late).collect()
    assert [(r["spec_id"], r["started"]) for r in row] == [("a", day(100))]
    assert row[0]["return_pct"] == pytest.approx(round((599 / 200 - 1) * 100, 2)) and row[0]["other_pct"] == pytest.approx(round((519 / 120 - 1) * 100, 2))


def test_gate_flattens_and_reenters(spark):
    """Cash between exit and re-entry, a full rebalance at re-entry and the clock from there."""
    from barlattice.operators import overlays

    gate = [0, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1]
    ev = overlays.gate_events(spark.createDataFrame([("M", i, i, g) for i, g in enumerate(gate)], "sym string, d int, gi int, gate int"), 3)
    dec = overlays.gate_decisions(ev)
    assert sorted((r["gi"], r["on"]) for r in dec.collect()) == [(0, False), (1, True), (4, True), (6, False), (7, False), (9, True), (12, True), (15, True)]
    px = [100.0 * 1.01**i for i in range(16)]
    grid = spark.createDataFrame([(i, "A", p) for i, p in enumerate(px)], "gi int, sym string, px double")
    chosen = dec.select(F.lit("s").alias("spec_id"), "gi", F.lit("A").alias("sym"), F.lit(1.0).alias("w"))
    w = xsection.gated_weights(dec.withColumn("spec_id", F.lit("s")), chosen)
    free = {"buy": 0.0, "sell": 0.0, "borrow": 0.0}
    eq = {r["gi"]: r["eq"] for r in returns.basket_returns(w, grid, free).collect()}
    assert eq[7] == pytest.approx(1.01**5) and eq[8] == eq[9] == eq[10] == pytest.approx(1.01**5)  # sold at bar 7, bought at bar 10
    assert eq[15] == pytest.approx(1.01**10)
    trades = {(r["x"], r["kind"]) for r in returns.basket_trades(returns.basket_values(w, grid), w, free).collect()}
    assert trades == {(2, "entry"), (7, "exit"), (10, "entry")}


def test_optimiser_weights(t):
    from barlattice.plans.covariance import CAP, shrunk

    c, cov = shrunk(t)
    sh = covariance.shrink_delta(cov).cache()
    rp = covariance.w_riskparity(sh, cap=1e0)
    for r in covariance.risk_contributions(sh, rp).groupBy("gi").agg(F.max("risk_pct").alias("a"), F.min("risk_pct").alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], abs=1e-3)
    mv = covariance.w_meanvar(sh, c.select("gi", "sym", F.col("score").alias("mu")), cap=CAP)
    for r in mv.filter("w is not null").groupBy("gi").agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("w").alias("s")).collect():
        assert r["lo"] >= 0 and r["hi"] <= CAP + 1e-9 and r["s"] <= 1 + 1e-9


def test_linear_fits(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rnd.normal(0, .1, 400)
    lab = (x[:, 0] + rnd.normal(0, 1, 400) > 0).astype(float)
    df = spark.createDataFrame([(i % 2, float(a), float(b), float(c), float(d)) for i, ((a, b), c, d) in enumerate(zip(x, y, lab))], "dec int, z_a double, z_b double, fwd double, top double")
    got = {r["dec"]: r["w"] for r in learning.fit_ridge(df, 2.0, features=["a", "b"]).collect()}
    log = {r["dec"]: r["w"] for r in learning.fit_logistic(df, 1.0, features=["a", "b"]).collect()}
    for k in (0, 1):
        X = np.column_stack([np.ones(200), x[k::2]])
        pen = np.diag([0, 2.0, 2.0])
        assert got[k] == pytest.approx(np.linalg.solve(X.T @ X + pen, X.T @ y[k::2]), abs=1e-9)
        w = np.zeros(3)
        for _ in range(8):
            p = 1 / (1 + np.exp(-X @ w))
            h = X.T @ (X * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag([0, 1.0, 1.0])
            w = w + np.linalg.solve(h, X.T @ (lab[k::2] - p) - np.array([0, w[1], w[2]]))
        assert log[k] == pytest.approx(w, abs=1e-8)


def _tree_rows(rnd, n, folds=(0, 1)):
    out = []
    for d in folds:
        x = rnd.normal(size=(n, 3)).round(1 + d)  # ties in one fold
        out += [(d, i, *[float(v) for v in r], float((r[0] > .2) - .5 * (r[1] <= 0) * (r[0] > 0) + .1 * e)) for i, (r, e) in enumerate(zip(x, rnd.normal(size=n)))]
    return out


def _cut(x, y, w, feats, least):
    """The best split by trying every value: (gain, feature, threshold), first feature and value on ties."""
    best, n = None, w.sum()
    for f in feats:
        for thr in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= thr
            nl = w[low].sum()
            if nl < least or n - nl < least:
                continue
            gain = (w * y)[low].sum() ** 2 / nl + (w * y)[~low].sum() ** 2 / (n - nl) - (w * y).sum() ** 2 / n
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, thr)
    return best


def test_boosting_equals_brute_force(spark):
    """Folds with fewer values than bins: every value is a candidate, rounds on bins equal rounds on rows."""
    rows = _tree_rows(np.random.default_rng(3), 60)
    z = spark.createDataFrame(rows, "dec int, i int, z_a double, z_b double, z_c double, fwd double")
    model = learning.fit_gbm(z, features=["a", "b", "c"], rounds=15, bins=64)
    got = {(r["dec"], r["i"]): r["prediction"] for r in learning.predict_gbm(z, model, features=["a", "b", "c"]).collect()}
    shares = {r["dec"]: r["importance"] for r in model.collect()}
    for d in (0, 1):
        mine = [r for r in rows if r[0] == d]
        x, y = np.array([r[2:5] for r in mine]), np.array([r[5] for r in mine])
        pred, gains = np.full(len(y), y.mean()), np.zeros(3)
        for _ in range(15):
            cut = _cut(x, y - pred, np.ones(len(y)), range(3), max(1, int(len(y) * .05)))
            if cut is None:
                break
            gain, f, thr = cut
            low = x[:, f] <= thr
            pred = pred + .1 * np.where(low, (y - pred)[low].mean(), (y - pred)[~low].mean())
            gains[f] += gain
        assert [got[d, r[1]] for r in mine] == pytest.approx(pred.tolist(), abs=1e-9)
        assert shares[d] == pytest.approx((gains / gains.sum()).tolist(), abs=1e-9)


def test_forest_equals_brute_force(spark):
    """Every tree grown in plain Python from the same draws and the same features per node."""
    rows = _tree_rows(np.random.default_rng(4), 60)
    names = ["a", "b", "c"]
    z = spark.createDataFrame(rows, "dec int, i int, z_a double, z_b double, z_c double, fwd double")
    model = learning.fit_forest(z, features=names, trees=5, depth=3, bins=64)
    got = {(r["dec"], r["i"]): r["prediction"] for r in learning.predict_forest(z, model, features=names).collect()}
    draws = z.select("dec", "i", F.posexplode(F.array(*[learning._draws(F.xxhash64(F.xxhash64("z_a", "z_b", "z_c", "fwd"), F.lit(t))) for t in range(5)])).alias("tree", "k")).collect()
    weight = {(r["dec"], r["i"], r["tree"]): r["k"] for r in draws}
    assert np.mean(list(weight.values())) == pytest.approx(1, abs=.15)
    choice = learning._choice(5, 3, 3, 7)
    for d in (0, 1):
        mine = [r for r in rows if r[0] == d]
        x, y = np.array([r[2:5] for r in mine]), np.array([r[5] for r in mine])
        total = np.zeros(len(y))
        for t in range(5):
            w = np.array([weight[d, r[1], t] for r in mine], float)

            def grow(on, node, t=t, w=w):
                cut = _cut(x[on], y[on], w[on], choice[t][node], max(2, int(len(y) * .05))) if node < 8 and w[on].sum() > 0 else None
                if cut is None:
                    return {tuple(on.tolist()): (w[on] * y[on]).sum() / w[on].sum()}
                low = x[on][:, cut[1]] <= cut[2]
                return grow(on[low], 2 * node) | grow(on[~low], 2 * node + 1)

            for on, value in grow(np.arange(len(y)), 1).items():
                total[list(on)] += value
        assert [got[d, r[1]] for r in mine] == pytest.approx((total / 5).tolist(), abs=1e-9)
    assert sum(model.first()["importance"]) == pytest.approx(1)


def test_trees_learn(spark):
    rnd = np.random.default_rng(3)
    rows = [(0, *[float(v) for v in r], float(r[0] > 0)) for r in rnd.normal(size=(2000, 2))]
    z = spark.createDataFrame(rows, "dec int, z_a double, z_b double, fwd double")
    for fit, predict in learning.TREES.values():
        model = fit(z, features=["a", "b"])
        imp = learning.feature_importance(model, features=["a", "b"]).collect()
        assert {r["feature"]: r["importance"] for r in imp}["a"] > .8
        err = predict(z, model, features=["a", "b"]).agg(F.avg(F.pow(F.col("prediction") - F.col("fwd"), 2))).first()[0]
        assert err < .05


def test_pieces_stay_small_as_rows_grow(spark):
    """Ten times the rows make more pieces, not larger ones, also for one key that holds them all."""
    most = []
    for n in (4_000, 40_000):
        df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
        pinned = scan.pin_chunks(df, ["k"], ["i"], piece_rows=400)
        most.append(pinned.groupBy(scan.CHUNK).count().agg(F.max("count")).first()[0])
    assert max(most) <= 3 * 400


def test_optimiser_groups_by_several_columns(spark):
    """Two specs on one date stay apart; a name without an expected return makes its group's returns equal."""
    m = {"A": [[4.0, 1.0], [1.0, 9.0]], "B": [[1.0, 0.0], [0.0, 1.0]]}
    rows = [(s, 1, a, b, m[s]["xy".index(a)]["xy".index(b)]) for s in m for a in "xy" for b in "xy"]
    sh = spark.createDataFrame(rows, "spec string, gi int, a string, b string, sigma double")
    rp = {(r["spec"], r["sym"]): r["w"] for r in covariance.w_riskparity(sh, by=("spec", "gi")).collect()}
    assert rp[("A", "x")] == pytest.approx(0.6) and rp[("A", "y")] == pytest.approx(0.4) and rp[("B", "x")] == pytest.approx(0.5)
    mu = spark.createDataFrame([("A", 1, "x", 0.1), ("B", 1, "x", 0.1), ("B", 1, "y", 0.3)], "spec string, gi int, sym string, mu double")
    mv = {(r["spec"], r["sym"]): r["w"] for r in covariance.w_meanvar(sh, mu, by=("spec", "gi")).collect()}
    assert mv[("A", "x")] == pytest.approx(8 / 11) and mv[("A", "y")] == pytest.approx(3 / 11) and mv[("B", "y")] == pytest.approx(1, abs=1e-4)


def test_basket_specs_do_not_touch(spark):
    """A spec alone equals the spec among others; a decision before the last bar trades on it; a wiped basket stays at 0."""
    px = {"x": [10, 11, 12, 13, 12, 14, 15, 16, 15, 17, 18], "y": [5, 5, 6, 5, 7, 6, 5, 6, 7, 8, 8], "z": [4, 4, 4, -5, 4, 4, 4, 4, 4, 4, 4]}
    grid = spark.createDataFrame([(i, s, float(p)) for s, v in px.items() for i, p in enumerate(v)], "gi long, sym string, px double")
    w = [("A", 0, "x", 1.0), ("B", 0, "y", 1.0), ("B", 4, "x", 0.5), ("B", 9, "y", 1.0), ("C", 0, "z", 1.0), ("C", 2, "x", 1.0), ("D", 10, "x", 1.0)]
    weights = spark.createDataFrame(w, "spec_id string, gi long, sym string, w double")
    model = {"buy": 1e-3, "sell": 1e-3}

    def run(x):
        v = returns.basket_values(x, grid)
        return (sorted(tuple(r) for r in returns.basket_trades(v, x, model).select("spec_id", "x", "sym", "kind", "size").collect()),
                sorted(tuple(r) for r in returns.basket_returns(x, grid, model).collect()))

    trades, curves = run(weights)
    for spec in "ABCD":
        alone = run(weights.filter(F.col("spec_id") == spec))
        assert alone == ([r for r in trades if r[0] == spec], [r for r in curves if r[0] == spec])
    assert [r[:4] for r in trades if r[0] == "A"] == [("A", 1, "x", "entry")]
    assert ("B", 10, "x", "exit") in [r[:4] for r in trades] and ("B", 10, "y", "entry") in [r[:4] for r in trades]
    assert all(r[2] == 0 for r in curves if r[0] == "C" and r[1] > 3) and not [r for r in trades if r[0] == "D"]


def test_payoff_of_many_legs(spark):
    legs = [("BUY", "CE", 100.0), ("SELL", "CE", 110.0), ("BUY", "PE", 95.0), ("SELL", "PE", 90.0), ("BUY", "CE", 120.0), ("SELL", "FUT", 0.0)]
    rows = [(1, 100.0, [(s, o, k, 1.5, 10.0) for s, o, k in legs]), (2, 100.0, [(s, o, k, 1.5, 10.0) for s, o, k in legs[:2]])]
    df = spark.createDataFrame(rows, "id int, spot double, legs array<struct<side:string,opt_type:string,strike:double,premium:double,units:double>>")
    for r in options.payoff_curve(df, points=20).collect():
        want = 0.0
        for s, o, k in legs if r["id"] == 1 else legs[:2]:
            value = r["s"] if o == "FUT" else max(r["s"] - k, 0) if o == "CE" else max(k - r["s"], 0)
            want += (1 if s == "BUY" else -1) * (value - 1.5) * 10
        assert r["pnl"] == pytest.approx(want)


def test_live_rows_of_one_time_have_one_winner(spark):
    old = spark.createDataFrame([("A", 1, 1.0, 2.0)], "sym string, d int, o double, c double")
    new = spark.createDataFrame([("A", 1, 3.0, 1.0), ("A", 1, 3.0, 5.0), ("B", 1, 9.0, 9.0)], "sym string, d int, o double, c double")
    assert [tuple(r) for r in io.merge_history_live(old, new.repartition(3)).collect()] == [("A", 1, 3.0, 5.0)]


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from barlattice.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_pair_book_is_neutral(t):
    from barlattice.plans.pairs import MAXP, states

    _, s = states(t)
    assert pairs.net_exposure_check(pairs.pair_legs(s, 1e0, MAXP)).filter("not neutral").count() == 0
