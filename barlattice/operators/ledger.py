"""Ledger analytics over fills: positions, realised results, cash, margin and first crossings.

One account may hold a third of all fills, so nothing here folds a long key in one task: its rows are cut into range
partitions of the global order, and what travels along the key is one summary row per (key, partition).  Short keys, mostly
all of them, stay whole and are hashed to their task: one shuffle, nothing written.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlattice.operators.scan import CHUNK, key_sizes, pin_chunks, prefix
from barlattice.session import pin

KEY, ORDER = ("acct", "ikey"), ("d", "ok", "ln", "pk")
INITIAL = 1e6
PIECE_ROWS = 50_000
SHORT = 5  # pieces; a key of no more rows is not cut
FUTURES_MARGIN, SHORT_OPTION_SPAN = 1.2e-1, 1e-1


def signed(side="side", qty="qty") -> Column:
    return F.when(F.col(side) == "BUY", F.col(qty)).otherwise(-F.col(qty))


def _piece(batches, key: list[str]):
    """A piece's rows, the row where each key starts, and per row the quantity before (0 where unknown) and the change by the fill."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    t = pa.Table.from_batches(parts).combine_chunks()
    new = np.zeros(len(t), dtype=bool)
    new[0] = True
    for c in key:
        x = t.column(c)
        same = pc.or_kleene(pc.equal(x[1:], x[:-1]), pc.and_(pc.is_null(x[1:]), pc.is_null(x[:-1])))
        new[1:] |= ~pc.fill_null(same, False).to_numpy()
    s = pc.fill_null(t.column("_s"), 0).to_numpy()
    starts, run = np.flatnonzero(new), np.cumsum(s)
    q1 = run - np.repeat((run - s)[starts], np.diff([*starts, len(t)]))
    held = pc.fill_null(t.column("_q").slice(0, 1), 0)[0].as_py()  # a piece's first key may come from the piece before
    q1[:starts[1] if len(starts) > 1 else len(t)] += held
    return t, starts, q1 - s, s


def _averages(al: np.ndarray, be: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of ``avg -> al * avg + be`` from the first step on, in blocks of ``width``; a step with al 0 forgets what was before."""
    n = len(al)
    a, b = np.ones(-(-n // width) * width), np.zeros(-(-n // width) * width)
    a[:n], b[:n] = al, be
    a, b = a.reshape(-1, width).T.copy(), b.reshape(-1, width).T.copy()
    for j in range(1, width):
        b[j] = np.where(a[j] == 0, b[j], a[j] * b[j - 1] + b[j])
        a[j] = np.where(a[j] == 0, 0e0, a[j] * a[j - 1])
    x, y, fa, fb = 1e0, 0e0, [], []
    for u, v in zip(a[-1].tolist(), b[-1].tolist(), strict=True):
        fa.append(x)
        fb.append(y)
        x, y = (0e0, v) if u == 0 else (u * x, u * y + v)
    ahead, base = np.array(fa), np.array(fb)
    return np.where(a == 0, 0e0, a * ahead).T.reshape(-1)[:n], np.where(a == 0, b, a * base + b).T.reshape(-1)[:n]


def _replay(batches, key: list[str]):
    """The fills of one piece: ``_piece``, closing, closed quantity, price, and the compositions up to each fill.

    avg' = al * avg + be: an opening or a flip sets the price, an addition averages, a reduction leaves it.
    """
    got = _piece(batches, key)
    if got is None:
        return None
    t, starts, q0, s = got
    q1, p = q0 + s, pc.fill_null(pc.cast(t.column("price"), pa.float64()), np.nan).to_numpy()
    idle = pc.is_null(t.column("_s")).to_numpy()
    opens = ((q0 == 0) | (np.sign(q0) * np.sign(q1) < 0)) & ~idle
    adds = (np.sign(q0) == np.sign(s)) & (q0 != 0) & ~idle
    closing = (q0 != 0) & (np.sign(q0) != np.sign(s)) & (s != 0)
    den = np.where(q1 == 0, 1, np.abs(q1)).astype("float64")
    al = np.where(opens, 0e0, np.where(adds, np.abs(q0) / den, 1e0))
    be = np.where(opens, p, np.where(adds, p * np.abs(s) / den, 0e0))
    al[starts[1:]] = 0e0  # no average comes from another key
    closed = np.where(closing, np.minimum(np.abs(s), np.abs(q0)) * np.sign(q0), 0)
    return t, starts, closing, idle, closed, p, *_averages(al, be, FANOUT)


def _pinned(fills: DataFrame, key, order) -> DataFrame:
    """Fills in pieces, sorted, with the change ``_s`` of the quantity and the quantity ``_q`` that a piece's first key brings along, null if none."""
    x = pin_chunks(fills.withColumn("_s", signed().cast("long")), list(key), list(order), piece_rows=PIECE_ROWS, ordered=True)
    tot = x.groupBy(*key, CHUNK).agg(F.sum("_s").alias("_t"))
    w = Window.partitionBy(*key).orderBy(CHUNK)
    brought = tot.select(CHUNK, F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_q"), F.row_number().over(w).alias("_n"))
    # at most one row per piece: pieces are ranges of (key, order), only their first key can have begun before
    return x.join(F.broadcast(brought.filter("_n > 1").select(CHUNK, "_q")), CHUNK, "left").select(*x.columns, "_q")


def _sorted_pieces(fills: DataFrame, key, order, sizes=None) -> list[DataFrame]:
    """Fills in sorted pieces with ``_s`` and what a piece's first key brings along, ``_q`` and the average ``_a``: short keys whole, then long keys cut.

    ``sizes``: ``key_sizes`` where known, of ``key`` or of a part of it.
    """
    key, bound = list(key), SHORT * PIECE_ROWS
    rows, longest = sizes if sizes and sizes[1] <= bound else key_sizes(fills, key)

    def whole(x):
        parts = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (4 * PIECE_ROWS)))
        x = pin_chunks(x.withColumn("_s", signed().cast("long")), key, list(order), parts=parts, ordered=True, whole_keys=True)
        return x.select("*", F.lit(None).cast("long").alias("_q"), F.lit(None).cast("double").alias("_a"))

    if longest <= bound:
        return [whole(fills)]
    long = pin(fills.groupBy(*[F.col(c).alias(f"_k_{c}") for c in key]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key])
    # long keys are few: no more than rows / bound
    return [whole(fills.join(F.broadcast(long), on, "left_anti")), _entered(_pinned(fills.join(F.broadcast(long), on, "left_semi"), key, order), key)]


FANOUT = 64  # children of a node in the summaries' trees


def _fold(seq: str) -> Column:
    """Composes affine steps (al, be, rc, rd) in order."""
    one = F.struct(F.lit(1e0).alias("al"), F.lit(0e0).alias("be"), F.lit(0e0).alias("rc"), F.lit(0e0).alias("rd"))
    return F.aggregate(seq, one, lambda a, r: F.struct(
        (a["al"] * r["al"]).alias("al"), (a["be"] * r["al"] + r["be"]).alias("be"),
        (a["rc"] + r["rc"] + r["rd"] * a["be"]).alias("rc"), (a["rd"] + r["rd"] * a["al"]).alias("rd")))


def _entering(seq: str, first: Column) -> Column:
    """The average before each step of ``seq``, ``first`` before the first one."""
    start = F.struct(first.alias("a"), F.array().cast("array<double>").alias("o"))
    return F.aggregate(seq, start, lambda x, r: F.struct((x["a"] * r["al"] + r["be"]).alias("a"), F.concat(x["o"], F.array(x["a"])).alias("o")), lambda x: x["o"])


def _above(nodes: DataFrame, key) -> DataFrame:
    """One level up: nodes ``key, _at, m`` by their ``_at div FANOUT``, the children in order as ``_b``."""
    g = nodes.groupBy(*key, F.expr(f"_at div {FANOUT}").alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_at", "m.al", "m.be", "m.rc", "m.rd"))).alias("_b"))
    return g.withColumnRenamed("_up", "_at").withColumn("m", _fold("_b"))


def _levels(pieces: DataFrame, key) -> list[DataFrame]:
    """The tree over the pieces of every key, from the pieces up to one node."""
    out = [pieces.select(*key, F.col(CHUNK).cast("long").alias("_at"), "m")]
    last = pieces.agg(F.max(CHUNK).alias("n")).first()["n"]  # one row
    while last:
        last //= FANOUT
        out.append(_above(out[-1].select(*key, "_at", "m"), key))
    return out


def _entered(x: DataFrame, key) -> DataFrame:
    """``_pinned`` fills with the average ``_a`` that a piece's first key enters with."""

    def ends(batches):
        got = _replay(batches, key)
        if got is None:
            return
        t, starts, *_, a, b = got
        first, last = ([*starts[1:], len(t)])[0] - 1, len(t) - 1
        at = [first] if first == last else [first, last]
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(t.column(c).take(rows).combine_chunks() for c in (*key, CHUNK)), pa.array([r == first for r in at]), pa.array(a[at]), pa.array(b[at], from_pandas=True)], names)

    key = list(key)
    schema = StructType([*(x.schema[c] for c in (*key, CHUNK)), *StructType.fromDDL("first boolean, al double, be double").fields])
    names = schema.names
    pieces = x.select(*key, CHUNK, "_s", "_q", "price").mapInArrow(ends, schema)
    pieces = pin(pieces.withColumn("m", F.struct("al", "be", F.lit(0e0).alias("rc"), F.lit(0e0).alias("rd"))))  # two rows a piece
    tree = _levels(pieces, key)
    enter = tree[-1].select(*key, "_at", F.lit(0e0).alias("_a"))  # the average that a node starts from
    for parents in tree[:0:-1]:
        y = parents.select(*key, "_at", "_b").join(enter, [*key, "_at"])
        enter = y.select(*key, F.inline(F.arrays_zip(F.transform("_b", lambda r: r["_at"]).alias("_at"), _entering("_b", F.col("_a")).alias("_a"))))
    first = pieces.filter("first").select(*key, CHUNK).join(enter.select(*key, F.col("_at").cast("int").alias(CHUNK), "_a"), [*key, CHUNK])
    return x.join(F.broadcast(first.select(CHUNK, "_a")), CHUNK, "left").select(*x.columns, "_a")


def _results(batches, key):
    """``_replay`` of a piece with the averages after its fills and the results they locked in."""
    got = _replay(batches, key)
    if got is None:
        return None
    t, starts, closing, idle, closed, p, a, b = got
    enter = t.column("_a")[0].as_py()
    enter = 0e0 if enter is None else enter
    after = np.where(a == 0, b, a * enter + b)
    before = np.concatenate([[enter], after[:-1]])
    return t, starts, closing, idle, after, np.where(closing, closed * (p - before), 0e0)


def fold_fills(fills: DataFrame, *, key=KEY, order=ORDER, last=False) -> DataFrame:
    """Position per (account, instrument): signed qty, average price (0 when flat) and realised result.

    ``last`` adds the order columns and ``price`` of the position's last fill, so that ``last_prices`` can read positions.
    """
    key, at_end = list(key), [*order, "price"] if last else []

    def run(batches):
        got = _results(batches, key)
        if got is None:
            return
        t, starts, _, _, after, realised = got
        ends, rows = np.array([*starts[1:], len(t)]) - 1, pa.array(starts)
        qty = np.add.reduceat(pc.fill_null(t.column("_s"), 0).to_numpy(), starts)
        yield pa.RecordBatch.from_arrays([*(t.column(c).take(rows).combine_chunks() for c in (*key, CHUNK)), pa.array(qty), pa.array(after[ends], from_pandas=True),
                                          pa.array(np.add.reduceat(realised, starts), from_pandas=True), *(t.column(c).take(pa.array(ends)).combine_chunks() for c in at_end)], names)

    schema = StructType([*(fills.schema[c] for c in key), *StructType.fromDDL(f"{CHUNK} int, dq bigint, avg double, r double").fields, *(fills.schema[c] for c in at_end)])
    names, out = schema.names, []
    inputs = list(dict.fromkeys([*key, CHUNK, "_s", "_q", "_a", "price", *at_end]))
    for x in _sorted_pieces(fills, key, order):
        g = x.select(*inputs).mapInArrow(run, schema)
        if not out:  # whole keys
            g = g.select(*key, F.col("dq").alias("qty"), F.col("avg").alias("avg_price"), F.col("r").alias("realised"), *at_end)
        else:
            g = g.groupBy(*key).agg(F.sum("dq").alias("qty"), F.max_by("avg", CHUNK).alias("avg_price"), F.sum("r").alias("realised"), *[F.max_by(c, CHUNK).alias(c) for c in at_end])
        out.append(g.withColumn("avg_price", F.when(F.col("qty") != 0, F.col("avg_price")).otherwise(0e0)))
    return reduce(DataFrame.unionByName, out)


def realised_by_fill(fills: DataFrame, *, key=KEY, order=ORDER, sizes=None) -> DataFrame:
    """Every fill with the result it locked in, the average price after it and whether it closed something.

    Short keys are folded whole.  A long key is a scan of affine maps over sorted range partitions: a piece's fills are composed in its own task, one or two
    rows a piece go up a tree per key, and a second pass starts each piece from the quantity and the average it enters with.
    """

    def run(batches):
        got = _results(batches, list(key))
        if got is None:
            return
        t, _, closing, idle, after, realised = got
        out = t.select(fills_columns)
        for name, c in (("closing", pa.array(closing, mask=idle)), ("realised", pa.array(realised, from_pandas=True)), ("avg_after", pa.array(after, from_pandas=True))):
            out = out.append_column(name, c)
        yield from out.to_batches(max_chunksize=10_000)

    fills_columns = fills.columns
    schema = StructType([*fills.schema.fields, *StructType.fromDDL("closing boolean, realised double, avg_after double").fields])
    return reduce(DataFrame.unionByName, [x.mapInArrow(run, schema) for x in _sorted_pieces(fills, key, order, sizes)])


def kind(ikey="ikey") -> Column:
    return F.substring_index(F.col(ikey), ":", 1)


def cash_flow(fills: DataFrame) -> DataFrame:
    """Cash moved by each fill: price paid or received; a future moves its realised result only."""
    v = F.when(F.col("side") == "SELL", 1e0).otherwise(-1e0) * F.col("qty") * F.col("price")
    return fills.withColumn("flow", F.when(kind() == "FUT", F.col("realised")).otherwise(v))


def cash_balance(flows: DataFrame, *, initial=INITIAL, order=("d", "ikey", "ok", "ln", "pk"), sizes=None) -> DataFrame:
    """Running cash of every account after each fill: a window over short accounts, a split prefix sum if one is long.

    ``sizes``: ``key_sizes`` of the flows by account where known; else the flows are pinned to be counted.
    """
    if sizes is None:
        flows = pin(flows)
        sizes = key_sizes(flows, ["acct"])
    rows, longest = sizes
    if longest <= SHORT * PIECE_ROWS:
        parts = max(int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (4 * PIECE_ROWS)))
        w = Window.partitionBy("acct").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return flows.repartition(parts, "acct").withColumn("cash", initial + F.sum("flow").over(w))
    x = prefix(pin_chunks(pin(flows), ["acct"], list(order)), ["acct"], list(order), sums={"_run": F.col("flow")})
    return x.withColumn("cash", initial + F.col("_run")).drop("_run", CHUNK)


def last_prices(fills: DataFrame, order=ORDER) -> DataFrame:
    return fills.groupBy("ikey").agg(F.max_by("price", F.struct(*order, "acct")).alias("last"))


def mark_to_market(pos: DataFrame, last: DataFrame) -> DataFrame:
    """Unrealised result and holdings value; a future counts its mark only, no mark means the average price."""
    x = pos.join(last, "ikey", "left")
    px = F.coalesce("last", "avg_price")
    un = F.when(F.col("last").isNotNull(), (F.col("last") - F.col("avg_price")) * F.col("qty")).otherwise(0e0)
    val = F.when(kind() == "FUT", (px - F.col("avg_price")) * F.col("qty")).otherwise(px * F.col("qty"))
    return x.withColumn("unrealised", F.when(F.col("qty") != 0, un).otherwise(0e0)).withColumn("value", F.when(F.col("qty") != 0, val).otherwise(0e0))


def margin(kind_: Column, side: Column, qty: Column, price: Column, underlying: Column) -> Column:
    """Estimated margin to open: full value, 12 % of a future's notional, premium plus 10 % span of a short option."""
    return (F.when(kind_ == "FUT", qty * price * FUTURES_MARGIN)
            .when((kind_ == "OPT") & (side == "SELL"), qty * price + qty * underlying * SHORT_OPTION_SPAN).otherwise(qty * price))


def margin_estimate(marked: DataFrame, underlying: Column) -> DataFrame:
    """Margin blocked per account: futures, short options and short shares."""
    q, px = F.abs("qty"), F.coalesce("last", "avg_price")
    short = F.col("qty") < 0
    m = F.when((kind() == "FUT") | short, margin(kind(), F.when(short & (kind() != "FUT"), "SELL").otherwise("BUY"), q, px, underlying)).otherwise(0e0)
    return marked.groupBy("acct").agg(F.sum(F.when(F.col("qty") != 0, m).otherwise(0e0)).alias("blocked"))


def pnl_identity(marked: DataFrame, flows: DataFrame, fees: DataFrame, *, initial=INITIAL) -> DataFrame:
    """Per account both sides of realised + unrealised - fees = equity - initial, and whether they differ by a cent."""
    a = marked.groupBy("acct").agg(F.sum("realised").alias("realised"), F.sum("unrealised").alias("unrealised"), F.sum("value").alias("holdings"))
    c = flows.groupBy("acct").agg(F.sum("flow").alias("flow"))
    x = a.join(c, "acct").join(fees, "acct", "left").fillna(0e0, ["fee"])
    x = x.withColumn("equity", initial + F.col("flow") - F.col("fee") + F.col("holdings"))
    x = x.withColumn("pnl", F.col("realised") + F.col("unrealised") - F.col("fee"))
    return x.withColumn("broken", F.abs(F.col("pnl") - (F.col("equity") - initial)) > 1e-2).select("acct", "equity", "pnl", "broken")


def day_pnl(samples: DataFrame, day: Column, *, key="acct", ts="ts", value="price", tie="event_id") -> DataFrame:
    o = F.struct(ts, tie)
    g = samples.groupBy(key, day.alias("day")).agg(F.min_by(value, o).alias("open"), F.max_by(value, o).alias("last"))
    return g.withColumn("pnl", F.col("last") - F.col("open"))


def contributions(realised: DataFrame, marked: DataFrame) -> DataFrame:
    """Realised result by account and instrument with the current share of gross holdings."""
    r = realised.groupBy("acct", "ikey").agg(F.sum("realised").alias("realised"))
    tot = marked.groupBy("acct").agg(F.sum(F.abs("value")).alias("_t"))
    w = marked.join(tot, "acct").select("acct", "ikey", F.when(F.col("_t") > 0, F.abs("value") / F.nullif(F.col("_t"), F.lit(0e0)) * 1e2).otherwise(0e0).alias("weight_pct"))
    return r.join(w, ["acct", "ikey"], "left").fillna(0e0, ["weight_pct"])


def pending_reservation(pending: DataFrame, live: DataFrame, underlying: Column, *, key=KEY, order=ORDER) -> DataFrame:
    """Funds promised to resting orders per account.

    Orders of one contract run through a simulated quantity that starts at the live position, so its closing capacity is
    used once; only new exposure is reserved, at the limit price.
    """
    x = pending.withColumn("_s", signed())
    x = prefix(pin_chunks(x, list(key), list(order)), list(key), list(order), sums={"_run": F.col("_s")})
    x = x.join(live.select(*key, F.col("qty").alias("_live")), list(key), "left")
    have = F.coalesce("_live", F.lit(0)) + F.col("_run") - F.col("_s")
    new = F.when((have == 0) | (F.signum(have) == F.signum("_s")), F.col("qty")).otherwise(F.col("qty") - F.least(F.col("qty"), F.abs(have)))
    return x.withColumn("new_qty", new).groupBy("acct").agg(F.sum(margin(kind(), F.col("side"), F.col("new_qty"), F.col("price"), underlying)).alias("reserved"))


def instrument_key(kind_: Column, sym: Column, expiry: Column, strike: Column, typ: Column) -> Column:
    return (F.when(kind_ == "EQ", F.concat_ws(":", F.lit("EQ"), sym)).when(kind_ == "FUT", F.concat_ws(":", F.lit("FUT"), sym, expiry))
            .otherwise(F.concat_ws(":", F.lit("OPT"), sym, expiry, strike.cast("string"), typ)))


# ---- first crossing --------------------------------------------------------------------------------------------------

def _first_at_or_below(v: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each (start, level) the first index >= start with v <= level, len(v) if none: doubling minima, walked down."""
    n = len(v)
    tables, size = [v], 1
    while size < n:
        t = tables[-1]
        nxt = t.copy()
        nxt[: n - size] = np.minimum(t[: n - size], t[size:])
        tables.append(nxt)
        size *= 2
    at = start.copy()
    for k in range(len(tables) - 1, -1, -1):
        inside = at < n
        clear = inside & (tables[k][np.minimum(at, n - 1)] > level)
        at = np.where(clear, np.minimum(at + (1 << k), n), at)
    return at


def _cross_piece(batches):
    """Looks up the orders of one range partition among its own ticks, all accounts at once."""
    parts = list(batches)
    if not parts:
        return
    pdf = pd.concat(parts).sort_values(["acct", "ts", "kind", "id"], kind="stable").reset_index(drop=True)
    acct, is_order = pdf["acct"].to_numpy(), (pdf["kind"] == 1).to_numpy()
    ends = np.searchsorted(acct, acct, side="right")  # rows are sorted by account
    px = np.where(is_order, np.nan, pdf["price"].to_numpy(dtype="float64"))
    pos = np.nonzero(is_order)[0]
    o = pdf.iloc[pos]
    level, down = o["price"].to_numpy(dtype="float64"), o["down"].to_numpy(dtype="bool")
    hit = np.full(len(pos), len(pdf))
    for flag, sign in ((True, 1.0), (False, -1.0)):
        m = down == flag
        if m.any():
            v = np.where(np.isnan(px), np.inf, sign * px)
            hit[m] = _first_at_or_below(v, pos[m] + 1, sign * level[m])
    ok = hit < ends[pos]  # a crossing in the next account's rows is none
    at = np.minimum(hit, len(pdf) - 1)
    yield pd.DataFrame({
        "acct": o["acct"].to_numpy(), "id": o["id"].to_numpy(), "down": down, "level": level, "chunk": o[CHUNK].to_numpy(),
        "cross_ts": pd.Series(pdf["ts"].to_numpy()[at]).where(ok, pd.NaT), "cross_id": pd.Series(pdf["id"].to_numpy()[at]).astype("Int64").where(ok, pd.NA),
        "cross_price": pd.Series(px[at]).where(ok)})


def _pyramid(nodes: DataFrame, key: list[str], level: int) -> DataFrame:
    """Level ``level`` above nodes ``key, at, v``: one row per parent with its children's least values, at most ``FANOUT`` of them."""
    x = nodes.groupBy(*key, F.expr(f"at div {FANOUT**level}").alias("_c")).agg(F.min("v").alias("v"))
    return x.groupBy(*key, F.expr(f"_c div {FANOUT}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("_c", "v"))).alias("kids"))


def _height(last: int) -> int:
    """Levels of a pyramid over nodes 0 to ``last``."""
    return 1 if last < FANOUT else 1 + _height(last // FANOUT)


def _descend(rows: DataFrame, kids: DataFrame, key: list[str], active: Column, parent: Column, after: Column, out: str) -> DataFrame:
    """For active rows the first child behind ``after`` that reaches the row's level, as ``out``; by one equality join."""
    none = -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20))  # rows that look for nothing meet no node, and no common key
    x = rows.withColumn("parent", F.when(active, parent).otherwise(none)).join(kids, [*key, "parent"], "left")
    hit = F.filter("kids", lambda k: (k["_c"] > after) & (k["v"] <= F.col("lv")))
    return x.withColumn(out, F.when(active, F.get(hit, F.lit(0))["_c"]).otherwise(F.col(out) if out in rows.columns else F.lit(None).cast("long"))).drop("parent", "kids")


def later_pieces(rows: DataFrame, ticks: DataFrame) -> DataFrame:
    """For orders ``acct, id, down, lv, chunk`` the first tick of a later piece that reaches the level: ``cross_ts, cross_id, cross_price`` added, or null.

    ``ticks``: ``acct, id, ts, price`` with their piece.  ``down`` waits for prices at or below; the other side works on negated prices and levels, so
    that every search is for the first value at or below ``lv``.  Pieces form a pyramid of minima, 64 children to a row.  Each piece knows the least value
    behind it inside every ancestor, which names the level where an order leaves its own branch; from there the pyramid is descended by one
    equality join per level, then the pyramid over the running records of the piece found.
    """
    side = F.explode(F.array(F.lit(True), F.lit(False)))
    sign = F.when(F.col("down"), 1e0).otherwise(-1e0)
    ends = ticks.groupBy("acct", CHUNK).agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    # where orders stand, a piece without ticks of the account is a node too
    ends = ends.unionByName(rows.select("acct", F.col("chunk").alias(CHUNK)).distinct().withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")}))
    ends = ends.groupBy("acct", CHUNK).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    nodes = ends.select("acct", F.col(CHUNK).cast("long").alias("at"), side.alias("down"), "lo", "hi").withColumn("v", F.when(F.col("down"), F.col("lo")).otherwise(-F.col("hi"))).drop("lo", "hi").checkpoint()
    top = nodes.agg(F.max("at").alias("n")).first()["n"] or 0  # one row
    height, key = _height(top), ["acct", "down"]
    behind = [F.min("v").over(Window.partitionBy(*key, F.expr(f"at div {FANOUT**(j + 1)}")).orderBy(F.expr(f"-(at div {FANOUT**j})")).rangeBetween(Window.unboundedPreceding, -1)).alias(f"_b{j}") for j in range(height)]
    marks = nodes.select(*key, F.col("at").alias("chunk"), *behind)
    x = rows.withColumn("chunk", F.col("chunk").cast("long")).join(marks, [*key, "chunk"], "left")
    leave = F.coalesce(*[F.when(F.col(f"_b{j}") <= F.col("lv"), F.lit(j)) for j in range(height)])
    x = x.withColumn("_leave", leave).drop(*[f"_b{j}" for j in range(height)])
    for j in reversed(range(height)):
        starts = F.col("_leave") == j
        parent = F.when(starts, F.expr(f"chunk div {FANOUT**(j + 1)}")).otherwise(F.col("_node") if j + 1 < height else F.lit(None))
        x = _descend(x, _pyramid(nodes, key, j), key, F.coalesce(F.col("_leave") >= j, F.lit(False)), parent, F.when(starts, F.expr(f"chunk div {FANOUT**j}")).otherwise(-1), "_node")
    # running records of pieces that are not an account's first: only those can be found
    first = nodes.groupBy("acct").agg(F.min("at").alias("_first"))
    w = Window.partitionBy("acct", CHUNK, "down").orderBy("ts", "id")
    t = ticks.join(first, "acct").filter(F.col(CHUNK) > F.col("_first")).select("acct", CHUNK, "ts", "id", "price", side.alias("down")).withColumn("v", sign * F.col("price"))
    least = F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_new", least.isNull() | (F.col("v") < least)).filter("_new")
    rec = t.select("acct", "down", F.col(CHUNK).cast("long").alias("_node"), "v", "ts", "id", (F.row_number().over(w) - 1).cast("long").alias("at")).checkpoint()
    height, key = _height(rec.agg(F.max("at").alias("n")).first()["n"] or 0), ["acct", "down", "_node"]
    x = x.withColumn("_rec", F.lit(0).cast("long"))
    x = x.withColumn("_node", F.coalesce("_node", -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    found = F.col("_node") >= 0
    for j in reversed(range(height)):
        x = _descend(x, _pyramid(rec, key, j), key, found, F.col("_rec"), F.lit(-1), "_rec")
    hit = rec.select(*key, F.col("at").alias("_rec"), F.col("ts").alias("cross_ts"), F.col("id").alias("cross_id"), (sign * F.col("v")).alias("cross_price"))
    return x.join(hit, [*key, "_rec"], "left").select(*rows.columns, "cross_ts", "cross_id", "cross_price")


def first_cross(orders: DataFrame, ticks: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """For each order the first later tick of its account at or beyond the level.

    ``orders``: (acct, id, ts, level, down) with down = waits for price <= level; ``ticks``: (acct, id, ts, price).
    Ticks and orders are range-partitioned together by (acct, time).  An order is first looked up in its own piece, then in a pyramid over the
    account's later pieces; no order carries more than one node's children.
    Output: (acct, id, cross_ts, cross_id, cross_price), nulls when never crossed.
    """
    t = ticks.select("acct", "ts", F.lit(0).alias("kind"), "id", F.col("price").cast("double").alias("price"), F.lit(False).alias("down"))
    o = orders.select("acct", "ts", F.lit(1).alias("kind"), "id", F.col("level").cast("double").alias("price"), "down")
    # a tick at the order's own time does not count, so ticks sort before orders of the same time
    x = pin_chunks(t.unionByName(o), ["acct"], ["ts", "kind", "id"], piece_rows=piece_rows)
    tsty = ticks.schema["ts"].dataType.simpleString()
    # the checkpointed partitions are the pieces, so the local lookup needs no shuffle
    res = x.mapInPandas(
        _cross_piece, f"acct bigint, id bigint, down boolean, level double, chunk int, cross_ts {tsty}, cross_id bigint, cross_price double").checkpoint()
    found = res.filter("cross_id is not null").select("acct", "id", "cross_ts", "cross_id", "cross_price")
    open_ = res.filter("cross_id is null").select("acct", "id", "down", F.when(F.col("down"), F.col("level")).otherwise(-F.col("level")).alias("lv"), "chunk")
    later = later_pieces(open_, x.filter("kind = 0").select("acct", "id", "ts", "price", CHUNK))
    return found.unionByName(later.select("acct", "id", "cross_ts", "cross_id", "cross_price"))


def limit_first_cross(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Fill of each limit order at the first later crossing tick: the better of limit and tick."""
    o = orders.select("acct", F.col("order_id").alias("id"), "ts", F.col("limit_price").alias("level"), (F.col("side") == "BUY").alias("down"))
    t = ticks.select("acct", F.col("event_id").alias("id"), "ts", "price")
    x = first_cross(o, t).join(orders.select(F.col("order_id").alias("id"), "side", "limit_price"), "id")
    fp = F.when(F.col("side") == "BUY", F.least("limit_price", "cross_price")).otherwise(F.greatest("limit_price", "cross_price"))
    return x.select(F.col("id").alias("order_id"), "acct", "cross_id", F.when(F.col("cross_id").isNotNull(), fp).alias("fill_price"))


def bracket_first_touch(brackets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Which exit of a held position comes first; the stop wins when both are hit by the same tick.

    ``brackets``: (acct, id, ts, is_long, stop, target).  Stop and target are two orders of one lookup.
    """
    legs = F.array(F.struct(F.lit(0).alias("leg"), F.col("stop").alias("level"), F.col("is_long").alias("down")),
                   F.struct(F.lit(1).alias("leg"), F.col("target").alias("level"), (~F.col("is_long")).alias("down")))
    o = brackets.select("acct", "id", "ts", F.inline(legs)).withColumn("id", F.col("id") * 2 + F.col("leg"))
    t = ticks.select("acct", F.col("event_id").alias("id"), "ts", "price")
    x = first_cross(o, t).filter("cross_id is not null").select("acct", F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 2).alias("leg"), "cross_ts", "cross_id", "cross_price")
    g = x.groupBy("acct", "id").agg(F.min_by(F.struct("leg", "cross_id", "cross_price"), F.struct("cross_ts", "cross_id", "leg")).alias("z"))
    return g.select("acct", "id", F.when(F.col("z.leg") == 0, "stop").otherwise("target").alias("exit"), "z.cross_id", "z.cross_price")
