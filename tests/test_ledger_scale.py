"""Ledger queries fold the fills once, without collecting them into arrays."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barlattice.operators import ledger
from tests.test_identities import fills_fixture, replay


def test_realised_by_fill_collects_no_fills(spark):
    _, df = fills_fixture(spark)
    plan = ledger.realised_by_fill(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_blk" not in plan and "struct(d, " not in plan  # arrays hold pieces' summaries only


@pytest.mark.parametrize("name", ["contributions", "pnl_identity"])
def test_fills_are_cut_once(spark, sf, monkeypatch, name):
    cut, calls = ledger.pin_chunks, []
    monkeypatch.setattr(ledger, "pin_chunks", lambda *a, **k: calls.append(1) or cut(*a, **k))
    assert entry.queries()[name](spark, sf).count() and len(calls) == 1


def test_short_keys_are_hashed_and_not_written(spark):
    _, df = fills_fixture(spark)
    for x in (ledger.fold_fills(df, last=True), ledger.realised_by_fill(df)):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [acct") == 1 and "Join" not in plan and "Window" not in plan and "_chunk" in plan


@pytest.mark.parametrize("piece", [5, 50_000])  # long keys cut beside short ones; all short
def test_last_fill_of_positions_gives_last_prices(spark, monkeypatch, piece):
    monkeypatch.setattr(ledger, "PIECE_ROWS", piece)
    rows, df = fills_fixture(spark, seed=33)
    df = df.union(df.filter("ok < 4").selectExpr("cast(null as bigint)", "ikey", "d", "ok + 1000", "ln", "pk", "side", "qty", "price"))
    book, _ = replay([*rows, *[(None, *r[1:]) for r in rows if r[3] < 4]])
    pos = ledger.fold_fills(df, last=True).collect()
    assert len(pos) == len(book) == len({(r["acct"], r["ikey"]) for r in pos})
    for r in pos:
        q, a, real = book[r["acct"], r["ikey"]]
        assert r["qty"] == q and r["realised"] == pytest.approx(real, abs=1e-6) and r["avg_price"] == pytest.approx(a if q else 0, abs=1e-9)
    want = {r["ikey"]: r["last"] for r in ledger.last_prices(df).collect()}
    assert {r["ikey"]: r["last"] for r in ledger.last_prices(ledger.fold_fills(df, last=True)).collect()} == want and len(want) == 3
    assert ledger.realised_by_fill(df).agg(F.sum("realised")).first()[0] == pytest.approx(sum(r["realised"] for r in pos), abs=1e-6)


@pytest.mark.parametrize("name", ["contributions", "mark_to_market", "pnl_identity"])
def test_fills_are_not_read_again_for_prices_and_fees(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" not in plan  # positions are pinned


def test_cash_of_short_accounts_is_one_window(spark, sf, monkeypatch):
    _, df = fills_fixture(spark, seed=34)
    flows = ledger.cash_flow(ledger.realised_by_fill(df)).select("acct", "d", "ikey", "ok", "ln", "pk", "flow")
    sizes = ledger.key_sizes(df, ["acct"])
    assert sizes == (600, df.groupBy("acct").count().agg(F.max("count")).first()[0])
    short = {r["ok"]: r["cash"] for r in ledger.cash_balance(flows, sizes=sizes).collect()}
    monkeypatch.setattr(ledger, "PIECE_ROWS", 5)
    long = {r["ok"]: r["cash"] for r in ledger.cash_balance(flows).collect()}
    assert len(short) == len(long) == 600 and all(long[k] == pytest.approx(v, abs=1e-6) for k, v in short.items())
    monkeypatch.undo()
    plan = entry.queries()["cash_balance"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "Join" not in plan and "LogicalRDD" not in plan  # by position, by account
