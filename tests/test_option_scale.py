"""Option queries whose work must grow with the structures only: one row per structure, nothing evaluated twice."""

import re

import pytest
from pyspark.sql import functions as F

from barlattice.operators import options


def packed(spark, n=4):
    spots = spark.range(n).select("id", (F.col("id") * 37 + 900.0).alias("spot"), F.lit(25.0).alias("step"), (F.col("id") + 8).alias("hdays"), F.lit(22.0).alias("iv"))
    return options.pack_legs(options.price_legs(options.structure_templates(spots)))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_horizon_extremes_need_no_join_and_no_rows_per_price(spark):
    text = plan(options.horizon_extremes(packed(spark)))
    assert "Join" not in text and text.count("Aggregate") == 1  # the packing


def test_breakevens_are_not_written_out_per_use(spark):
    """Exploding them adds a filter on their size, which must not copy the payoffs below the projections."""
    text = plan(options.breakevens(packed(spark)).select("id", "structure", F.explode("breakevens")))
    assert text.count("aggregate(") == 0 and len(text) < 50_000


def test_horizon_range_equals_the_grid(spark):
    p = packed(spark)
    grid = {(r["id"], r["structure"]): r for r in options.horizon_grid(p).groupBy("id", "structure").agg(F.count("*").alias("n"), F.max("pnl").alias("a"), F.min("pnl").alias("b")).collect()}
    got = options.horizon_range(p).collect()
    assert {r["structure"] for r in got} == set(options.SEVERAL_EXPIRIES) and len(got) == len(grid)
    for r in got:
        g = grid[r["id"], r["structure"]]
        assert r["points"] == g["n"] and r["max_profit"] == pytest.approx(g["a"]) and r["max_loss"] == pytest.approx(g["b"])
    assert "Explode" not in plan(options.horizon_range(p)) and plan(options.horizon_range(p)).count("Aggregate") == 1


def test_profile_sums_up_the_curves(spark):
    p = packed(spark).union(packed(spark).filter("structure = 'collar'").withColumn("spot", F.lit(None).cast("double")))
    want = {(r["structure"], r["point"]): r for r in options.payoff_curve(p, 24).groupBy("structure", "point").agg(
        F.count("*").alias("n"), F.avg("pnl").alias("pnl"), F.min("pnl").alias("worst"), F.max("pnl").alias("best")).collect()}
    got = options.payoff_profile(p, 24).collect()
    assert len(got) == len(want) == 15 * 25
    for r in got:
        w = want[r["structure"], r["point"]]
        assert r["n"] == w["n"] and all(r[c] == pytest.approx(w[c], abs=1e-9) for c in ("pnl", "worst", "best"))


@pytest.mark.parametrize("step", [lambda x: x, options.pack_legs, options.net_greeks])
def test_pricing_stays_below_the_size_the_jvm_compiles(spark, step):
    """Methods of more than 8,000 bytes are interpreted, a leg then takes ten times as long."""
    spots = spark.range(4).select("id", (F.col("id") + 900.0).alias("spot"), F.lit(25.0).alias("step"), (F.col("id") + 8).alias("hdays"), F.lit(22.0).alias("iv"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(step(options.price_legs(options.structure_templates(spots)))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 6000  # more columns of the spots make it larger


def test_parts_grow_with_the_spots(spark, monkeypatch):
    spots = spark.range(120).select("id", (F.col("id") + 900.0).alias("spot"), F.lit(25.0).alias("step"), (F.col("id") + 8).alias("hdays"), F.lit(22.0).alias("iv"))
    monkeypatch.setattr(options, "SPOTS_PER_TASK", 10)
    assert options.structure_templates(spots).rdd.getNumPartitions() == 12
    monkeypatch.undo()
    assert options.structure_templates(spots).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
