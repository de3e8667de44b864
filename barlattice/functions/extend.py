"""User extensions: own signals, own stateful rules, own rank scores, own cost rates, spec expansion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.functions.signals import STRATEGIES
from barlattice.operators.xsection import score_fallback

SIGNALS: dict[str, Callable[[DataFrame], DataFrame]] = dict(STRATEGIES)


def register_signal(name: str, fn: Callable[..., Column], needs: dict[str, tuple] | None = None) -> None:
    """A named signal from native columns: ``fn()`` returns the weight over the bars and the indicators in ``needs``."""
    from barlattice.functions.indicators import with_indicators

    def run(df: DataFrame, **kw) -> DataFrame:
        x = with_indicators(df, needs, **kw) if needs else df
        return x.withColumn("w", fn()).select(*df.columns, "w")

    SIGNALS[name] = run


def register_fold(name: str, make: Callable[[], Callable[[float], float]], *, key="sym", ts="d", c="c") -> None:
    """A named stateful rule: ``make()`` gives a fresh ``step(close) -> weight`` for each series.

    Series are bars (at most one row per calendar slot), so each is folded in one Arrow-batched group.
    """

    def run(df: DataFrame, **_) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", w double"

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ts, kind="stable")
            step = make()
            return pdf.assign(w=[float(step(v)) for v in pdf[c].to_numpy().tolist()])

        return df.groupBy(key).applyInPandas(fold, schema)

    SIGNALS[name] = run


def apply_signal(name: str, df: DataFrame) -> DataFrame:
    return SIGNALS[name](df)


def rank_source(rows: DataFrame, scores: DataFrame, *, by=("gi", "sym"), rule="rule") -> DataFrame:
    """Uses an external score table where it has a finite score, the rule's score elsewhere."""
    x = rows.join(scores.select(*by, F.col("score").alias("_m")), list(by), "left")
    return x.withColumn("score", score_fallback(F.col("_m"), F.col(rule))).drop("_m").filter("score is not null")


def user_cost_model(buy: float, sell: float, borrow: float = 0e0) -> dict[str, float]:
    """Rates of one side as fractions of traded value, usable wherever a built-in model is."""
    if min(buy, sell, borrow) < 0:
        raise ValueError("rates must not be negative")
    return {"buy": float(buy), "sell": float(sell), "borrow": float(borrow)}


def spec_rows(specs: DataFrame) -> DataFrame:
    """One row per part of a spec: its universe names and its weighted factors."""
    parts = F.concat(
        F.transform(F.coalesce("universe", F.array().cast("array<string>")), lambda u: F.struct(F.lit("name").alias("part"), u.alias("item"), F.lit(None).cast("double").alias("weight"))),
        F.transform(F.coalesce("factors", F.array().cast("array<struct<name:string,weight:double>>")),
                    lambda f: F.struct(F.lit("factor").alias("part"), f["name"].alias("item"), f["weight"].alias("weight"))))
    return specs.select("spec_id", F.inline(parts))
