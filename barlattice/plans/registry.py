"""Catalogue of runnable queries, each paired with the DuckDB text it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.session import pin
from barlattice.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Lazy access to the views of one scale-factor directory: ``t.candles_daily``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._pinned = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self._pinned[name] if name in self._pinned else view(self.spark, self.sf_dir, name, self._pinned)

    def pin(self, name: str) -> DataFrame:
        """A view read several times by one query: computed once and kept by a reliable checkpoint."""
        if name not in self._pinned:
            self._pinned[name] = pin(view(self.spark, self.sf_dir, name, self._pinned))
        return self._pinned[name]


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(t: Inputs) -> DataFrame`` under ``name``; ``sql`` may use the space-separated ``views``."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql)
        return fn

    return deco


def rr(x: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for results compared row by row."""
    return F.round(x, digits) + F.lit(0e0)


def tr(x: Column | str, digits: int = 2) -> Column:
    """Rounding for values that often sit on a decimal tie: ties are pushed up before the cut."""
    x = F.col(x) if isinstance(x, str) else x
    p = float(10 ** digits)
    return F.floor(x * p + 5.001e-1) / p + F.lit(0e0)


def tr_sql(x: str, digits: int = 2) -> str:
    p = repr(float(10 ** digits)) + "e0"
    return f"floor(({x})*{p} + 5.001e-1)/{p} + 0e0"
