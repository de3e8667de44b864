"""Every registered panel query against DuckDB on the small tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import __spark_entry__ as entry
from barlattice.plans.registry import ORACLES, QUERIES
from tools.verify import compare, duck

# tree and walk-forward models without a SQL counterpart; checked by their own tests
NO_ORACLE = {"fit_gbm", "fit_forest", "feature_importance",
             "walk_forward_scores", "walk_forward_gbm", "walk_forward_forest", "walk_forward_logistic"}
# the smallest tables hold no series of the length asked for
MAY_BE_EMPTY = {"min_history"}


def test_catalogue():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_all_queries_match(spark, sf):
    con = duck(sf)

    def one(name):
        try:
            return compare(name, spark, sf, con, QUERIES, ORACLES)
        except Exception as ex:  # noqa: BLE001
            return name, "ERROR", "", str(ex)[:400]

    with ThreadPoolExecutor(4) as pool:
        res = list(pool.map(one, ORACLES))
    bad = [r for r in res if r[1] != "OK" and not (r[1] == "EMPTY" and r[0] in MAY_BE_EMPTY)]
    assert not bad, "\n".join(f"{n} {s} {d}" for n, s, _, d in bad)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
