"""Metric queries over equity curves, and the flagship trend report."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.functions.signals import strat_sma_cross
from barlattice.operators.metrics import aggregates, curve_metrics, curve_rows, drawdown_series
from barlattice.operators.returns import equity_curve, weight_returns
from barlattice.plans.registry import query

ROWS = """r as (select *, case when lag(eq) over w > 0 then eq/lag(eq) over w - 1 end ret,
               max(eq) over (partition by spec_id order by d rows between unbounded preceding and current row) pk
           from curves window w as (partition by spec_id order by d))"""
YEARS = "date_diff('day', min(d), max(d))/3.6525e2"
SQL = {
    "total_return_pct": "(arg_max(eq, d)/arg_min(eq, d) - 1)*1e2",
    "cagr_pct": f"(pow(arg_max(eq, d)/arg_min(eq, d), 1/({YEARS})) - 1)*1e2",
    "sharpe": "(avg(ret) - 6.5e-2/2.52e2)/stddev_samp(ret)*sqrt(2.52e2)",
    "sharpe_rf0": "avg(ret)/stddev_samp(ret)*sqrt(2.52e2)",
    "sortino": """(avg(ret) - 6.5e-2/2.52e2)/sqrt(sum(case when ret - 6.5e-2/2.52e2 < 0 then pow(ret - 6.5e-2/2.52e2, 2)
                   else 0 end)/count(ret))*sqrt(2.52e2)""",
    "periods_per_year": f"(count(*) - 1)/({YEARS})",
    "max_drawdown_pct": "max((pk - eq)/pk)*1e2",
}


def _metric(name):
    @query(name, "curves", f"{ROWS} select spec_id, round({SQL[name]}, 4) + 0e0 {name} from r group by spec_id")
    def run(t, name=name):
        return curve_metrics(t.curves, names=[name], digits=4)


for _n in SQL:
    _metric(_n)


@query("summary", "curves", f"{ROWS} select spec_id, count(*) bars, arg_max(eq, d) final_equity, "
       + ", ".join(f"round({e}, 2) + 0e0 {n}" for n, e in SQL.items()) + " from r group by spec_id")
def summary(t):
    return curve_metrics(t.curves, names=[*SQL, "final_equity", "bars"])


@query("drawdown_series", "curves", f"""{ROWS} select spec_id, d, round((pk-eq)/pk, 8) + 0e0 dd,
   round(last_value((pk-eq)/pk) over (partition by spec_id order by d rows between unbounded preceding and unbounded following), 8) + 0e0 current_dd
   from r""")
def dd(t):
    z = F.lit(0e0)
    return drawdown_series(t.curves).select("spec_id", "d", (F.round("dd", 8) + z).alias("dd"),
                                            (F.round("current_dd", 8) + z).alias("current_dd"))


def _report_sql(src: str) -> str:
    return f"""i as (select *, case when count(*) over w50=50 then avg(c) over w50 end s50,
             case when count(*) over w200=200 then avg(c) over w200 end s200,
             c/lag(c) over (partition by sym order by d)-1 r
      from {src} window w50 as (partition by sym order by d rows between 49 preceding and current row),
                    w200 as (partition by sym order by d rows between 199 preceding and current row)),
sg as (select *, case when s50>s200 then 1e0 else 0e0 end w from i),
e as (select *, coalesce(lag(w,2) over (partition by sym order by d),0e0)*coalesce(r,0e0)
        - 1.6e-3*abs(coalesce(lag(w,1) over (partition by sym order by d),0e0)
                    -coalesce(lag(w,2) over (partition by sym order by d),0e0)) pr from sg),
q as (select sym, d, pr, exp(sum(ln(1+pr)) over (partition by sym order by d
        rows between unbounded preceding and current row)) eq from e),
m as (select *, max(eq) over (partition by sym order by d rows between unbounded preceding and current row) pk from q)
select sym, count(*) bars, round(100*max(1-eq/pk),2) + 0e0 mdd,
       case when stddev_samp(pr) = 0 then 0e0 else round(sqrt(2.52e2)*(avg(pr)-6.5e-2/2.52e2)/stddev_samp(pr),4) + 0e0 end sharpe from m group by sym"""


def _report(candles):
    flat16 = {"buy": 1.6e-3, "sell": 1.6e-3, "borrow": 0e0}
    x = equity_curve(weight_returns(strat_sma_cross(candles), flat16))
    rows = curve_rows(x, by=("sym",)).withColumn("_r", F.col("r"))
    agg = aggregates()
    z = F.lit(0e0)
    return rows.groupBy("sym").agg(
        F.count("*").alias("bars"), (F.round(F.max("_dd") * 1e2, 2) + z).alias("mdd"),
        (F.round(agg["sharpe"], 4) + z).alias("sharpe"))


@query("trend_report", "candles_daily", _report_sql("candles_daily"))
def trend_report(t):
    return _report(t.candles_daily)


@query("trend_report_by_type", "candles_type", _report_sql("candles_type"))
def trend_report_by_type(t):
    return _report(t.candles_type)
