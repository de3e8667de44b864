"""Panel views derived from the raw tables.

Each view is a piece of SQL in the dialect both Spark and DuckDB accept, so the same rows feed the Spark job and
its oracle.  ``{name}`` placeholders are not used: a view refers to earlier views by name and ``resolve`` puts the
needed ones, in dependency order, into one WITH clause.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _chain(source: str, key: str) -> str:
    """Chained walk whose daily step comes from the traded amount (bounded near +-2 % a day)."""
    part_by = "partition by sym "
    return f"""
    select sym, d, v, floor((1e2*exp(sum(step) over ({part_by}order by d
           rows between unbounded preceding and current row)/1e4))*1e4+5e-1)/1e4 c
    from (select sym, d, v, cast(cast(amt*100 as bigint) % 401 as int) - 199 as step
          from (select {key} sym, cast(l_shipdate as date) d,
                       sum(cast(l_extendedprice as decimal(18,2))) amt, cast(sum(l_quantity) as bigint) v
                from {source} group by {key}, cast(l_shipdate as date)) x) y"""


# name -> (dependencies, sql)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "candles_daily": ((), _chain("lineitem join part on l_partkey = p_partkey", "p_brand")),
    "candles_type": ((), _chain("lineitem join part on l_partkey = p_partkey", "p_type")),
    "market_daily": ((), """
    select sym, d, v, floor((1e2*exp(sum(step) over (partition by sym order by d
           rows between unbounded preceding and current row)/1e4))*1e4+5e-1)/1e4 c
    from (select 'MKT' sym, d, v, cast(cast(amt*100 as bigint) % 401 as int) - 199 as step
          from (select cast(l_shipdate as date) d, sum(cast(l_extendedprice as decimal(18,2))) amt,
                       cast(sum(l_quantity) as bigint) v
                from lineitem group by cast(l_shipdate as date)) x) y"""),
    "candles_dirty": (("candles_daily",), """
    select sym, d, v, rn,
           floor((case when sym = 'Brand#1' and rn <= 12 then c0
                       when sym = 'Brand#2' and rn < 40 then c*2.5e-1
                       when sym = 'Brand#3' and rn in (60, 61) then c*1e-1
                       when sym = 'Brand#4' and rn >= n - 1 then c*5e-1
                       else c end)*1e4+5e-1)/1e4 c,
           case when rn % 37 = 0 or (sym = 'Brand#5' and rn % 7 = 0) then null
                else floor((c*9.5e-1)*1e4+5e-1)/1e4 end a
    from (select *, row_number() over (partition by sym order by d) rn, count(*) over (partition by sym) n,
                 first_value(c) over (partition by sym order by d) c0 from candles_daily) r"""),
    "ohlc_daily": (("candles_daily",), """
    select sym, d, o, floor((greatest(o,c)*1.004e0)*1e4+5e-1)/1e4 h, floor((least(o,c)*9.96e-1)*1e4+5e-1)/1e4 l, c, v
    from (select *, coalesce(lag(c) over (partition by sym order by d), c) o from candles_daily) r"""),
    "ticks": ((), "select event_id, ts, event_type sym, user_id acct, value price from events"),
    "fills": ((), """
    select l_suppkey acct, concat(case l_returnflag when 'A' then 'EQ:' when 'N' then 'OPT:' else 'FUT:' end, l_returnflag) ikey, cast(l_shipdate as date) d,
           l_orderkey ok, l_linenumber ln, l_partkey pk,
           case when l_linestatus = 'O' then 'BUY' else 'SELL' end side,
           cast(l_quantity as bigint) qty, floor((l_extendedprice/l_quantity)*1e2+5e-1)/1e2 price
    from lineitem"""),
    "limit_orders": ((), """
    select event_id order_id, user_id acct, ts, case when event_id % 2 = 0 then 'BUY' else 'SELL' end side,
           value limit_price
    from events where event_type = 'purchase'"""),
    "chain": ((), """
    select p_partkey % 50 grp, p_partkey quote_id, case when p_partkey % 2 = 0 then 'CE' else 'PE' end opt_type,
           p_retailprice s, floor((p_retailprice*(8e-1 + (p_partkey % 41)/1e2))*1e2+5e-1)/1e2 k,
           (7 + p_size)/3.65e2 t, (10 + p_size % 40)/1e2 vol
    from part"""),
    "spots": ((), """
    select p_partkey id, p_retailprice spot, cast(2 + p_size % 9 as double) * 5e0 step,
           cast(7 + p_size as bigint) hdays, 10 + p_size % 40 iv
    from part"""),
    "books": (("candles_daily",), """
    select sym, px, case when px > px0 then cast(floor(1e5/px) as bigint)
                         when px < px0*9.8e-1 then -cast(floor(5e4/px) as bigint) else 0 end target_qty,
           case when px0 > 9e1 then cast(floor(1e5/px0) as bigint) else 0 end current_qty
    from (select sym, max(case when rd = 1 then c end) px, max(case when rd = 21 then c end) px0
          from (select sym, c, row_number() over (partition by sym order by d desc) rd from candles_daily) x
          group by sym) y
    where px0 is not null"""),
    "curves": (("candles_daily",), "select sym spec_id, d, floor((c*1e5)*1e2+5e-1)/1e2 eq from candles_daily"),
    "acct_books": (("fills",), """
    select acct, ikey, cast(sum(case when d < date '1998-01-01' then case when side = 'BUY' then qty else -qty end else 0 end) as bigint) current_qty,
           cast(sum(case when side = 'BUY' then qty else -qty end) as bigint) target_qty, max(price) px,
           cast(case when acct % 3 = 0 then 5 else 1 end as bigint) lot
    from fills group by acct, ikey"""),
    "month_ends": (("candles_daily",), """
    select max(d) d from candles_daily group by date_trunc('month', d)"""),
    "advice": (("candles_daily", "month_ends"), """
    select d, sym, rk, cast(floor(2e5/c) as bigint) qty, floor(c*1e2+5e-1)/1e2 price,
           floor(floor(2e5/c)*c+5e-1)/1e6 weight, extract(month from d) <> 6 eligible, 1e6 equity
    from (select x.sym, x.d, x.c, row_number() over (partition by x.d order by floor(x.m*1e8) desc, x.sym) rk
          from (select sym, d, c, c/lag(c, 63) over (partition by sym order by d) - 1 m from candles_daily) x
          join month_ends on x.d = month_ends.d where x.m is not null) r
    where rk <= 5"""),
    "specs": (("candles_daily",), """
    select sym spec_id, case when cast(substr(sym, 7) as int) % 3 = 0 then 'EQ' else 'BASKET' end kind,
           cast(cast(substr(sym, 7) as int) % 4 as bigint) archetype, count(*) bars,
           floor((max(c)/min(c))*1e4+5e-1)/1e4 score
    from candles_daily group by sym"""),
}


def closure(names: tuple[str, ...] | list[str]) -> list[str]:
    """The named views and everything they depend on, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def with_views(names: tuple[str, ...] | list[str], body: str) -> str:
    """DuckDB text: a WITH clause of the named views, then ``body`` (more CTEs and a select, or only a select)."""
    ctes = [f"{n} as ({VIEWS[n][1]})" for n in closure(names)]
    body = body.strip()
    if not ctes:
        return body if body.lower().startswith("select") else "with " + body
    sep = "\n" if body.lower().startswith("select") else ",\n"
    return "with " + ",\n".join(ctes) + sep + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=None)
def _bases(name: str) -> tuple[str, ...]:
    text = " ".join(VIEWS[n][1] for n in closure((name,))).replace("\n", " ")
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return tuple(t for t in TABLES if t in words)


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived view as a DataFrame (lazy); views in ``given`` are taken as they are instead of derived again."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    given = {n: df for n, df in (given or {}).items() if n in closure((name,)) and n != name}
    ctes = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in _bases(name)]
    ctes += [f"{n} as (select * from {{{n}}})" if n in given else f"{n} as ({VIEWS[n][1]})" for n in closure((name,))]
    return spark.sql("with " + ",\n".join(ctes) + f"\nselect * from {name}", **given)
