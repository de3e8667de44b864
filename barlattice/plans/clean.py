"""Cleaning queries over the dirty panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlattice.operators import clean as C
from barlattice.plans.registry import query

W = "partition by sym order by d"


@query("valid_bars", "candles_dirty", "select sym, d, c from candles_dirty where d is not null and c > 9.9e1")
def valid_bars(t):
    return C.valid_bars(t.candles_dirty.withColumn("c", F.when(F.col("c") > 9.9e1, F.col("c")).otherwise(-F.col("c")))) \
        .select("sym", "d", "c")


ADJ = """ad as (select sym, d, v, case when adj then a else c end c, case when adj then c end craw, adj, a
   from (select *, avg(case when a > 0 then 1e0 else 0e0 end) over (partition by sym) >= 9e-1 adj from candles_dirty) q
   where not adj or coalesce(a > 0, false))"""


@query("to_adjusted", "candles_dirty", f"{ADJ} select sym, d, c, craw from ad")
def to_adjusted(t):
    return C.to_adjusted(t.candles_dirty).select("sym", "d", "c", "craw")


def _drop(src: str) -> str:
    near = " ".join(f"when abs(lead(c,{k}) over ({W})/c - 1) <= 1.5e-1 then {k}" for k in (2, 3, 4))
    return f"""jmp as (select sym, d, c, row_number() over ({W}) rn,
      case when abs(lead(c,1) over ({W})/c - 1) > 4e-1 then case {near} end end k from {src}),
  jl as (select sym, list(struct_pack(rn := rn, nx := rn + coalesce(k, 1)) order by rn) s from jmp group by sym),
  kept as (select sym, unnest(list_reduce(list_transform(s, lambda q: struct_pack(nx := q.nx, rn := q.rn, acc := [q.rn])),
     lambda a, b: case when b.rn < a.nx then a else struct_pack(nx := b.nx, rn := b.rn, acc := list_append(a.acc, b.rn)) end).acc) rn from jl),
  dropped as (select jmp.* from jmp join kept using (sym, rn))"""


@query("drop_bad_prints", "candles_dirty", f"{_drop('candles_dirty')} select sym, d, c from dropped")
def drop_bad_prints(t):
    return C.drop_bad_prints(t.candles_dirty).select("sym", "d", "c")


def _trim(src: str, frozen: bool, steps: bool) -> str:
    parts = ["0"]
    if frozen:
        parts.append("case when fe > 10 then fe else 0 end")
    if steps:
        parts.append("coalesce(st, 0)")
    return f"""n0 as (select sym, d, c, row_number() over ({W}) - 1 i, count(*) over (partition by sym) n, lag(c) over ({W}) p,
      first_value(c) over ({W}) c0 from {src}),
  n1 as (select *, coalesce(min(case when c <> c0 then i end) over (partition by sym), n) fe,
      max(case when i > 0 and not c > 0 and i + 1 < n*6e-1 then i + 1
               when c > 0 and p > 0 and i < n*6e-1 and abs(c/p - 1) > 4e-1 then i end) over (partition by sym) st from n0),
  n2 as (select *, greatest({', '.join(parts)}) good from n1),
  trimmed as (select sym, d, c from n2 where not (good > 0 and good < n*6e-1) or i >= good)"""


@query("trim_frozen_lead", "candles_dirty", f"{_trim('candles_dirty', True, False)} select * from trimmed")
def trim_frozen_lead(t):
    return C.trim_frozen_lead(t.candles_dirty).select("sym", "d", "c")


@query("trim_early_step", "candles_dirty", f"{_trim('candles_dirty', False, True)} select * from trimmed")
def trim_early_step(t):
    return C.trim_early_step(t.candles_dirty).select("sym", "d", "c")


@query("trailing_suspect_jump", "candles_dirty", f"""x as (select sym, abs(c/lag(c) over ({W}) - 1) > 4e-1 j,
   row_number() over (partition by sym order by d desc) b from candles_dirty)
   select sym, coalesce(bool_or(j) filter (b <= 4), false) suspect from x group by sym""")
def trailing(t):
    return C.trailing_suspect_jump(t.candles_dirty)


@query("last_session", "ticks", """select event_id, sym, ts, price from ticks t
   where cast(ts as date) = (select max(cast(ts as date)) from ticks u where u.sym = t.sym)""")
def last_session(t):
    return C.last_session(t.ticks).select("event_id", "sym", "ts", "price")


@query("min_history", "candles_daily", """select sym, d, c from candles_daily where sym in
   (select sym from candles_daily group by sym having count(*) >= 1500 and min(d) <= date '1995-02-01')""")
def min_history(t):
    return C.min_history(t.candles_daily, 1500, "1995-02-01").select("sym", "d", "c")


@query("clean_report", "candles_dirty", f"""{ADJ}, {_drop('ad')}, {_trim('dropped', True, True)},
   b as (select sym, count(*) rows_in from candles_dirty group by sym), a as (select sym, count(*) rows_out from trimmed group by sym)
   select sym, rows_in, coalesce(rows_out, 0) rows_out, rows_in - coalesce(rows_out, 0) dropped from b left join a using (sym)""")
def clean_report(t):
    return C.clean_report(t.candles_dirty, C.sanitize(C.to_adjusted(t.candles_dirty)))
