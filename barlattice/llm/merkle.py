"""Merkle manifest of a table: a digest tree over each group's rows, and one over the groups' roots, with every row's proof.

Rows of a group ascend by the order columns; every eight consecutive nodes of a level become one node of the next until one is left.  Nodes are
numbered over the whole group first (range partitions, then counts per partition), so a group of any share of the table is cut into chunks
of ``8 ** 4`` rows.  One shuffle by (group, chunk) and one sort serve all four levels inside it:

* ``lag`` and ``lead`` columns of fixed offsets 1 to 7 (times the level's stride) hold a node's neighbours.  Slot and run length mask them:
  ``lag k`` counts from slot k on, ``lead k`` while slot + k is inside the run.
* The first child of a run hashes itself and its leads into the parent; a running ``first`` hands a node's siblings to the rows below it.

The chunks' nodes are the rows of the next pass, a table smaller by 4,096; what a pass finds is joined back by (group, chunk), 4,096 rows to
a key, whatever the group's size.  The tree over the groups' roots hangs on the last pass, which has one row for each group.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import shared_dir

ARITY = 8
LEVELS = 4  # of one pass
CHUNK = ARITY**LEVELS
ROWS_PER_PIECE = 500_000


def record_digest(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of values one behind the other: ``-`` for null, else byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``_idx``, the position among the rows of ``key`` by ``order`` from 0, and ``_cnt``, their number; no task holds a whole key."""
    spark = frame.sparkSession
    shared_dir(spark)
    fixed = frame.checkpoint()  # range bounds are sampled from it: it would be computed twice
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fixed.count() // ROWS_PER_PIECE))
    cut = fixed.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    cut = cut.withColumn("_piece", F.shiftright("_at", 33)).checkpoint()  # bounds sampled again after a lost executor could differ
    pieces = cut.groupBy(key, "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(key, "_piece", (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(key)).alias("_cnt"))
    return cut.join(pieces, [key, "_piece"]).select(*frame.columns, (F.col("_at") + F.col("_shift")).alias("_idx"), "_cnt")


def _joined(columns: list[Column]) -> Column:
    return F.concat(*[F.coalesce(c, F.lit("")) for c in columns])


def _pass(nodes: DataFrame) -> DataFrame:
    """Four levels over nodes ``_key, _idx, _cnt, _node``: adds ``_chunk``, ``_path`` (steps ``left, right`` up to the chunk's node) and, on each
    chunk's first row, that node as ``_top``."""
    idx, slots = F.col("_idx"), [f"_s{k}" for k in range(LEVELS)]
    frame = nodes.select("*", F.expr(f"_idx div {CHUNK}").alias("_chunk"), *[F.expr(f"(_idx div {ARITY**k}) % {ARITY}").alias(s) for k, s in enumerate(slots)])
    frame = frame.withColumn("_d0", F.col("_node"))
    order = slots[::-1]
    along = Window.partitionBy("_key", "_chunk").orderBy(*order)
    for k in range(LEVELS):
        stride, d, slot = ARITY**k, F.col(f"_d{k}"), F.col(slots[k])
        nodes_here = F.expr(f"(_cnt + {stride - 1}) div {stride}")
        run = F.least(F.lit(ARITY), nodes_here - F.expr(f"(_idx div {stride * ARITY}) * {ARITY}"))
        lags = [F.when(slot >= j, F.lag(d, j * stride).over(along)) for j in range(ARITY - 1, 0, -1)]
        leads = [F.when(slot + j < run, F.lead(d, j * stride).over(along)) for j in range(1, ARITY)]
        frame = frame.select("*", _joined(lags).alias("_l"), _joined(leads).alias("_r"))
        step = F.when((idx % stride == 0) & (nodes_here > 1), F.struct(F.col("_l").alias("left"), F.col("_r").alias("right")))
        parent = F.when(idx % (stride * ARITY) == 0, F.when(nodes_here > 1, F.sha2(F.concat(d, F.col("_r")), 256)).otherwise(d))
        frame = frame.select(*[c for c in frame.columns if c not in ("_l", "_r", f"_d{k}")], step.alias(f"_p{k}"), parent.alias(f"_d{k + 1}"))
        if k:  # the node's first row to all rows below it; the same sort serves
            below = Window.partitionBy("_key", "_chunk", *order[:LEVELS - k]).orderBy(*order[LEVELS - k:]).rowsBetween(Window.unboundedPreceding, 0)
            frame = frame.withColumn(f"_p{k}", F.first(f"_p{k}").over(below))
    path = F.filter(F.array(*[F.col(f"_p{k}") for k in range(LEVELS)]), lambda step: step.isNotNull())
    return frame.select(*nodes.columns, "_chunk", path.alias("_path"), F.col(f"_d{LEVELS}").alias("_top"))


def _passes(most: int) -> int:
    return 0 if most <= 1 else 1 + _passes(-(-most // CHUNK))


def _climb(nodes: DataFrame, passes: int, crown) -> DataFrame:
    """``nodes`` with ``_path`` up to the root, ``_subroot`` and ``_root``; ``crown`` gives these for one node of each key."""
    if not passes:
        return crown(nodes)
    done = _pass(nodes)
    tops = done.filter(f"_idx % {CHUNK} = 0").select("_key", F.col("_chunk").alias("_idx"), F.expr(f"(_cnt + {CHUNK - 1}) div {CHUNK}").alias("_cnt"), F.col("_top").alias("_node"))
    upper = _climb(tops, passes - 1, crown).select("_key", F.col("_idx").alias("_chunk"), F.col("_path").alias("_up"), "_subroot", "_root")
    return done.join(upper, ["_key", "_chunk"]).select(*nodes.columns, F.concat("_path", "_up").alias("_path"), "_subroot", "_root")


def _most(frame: DataFrame) -> int:
    return frame.agg(F.max("_cnt").alias("n")).first()["n"] or 0  # one row


def proofs(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """``leaves`` with ``subroot`` (of its group), ``root`` (over all groups, ordered by ``group``, null first, bytewise) and ``path``: an array of
    steps ``left, right``, the siblings before and behind the node of each level, joined.

    Nulls in ``group`` are one group; nulls in ``order`` come first.  Rows tied in ``order`` follow by their leaf, so tied rows differ in nothing that counts.
    Repeated rows are leaves of their own.  A lone leaf is its own root with an empty path; an empty table gives no rows.  ``subroot, root, path`` of the
    input are replaced, other columns are kept; names that begin with an underscore are this function's own and refused.
    """
    if clash := [c for c in leaves.columns if c.startswith("_")]:
        raise ValueError(f"column names begin with an underscore: {clash}")
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    # "=de" for de and "" for null: not null, in the order asked for
    keyed = leaves.select(*kept, F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("_key"), F.col(leaf).alias("_node"))
    low = numbered(keyed, "_key", [*order, "_node"])
    narrow = low.select("_key", "_idx", "_cnt", "_node")
    passes = _passes(_most(narrow))

    def over_groups(nodes: DataFrame) -> DataFrame:
        """One node of each group: the leaves of the tree over groups."""
        ranked = numbered(nodes.select(F.lit("").alias("_all"), F.col("_key").alias("_name"), F.col("_idx").alias("_i"), F.col("_node")), "_all", ["_name"])
        ranked = ranked.withColumnRenamed("_all", "_key")
        end = _climb(ranked, _passes(_most(ranked)), lambda one: one.select("*", F.array().cast("array<struct<left:string,right:string>>").alias("_path"), F.col("_node").alias("_subroot"), F.col("_node").alias("_root")))
        return end.select(F.col("_name").alias("_key"), F.col("_i").alias("_idx"), "_path", F.col("_node").alias("_subroot"), "_root")

    if passes:
        return _climb(low, passes, over_groups).select(*kept, F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))
    found = over_groups(narrow)
    return low.join(found, ["_key", "_idx"]).select(*kept, F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", order: str = "doc_id", changed: Column | None = None, now: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``docs`` and a check of its rows: ``order`` and ``group`` columns, leaf, subroot, root, path, now (the leaf found again).

    A leaf digests ``columns`` of a row.  Where ``changed`` holds, ``now`` digests the values in the dictionary ``now`` instead (a later state of the
    row); elsewhere it equals ``leaf``.  Null values of any column count as such; null or empty texts are values like others, texts of any length are
    digested whole.  See ``proofs`` for ties, repeated rows and empty tables; other columns are not read, so their names can't clash.
    """
    leaf = record_digest(*[F.col(c) for c in columns])
    later = leaf if changed is None else F.when(changed, record_digest(*[(now or {}).get(c, F.col(c)) for c in columns]))
    leaves = docs.select(F.col(order).alias("order"), F.col(group).cast("string").alias("group"), leaf.alias("leaf"), later.alias("now"))
    done = proofs(leaves, "group", ["order"]).withColumn("now", F.coalesce("now", "leaf"))
    return done.select(F.col("order").alias(order), F.col("group").alias(group), "leaf", "subroot", "root", "path", "now")


def oracle(levels: int = 8, crown: int = 3) -> str:
    """DuckDB text of the query over ``documents``, for groups of up to ``8 ** levels`` rows and up to ``8 ** crown`` groups."""
    def rec(columns):
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in columns) + ")"

    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bit = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda s: ord(s)::bigint)), lambda a, b: {bit}), 4294967295)"
    parts = [f"""l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by lang) c
 from (select doc_id, lang, {rec(['doc_id', 'source', 'lang', 'n_chars', 'text'])} leaf,
  case when {crc} % 3 = 0 then {rec(['doc_id', 'source', 'lang', 'n_chars', lower])} else {rec(['doc_id', 'source', 'lang', 'n_chars', 'text'])} end now from documents))""",
             "n0 as (select lang, i, c, leaf d from l)", "f0 as (select doc_id, lang, leaf, i, now f, '' p from l)"]

    def up(n, f, depth, key):
        for k in range(depth):
            parts.append(f"{n}{k + 1} as (select {key}, i // 8 i, (any_value(c) + 7) // 8 c, case when any_value(c) > 1 then sha256(string_agg(d, '' order by i)) else any_value(d) end d from {n}{k} group by {key}, i // 8)")
            parts.append(f"{n}r{k} as (select {key}, i // 8 i, any_value(c) c, list(d order by i) ds from {n}{k} group by {key}, i // 8)")
            left, right = (f"array_to_string(ds[{x}], '')" for x in ("1:f.i % 8", "f.i % 8 + 2:"))
            others = ", ".join(f"f.{c}" for c in ("doc_id", "lang", "leaf", *(["j", "subroot"] if n == "m" else [])) if c != "j")
            parts.append(f"{f}{k + 1} as (select {others}, f.i // 8 i, case when c > 1 then sha256({left} || f.f || {right}) else f.f end f, case when c > 1 then f.p || {left} || {right} else f.p end p "
                         f"from {f}{k} f join {n}r{k} r on f.i // 8 = r.i" + (" and f.lang is not distinct from r.lang" if n == "n" else "") + ")")

    up("n", "f", levels, "lang")
    parts.append(f"m0 as (select 1 j, lang, row_number() over (order by lang nulls first) - 1 i, count(*) over () c, d from n{levels})")
    parts.append(f"g0 as (select f.doc_id, f.lang, f.leaf, m.d subroot, m.i, f.f, f.p from f{levels} f join m0 m on f.lang is not distinct from m.lang)")
    up("m", "g", crown, "j")
    return reduce(lambda a, b: f"{a},\n{b}", parts[1:], "with " + parts[0]) + f"""
select doc_id, leaf, subroot, d root, sha256(p) proof_sha256, f folded_root, f = d verified from g{crown} g, (select d from m{crown}) r"""
