"""Ordered scans over series of any length.

A window over ``partitionBy(key)`` puts a whole series into one task.  That is fine for bars (a series has at most one
row per calendar slot) but not for ticks or fills, where one key may hold a third of all rows.  The helpers here cut a
series into range partitions first, work inside each piece, and carry small per-piece summaries forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import shared_dir

CHUNK = "_chunk"


def pin_chunks(df: DataFrame, key: list[str], order: list[str], parts: int | None = None, piece_rows: int = 50_000,
               ordered: bool = False, whole_keys: bool = False) -> DataFrame:
    """Range-partition by (key, order), tag rows with their partition and fix the result by a reliable checkpoint.

    Pieces are sized by rows: their number grows with the table, so one piece stays near ``piece_rows`` rows (range bounds are
    sampled) and what holds a piece in memory is bounded.  A hot key spreads over many pieces.  The checkpoint matters: bounds sampled
    again after a lost executor could differ.  ``ordered`` sorts the rows of a piece.  ``whole_keys``, for keys that are short enough
    for one piece, hashes the key instead: every key lies in one piece, and as a hash has no sampled bounds nothing is written.
    """
    spark = df.sparkSession
    if not whole_keys:
        shared_dir(spark)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // piece_rows))
    cols = [F.col(c) for c in [*key, *order]]
    cut = df.repartition(n, *key) if whole_keys else df.repartitionByRange(n, *cols)
    out = (cut.sortWithinPartitions(*cols) if ordered else cut).withColumn(CHUNK, F.spark_partition_id())
    return out if whole_keys else out.checkpoint()


def key_sizes(df: DataFrame, key) -> tuple[int, int]:
    """(rows, rows of the longest key)."""
    r = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("longest")).first()  # one row
    return r["rows"] or 0, r["longest"] or 0


def prefix(pinned: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None,
           maxs: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Inclusive running sum / max / last-non-null per key, in two phases over pinned chunks.

    Shuffles rows once on (key, chunk); only one summary row per (key, chunk) travels along the key.
    """
    sums, maxs, lasts = sums or {}, maxs or {}, lasts or {}
    local = Window.partitionBy(*key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    inner = pinned.select(
        "*",
        *[F.sum(c).over(local).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).over(local).alias(f"_m_{n}") for n, c in maxs.items()],
        *[F.last(c, ignorenulls=True).over(local).alias(f"_l_{n}") for n, c in lasts.items()],
    )
    tot = pinned.groupBy(*key, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxs.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"_t_{n}") for n, c in lasts.items()],
    )
    carry = tot.select(
        *key, CHUNK,
        *[F.coalesce(F.sum(f"_t_{n}").over(whole), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(whole).alias(f"_c_{n}") for n in maxs],
        *[F.last(f"_t_{n}", ignorenulls=True).over(whole).alias(f"_c_{n}") for n in lasts],
    )
    out = inner.join(carry, [*key, CHUNK])
    keep = [c for c in pinned.columns]
    return out.select(
        *keep,
        *[(F.col(f"_s_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_m_{n}", f"_c_{n}").alias(n) for n in maxs],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
    )


def split_frames(df: DataFrame, key: str, ts: str, lookback: int, rows: int = 100_000) -> DataFrame:
    """Cut every series into pieces of ``rows`` rows, each preceded by ``lookback`` rows of its predecessor.

    Adds ``_piece`` (partition windows by (key, _piece)) and ``_halo`` (drop those rows afterwards).  Frames that look
    back at most ``lookback`` rows then give the same values as over the whole series.
    """
    rows = max(rows, lookback)
    numbered = prefix(pin_chunks(df, [key], [ts]), [key], [ts], sums={"_rn": F.lit(1)})
    piece = F.floor((F.col("_rn") - 1) / rows)
    near_end = (F.col("_rn") - 1) % rows >= rows - lookback
    places = F.when(near_end, F.array(piece, piece + 1)).otherwise(F.array(piece))
    out = numbered.withColumn("_piece", F.explode(places)).withColumn("_halo", F.col("_piece") > piece)
    return out.drop("_rn", CHUNK)
