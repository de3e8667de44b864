"""Exact inner-product search over vectors sorted by length.

Candidates are range-partitioned by descending length and kept as blocks in that order.  Queries go to all blocks in bounded
broadcasts.  All vectors are rotated by the eigenvectors of their common second-moment matrix (the right singular vectors of
the whole table), so that a few leading components carry most of every product; the rest is bounded by Cauchy-Schwarz.  A task
goes down the lengths and skips, per query, every block whose longest vector can't reach that query's k-th best score, then
every vector whose partial sum plus residual bound can't.  What is left gets its exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import shared_dir

BLOCK = 1024


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray  # integers in doubles
    threshold: np.ndarray  # a lower bound of each query's k-th score


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col(embedding)
    good = F.col(vec_id).isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(blocks: Iterator[tuple[np.ndarray, np.ndarray]], q: Queries, rotation: np.ndarray, lead: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query index, ids, scores)`` of the best k per query over blocks of descending length."""
    n = len(q.ids)
    turned = q.vectors @ rotation
    q_len = np.linalg.norm(q.vectors, axis=1)
    q_rest = np.linalg.norm(turned[:, lead:], axis=1)
    bound = q.threshold.copy()
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * n
    for ids, x in blocks:
        length = np.linalg.norm(x, axis=1)
        slack = 1e-6 * (1 + length.max() * q_len)  # rounding of the rotated sums
        live = np.flatnonzero(length.max() * q_len + slack >= bound)
        if not len(live):
            continue
        y = x @ rotation
        rest = np.linalg.norm(y[:, lead:], axis=1)
        upper = turned[live, :lead] @ y[:, :lead].T + q_rest[live, None] * rest[None, :] + slack[live, None]
        may = upper >= bound[live, None]
        share = may.mean()
        exact = q.vectors[live] @ x.T if share > 0.05 else None
        for j, i in enumerate(live):
            at = np.flatnonzero(may[j])
            if not len(at):
                continue
            s = exact[j, at] if exact is not None else x[at] @ q.vectors[i]
            fit = (s >= bound[i]) & (ids[at] != q.ids[i])
            if not fit.any():
                continue
            all_ids, all_s = np.concatenate((held[i][0], ids[at][fit])), np.concatenate((held[i][1], s[fit]))
            keep = _best(all_s, all_ids, k)
            held[i] = (all_ids[keep], all_s[keep])
            if len(keep) == k:
                bound[i] = max(bound[i], all_s[keep[-1]])
    for i, (ids, s) in enumerate(held):
        if len(ids):
            yield i, ids, s


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part.column(0).to_numpy(), _matrix(part.column(1), dims)


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", lead: int = 16, head: int = 2048, query_block: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query row over all other rows.

    Components become ``floor(256 * x)`` as doubles.  ``is_query`` is a condition on the id column.  Ties go to the smaller id; fewer than k
    candidates give fewer rows.  Vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of fewer
    components count as filled up with zeros; other columns are not read; an empty table gives no rows.  Rows of equal id are separate candidates, but none of them is a
    candidate of its own id, and as a query the least of their vectors stands for all.  Scores are exact while products stay below 2**53.

    Queries travel in broadcasts of at most ``query_block`` vectors, one pass over the candidates each.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    used = _usable(vectors, vec_id, embedding)
    facts = used.agg(F.max(F.size("x")).alias("dims"), F.count("*").alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"] or not facts["dims"]:
        return empty
    dims, n = facts["dims"], facts["n"]
    lead = min(lead, dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for _, x in _blocks(batches, dims):
            total += x.T @ x
        yield pa.record_batch([pa.array(np.repeat(np.arange(dims, dtype=np.int32), dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), dims)), pa.array(total.reshape(-1))], names=["i", "j", "s"])

    rows = used.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # dims x dims numbers
    second = np.zeros((dims, dims))
    second[rows["i"], rows["j"]] = rows["s"]
    rotation = np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK)))
    length = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)
    ordered = used.withColumn("len2", length).repartitionByRange(parts, F.desc("len2"), "vec_id").sortWithinPartitions(F.desc("len2"), "vec_id").checkpoint()
    first = ordered.orderBy(F.desc("len2"), "vec_id").limit(head).select("vec_id", "x").toPandas()  # ``head`` rows: they give the first thresholds
    head_ids, head_x = first["vec_id"].to_numpy(np.int64), _matrix(pa.array(first["x"].tolist(), pa.list_(pa.float64())), dims)
    asked = used.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    n_asked = asked.count()
    cuts = -(-n_asked // query_block)
    found = []
    for b in range(cuts):  # blocks of queries, each against all rows
        part = asked if cuts == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(cuts)) == b)
        got = part.toPandas()
        if not len(got):
            continue
        q = Queries(got["vec_id"].to_numpy(np.int64), _matrix(pa.array(got["x"].tolist(), pa.list_(pa.float64())), dims), np.full(len(got), -np.inf))
        for i, ids, s in _search(((head_ids[lo:lo + BLOCK], head_x[lo:lo + BLOCK]) for lo in range(0, len(head_ids), BLOCK)), q, rotation, lead, k):
            if len(ids) == k:
                q.threshold[i] = s[-1]
        shared = spark.sparkContext.broadcast((q, rotation))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, turn = shared.value
            for i, ids, s in _search(_blocks(batches, dims), q, turn, lead, k):
                yield pa.record_batch([pa.array(np.full(len(ids), q.ids[i])), pa.array(ids), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

        found.append(ordered.select("vec_id", "x").mapInArrow(search, "query_id long, vec_id long, score long"))
    if not found:
        return empty
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
