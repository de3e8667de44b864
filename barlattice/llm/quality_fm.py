"""Document quality by a factorisation machine.

Inputs are hashed words (log counts, unit length), structure statistics of the text and the table's own length metadata.  The
score is ``sigmoid(b + w.x + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])``: all pairwise interactions in time linear in the inputs.
Fitting takes a bounded, documented sample of labelled rows; scoring is one map-only pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.llm import text as tx

BUCKETS = 1 << 15
STATS = ["words", "distinct", "top_word", "repeat", "word_length", "long_words", "upper", "digit", "symbol", "white", "lines", "foreign", "stated_length", "no_stated_length"]


@dataclass
class Model:
    bias: float
    w: np.ndarray  # buckets then statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def labelled_sample(labels: DataFrame, label: str, learn: Column, per_class: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows ``(doc_id, label, weight)`` of each class, picked by the hash of the id; rows without id or label are left out.

    Conflicting labels of one id count by their larger value.  A row's ``weight`` is how many labelled rows of its class it stands for,
    so class shares by weight are those of all labelled rows, whatever ``per_class`` leaves of each class.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows

    def pick(k: int) -> DataFrame:
        weight = max(1.0, counts.get(k, 0) / per_class)
        return known.filter(F.col("label") == k).orderBy(F.xxhash64(doc_id), doc_id).limit(per_class).withColumn("weight", F.lit(weight))

    picks = [pick(k) for k in (0, 1)]
    return picks[0].unionByName(picks[1])


def features(strings: pa.Array, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: entries ``(row, bucket, value)`` sorted by row, and the statistics, one row per document.

    ``stated`` holds the metadata lengths, NaN where there is none.
    """
    data, offsets = tx.buffer_of(strings)
    n = len(offsets) - 1
    starts, ends, first = tx.word_spans(data, offsets, tx.NON_SPACE)
    hashes = tx.span_hashes(tx.lower_ascii(data), starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(n), counts)
    keys, tf = np.unique(row * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
    rows, buckets = keys // BUCKETS, keys % BUCKETS
    value = 1.0 + np.log(tf)
    norm = np.sqrt(np.bincount(rows, value * value, n))
    value = value / norm[rows]

    def per_row(mask: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:] if of is None else of[1:]] - total[offsets[:-1] if of is None else of[:-1]]

    size = np.maximum(np.diff(offsets) - 1, 1).astype(float)
    words = np.maximum(counts, 1).astype(float)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    top = np.zeros(n)
    np.maximum.at(top, rows, tf)
    length = ends - starts
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    symbol = (data > 32) & (data < 127) & ~tx.ALNUM[data]
    letters = np.maximum(per_row(tx.ALNUM[data] & (data < 128) & ~digit), 1)
    stats = np.column_stack([
        np.log1p(counts), np.bincount(rows, minlength=n) / words, top / words, per_row(same, first) / words, per_row(length, first) / words,
        per_row(length > 20, first) / words, per_row(upper) / letters, per_row(digit) / size, per_row(symbol) / size, per_row((data == 32) | (data == 9)) / size,
        np.log1p(per_row(data == 10) - 1), per_row(data >= 128) / size, np.log1p(np.maximum(np.nan_to_num(stated), 0)), np.isnan(stated),
    ])
    return rows, buckets, value, stats


def _sums(rows: np.ndarray, buckets: np.ndarray, value: np.ndarray, stats: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid and the factors' sums of each row."""
    n = len(stats)
    weights = np.concatenate([m.w[:, None], m.v, m.v * m.v], axis=1)
    powers = np.concatenate([value[:, None], np.repeat(value[:, None], m.v.shape[1], 1), np.repeat(value[:, None] ** 2, m.v.shape[1], 1)], axis=1)
    out = np.zeros((n, weights.shape[1]))
    if len(rows):
        full = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[full]] = np.add.reduceat(weights[buckets] * powers, full, axis=0)
    k = m.v.shape[1]
    ws, vs = m.w[BUCKETS:], m.v[BUCKETS:]
    linear = out[:, 0] + stats @ ws
    sums = out[:, 1:1 + k] + stats @ vs
    squares = out[:, 1 + k:] + (stats * stats) @ (vs * vs)
    return m.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def _standard(stats: np.ndarray, m: Model) -> np.ndarray:
    return np.clip((stats - m.mean) / m.scale, -4, 4) / np.sqrt(len(STATS))


def predict(strings: pa.Array, stated: np.ndarray, m: Model) -> np.ndarray:
    rows, buckets, value, stats = features(strings, stated)
    z, _ = _sums(rows, buckets, value, _standard(stats, m), m)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _with_stated(docs: DataFrame, text: str, stated: str | None, *more: str) -> DataFrame:
    length = F.col(stated).cast("double") if stated else F.lit(None).cast("double")
    return docs.select(F.col(text).alias("text"), length.alias("stated"), *more)


def fit(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", stated: str | None = "n_chars", factors: int = 6, epochs: int = 12,
        rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """Fits on the documents of ``sample`` (see ``labelled_sample``, which bounds it) by Adagrad on the log loss, rows counting by their weight.

    Features are made by tasks; the driver gets a few kilobytes per sampled row.  Without rows of both classes the score is the
    sample's share of ones, one half for an empty sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, stated_length, key, weight = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(3), batch.column(4)
            for lo, part in tx.chunks(batch.column(0)):
                n = len(part)
                rows, buckets, value, stats = features(part, stated_length[lo:lo + n])
                cuts = np.searchsorted(rows, np.arange(n + 1))
                b, x = buckets.astype("<i4"), value.astype("<f4")
                yield pa.record_batch([key.slice(lo, n), label.slice(lo, n), weight.slice(lo, n), pa.array([b[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]),
                                       pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]), pa.array([s.tobytes() for s in stats])],
                                      names=["key", "label", "weight", "b", "x", "s"])

    own_columns = list(dict.fromkeys(c for c in (doc_id, text, stated) if c))
    chosen = docs.select(*own_columns).join(F.broadcast(sample), doc_id)  # the sample is bounded by its own parameter
    got = _with_stated(chosen, text, stated, "label", F.col(doc_id).cast("string").alias("key"), "weight").mapInArrow(run, "key string, label int, weight double, b binary, x binary, s binary").toPandas()
    got = got.sort_values(["key", "b"]).reset_index(drop=True)
    y, weight = got["label"].to_numpy(float), got["weight"].to_numpy(float)
    weight = weight / weight.mean() if len(weight) else weight
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATS)
    m = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, factors)), np.zeros(len(STATS)), np.ones(len(STATS)))
    if len(y) == 0 or y.min() == y.max():
        m.bias, m.v = float(np.clip(np.log(y.mean() / (1 - y.mean())) if 0 < y.mean() < 1 else 40 * (2 * y.mean() - 1), -40, 40)) if len(y) else 0.0, np.zeros((size, factors))
        return m
    raw = np.stack([np.frombuffer(s) for s in got["s"]])
    m.mean = np.average(raw, axis=0, weights=weight)
    m.scale = np.maximum(np.sqrt(np.average((raw - m.mean) ** 2, axis=0, weights=weight)), 1e-6)
    stats = _standard(raw, m)
    bs, xs = [np.frombuffer(b, "<i4") for b in got["b"]], [np.frombuffer(x, "<f4").astype(float) for x in got["x"]]
    m.bias = float(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    g_bias, g_w, g_v = 1e-6, np.full(size, 1e-6), np.full((size, factors), 1e-6)
    own = np.arange(BUCKETS, size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            take = order[lo:lo + 64]
            rows = np.repeat(np.arange(len(take)), [len(bs[i]) for i in take])
            b, x, s = np.concatenate([bs[i] for i in take]), np.concatenate([xs[i] for i in take]), stats[take]
            z, sums = _sums(rows, b, x, s, m)
            delta = weight[take] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[take]) / len(take)
            dw, dv = np.zeros(size), np.zeros((size, factors))
            np.add.at(dw, b, delta[rows] * x)
            dw[own] += delta @ s
            idx, inverse = np.unique(b, return_inverse=True)
            for f in range(factors):
                dv[idx, f] = np.bincount(inverse, delta[rows] * x * (sums[rows, f] - m.v[b, f] * x), len(idx))
            dv[own] += (delta[:, None] * s).T @ sums - (delta @ (s * s))[:, None] * m.v[own]
            touched = np.concatenate([idx, own])
            gw, gv = dw[touched] + decay * m.w[touched], dv[touched] + decay * m.v[touched]
            g_w[touched] += gw * gw
            g_v[touched] += gv * gv
            m.w[touched] -= rate * gw / np.sqrt(g_w[touched])
            m.v[touched] -= rate * gv / np.sqrt(g_v[touched])
            db = delta.sum()
            g_bias += db * db
            m.bias -= rate * db / np.sqrt(g_bias)
    return m


def score(docs: DataFrame, model: Model, text: str = "text", stated: str | None = "n_chars", out: str = "score") -> DataFrame:
    """Adds the score of every row's whole text, however long; null counts as empty, an existing ``out`` is replaced, other columns are kept, an empty table stays empty."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x factors, whatever the data

    def run(series: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lengths in series:
            given = lengths.to_numpy(zero_copy_only=False).astype(float)
            parts = [predict(part, given[lo:lo + len(part)], shared.value) for lo, part in tx.chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    length = F.col(stated).cast("double") if stated else F.lit(None).cast("double")
    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text), length))

