"""Toxic text by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased; an n-gram lies inside one word and may include the blank on either side of it.  Of the labelled rows
learned from, Spark counts each n-gram's documents per class; the ratio ``r = log((p/|p|) / (q/|q|))`` of the smoothed counts
scales a binary feature, and logistic weights are fitted on the scaled features.  Scoring is one map-only pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import text as tx

ORDERS = (3, 4, 5, 6)
_FILTER_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    bias: float
    grams: np.ndarray  # sorted hashes
    weight: np.ndarray  # weight times ratio of each


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hash of the n-gram at every position it is whole, and the positions' documents."""
    joined = "".join(f" {t.lower()} " for t in texts)  # the blank before a text's first word is its own
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    inside = np.ones(len(points), bool)
    low = points < 128
    inside[low] = tx.ALNUM[points[low]]
    document = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
    letters = np.where(inside, points, 32).astype(np.uint64)
    hashed = tx.mix(letters + np.uint64(1))
    edge = ~inside
    whole = np.ones(len(points), bool)  # no blank strictly inside the window
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            return
        hashed = hashed[:len(points) - n + 1] * _STEP + letters[n - 1:]
        whole = whole[:len(points) - n + 1] if n == 2 else whole[:len(points) - n + 1] & inside[n - 2:len(points) - 1]
        if n in ORDERS:
            at = np.flatnonzero(whole & ~(edge[:len(whole)] & edge[n - 1:]) | whole & (inside[1:1 + len(whole)]))
            yield tx.mix(hashed[at] + np.uint64(n)), document[at]


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) pairs."""
    parts = list(grams(texts))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    docs, hashes = np.concatenate([d for _, d in parts]), np.concatenate([h for h, _ in parts])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[keep], hashes[keep]


class Scorer:
    """Looks n-grams up in the model: a bit table in cache drops nearly all of them, binary search decides the rest."""

    _made: dict[int, Scorer] = {}

    def __init__(self, m: Model):
        self.m = m
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(m.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(document, feature)`` pairs in that order."""
        found = []
        if len(self.m.grams):
            for hashes, docs in grams(texts):
                at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
                place = np.searchsorted(self.m.grams, hashes[at])
                hit = self.m.grams[np.minimum(place, len(self.m.grams) - 1)] == hashes[at]
                found.append(docs[at[hit]].astype(np.int64) * len(self.m.grams) + place[hit])
        keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return keys // max(len(self.m.grams), 1), keys % max(len(self.m.grams), 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        docs, feats = self.entries(texts)
        z = self.m.bias + np.bincount(docs, self.m.weight[feats], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", features: int = 4000, least_documents: int = 4, smoothing: float = 1.0,
        ridge: float = 1e-3, rounds: int = 300) -> Model:
    """Fits on the documents of ``sample`` (``doc_id, label, weight``; its size is the caller's documented bound).

    A row counts by its weight, the labelled rows that it stands for, so bias and class balance are those of all labels.

    The ``features`` n-grams of positive ratio that are largest when weighted by the root of their count are kept: what marks
    toxic text is present in it, while n-grams of clean text only tell how long a text is.  Rare labels count by the root of their odds.  Without rows of both classes the score is
    the sample's share of ones, one half for an empty sample.
    """
    chosen = docs.select(*dict.fromkeys((doc_id, text))).join(F.broadcast(sample), doc_id).select(F.col(text).alias("text"), "label", F.col(doc_id).cast("string").alias("key"), "weight")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, part in tx.chunks(batch.column(0)):
                d, h = _pairs(part.to_pylist())
                g, inverse = np.unique(h, return_inverse=True)
                ones = np.bincount(inverse, label[lo + d], len(g)).astype(np.int64)
                yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(ones), pa.array(np.bincount(inverse, minlength=len(g)).astype(np.int64) - ones)], names=["g", "p", "q"])

    sizes = {r["label"]: (r["n"], r["all"]) for r in chosen.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).collect()}  # two rows
    (pos, all_pos), (neg, all_neg) = sizes.get(1, (0, 0.0)), sizes.get(0, (0, 0.0))
    if not pos or not neg:
        return Model(40.0 if pos else -40.0 if neg else 0.0, np.empty(0, np.uint64), np.empty(0))
    ratio = F.log((F.col("p") + smoothing) / (pos + smoothing)) - F.log((F.col("q") + smoothing) / (neg + smoothing))
    table = chosen.mapInArrow(counted, "g long, p long, q long").groupBy("g").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    table = table.filter(F.col("p") + F.col("q") >= least_documents).select("g", ratio.alias("r"), (ratio * F.sqrt(F.col("p") * (all_pos / pos) + F.col("q") * (all_neg / neg))).alias("k")).filter("k > 0")
    best = table.orderBy(F.desc("k"), "g").limit(features).toPandas()  # at most ``features`` rows
    hashes = best["g"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    m = Model(0.0, hashes[order], best["r"].to_numpy(float)[order])
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo, part in tx.chunks(batch.column(0)):
                n = len(part)
                d, f = scorer.entries(part.to_pylist())
                cuts = np.searchsorted(d, np.arange(n + 1))
                yield pa.record_batch([batch.column(2).slice(lo, n), batch.column(1).slice(lo, n), pa.array([f[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])], names=["key", "label", "f"])

    rows = chosen.mapInArrow(listed, "key string, label int, f binary").toPandas().sort_values(["key", "f"])
    y = rows["label"].to_numpy(float)
    known = all_pos + all_neg
    lists = [np.frombuffer(f, "<i4") for f in rows["f"]]
    row, feat = np.repeat(np.arange(len(y)), [len(x) for x in lists]), np.concatenate(lists)
    value = m.weight[feat]
    w, bias = np.zeros(len(m.weight)), float(np.log(all_pos / all_neg))
    # each class by its share of all labels, times the root of its odds
    balance = np.where(y == 1, all_pos / pos * np.sqrt(known / (2 * all_pos)), all_neg / neg * np.sqrt(known / (2 * all_neg)))
    step_w, step_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):  # full gradients with a step per weight
        z = bias + np.bincount(row, value * w[feat], len(y))
        delta = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / known
        g = np.bincount(feat, value * delta[row], len(w)) + ridge * w
        step_w += g * g
        step_b += delta.sum() ** 2
        w -= 0.1 * g / np.sqrt(step_w)
        bias -= 0.1 * delta.sum() / np.sqrt(step_b)
    return Model(bias, m.grams, w * m.weight)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every row's whole text, however long; null counts as empty, no other column is an input, an existing ``out`` is replaced.

    Other columns are kept, repeated rows get equal scores, an empty table stays empty.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of features

    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in series:
            parts = [scorer.scores(part.to_pylist()) for _, part in tx.chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))
