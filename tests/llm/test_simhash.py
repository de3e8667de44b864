"""SimHash fingerprints and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from barlattice.llm import simhash_gray as sg
from barlattice.llm.queries import QUERIES

rng = np.random.default_rng(12)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, distance):
    """For each code the least number of a code reachable by steps of at most ``distance`` bits."""
    codes = np.array(codes, np.uint64)
    label = np.full(len(codes), -1)
    for k in range(len(codes)):
        if label[k] < 0:
            label[k], todo = k, [k]
            while todo:
                near = np.flatnonzero((np.bitwise_count(codes ^ codes[todo.pop()]) <= distance) & (label < 0))
                label[near] = k
                todo += near.tolist()
    return label


def clustered(size, r=rng):
    """Distinct random codes, codes some bits from earlier ones, and a dense ball."""
    out = [int(x) for x in r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)]
    ball = int(r.integers(0, 1 << 63))
    for k in range(size):
        base = ball if k % 3 == 0 else out[int(r.integers(0, len(out)))]
        for b in r.choice(64, int(r.integers(0, 7)), replace=False):
            base ^= 1 << int(b)
        out.append(base)
    return sorted(set(out))


def test_fingerprints():
    words = [f"w{k}" for k in range(50)] + ["Ünï", "MIXED", "x" * 70]
    texts = [" ".join(rng.choice(words, int(m))) for m in (0, 1, 2, 3, 4, 5, 17, 254, 258, 259, 600, 3000)]
    texts += ["", "  \t ", "a\x0bb\nc  d", "É À Z", " lead and trail "]
    assert [int(x) for x in sg.fingerprints(pa.array(texts, pa.large_string()))] == [brute_fingerprint(t) for t in texts]
    assert len(sg.fingerprints(pa.array([], pa.large_string()))) == 0


@pytest.mark.parametrize("distance", [0, 1, 4, 7])
def test_layout(distance):
    layout, x = sg.Layout(distance), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    assert len(layout.tables) == (distance + 2) * (distance + 1) // 2
    near = x.copy()
    for k in range(len(near)):
        for b in rng.choice(64, distance, replace=False):
            near[k] ^= np.uint64(1 << int(b))
    met = np.zeros(len(x), bool)
    for t in range(len(layout.tables)):
        tab, r, s = np.full(len(x), t), layout.ranks(x, t), layout.ranks(near, t)
        assert (layout.fingerprints(tab, r) == x).all()
        met |= layout.keys(tab, r) == layout.keys(tab, s)
    assert met.all()  # a pair within the distance shares a key in some table


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_link(monkeypatch, block):
    monkeypatch.setattr(sg, "PAIR_BLOCK", block)
    for distance in (0, 2, 4, 9):
        for _ in range(5):
            codes = np.array(clustered(120), np.uint64)
            layout = sg.Layout(4)
            rank = np.sort(layout.ranks(codes, 3))
            codes = sg._codes(rank)
            group = np.sort(rng.integers(0, 3, len(codes)))
            got = sg.link(codes, group, distance)
            for g in range(3):
                s = np.flatnonzero(group == g)
                if len(s):
                    assert (got[s] == s[brute_components(codes[s], distance)]).all()


@pytest.mark.parametrize("tile_rows", [40, 50_000])
def test_components_over_tiles(spark, tile_rows):
    """Small tiles: a key lies in many of them."""
    codes = [x - (1 << 64) if x >> 63 else x for x in clustered(400)]
    frame = spark.createDataFrame([(c,) for c in codes], "fp long").repartition(4).checkpoint()
    found = {r["node"]: r["label"] for r in sg.components(sg.links(frame, 4, tile_rows)).collect()}
    want = brute_components([c % (1 << 64) for c in codes], 4)
    label = {}
    for c, k in zip(codes, want.tolist(), strict=True):
        label.setdefault(k, []).append(c)
    assert {c: found.get(c, c) for c in codes} == {c: min(cs) for cs in label.values() for c in cs}


def test_ball_over_tiles(spark):
    """All codes of a ball of radius 2: one component, every key of its table hot; and far codes of one block pattern that stay alone."""
    ball = [0] + [1 << a for a in range(63)] + [1 << a | 1 << b for a in range(63) for b in range(a)]
    far = [(0x7FFFFFFF << 32 | int(x)) for x in rng.integers(0, 1 << 31, 300) * 0x1001 % (1 << 31)]
    codes = sorted(set(ball + far))
    frame = spark.createDataFrame([(c,) for c in codes], "fp long").checkpoint()
    found = {r["node"]: r["label"] for r in sg.components(sg.links(frame, 4, 100)).collect()}
    want = brute_components(codes, 4)
    assert [found.get(c, c) for c in codes] == [codes[k] for k in want]


def test_near_duplicates_odd(spark):
    base = " ".join(rng.choice([f"w{k}" for k in range(900)], 400))
    rows = [(5, base, "x"), (3, base.upper(), "y"), (9, base + " tail", None), (None, base, "z"), (7, None, "z"), (2, "", "z"), (8, " \t", "z"), (4, "alone in the world of words", "z"),
            (4, "another text that has this id too", "z"), (6, base * 3000, "z")]
    got = sg.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    codes = [brute_fingerprint(r[1]) for r in rows[:-1]]
    seen = sorted((str(r["doc_id"]), r["fingerprint"] % (1 << 64), r["component_id"]) for r in got.collect() if r["doc_id"] != 6)
    label = brute_components(codes, 4)
    least = {k: min(r[0] for r, x in zip(rows, label, strict=False) if x == k and r[0] is not None) for k in set(label.tolist())}
    assert seen == sorted((str(r[0]), c, least[k]) for r, c, k in zip(rows, codes, label.tolist(), strict=False))
    only = sg.near_duplicates(spark.createDataFrame([(None, base), (None, "b c d e f")], "doc_id long, text string"))
    assert [r["component_id"] for r in only.collect()] == [None, None]
    assert sg.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    """op12 against brute force, whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    codes = [brute_fingerprint(d["text"]) for d in docs]
    want = [(d["doc_id"], f"{c:016x}", docs[k]["doc_id"]) for d, c, k in zip(docs, codes, brute_components(codes, 4).tolist(), strict=True)]
    assert sorted(tuple(r) for r in QUERIES["op12_simhash"](spark, sf).collect()) == want
    assert len({k for *_, k in want}) < len(want)
