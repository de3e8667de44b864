"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barlattice.llm import periodic
from barlattice.llm.queries import QUERIES

rng = np.random.default_rng(11)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, copies=4, least=6):
    """``start, length, period`` of all runs, by start and period."""
    n, out = len(w), set()
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, copies * q) and not any(all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_text(r):
    """A few stretches: random words, repeats of blocks, copies of earlier blocks with changes."""
    w = []
    for _ in range(int(r.integers(1, 6))):
        block = [f"w{x}" for x in r.integers(0, 3 + 40 * int(r.integers(0, 2)), int(r.integers(1, 9)))]
        w += block * int(r.integers(1, 9)) + block[:int(r.integers(0, len(block) + 1))]
        if len(w) > 20 and r.random() < 0.5:
            at = int(r.integers(0, len(w) - 10))
            w += w[at:at + int(r.integers(1, 200))]
    return w


def test_cover_reaches_every_pair():
    assert sorted({(a - b) % periodic.MOD for a in periodic.COVER for b in periodic.COVER}) == list(range(periodic.MOD))


def test_extensions():
    """LCE of all pairs of repetitive texts, forwards."""
    for _ in range(6):
        w = [int(x[1:]) for x in periodic_text(rng)] * 2 + [99] + [7] * 150
        t = np.array([*w, 1000], np.int64)
        i, j = np.triu_indices(len(w), 1)
        want = np.zeros((len(w) + 1, len(w) + 1), np.int64)
        for a in range(len(w) - 1, -1, -1):
            for b in range(len(w) - 1, a, -1):
                want[a, b] = want[a + 1, b + 1] + 1 if w[a] == w[b] else 0
        assert (periodic.Extensions(t).query(i, j) == want[i, j]).all()


@pytest.mark.parametrize("copies,least", [(4, 6), (2, 2), (3, 10)])
def test_runs(copies, least):
    texts = [" ".join(periodic_text(rng)) for _ in range(60)]
    texts += ["", " \t\n", "a", "a a a a a", "a a a a a a", "ab " * 500, " ".join(["x"] * 400), "           ", "a b a b a b a b c"]
    n, (which, *found), collapsed = periodic.collapse_chunk(pa.array(texts, pa.large_string()), copies, least)
    for k, text in enumerate(texts):
        w = words_of(text)
        want = brute_runs(w, copies, least)
        assert [tuple(int(c[i]) for c in found) for i in np.flatnonzero(which == k)] == want
        assert collapsed[k].as_py() == brute_collapse(w, want) and n[k] == len(w)


def test_runs_in_grid_blocks(monkeypatch):
    text = " ".join(periodic_text(np.random.default_rng(5)) * 3)
    whole = periodic.collapse_chunk(pa.array([text], pa.large_string()))[1]
    monkeypatch.setattr(periodic, "GRID_BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic.collapse_chunk(pa.array([text], pa.large_string()))[1], strict=True))


def test_collapse_odd(spark):
    long = "one two three " * 60_000 + "end"
    rows = [(1, None, "x"), (2, "", "x"), (None, "a a a a a a", "y"), (3, "a a a a a a", None), (3, "a a a a a a", None), (4, long, "z")]
    got = {}
    for r in periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got == {1: [(0, [], "")], 2: [(0, [], "")], None: [(6, [(0, 6, 1)], "a")], 3: [(6, [(0, 6, 1)], "a")] * 2, 4: [(180_001, [(0, 180_000, 3)], "one two three end")]}
    assert periodic.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string, runs string"), copies=1)


def test_query(spark, sf):
    """op11 against its contract in plain Python, whole table."""
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = words_of(d["text"])
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = brute_runs_fast(w)
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d["doc_id"]]
        assert r["n_runs"] == len(want)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(w, want).encode()).hexdigest()
    assert planted > 5


def brute_runs_fast(w, copies=4, least=6):
    """``brute_runs`` with whole-array comparisons, for long texts."""
    number = {}
    t = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    out = {}
    for q in range(1, len(t) // copies + 1):
        same = np.concatenate(([0], (t[:-q] == t[q:]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s + q >= max(least, copies * q):
                out.setdefault((s, e - s + q), q)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))
