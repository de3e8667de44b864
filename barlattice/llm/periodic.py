"""Periodic runs of words: maximal stretches that repeat with a period at least ``copies`` times, and texts without the repeats.

A run of period p holds two equal words p apart at every place but its last p, so a grid of step ``(copies - 1) * p`` meets it.  For every p the grid's
points are extended to both sides by longest common extensions (LCE) of i and i + p; all grids of a text together have about ``n ln n / (copies - 1)`` points.

LCE of two places: few words are compared outright, which settles almost every pair of ordinary text.  What goes on longer is answered by a
difference cover (residues mod 31 such that any two places reach cover residues by one shift below 31): only suffixes at cover
residues are sorted, by prefix doubling from 31 words on; the shift's words are compared one by one, then a sparse table of the sorted
suffixes' common prefixes gives the rest as a range minimum.  The same over reversed texts extends backwards.

Everything is vectorised over a chunk of texts; nothing is shuffled.  A text is worked on whole, in memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import text as tx

COVER, MOD = (1, 5, 11, 24, 25, 27), 31  # a perfect difference set
FEW = 8  # words compared outright
GRID_BLOCK = 1 << 20  # grid points at once


def _shifts() -> np.ndarray:
    """``[a, b]``: the least shift that takes the residues a and b into the cover."""
    inside = np.zeros(MOD, bool)
    inside[list(COVER)] = True
    table = np.full((MOD, MOD), -1, np.int64)
    for a in range(MOD):
        for b in range(MOD):
            table[a, b] = next(s for s in range(MOD) if inside[(a + s) % MOD] and inside[(b + s) % MOD])
    return table


_SHIFT = _shifts()


def common_words(t: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int, step: int = 1) -> np.ndarray:
    """How many words from i and j on (``step`` -1: backwards) are equal, ``most`` at most.  Separators in ``t`` end it."""
    out = np.zeros(len(i), np.int64)
    most = np.broadcast_to(np.asarray(most, np.int64), len(i))
    act, k = np.flatnonzero(most > 0), 0
    while len(act):
        act = act[t[i[act] + step * k] == t[j[act] + step * k]]
        k += 1
        out[act] = k
        act = act[most[act] > k]
    return out


class Extensions:
    """LCE over ``t``, word numbers in which every text ends with a separator of its own number."""

    def __init__(self, t: np.ndarray):
        self.t = t
        inside = np.zeros(MOD, bool)
        inside[list(COVER)] = True
        self.at = np.flatnonzero(np.resize(inside, len(t)))  # the sampled suffixes
        m = len(self.at)
        self.number = np.full(len(t), -1, np.int64)
        self.number[self.at] = np.arange(m)
        order, group = np.arange(m), np.zeros(m, np.int64)  # group: the first slot of suffixes that are still alike
        slots, levels, h = np.arange(m), [], 0
        while len(slots) or h < MOD:
            tied = order[slots]
            word = t[self.at[tied] + h] if h < MOD else group[self.number[self.at[tied] + h]]
            key = group[tied] << 32 | word
            by = np.argsort(key, kind="stable")
            tied, key = tied[by], key[by]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            order[slots] = tied
            starts = np.flatnonzero(new)
            group[tied] = slots[starts][np.cumsum(new) - 1]
            alone = np.diff(starts, append=len(key)) == 1
            slots = slots[~alone[np.cumsum(new) - 1]]
            h = h + 1 if h < MOD else 2 * h
            if h >= MOD:
                levels.append(group.astype(np.int32))  # suffixes alike over h words
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        # neighbours' common prefixes, from the longest span alike down, then word by word
        x, y = self.at[order[:-1]], self.at[order[1:]]
        lcp = np.zeros(max(m - 1, 0), np.int64)
        for k in reversed(range(len(levels))):
            same = levels[k][self.number[x + lcp]] == levels[k][self.number[y + lcp]]
            lcp += same * (MOD << k)
        lcp += common_words(t, x + lcp, y + lcp, MOD)
        self.table = [lcp]
        while 2 << (len(self.table) - 1) <= len(lcp):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words alike from i and j on; i and j differ and lie in one text."""
        shift = _SHIFT[i % MOD, j % MOD]
        out = common_words(self.t, i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = (self.rank[self.number[x[on] + shift[on]]] for x in (i, j))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1  # floor of the logarithm
        for k in np.unique(level):
            s = level == k
            out[on[s]] += np.minimum(self.table[k][lo[s]], self.table[k][hi[s] - (1 << int(k))])
        return out


def grid(first: np.ndarray, n: np.ndarray, copies: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of grid points ``i, p``: for texts at ``first`` of ``n`` words, every ``(copies - 1) * p``-th place for every period that fits."""
    periods = n // copies
    text = np.repeat(np.arange(len(n)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (n[text] - p - 1) // ((copies - 1) * p) + 1
    upto = np.cumsum(points)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + GRID_BLOCK, side="right")))
        count = points[lo:hi]
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        period = np.repeat(p[lo:hi], count)
        yield np.repeat(first[text[lo:hi]], count) + k * (copies - 1) * period, period
        lo = hi


def find_runs(words: np.ndarray, first: np.ndarray, copies: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs, by text, start and period.

    ``words``: word numbers from 0 of all texts; ``first``: where each text's words begin, with the total last.
    """
    n, texts = np.diff(first), len(first) - 1
    top = int(words.max(initial=-1)) + 1
    t = np.empty(len(words) + texts + 1, np.int64)
    gaps = first + np.arange(texts + 1)  # a separator before each text and one at the end
    t[gaps] = top + np.arange(texts + 1)
    mine = np.ones(len(t), bool)
    mine[gaps] = False
    t[mine] = words
    found = []
    for i, p in grid(gaps[:-1] + 1, n, copies):
        same = t[i] == t[i + p]
        i, p = i[same], p[same]
        need = np.maximum((copies - 1) * p, least - p)
        ahead, back = common_words(t, i, i + p, FEW), common_words(t, i - 1, i + p - 1, FEW, -1)
        keep = (ahead == FEW) | (back == FEW) | (ahead + back >= need)
        found.append([x[keep] for x in (i, p, need, ahead, back)])
    i, p, need, ahead, back = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(5))
    open_a, open_b = np.flatnonzero(ahead == FEW), np.flatnonzero(back == FEW)
    if len(open_a) or len(open_b):
        # suffixes of the texts concerned only
        which = np.zeros(texts, bool)
        which[np.searchsorted(gaps, i[np.union1d(open_a, open_b)], side="right") - 1] = True
        part = np.append(np.repeat(which, n + 1), True)
        place, some = np.cumsum(part) - 1, t[part]
        if len(open_a):
            ahead[open_a] = Extensions(some).query(place[i[open_a]], place[(i + p)[open_a]])
        if len(open_b):
            end = len(some) - 1
            back[open_b] = Extensions(some[::-1].copy()).query(end - place[i[open_b] - 1], end - place[(i + p)[open_b] - 1])
    ok = ahead + back >= need
    start, period, length = (i - back)[ok], p[ok], (ahead + back + p)[ok]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    new = np.ones(len(start), bool)  # of periods of one stretch the smallest; the others are its multiples
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[new], period[new], length[new]
    order = np.lexsort((period, start))
    start, period, length = start[order], period[order], length[order]
    text = np.searchsorted(gaps, start, side="right") - 1
    return text, start - gaps[text] - 1, length, period


def _numbered_words(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, and only they, have equal numbers."""
    flat = data[tx.NON_SPACE[data]]
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def collapse_chunk(strings: pa.Array, copies: int = 4, least: int = 6) -> tuple[np.ndarray, tuple[np.ndarray, ...], pa.Array]:
    """Of a chunk of texts: words of each, runs as from ``find_runs``, and the texts without repeats."""
    data, offsets = tx.buffer_of(strings)
    starts, ends, first = tx.word_spans(data, offsets, tx.NON_SPACE)
    lens = ends - starts
    runs = find_runs(_numbered_words(data, lens), first, copies, least)
    text, start, length, period = runs
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first[text] + start + period, 1)
    np.add.at(change, first[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    bounds = np.searchsorted(kept, first)
    size = lens[kept] + 1  # with the space behind it, but for a text's last
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    size[last] -= 1
    upto = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    out = data[np.arange(upto[-1]) + np.repeat(starts[kept] - upto[:-1], size)]
    gap = np.ones(len(kept), bool)
    gap[last] = False
    out[upto[1:][gap] - 1] = 32
    return np.diff(first), runs, pa.LargeStringArray.from_buffers(len(strings), pa.py_buffer(upto[bounds]), pa.py_buffer(out))


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: int = 4, least: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of ``start, length, period``, by start, then period) and collapsed.

    Words are runs of anything but ASCII white space, numbered from 0.  A run is a stretch with smallest period q of at least ``least`` words
    and ``copies`` periods that no neighbouring word extends; ``collapsed`` joins by one space the words that no run holds behind its first q.  Overlapping
    runs, or several of one start, all count.  Null and empty texts and texts of white space have no words, no runs and an empty ``collapsed``.  Long texts are
    taken whole.  A null id stays null, repeated rows stay repeated, other columns are not read, an empty table gives no rows.
    """
    if copies < 2:
        raise ValueError("a run has two copies at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in tx.chunks(batch.column(1)):
                n, (which, *columns), collapsed = collapse_chunk(part, copies, least)
                offsets = np.searchsorted(which, np.arange(len(part) + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
                yield pa.record_batch([batch.column(0).slice(lo, len(part)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), collapsed.cast(pa.string())],
                                      names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
