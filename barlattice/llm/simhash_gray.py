"""SimHash near-duplicates: fingerprints within a Hamming distance, found through a Gray-ordered hierarchical index, and their components.

1. A text's fingerprint has each bit that over half of its shingles' hashes have.  Equal fingerprints are one entry from here on.
2. Upper nodes of the index share a masked bit pattern.  The topmost are bit blocks: with ``distance + 2`` of them, two fingerprints that link
   agree on two blocks whole, so the index has one table for each pair of blocks, every entry in each, its two blocks in front.
3. Entries of a table are sorted by the Gray rank of their bits in the table's order: neighbours differ in few bits, and all that share the
   leading pattern (a key) stand together.  Range partitions cut this order into tiles of bounded size; a key of any size spreads over tiles.
4. Inside a tile eight neighbours form a node, eight nodes the next one, up to the key.  A node holds the bits in which all below it agree.  Pairs of
   nodes are descended together: bits that both have settled add to their differences, and a pair is dropped whole when these
   exceed the distance, or when both lie in one component already.
5. Keys that span tiles: tiles become nodes in turn, and pairs of tiles are descended by the same two rules as joins; the rows of what is
   left meet one pair of tiles to a task.

Links leave a task as stars, one row for an entry at most.  Nothing is dropped: the components are those of all linked pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm import text as tx
from barlattice.llm.jaccard_tgm import components
from barlattice.session import shared_dir

BITS = 64
FAN = 8
NEAR = 8  # Gray neighbours looked at first
TILE_ROWS = 50_000
PAIR_BLOCK = 1 << 20  # node pairs expanded at once
_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)  # a byte's bits, one in each byte
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(strings: pa.Array, n: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of the XXH64 of its ``n``-word shingles (all words if fewer; none: 0)."""
    data, offsets = tx.buffer_of(strings)
    starts, ends, first = tx.word_spans(data, offsets, tx.NON_SPACE)
    size = ends - starts + 1
    upto = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    flat = tx.lower_ascii(data)[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], size)]
    flat[upto[1:] - 1] = 32
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))  # shingles of each text
    begin = np.repeat(first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(begin + n, np.repeat(first[1:], count))
    joined, digest = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(upto[begin].tolist(), (upto[last] - 1).tolist(), strict=True)], np.uint64)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    # bits are counted in bytes, eight at a time, over at most 255 hashes
    count = count[some]
    pieces = -(-count // 255)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(np.cumsum(count) - count, pieces) + 255 * piece
    octets = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_LANES[octets[:, k]], cuts) for k in range(8)], axis=1)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS).astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    bits = (2 * ones > count[:, None]).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)
    out[some] = np.bitwise_or.reduce(bits, axis=1)
    return out


class Layout:
    """Tables of the index: for each pair of bit blocks, the order of all blocks with these two in front."""

    def __init__(self, distance: int):
        if not 0 <= distance <= BITS - 2:
            raise ValueError("the distance must be at least 0 and leave two blocks of a bit")
        self.distance, blocks = distance, distance + 2
        size = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
        at = np.cumsum([0, *size[:-1]])
        self.tables, self.head = [], []
        for pair in combinations(range(blocks), 2):
            to, moves = BITS, []
            for b in [*pair, *(k for k in range(blocks) if k not in pair)]:
                to -= size[b]
                moves.append((np.uint64(at[b]), np.uint64((1 << size[b]) - 1), np.uint64(to)))
            self.tables.append(moves)
            self.head.append(size[pair[0]] + size[pair[1]])
        self.tail = np.array([BITS - h for h in self.head], np.uint64)

    def ranks(self, x: np.ndarray, table: int) -> np.ndarray:
        """Gray ranks of fingerprints in the order of a table."""
        p = np.zeros(len(x), np.uint64)
        for at, mask, to in self.tables[table]:
            p |= (x >> at & mask) << to
        for k in (1, 2, 4, 8, 16, 32):
            p ^= p >> np.uint64(k)
        return p

    def fingerprints(self, tables: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        p, out = ranks ^ ranks >> np.uint64(1), np.zeros(len(ranks), np.uint64)
        for t in np.unique(tables):
            s = tables == t
            for at, mask, to in self.tables[t]:
                out[s] |= (p[s] >> to & mask) << at
        return out

    def keys(self, tables: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return (ranks >> self.tail[tables]).astype(np.int64)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the components of u and v; every entry's label is its component's least number."""
    while True:
        a, b = label[u], label[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(label, hi[apart], lo[apart])
        while (label != (up := label[label])).any():
            label[:] = up


def link(codes: np.ndarray, group: np.ndarray, distance: int, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components of codes within ``distance`` of each other inside their group; groups stand together, codes in Gray order.

    ``label``: components known before, as numbers of entries.
    """
    label = np.arange(len(codes)) if label is None else label
    for k in range(1, NEAR):
        u = np.flatnonzero((group[k:] == group[:-k]) & (np.bitwise_count(codes[k:] ^ codes[:-k]) <= distance))
        _merge(label, u, u + k)
    # nodes: first child, number of children, bits all agree in, these bits' values
    levels = [(np.arange(len(codes)), np.ones(len(codes), np.int64), np.full(len(codes), _ALL), codes)]
    owner = group
    while True:
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        begin = np.flatnonzero(new)
        if len(begin) == len(owner) and len(levels) > 1:
            break
        place = np.arange(len(owner)) - begin[np.cumsum(new) - 1]
        first = np.flatnonzero(place % FAN == 0)
        _, _, mask, bits = levels[-1]
        both, either = np.bitwise_and.reduceat(bits | ~mask, first), np.bitwise_or.reduceat(bits & mask, first)
        agree = np.bitwise_and.reduceat(mask, first) & ~(both ^ either)
        levels.append((first, np.diff(first, append=len(owner)), agree, either & agree))
        owner = owner[first]

    def spans() -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(label, label)]
        for first, *_ in levels[1:]:
            out.append((np.minimum.reduceat(out[-1][0], first), np.maximum.reduceat(out[-1][1], first)))
        return out

    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    known, stack = spans(), [(top, roots, roots, np.zeros(len(roots), np.int64))]
    while stack:
        level, a, b, differ = stack.pop()
        low, high = known[level]
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b, differ = a[apart], b[apart], differ[apart]
        if not len(a):
            continue
        if len(a) > 1 and len(a) * FAN * FAN > PAIR_BLOCK:
            cut = PAIR_BLOCK // (FAN * FAN)
            stack.extend((level, a[k:k + cut], b[k:k + cut], differ[k:k + cut]) for k in range(0, len(a), cut))
            continue
        first, many, mask, _ = levels[level]
        times = many[a] * many[b]
        pair = np.repeat(np.arange(len(a)), times)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        u, v = first[a][pair] + k // many[b][pair], first[b][pair] + k % many[b][pair]
        keep = (a != b)[pair] | (u < v) | ((level > 1) & (u == v))
        pair, u, v = pair[keep], u[keep], v[keep]
        _, _, below, bits = levels[level - 1]
        fresh = below[u] & below[v] & ~(mask[a] & mask[b])[pair]  # settled here, not yet above
        differ = differ[pair] + np.bitwise_count((bits[u] ^ bits[v]) & fresh)
        near = differ <= distance
        u, v, differ = u[near], v[near], differ[near]
        if level > 1:
            stack.append((level - 1, u, v, differ))
        elif len(u):
            _merge(label, u, v)
            known = spans()
    return label


def _codes(ranks: np.ndarray) -> np.ndarray:
    return ranks ^ ranks >> np.uint64(1)


def _column(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tab, rank, tile`` of a whole tile."""
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    tab, rank, tile = (np.concatenate([g[k] for g in got]) for k in range(3))
    return tab.astype(np.int64), rank.astype(np.int64).view(np.uint64), tile.astype(np.int64)


def links(codes: DataFrame, distance: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``u, v`` over distinct longs ``fp``: links whose components are those of all pairs within ``distance``."""
    spark = codes.sparkSession
    shared_dir(spark)
    layout = Layout(distance)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(len(layout.tables)):
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(layout.ranks(x, t).view(np.int64))], names=["tab", "rank"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, rank, _ = _column(batches)
        if len(tab):
            key = layout.keys(tab, rank)
            change = np.ones(len(tab), bool)
            change[1:] = (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])
            group = np.cumsum(change)
            shared = np.bincount(group)[group] > 1
            tab, rank, group = tab[shared], rank[shared], group[shared]
        if len(tab):
            label = link(_codes(rank), group, distance)
            on = np.flatnonzero(label != np.arange(len(label)))
            u, v = (layout.fingerprints(tab[k], rank[k]).view(np.int64) for k in (on, label[on]))
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile's first and last key: the only ones that can go on in another."""
        tab, rank, tile = _column(batches)
        if len(tab):
            key = layout.keys(tab, rank)
            of = [(tab == tab[k]) & (key == key[k]) for k in (0, -1)]
            s = of[0] | of[1]
            columns = [tab[s], key[s], tile[s], rank[s].view(np.int64), layout.fingerprints(tab[s], rank[s]).view(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["tab", "key", "tile", "rank", "fp"])

    rows = codes.select("fp").mapInArrow(placed, "tab int, rank long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() * len(layout.tables) // tile_rows))
    tiles = rows.repartitionByRange(n, "tab", "rank").sortWithinPartitions("tab", "rank").withColumn("tile", F.spark_partition_id()).checkpoint()
    found = tiles.mapInArrow(inside, "u long, v long").checkpoint()
    edge = tiles.mapInArrow(ends, "tab long, key long, tile long, rank long, fp long")
    span = edge.groupBy("tab", "key").agg(F.min("tile").alias("tile0"), F.max("tile").alias("tile1")).filter("tile0 < tile1")
    edge = edge.join(span, ["tab", "key"]).withColumn("tile", F.col("tile") - F.col("tile0"))
    edge = edge.join(components(found).select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")).checkpoint()
    wide = edge.agg(F.max("tile").alias("n")).first()["n"]  # one row
    if wide is None:
        return found
    return found.unionByName(_across(edge, wide, distance))


def _across(edge: DataFrame, wide: int, distance: int) -> DataFrame:
    """Links between tiles of one key (tiles numbered from 0 inside it, ``wide`` the largest number)."""
    spec = ["tab", "key"]
    leaf = edge.groupBy(*spec, "tile").agg(F.bit_and("fp").alias("both"), F.bit_or("fp").alias("either"), F.min("label").alias("low"), F.max("label").alias("high")).checkpoint()
    depth = 0
    while FAN**depth <= wide:
        depth += 1

    def nodes(level: int, side: str) -> DataFrame:
        at = leaf.groupBy(*spec, F.expr(f"tile div {FAN**level}").alias("node"))
        at = at.agg(*[f(c).alias(c) for f, c in ((F.bit_and, "both"), (F.bit_or, "either"), (F.min, "low"), (F.max, "high"))])
        return at.select(*spec, F.expr(f"node div {FAN}").alias(f"{side}_up"), *[F.col(c).alias(f"{side}_{c}") for c in ("node", "both", "either", "low", "high")])

    pairs = leaf.select(*spec, F.lit(0).cast("long").alias("a_up"), F.lit(0).cast("long").alias("b_up")).distinct()
    agree = F.bitwise_not(F.col("a_both").bitwiseXOR(F.col("a_either"))).bitwiseAND(F.bitwise_not(F.col("b_both").bitwiseXOR(F.col("b_either"))))
    near = F.bit_count(F.col("a_both").bitwiseXOR(F.col("b_both")).bitwiseAND(agree)) <= distance
    apart = (F.col("a_low") != F.col("a_high")) | (F.col("b_low") != F.col("b_high")) | (F.col("a_low") != F.col("b_low"))
    for level in reversed(range(depth)):
        order = F.col("a_node") < F.col("b_node") if level == 0 else F.col("a_node") <= F.col("b_node")
        met = pairs.join(nodes(level, "a"), [*spec, "a_up"]).join(nodes(level, "b"), [*spec, "b_up"])
        pairs = met.filter(order & near & apart).select(*spec, F.col("a_node").alias("a_up"), F.col("b_node").alias("b_up"))
    sides = pairs.select(*spec, "a_up", "b_up", F.explode(F.array("a_up", "b_up")).alias("tile"))
    rows = sides.join(edge.select(*spec, "tile", "rank", "fp", "label"), [*spec, "tile"])

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rank", ignore_index=True)
        _, first, inverse = np.unique(x["label"].to_numpy(), return_index=True, return_inverse=True)
        old = first[inverse]
        label = link(_codes(x["rank"].to_numpy().view(np.uint64)), np.zeros(len(x), np.int64), distance, old.copy())
        on, fp = np.flatnonzero(label != old), x["fp"].to_numpy()
        return pd.DataFrame({"u": fp[old[on]], "v": fp[label[on]]}).drop_duplicates()

    # components known before are links themselves: u and v name one of their entries
    return rows.groupBy(*spec, "a_up", "b_up").applyInPandas(meet, "u long, v long")


def near_duplicates(docs: DataFrame, n: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: 64 bits (a long) and the smallest doc_id reachable by links of at most ``distance`` bits.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are counted as often as they occur.  Null and empty texts and texts
    of white space have fingerprint 0, which links like any other.  Long texts are taken whole.  Rows of equal text have equal fingerprints and link;
    rows of equal id stay separate rows.  A null id never names a component: such a row gets its component's smallest id, null if there is none.
    Other columns are not read; an empty table gives no rows.
    """
    shared_dir(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in tx.chunks(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, len(part)), pa.array(fingerprints(part, n).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = rows.mapInArrow(run, "doc_id long, fp long").checkpoint()
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("rep")).checkpoint()
    found = components(links(classes, distance, tile_rows)).withColumnRenamed("node", "fp")
    named = classes.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    out = marks.join(named.select("fp", "label"), "fp").join(least, "label")
    return out.select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
