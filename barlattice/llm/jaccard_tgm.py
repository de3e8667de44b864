"""Documents linked by the Jaccard similarity of their word n-gram sets, through a token-group matrix.

Tokens are 64-bit hashes of word n-grams; a document's set is the sorted array of its distinct tokens.  With ``t = num / den``, two
documents link if ``den * |A and B| >= num * |A or B|``; then each holds at least ``ceil(t * max(|A|, |B|))`` of the other's tokens.

1. Documents of equal sets form a class; from here on classes stand for their copies.
2. A bound over all classes: of a class's first tokens in hash order enough must lie among the first tokens of some other class.
   It drops what can't link; whole sets are bounded alike for what is left, and nothing is compared yet.
3. What remains is partitioned into groups of similar documents: by minimum hashes, each with the document of most shared tokens as
   hub.  Documents checked against their hubs link to them, and the best such hub names the group.
4. The matrix of tokens and groups (each group's token union) bounds every document's overlap with all other groups, twice in turn.
   ``shared`` tokens that other groups have bound a partner's size by the reach, ``shared * (1 + t) / t - n``; only documents that
   some size could link outside their group are left.
5. Those documents look up their rarest tokens in the matrix, as many as a partner can't lack all of; groups found are opened only
   if sizes and reaches fit and the overlap with the whole union reaches the bound, and fitting members are compared exactly.
6. Links give components by repeated star contraction.

No step lists the pairs of a group: a document is compared with a few hubs and with the members of qualifying foreign groups.  Tokens
travel as packed arrays by hash range, so a frequent token costs one entry per document that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm import text as tx
from barlattice.session import shared_dir

BANDS = 4
MAX_BROADCAST_CLASSES = 500_000  # some 40 bytes each
FLUSH_TOKENS = 1 << 20
BUCKET_BYTES = 8 << 20
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(2 * BANDS)]


def token_sets(strings: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each document: hashes of ``n`` consecutive words, of all words if there are fewer, none without words."""
    data, offsets = tx.buffer_of(strings)
    starts, ends, first = tx.word_spans(data, offsets, tx.NON_SPACE)
    hashes = tx.span_hashes(tx.lower_ascii(data), starts, ends)
    weight = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(n)]
    whole = sum((hashes[k:len(hashes) - n + 1 + k] * weight[k] for k in range(n)), np.uint64(0)) if len(hashes) >= n else np.empty(0, np.uint64)
    whole = tx.mix(whole + np.uint64(n)) if len(whole) else whole
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(whole[lo:hi - n + 1])
        elif hi > lo:
            short = (hashes[lo:hi] * np.array(weight[:hi - lo], np.uint64)).sum(keepdims=True, dtype=np.uint64)
            yield tx.mix(short + np.uint64(hi - lo))
        else:
            yield np.empty(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set, signed."""
    with np.errstate(over="ignore"):
        a = tx.mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(s))
        b = tx.mix(s ^ np.uint64(0xC0FFEE1234ABCDEF)).sum(dtype=np.uint64)
    return int(np.array(a).view(np.int64)), int(np.array(b).view(np.int64))


def _keys(s: np.ndarray) -> list[int]:
    """Keys that similar sets share: each joins two minimum hashes, so one token that many sets have doesn't gather them."""
    low = np.array([tx.mix(s ^ seed).min() for seed in _SEEDS])
    return tx.mix(low[::2] * np.uint64(3) + low[1::2]).view(np.int64).tolist()


class Threshold:
    """Bounds that follow from ``den * |A and B| >= num * |A or B|``, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.num, self.den = num, den

    def need(self, n):
        """Least overlap of a set of ``n`` tokens with any partner."""
        return -(-self.num * n // self.den)

    def spare(self, n):
        """Tokens a partner may lack."""
        return n - self.need(n)

    def common(self, n):
        """Of the first ``first(n)`` tokens, so many are shared with a partner's first tokens, if the partner is no smaller."""
        return np.minimum(2 * self.spare(n) + 2, self.need(n))

    def first(self, n):
        return np.minimum(n, self.spare(n) + self.common(n))

    def least_common(self, n):
        """``common`` of the smallest partner."""
        return self.common(self.need(n))


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n, a, b``: size and digest of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in tx.chunks(batch.column(1)):
                got = [(len(s), *_digest(s)) for s in token_sets(part, n)]
                sizes, a, b = (pa.array(x, pa.int64()) for x in zip(*got, strict=True))
                yield pa.record_batch([batch.column(0).slice(lo, len(part)), sizes, a, b], names=["doc_id", "n", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long")


def _packed(owners: list[int], groups: list[int] | None, sets: list[np.ndarray], shift: int) -> Iterator[pa.RecordBatch]:
    """Token rows of some documents, one row per hash range."""
    tokens = np.concatenate(sets)
    sizes = [len(s) for s in sets]
    order = np.argsort(tokens)
    tokens = tokens[order]
    columns = [np.repeat(np.array(c, np.int64), sizes)[order] for c in ([owners] if groups is None else [owners, groups])]
    bucket = (tokens >> np.uint64(shift)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    cuts = [*at.tolist(), len(tokens)]
    packs = [pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (tokens, *columns)]
    packs += [packs[1]] * (groups is None)
    if groups is None:
        packs[2] = pa.nulls(len(at), pa.binary())
    yield pa.record_batch([pa.array(bucket[at]), *packs], names=["bucket", "tokens", "owners", "groups"])


def _shared_counts(packed: DataFrame, parts: int) -> DataFrame:
    """``owner, shared, popular``: how many of an owner's tokens occur in a group other than its own, and in how many groups altogether."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for b, t, o, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                owners = np.frombuffer(o, np.int64)
                rows.append((b, np.frombuffer(t, np.uint64), owners, owners if g is None else np.frombuffer(g, np.int64)))
        rows.sort(key=lambda r: r[0])
        owner_parts, shared_parts, popular_parts = [], [], []
        i = 0
        while i < len(rows):  # a hash range at a time
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            tokens, owners, groups = (np.concatenate([r[k] for r in rows[i:j]]) for k in (1, 2, 3))
            i = j
            order = np.lexsort((groups, tokens))
            tokens, owners, groups = tokens[order], owners[order], groups[order]
            new_token = np.ones(len(tokens), bool)
            new_token[1:] = tokens[1:] != tokens[:-1]
            new_group = new_token.copy()
            new_group[1:] |= groups[1:] != groups[:-1]
            number = np.cumsum(new_token) - 1
            count = np.bincount(number, new_group)[number]
            keep = count >= 2
            owners, count, number = owners[keep], count[keep], number[keep]
            pair = np.lexsort((number, owners))  # an owner's token counts once, however many copies brought it
            owners, count, number = owners[pair], count[pair], number[pair]
            once = np.ones(len(owners), bool)
            once[1:] = (owners[1:] != owners[:-1]) | (number[1:] != number[:-1])
            who, inverse = np.unique(owners[once], return_inverse=True)
            owner_parts.append(who)
            shared_parts.append(np.bincount(inverse, minlength=len(who)))
            popular_parts.append(np.bincount(inverse, count[once], len(who)))
        if owner_parts:
            who, inverse = np.unique(np.concatenate(owner_parts), return_inverse=True)
            shared, popular = (np.bincount(inverse, np.concatenate(x), len(who)).astype(np.int64) for x in (shared_parts, popular_parts))
            # packed by owner, as an owner's tokens lie in many hash ranges
            part = (tx.mix(who.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-1))
            cuts = [*at.tolist(), len(part)]
            packs = [pa.array([x[order][i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (who, shared, popular)]
            yield pa.record_batch([pa.array(part[order][at]), *packs], names=["part", "owners", "shared", "popular"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0, np.int64)] * 3
        for batch in batches:
            new = [np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in batch.columns[1:]]
            who, inverse = np.unique(np.concatenate((seen[0], new[0])), return_inverse=True)
            seen = [who, *(np.bincount(inverse, np.concatenate((seen[k], new[k])), len(who)).astype(np.int64) for k in (1, 2))]
        yield pa.record_batch([pa.array(x) for x in seen], names=["owner", "shared", "popular"])

    counted = packed.repartition(parts, "bucket").mapInArrow(run, "part long, owners binary, shared binary, popular binary")
    return counted.repartition(parts, "part").mapInArrow(add_up, "owner long, shared long, popular long")


def _ranges(tokens: int, width: int) -> tuple[int, int]:
    """Partitions and the shift that makes some eight hash ranges for each; from the tokens alone, as every task writes a row for each range it meets."""
    parts = max(1, -(-tokens * width // BUCKET_BYTES))
    return parts, 64 - (8 * parts - 1).bit_length()


def _overlap(one: bytes, other: bytes) -> int:
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _links(pairs: DataFrame, t: Threshold) -> DataFrame:
    """Pairs ``u, v`` (with columns ``us, vs``: their sets) that pass the exact test."""

    def run(series: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, other in series:
            out = []
            for a, b in zip(one, other, strict=True):
                a, b = a.as_py(), b.as_py()
                both = _overlap(a, b)
                out.append(t.den * both >= t.num * ((len(a) + len(b)) // 8 - both))
            yield pa.array(out, pa.bool_())

    return pairs.filter(F.arrow_udf(run, "boolean")("us", "vs"))


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable from each node of the links ``u, v``; by alternating star contractions."""
    shared_dir(links.sparkSession)
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours move to the least neighbour
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.join(least.withColumnRenamed("u", "w"), F.col("v") == F.col("w")).select("v", "m").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = small.filter("u > v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # one row
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the set's size and the smallest doc_id reachable by links.

    Words are runs of anything but white space, A-Z lower-cased.  Null and empty texts and texts of white space have an empty set, link with nothing and
    name themselves.  Long texts are taken whole.  Rows of equal sets link.  Rows of equal id count as one document in links, but each keeps its own size.  A null id never names a
    component: such a row gets its component's smallest id, or null if there is none.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    t = Threshold(num, den)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = _signatures(rows, n).checkpoint()
    classes = marks.filter("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))
    total = marks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]  # one row
    share = max(1, int(total * min(1.0, 3.2 * (1 - num / den)))) if total else 1

    # 2. first tokens of all classes
    parts, shift = _ranges(share, 16)

    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, part in tx.chunks(batch.column(1)):
                for s in token_sets(part, n):
                    if len(s) and (owner := _digest(s)[0]) not in seen:
                        seen[owner] = s[:int(t.first(len(s)))].copy()
                        held += len(seen[owner])
                if held >= FLUSH_TOKENS:
                    yield from _packed(list(seen), None, list(seen.values()), shift)
                    seen, held = {}, 0
        if seen:
            yield from _packed(list(seen), None, list(seen.values()), shift)

    shared = _shared_counts(rows.mapInArrow(first_tokens, "bucket long, tokens binary, owners binary, groups binary"), parts)
    able = classes.join(shared, classes["a"] == shared["owner"]).filter(F.col("shared") >= _least_common(F.col("n"), t)).filter(F.col("rep").isNotNull())
    able = able.select("rep", "a", "b", "n")

    # the bound on what could link outside its group (its class, if there are no groups yet) by whole sets
    def outside(frame: DataFrame) -> DataFrame:
        groups = "grp" in frame.columns
        tokens = frame.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]  # one row
        parts, shift = _ranges(tokens, 24 if groups else 16)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owners, names, held, size = [], [], [], 0
            for batch in batches:
                for rep, grp, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    owners.append(rep)
                    names.append(grp)
                    held.append(np.frombuffer(s, np.uint64))
                    size += len(held[-1])
                    if size >= FLUSH_TOKENS:
                        yield from _packed(owners, names if groups else None, held, shift)
                        owners, names, held, size = [], [], [], 0
            if held:
                yield from _packed(owners, names if groups else None, held, shift)

        packed = frame.select("rep", "grp" if groups else "rep", "set").toDF("rep", "grp", "set").mapInArrow(pack, "bucket long, tokens binary, owners binary, groups binary")
        counts = _shared_counts(packed, parts).withColumnRenamed("owner", "rep")
        # the largest partner that a document sharing so many tokens can have
        reach = F.floor(F.col("shared") * (num + den) / num) - F.col("n")
        # a text that others were made from has no tokens of its own
        central = F.struct((F.col("popular") / F.col("n")).alias("popular"), (-F.col("rep")).alias("first"))
        kept = [c for c in frame.columns if c not in ("reach", "central")]
        return frame.join(counts, "rep").filter(reach >= _need(F.col("n"), t)).select(*kept, reach.alias("reach"), central.alias("central")).checkpoint()

    # 3. their sets, hubs and groups
    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, a, b = (batch.column(k) for k in (0, 2, 3))
            for lo, part in tx.chunks(batch.column(1)):
                keep, sets, mins = [], [], []
                for i, s in enumerate(token_sets(part, n)):
                    if len(s) and _digest(s) == (a[lo + i].as_py(), b[lo + i].as_py()):  # a row of equal id and other text is none of it
                        keep.append(lo + i)
                        sets.append(s.tobytes())
                        mins.append(_keys(s))
                take = pa.array(keep, pa.int64())
                yield pa.record_batch([reps.take(take), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary()), pa.array(mins, pa.list_(pa.int64()))],
                                      names=["rep", "n", "set", "mins"])

    able = able.checkpoint()
    wanted = able.select(F.col("rep").alias("doc_id"), "a", "b")
    wanted = F.broadcast(wanted) if able.count() <= MAX_BROADCAST_CLASSES else wanted
    fetched = rows.join(wanted, "doc_id").select(F.col("doc_id").alias("rep"), "text", "a", "b")
    # rows of equal id and text are one
    sets = outside(fetched.mapInArrow(with_sets, "rep long, n long, set binary, mins array<long>").dropDuplicates(["rep", "set"]).checkpoint())
    keyed = sets.select("rep", "n", "central", F.posexplode("mins").alias("band", "key"))
    one = F.struct("central", "rep", "n")
    hubs = keyed.groupBy("band", "key").agg(F.array_distinct(F.array(F.max(one), F.min_by(one, "rep"))).alias("h"), F.count("*").alias("size")).filter("size > 1").select("band", "key", F.explode("h").alias("h"))
    fits = (den * F.col("n") >= num * F.col("h.n")) & (den * F.col("h.n") >= num * F.col("n"))
    to_hub = keyed.join(hubs, ["band", "key"]).filter((F.col("rep") != F.col("h.rep")) & fits)
    to_hub = to_hub.select(F.col("rep").alias("u"), F.col("h.rep").alias("v"), F.col("h.central").alias("hub_central")).distinct()
    plain = sets.select("rep", "n", "set")
    pairs = to_hub.join(plain.select(F.col("rep").alias("u"), F.col("set").alias("us")), "u").join(plain.select(F.col("rep").alias("v"), F.col("set").alias("vs")), "v")
    hub_links = _links(pairs, t).select("u", "v", "hub_central").checkpoint()
    best = hub_links.groupBy(F.col("u").alias("rep")).agg(F.max(F.struct("hub_central", "v")).alias("h")).select("rep", F.col("h.v").alias("hub"))
    grouped = plain.join(best, "rep", "left").select("rep", "n", "set", F.coalesce("hub", "rep").alias("grp"))

    # 4. the matrix's bound, now between groups
    left = outside(outside(grouped))
    links = hub_links.select("u", "v")
    if not left.isEmpty():
        links = links.unionByName(_open_groups(left, t))

    # 6. components over classes, then documents
    found = components(links.checkpoint())
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", "n", F.coalesce("label", "rep").alias("component_id"))
    out = marks.join(named, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def _need(n, t: Threshold):
    """``Threshold.need`` as a column."""
    up = n * t.num + (t.den - 1)
    return ((up - up % t.den) / t.den).cast("long")


def _least_common(n, t: Threshold):
    """``Threshold.least_common`` as a column."""
    s = _need(n, t)
    need = _need(s, t)
    return F.least(2 * (s - need) + 2, need)


def _open_groups(left: DataFrame, t: Threshold) -> DataFrame:
    """5. Exact links ``u, v`` between documents of different groups; the smaller document asks.

    A document asks for partners of its own size up to its reach; of its tokens such a partner lacks ``n - least`` at most, and the
    partner's own rarest tokens hold one of them.  The first token that two documents share, in order of rarity, leaves room for all of
    their overlap behind it in both; other hits are dropped.
    """
    least = -F.floor(-(2 * t.num * F.col("n")) / (t.num + t.den))  # overlap with a partner of no smaller size
    tokens = left.select("rep", "grp", "n", "reach", F.explode(_unpack("set")).alias("token"))
    matrix = tokens.select("token", F.col("grp").alias("other")).distinct()
    rarity = matrix.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1")
    sizes = left.groupBy(F.col("grp").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("far"), F.count("*").alias("members"))
    # tokens of one group come first and meet nothing, so only their number is needed
    ranked = tokens.join(rarity, "token").withColumn("behind", F.count("*").over(Window.partitionBy("rep").orderBy(F.desc("groups"), F.desc("token"))))
    prefix = ranked.filter("reach >= n").filter(F.col("behind") >= least).select("token", "rep", "grp", "n", "reach", "behind")
    listed = ranked.filter(F.col("behind") >= _need(F.col("n"), t)).groupBy("token", F.col("grp").alias("other")).agg(F.max("behind").alias("room")).join(sizes, "other")
    both = -F.floor(-(t.num * (F.col("n") + F.greatest("n", "low"))) / (t.num + t.den))  # least overlap with the group's smallest fitting member
    may = (F.col("other") != F.col("grp")) & (F.col("high") >= F.col("n")) & (F.col("low") <= F.col("reach")) & (F.col("far") >= F.col("n")) & (F.col("behind") >= both) & (F.col("room") >= both)
    asked = prefix.join(listed, (prefix["token"] == listed["token"]) & may).select("rep", "n", "reach", "other", "members").distinct()
    # a group of one is opened at once: its union is its only member
    many = asked.filter("members > 1")
    overlap = many.join(tokens.select("rep", "token"), "rep").join(matrix, ["token", "other"]).groupBy("rep", "n", "reach", "other").agg(F.count("*").alias("overlap"))
    opened = overlap.filter(F.col("overlap") >= least).select("rep", "n", "reach", "other").unionByName(asked.filter("members = 1").select("rep", "n", "reach", "other"))
    opened = opened.select(F.col("rep").alias("u"), F.col("n").alias("un"), F.col("reach").alias("ur"), "other")
    members = left.select(F.col("rep").alias("v"), F.col("n").alias("vn"), F.col("reach").alias("vr"), F.col("grp").alias("other"))
    fits = (F.col("vn") >= F.col("un")) & (F.col("vn") <= F.col("ur")) & (F.col("un") <= F.col("vr")) & (t.den * F.col("un") >= t.num * F.col("vn")) & (F.col("u") != F.col("v"))
    pairs = opened.join(members, (opened["other"] == members["other"]) & fits).select("u", "v").distinct()
    sets = left.select("rep", "set")
    pairs = pairs.join(sets.select(F.col("rep").alias("u"), F.col("set").alias("us")), "u").join(sets.select(F.col("rep").alias("v"), F.col("set").alias("vs")), "v")
    return _links(pairs, t).select("u", "v")


def _unpack(column: str):
    """The tokens of a packed set as signed numbers."""

    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for packed in series:
            yield pa.array([np.frombuffer(x.as_py(), np.int64) for x in packed], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(column)
