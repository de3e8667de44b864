"""Merkle proofs against a plain tree, groups of sizes around the arity and the chunk."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from barlattice.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def record(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node the (left, right) siblings of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            lo = k - k % 8
            paths[leaf].append(("".join(nodes[lo:k]), "".join(nodes[k + 1:lo + 8])))
        nodes = [sha("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def plain(rows):
    """``(lang, doc_id, leaf) -> subroot, root, path`` of rows (doc_id, text, lang)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, record(r)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([leaf for *_, leaf in sorted(groups[g])]) for g in langs}
    root, above = tree([below[g][0] for g in langs])
    out = {}
    for g, up in zip(langs, above, strict=True):
        for (has, i, leaf), path in zip(sorted(groups[g]), below[g][1], strict=True):
            out.setdefault((g, i if has else None, leaf), []).append((below[g][0], root, path + up))
    return out


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_path", F.lit("ours"))
    changed = F.crc32("text") % 2 == 0
    done = merkle.manifest(frame, ["doc_id", "text", "lang"], changed=changed, now={"text": F.upper("text")})
    got = done.withColumns({"folded": merkle.fold(F.col("path"), F.col("now")), "same": merkle.fold(F.col("path"), F.col("leaf")), "proof": merkle.proof_digest(F.col("path"))}).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        paths = want[r["lang"], r["doc_id"], r["leaf"]]
        mine = [tuple(p) for p in r["path"]]
        assert (r["subroot"], r["root"], mine) in paths
        paths.remove((r["subroot"], r["root"], mine))
        assert r["same"] == r["root"] and (r["folded"] == r["root"]) == (r["now"] == r["leaf"])
        assert r["proof"] == sha("".join(a + b for a, b in mine))
        node = r["now"]
        for a, b in mine:
            node = sha(a + node + b)
        assert node == r["folded"]


def test_sizes(spark):
    rows = [(i, f"Text {i}", lang) for lang, n in (("a", 1), ("b", 2), ("c", 7), ("d", 8), ("e", 9), ("é", 64), ("Z", 65), ("", 66), (None, 513), ("f", 3), ("g", 1)) for i in range(n)]
    check(spark, rows)


def test_chunks(spark, monkeypatch):
    """A group over one chunk, and small range partitions."""
    monkeypatch.setattr(merkle, "ROWS_PER_PIECE", 500)
    check(spark, [(i, "x" if i % 3 else None, "a") for i in range(4096 + 4096 * 8 + 1)][::-1] + [(1, "one", "b")])


def test_many_groups(spark):
    check(spark, [(k % 2, "t", f"lang{k // 2:03d}") for k in range(1200)])


def test_odd(spark):
    long = "word " * 300_000
    check(spark, [(None, None, None), (None, "", None), (2, "same", "a"), (2, "same", "a"), (2, "other", "a"), (3, long, "a")])
    check(spark, [(7, "alone", None)])
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, text string, lang string"), ["doc_id", "text", "lang"]).count() == 0
    with pytest.raises(ValueError):
        merkle.proofs(spark.createDataFrame([("a", "b", 1)], "lang string, leaf string, _cnt int"), "lang", ["_cnt"])
