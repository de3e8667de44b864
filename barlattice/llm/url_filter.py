"""URL rules in a sorted digest array.

The rule list is kept as one file image: a header, the 64-bit xxhash of every rule string in ascending order, the verdicts,
the strings' offsets and the strings.  Tasks map the image into memory and look up all keys of an Arrow batch by one
vectorised binary search; a hit counts only if the stored string is the one looked for, so equal digests do no harm.

A URL's keys are every suffix of its host (by labels) joined with every start of its path whose length some rule has.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAGIC = b"BLURL001"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_image(rules: list[tuple[str, str, str]]) -> bytes:
    """The digest array of ``(host, path, verdict)`` rules.  Of equal rules with different verdicts, block stands."""
    kept: dict[tuple[bytes, bytes], bool] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        key = (host.lower().encode(), path.encode())
        kept[key] = kept.get(key, False) or verdict == "block"
    entries = sorted((xxhash.xxh64_intdigest(h + b"\0" + p), h, p, b) for (h, p), b in kept.items())
    strings = [h + b"\0" + p for _, h, p, _ in entries]
    lengths = sorted({len(p) for _, _, p, _ in entries})
    offsets = np.cumsum([0, *map(len, strings)]).astype("<i8")
    head = np.array([len(entries), len(lengths)], "<i8").tobytes()
    return b"".join([_MAGIC, head, np.array(lengths, "<i8").tobytes(), np.array([e[0] for e in entries], "<u8").tobytes(), offsets.tobytes(),
                     np.array([e[3] for e in entries], "u1").tobytes(), *strings])


class DigestArray:
    """A mapped image; ``find(keys)`` gives for each key the index of its rule or -1."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:8]) != _MAGIC:
            raise ValueError(f"{path} is no rule image")
        n, m = raw[8:24].view("<i8").tolist()
        at = 24 + 8 * m
        self.path_lengths = raw[24:at].view("<i8").tolist()
        self.digests = raw[at:at + 8 * n].view("<u8")
        self.offsets = raw[at + 8 * n:at + 16 * n + 8].view("<i8")
        self.blocks = raw[at + 16 * n + 8:at + 17 * n + 8]
        self.strings = raw[at + 17 * n + 8:]

    def key(self, i: int) -> bytes:
        return self.strings[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def find(self, keys: list[bytes]) -> np.ndarray:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        lo = np.searchsorted(self.digests, digests)
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests):
            return out
        for i in np.flatnonzero(self.digests[np.minimum(lo, len(self.digests) - 1)] == digests):
            j = int(lo[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:  # equal digests stand side by side
                if self.key(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


class _Mapped:
    """Opens an image once per worker process, from a private copy that is unlinked at once."""

    made: dict[int, DigestArray] = {}

    @classmethod
    def of(cls, image: bytes) -> DigestArray:
        digest = xxhash.xxh3_128_intdigest(image)
        if digest not in cls.made:
            with tempfile.NamedTemporaryFile(suffix=".urls", delete=False) as f:
                f.write(image)
            cls.made[digest] = DigestArray(f.name)
            os.unlink(f.name)  # the mapping stays valid
        return cls.made[digest]


def _candidates(host: bytes, path: bytes, lengths: list[int]) -> list[bytes]:
    starts, at = [0], host.find(b".")
    while at >= 0:
        starts.append(at + 1)
        at = host.find(b".", at + 1)
    return [host[s:] + b"\0" + path[:n] for s in starts for n in lengths if n <= len(path)]


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", max_image_bytes: int = 64 << 20) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the deciding rule's string, else null) and ``verdict`` to every row of ``urls``.

    The longest fitting rule decides (by host and path together; of equally long ones the longer host); without one the
    verdict is ``default``, what a list lookup says of a key it doesn't hold.  Null and malformed URLs have no host, fit no rule and
    get ``default``.  Existing columns of these names are replaced, other columns are kept, repeated rows are judged alike, long URLs whole, an empty table stays empty.

    A list whose image is larger than ``max_image_bytes`` is cut into several arrays, each searched in turn over the same map-only pass.
    """
    spark = urls.sparkSession
    images, part, size = [], [], 0
    for r in sorted(set(rules)):
        part.append(r)
        size += len(r[0].encode()) + len(r[1].encode()) + 18
        if size > max_image_bytes:
            images.append(build_image(part))
            part, size = [], 0
    images.append(build_image(part))
    shared = [spark.sparkContext.broadcast(i) for i in images]
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    whole = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).select(*kept, "host", "path")
    schema = T.StructType([*whole.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_Mapped.of(b.value) for b in shared]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            hosts = pc.dictionary_encode(table.column("host").combine_chunks())
            paths = [p.encode() for p in table.column("path").to_pylist()]
            names = [h.encode() for h in hosts.dictionary.to_pylist()]
            best: list[tuple[int, int, bytes, bool] | None] = [None] * len(paths)
            for array in arrays:
                keys, owners = [], []
                for i, (h, p) in enumerate(zip(hosts.indices.to_pylist(), paths, strict=True)):
                    found = _candidates(names[h], p, array.path_lengths)
                    keys += found
                    owners += [i] * len(found)
                hits = array.find(keys)
                for k in np.flatnonzero(hits >= 0):
                    h, _, p = keys[k].partition(b"\0")
                    rank = (len(h) + len(p), len(h), h + p, bool(array.blocks[hits[k]]))
                    if best[owners[k]] is None or rank > best[owners[k]]:
                        best[owners[k]] = rank
            said = pa.array([b and b[2].decode() for b in best], pa.string())
            verdict = pa.array([default if b is None else "block" if b[3] else "allow" for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, said, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return whole.mapInArrow(run, schema)
