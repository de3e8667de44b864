"""Token ids as fixed-width bit-packed files with random access.

A file holds the ids of consecutive documents.  Layout, little-endian throughout:

    magic "BLBITS01" | width | ids per block | ids | documents           4 x int64 after the magic
    document ids | first id of each document (one more than documents)   int64
    byte offset of each block (one more than blocks)                     int64, from the start of the payload
    payload: block after block, each id in ``width`` bits, blocks padded to whole bytes

``width`` is the least that holds the largest id of the vocabulary.  Any block can be unpacked alone, by numpy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlattice.llm.text import chunks
from barlattice.llm.tokens import Encoder
from barlattice.session import shared_dir

MAGIC = b"BLBITS01"


def width_of(vocabulary: int) -> int:
    """Least number of bits for ids below ``vocabulary``."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, least significant bit first."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | np.ndarray, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width in (8, 16, 32):
        return raw[:n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def file_image(doc_ids: list[int], ids: list[bytes], width: int, block: int) -> bytes:
    """One file of documents; ``ids`` holds each document's ids as unsigned 32-bit bytes."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<i8")
    blocks = [pack_bits(flat[lo:lo + block], width) for lo in range(0, len(flat), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<i8")
    head = np.array([width, block, len(flat), len(doc_ids)], "<i8").tobytes()
    return b"".join([MAGIC, head, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class BitFile:
    """Random access to a file through any Arrow file system; only the blocks asked for are read."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.f = fs.open_input_file(path)
        if self.f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.width, self.block, self.n_ids, self.n_docs = np.frombuffer(self.f.read_at(32, 8), "<i8").tolist()
        n_blocks = -(-self.n_ids // self.block)
        rest = np.frombuffer(self.f.read_at(8 * (2 * self.n_docs + n_blocks + 2), 40), "<i8")
        self.doc_ids, self.starts, self.offsets = np.split(rest, [self.n_docs, 2 * self.n_docs + 1])
        self.payload = 40 + 8 * len(rest)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the file."""
        if hi <= lo:
            return np.empty(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        raw = np.frombuffer(self.f.read_at(int(self.offsets[b] - self.offsets[a]), self.payload + int(self.offsets[a])), np.uint8)
        parts = [unpack_bits(raw[self.offsets[k] - self.offsets[a]:self.offsets[k + 1] - self.offsets[a]], min(self.block, self.n_ids - k * self.block), self.width) for k in range(a, b)]
        return np.concatenate(parts)[lo - a * self.block:hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's ``k``-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.f.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
                 block: int = 8192, file_ids: int = 1 << 20) -> DataFrame:
    """Writes bit-packed files under ``folder`` (a URI all executors reach) in ascending doc_id order; returns their manifest.

    Manifest: part, number (a file's place is the order of the two), uri, n_docs, n_ids, start (ids in all earlier files).
    It is fixed by a checkpoint and names exactly one attempt's files, so tasks that ran twice leave files nobody reads.
    Null text counts as empty; a null doc_id can't be stored and its row stands under the smallest id, -2**63, before all others;
    repeated ids stand side by side, their order given by the text.  Long texts are encoded whole, other columns are not read.  An empty table
    gives an empty manifest.
    """
    width, end = width_of(vocabulary), end_id.to_bytes(4, "little")
    shared_dir(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        fs, top = pafs.FileSystem.from_uri(folder)
        keys, held, total, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{number:05d}-{uuid.uuid4().hex}.bits"
            with fs.open_output_stream(f"{top}/{name}") as f:
                f.write(file_image(keys, held, width, block))
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "uri": [f"{folder}/{name}"], "n_docs": [len(keys)], "n_ids": [total]})

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            ids = batch.column(0).to_pylist()
            for lo, piece in chunks(batch.column(1)):
                for i, encoded in enumerate(encoder.encode_bytes(piece.to_pylist())):
                    keys.append(least if ids[lo + i] is None else ids[lo + i])
                    held.append(encoded + end)
                    total += len(encoded) // 4 + 1
                    if total >= file_ids:
                        yield flush()
                        keys, held, total, number = [], [], 0, number + 1
        if keys:
            yield flush()

    fs, top = pafs.FileSystem.from_uri(folder)
    fs.create_dir(top, recursive=True)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = read.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id().cast("long"))
    files = ordered.mapInArrow(run, "part long, number long, uri string, n_docs long, n_ids long").checkpoint()
    # one row per file of about a million ids: a running sum over parts first, then inside a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    of_parts = files.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    started = F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return files.join(of_parts, "part").select("part", "number", "uri", "n_docs", "n_ids", started.alias("start"))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, unsigned 32 bit).

    Repeated ids come back as many times as they were written, a document of any length whole; an empty manifest gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = BitFile(row["uri"])
                for lo in range(0, f.n_docs, 512):
                    ids = [f.document(k).astype("<u4").tobytes() for k in range(lo, min(lo + 512, f.n_docs))]
                    cols = [pa.array(f.doc_ids[lo:lo + 512], pa.int64()), pa.array(row["start"] + f.starts[lo:lo + len(ids)], pa.int64()),
                            pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    yield pa.record_batch(cols + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                f.close()

    spread = manifest.select("uri", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files beside the checkpoints."""
    top = shared_dir(spark)
    return f"{top if '://' in top or top.startswith('file:') else 'file://' + top}/tokens-{uuid.uuid4().hex}"
