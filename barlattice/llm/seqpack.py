"""Cost-balanced packing of tokenised documents into training sequences.

A sequence costs ``linear * tokens + quadratic * sum(piece length ** 2)``: attention is masked to the piece, so it grows with
the square of each piece.  Documents are taken in descending length and each goes to the cheapest sequence that still has room.
What is longer than a sequence is cut into full sequences first; what no open sequence can hold whole is cut to fill the
gaps, so that all sequences but the last ones of a group are full.

Packing runs inside the scan's own tasks, on groups of at most ``group_tokens`` tokens (plus one document), so nothing is
shuffled, memory is bounded and a task that is run again gives the same rows.  Each group leaves one open rest; it is written
as sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.text import chunks
from barlattice.llm.tokens import Encoder

_GROUPS = 1 << 20  # groups of one task
_SEQUENCES = 1 << 20  # sequences of one group


def place(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` for one group of document lengths; sequences are numbered from 0.

    Empty documents get no piece.  Ties in length keep the input order, ties in cost the smaller sequence.
    """
    pieces, tails, seq = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            pieces.append((d, start, size, seq, 0))
            seq += 1
        if n % size:
            tails.append((n % size, d, n - n % size))
    total = sum(t[0] for t in tails)
    whole, rest = divmod(total, size)
    room = {seq + k: size for k in range(whole)}
    at = seq + whole
    for bit in reversed(range(rest.bit_length())):  # the open rest, as powers of two
        if rest >> bit & 1:
            room[at] = 1 << bit
            at += 1
    full = dict(room)
    heap = [(0.0, s) for s in room]
    for n, d, start in sorted(tails, key=lambda t: (-t[0], t[1])):
        passed = []
        while heap and room[heap[0][1]] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            parts = [(heapq.heappop(heap), n)]
        else:  # no sequence holds it whole: fill the cheapest ones
            parts, left, passed = [], n, passed[::-1]
            while left:
                entry = passed.pop()
                take = min(left, room[entry[1]])
                parts.append((entry, take))
                left -= take
        for entry in passed:
            heapq.heappush(heap, entry)
        for (cost, s), take in parts:
            pieces.append((d, start, take, s, full[s] - room[s]))
            room[s] -= take
            start += take
            if room[s]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s))
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0,
         linear: float = 1.0, quadratic: float = 1.0 / 1024, group_tokens: int = 1 << 20, cache_entries: int = 300_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (the piece's token ids).

    Null text counts as empty and gives the end id alone.  Documents of equal id are packed separately, a null id stays null;
    other columns are not read.  ``cache_entries`` bounds the pieces a worker keeps encoded (four times as many at most).  An empty table gives no rows.  A text of any length is cut over as many sequences as it needs.
    """
    if size < 1 or group_tokens < size:
        raise ValueError("size must be positive and group_tokens at least size")
    end = end_id.to_bytes(4, "little")

    def rows(k: int, group: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        base = (TaskContext.get().partitionId() * _GROUPS + k) * _SEQUENCES
        out = place([len(ids) // 4 for _, ids in group], size, linear, quadratic)
        cuts = [group[d][1][4 * start:4 * (start + n)] for d, start, n, _, _ in out]
        cols = [
            pa.array([group[p[0]][0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64()), pa.array([p[2] for p in out], pa.int64()),
            pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([len(group[p[0]][1]) // 4 for p in out], pa.int64()),
            pa.array([base + p[3] for p in out], pa.int64()), pa.array([p[4] for p in out], pa.int64()), pa.array(cuts, pa.binary()),
        ]
        return pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, cache_entries)
        group, held, k = [], 0, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, part in chunks(batch.column(1)):
                for i, ids in enumerate(encoder.encode_bytes(part.to_pylist())):
                    group.append((keys[lo + i], ids + end))
                    held += len(ids) // 4 + 1
                    if held >= group_tokens:
                        yield rows(k, group)
                        group, held, k = [], 0, k + 1
        if group:
            yield rows(k, group)

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
