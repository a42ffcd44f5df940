"""Packed matrices of token ids by best-fit decreasing.

Each task tokenises its own documents, cuts those over the capacity and packs a block of pieces at a time, so nothing
is shuffled. A segment tree over remaining capacities finds the fullest sequence that still holds a piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.tokenise import cuts, default_path, encoder

CAPACITY = 1024
#: ids that a task gathers before it packs them
BLOCK_IDS = 4_000_000
#: rows of a batch of sequences
OUT_ROWS = 512
#: the id that fills up a row
PAD = 0

SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, starts array<long>, "
    "ids binary, cu_seqlens array<int>, position_resets array<int>, ids_crc32 long"
)
_ARROW = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ("starts", pa.list_(pa.int64())), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids_crc32", pa.int64()),
])


class CapacityTree:
    """A segment tree over remaining capacities 0 to capacity that counts the open sequences with each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the smallest room of at least ``least``; None if there is none."""
        count, at = self.count, least + self.size
        while not count[at]:  # up to a right neighbour that isn't empty
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:  # down to its leftmost
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of places in ``lengths``; longer pieces first, equal ones in order."""
    tree, out = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = tree.take(n)
        room, at = got if got else (capacity, len(out))
        if not got:
            out.append([])
        out[at].append(i)
        if room > n:
            tree.add(room - n, at)
    return out


def _packer(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).document
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, total
            bins = best_fit_decreasing(np.array([len(p[3]) for p in held], np.int64), capacity)
            for at in range(0, len(bins), OUT_ROWS):
                rows = []
                for items in bins[at : at + OUT_ROWS]:
                    ids = np.concatenate([held[i][3] for i in items])
                    ends = np.cumsum([0, *(len(held[i][3]) for i in items)]).tolist()
                    row = np.full(capacity, PAD, "<u4")
                    row[: len(ids)] = ids
                    rows.append((number, len(ids), len(items), [held[i][0] for i in items], [held[i][1] for i in items], [held[i][2] for i in items], row.tobytes(), ends, ends[:-1], zlib.crc32(ids.tobytes())))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held.clear()
            total = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                held += [(doc_id, k, a, ids[a : a + n]) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def packed_matrix(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each sequence: ``ids`` holds ``capacity`` unsigned little-endian 32-bit ids, filled up with PAD.

    cu_seqlens has the cumulative lengths of its segments from 0, position_resets the places at which position ids
    start again at 0, and doc_ids, pieces and starts say which ids of which document a segment is. Documents longer
    than the capacity are cut, nothing is dropped. Null and empty texts are the end id alone; null ids and repeated
    rows are packed like others; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packer(path or default_path(), capacity), SCHEMA)


def write_packed(docs: DataFrame, target: str, path: str | None = None, capacity: int = CAPACITY) -> None:
    """Writes the matrix as Parquet; a lost task is run again and gives the same rows."""
    packed_matrix(docs, path, capacity).write.parquet(target)


def position_ids(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Position ids of a row: 0, 1, ... in each segment, 0 in what fills it up."""
    out = np.zeros(capacity, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed_matrix`` of all documents."""
    return packed_matrix(table(spark, sf_dir, "documents"))
