"""Best-fit packing through a configuration linear program.

Only the histogram of piece lengths reaches the driver: at most one row for each length up to the capacity. There the
program over packing patterns is solved by multiplicative weights, whose pricing is a knapsack, and the averaged
solution is rounded; what rounding leaves is solved again, and the last pieces are filled in exactly. Pieces then find
their places from their rank among pieces of their length, which two narrow passes over the pieces give.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import settle, table, tidy
from corpusloom.llm.tokenise import cuts, default_path, encoder

CAPACITY = 1024
#: pricing rounds of one solution, how often it covers every piece before it is averaged, and solutions (of what rounding leaves) at most
ROUNDS, LAYERS, PHASES = 4_000, 3.0, 3
#: share of the scarcest length's pieces that a step covers, and how fast weights fall with cover
STEP, RATE = 0.34, 2.0
#: weights start at this power of a length's share of the capacity: long pieces, which have fewer partners, go first
POWER = 1.05
#: patterns of one pricing, all within this share of the best value
BATCH, NEAR = 48, 0.03


class Knapsack:
    """The patterns of largest value for every capacity up to one: copies of lengths 1.. (value[i] for length i)."""

    def __init__(self, value: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items = np.flatnonzero(value > 0)
        self.items = self.items[self.items <= capacity]
        worth, items = value[self.items], self.items
        self.best, self.pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(items, np.arange(capacity + 1), side="right")
        for c in range(1, capacity + 1):
            self.best[c] = self.best[c - 1]
            k = upto[c]
            if k:
                total = self.best[c - items[:k]] + worth[:k]
                j = int(total.argmax())
                if total[j] > self.best[c]:
                    self.best[c], self.pick[c] = total[j], j
        # the largest capacity up to c at which an item comes in
        self.down = np.maximum.accumulate(np.where(self.pick >= 0, np.arange(capacity + 1), 0)).tolist()
        self.pick = self.pick.tolist()

    def pattern(self, room: int) -> Counter:
        out, c = Counter(), self.down[room]
        while c > 0:
            i = int(self.items[self.pick[c]])
            out[i] += 1
            c = self.down[c - i]
        return out


def knapsack(value: np.ndarray, capacity: int) -> Counter:
    """The pattern of largest value within the capacity."""
    return Knapsack(value, capacity).pattern(capacity)


def solve(n: np.ndarray, capacity: int) -> tuple[list[tuple[Counter, float]], float]:
    """A fractional solution, patterns and how often to use each so that n[i] pieces of length i are covered, and a lower bound of all solutions.

    Multiplicative weights on the covering program: a length's weight starts at about its share of a sequence and falls
    with its cover. The knapsack prices patterns by the weights; those of near the largest value get a small step each.
    The steps are averaged over LAYERS covers. Weights over the largest value are a solution of the dual program, so
    every round proves a bound. If rounds end first, lengths that aren't covered yet are covered in part.
    """
    length = np.arange(len(n))
    present = np.flatnonzero(n)
    cover = np.zeros(len(n))
    used: dict[tuple, float] = {}
    bound = 0.0
    for _ in range(ROUNDS):
        least = cover[present].min(initial=LAYERS)
        if least >= LAYERS:
            break
        weight = np.where(n > 0, (length / capacity) ** POWER * np.exp(-RATE * (cover - least)), 0.0)
        priced = Knapsack(weight, capacity)
        top = priced.best[capacity]
        bound = max(bound, float(n @ weight) / top)
        value = weight[present] + priced.best[capacity - present]
        near = present[value >= (1 - NEAR) * top]
        stale = cover + 0.5 * STEP
        for i in near[np.argsort(cover[near], kind="stable")][:BATCH].tolist():
            pattern = priced.pattern(capacity - i)
            pattern[i] += 1
            if any(cover[j] > stale[j] for j in pattern):  # its price has changed
                continue
            for j, k in list(pattern.items()):
                pattern[j] = min(k, int(n[j]))
            times = STEP * min(n[j] / k for j, k in pattern.items())
            for j, k in pattern.items():
                cover[j] += times * k / n[j]
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + times
    layers = max(1.0, float(cover[present].min(initial=LAYERS)))
    return [(Counter(dict(p)), x / layers) for p, x in used.items()], bound


def fill(n: np.ndarray, capacity: int) -> list[Counter]:
    """Sequences for the pieces that rounding leaves: the longest piece, then the fullest set of others beside it."""
    n, out = n.copy(), []
    while n.any():
        first = int(np.flatnonzero(n)[-1])
        n[first] -= 1
        room = capacity - first
        sums, steps = 1, []  # bit s: s ids can be made
        for i in np.flatnonzero(n[: room + 1])[::-1].tolist():
            for _ in range(min(int(n[i]), room // i)):
                grown = sums | (sums << i) & ((1 << room + 1) - 1)
                if grown == sums:
                    break
                steps.append((i, sums))
                sums = grown
            if sums >> room & 1:
                break
        bin_, at = Counter({first: 1}), sums.bit_length() - 1
        for i, before in reversed(steps):
            if not before >> at & 1:
                bin_[i] += 1
                n[i] -= 1
                at -= i
        out.append(bin_)
    return out


def rounded(n: np.ndarray, solution: list[tuple[Counter, float]], bound: float, capacity: int) -> Counter:
    """Whole numbers of the solution's patterns; n is left without their pieces.

    Rounded down, then one more of those that still fit, by what was cut off. Patterns less full than sequences are on
    average at the bound, where rounding would only add waste, are left out.
    """
    out: Counter = Counter()
    size = float(n @ np.arange(len(n)))
    need = size / max(bound, size / capacity)
    solution = [s for s in solution if sum(i * k for i, k in s[0].items()) >= need - 1e-6]

    def take(pattern: Counter, times: int) -> None:
        times = min(times, *(int(n[i]) // k for i, k in pattern.items()))
        if times > 0:
            out[tuple(sorted(pattern.items()))] += times
            for i, k in pattern.items():
                n[i] -= times * k

    for pattern, x in sorted(solution, key=lambda s: -s[1]):
        take(pattern, int(x + 1e-9))
    for pattern, _ in sorted(solution, key=lambda s: int(s[1] + 1e-9) - s[1]):
        take(pattern, 1)
    return out


def configurations(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], int]:
    """Patterns and whole numbers of sequences that hold exactly the pieces of the histogram, and sequences that any packing needs."""
    n = np.zeros(capacity + 1, np.int64)
    for i, k in histogram.items():
        n[i] = k
    out: Counter = Counter()
    whole = int(n[capacity])
    if whole:
        out[((capacity, 1),)] = whole
        n[capacity] = 0
    bound = -(-int(n @ np.arange(capacity + 1)) // capacity)
    for phase in range(PHASES):
        pieces = n.sum()
        if not pieces:
            break
        solution, least = solve(n, capacity)
        if phase == 0:
            bound = max(bound, int(np.ceil(least - 1e-6)))
        out += rounded(n, solution, least, capacity)
        if n.sum() > 0.9 * pieces:
            break
    for pattern in fill(n, capacity):
        out[tuple(sorted(pattern.items()))] += 1
    return [(Counter(dict(p)), k) for p, k in out.items()], whole + bound


@dataclass
class Plan:
    """For each length the slots in order: first rank, copies in a sequence, first sequence, offset there."""

    slots: dict[int, np.ndarray]
    n_sequences: int

    @classmethod
    def of(cls, patterns: list[tuple[Counter, int]]) -> Plan:
        slots: dict[int, list] = {}
        rank: Counter = Counter()
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for length, copies in sorted(pattern.items(), reverse=True):
                slots.setdefault(length, []).append((rank[length], copies, sequence, offset))
                rank[length] += copies * times
                offset += copies * length
            sequence += times
        return cls({k: np.array(v, np.int64) for k, v in slots.items()}, sequence)

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces of one length."""
        s = self.slots[length]
        at = np.searchsorted(s[:, 0], ranks, side="right") - 1
        first, copies, sequence, offset = s[at].T
        inside = ranks - first
        return sequence + inside // copies, offset + inside % copies * length


def _cutter(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).document
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                for k, (a, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, k, a, n, zlib.crc32(ids[a : a + n].tobytes()), chunk, int(seen[n])))
                    seen[n] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with its chunk (a task) and rank in it among its length.

    Settled, because a rank holds only with the chunks it was given in.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"
    return settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_cutter(path, capacity)), schema))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id, offset and least_sequences, the number that any packing of them needs by the program's bound."""
    spark = cut.sparkSession
    counts = settle(cut.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    patterns, least = configurations(histogram, capacity)
    plan = spark.sparkContext.broadcast(Plan.of(patterns))
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each chunk and length grows with the table: never broadcast
    ranked = cut.join(bases.hint("merge"), ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    sequence[part], offset[part] = plan.value.place(int(length[part[0]]), rank[part])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("least_sequences", F.lit(least).cast("long"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and least_sequences of each piece of each row of documents.

    A document is its ids and the end id, a null or empty text the end id alone. Documents over the capacity are cut
    into pieces of it, the first of which may be shorter. Sequences are numbered from 0 and filled from offset 0
    without gaps. Null ids and repeated rows are packed like others; an empty table gives no rows; other columns are
    ignored. least_sequences, one for all rows, is what no packing can be below.
    """
    return pack(pieces(docs, path or default_path(), capacity), capacity)


def op9_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packed`` of all documents."""
    return packed(table(spark, sf_dir, "documents"))
