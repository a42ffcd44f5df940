"""Interval analytics: unions, peaks, exclusive attribution and hierarchies of spans.

Spans are rows with a key (a trace), a start and an end. Ends may equal starts; touching spans merge; ties always break
by an id. All work is partitioned by the key, so the number of tasks is that of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.shared import cut


def islands(spans: DataFrame, keys: list[str], start: str = "st", end: str = "en", tie: str = "id") -> DataFrame:
    """keys, island, st, en: the merged spans. A span opens an island if it starts after all before it have ended."""
    order = W.partitionBy(*keys).orderBy(start, end, tie)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("_opens", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("st"), F.max(end).alias("en"))


def union_measure(spans: DataFrame, keys: list[str], name: str = "covered", **at: str) -> DataFrame:
    """keys, name: the length of the union of the spans of each key."""
    return islands(spans, keys, **at).groupBy(*keys).agg(F.sum(F.col("en") - F.col("st")).cast("long").alias(name))


def peak_concurrency(spans: DataFrame, keys: list[str], start: str = "st", end: str = "en") -> DataFrame:
    """keys, peak: the most spans at once; at equal times spans end before others start."""
    edges = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.t", "e.d")
    edges = edges.groupBy(*keys, "t", "d").agg(F.sum("d").alias("s"))  # equal edges at once: ends first, then starts
    running = F.sum("s").over(W.partitionBy(*keys).orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0))
    return edges.withColumn("_r", running).groupBy(*keys).agg(F.greatest(F.max("_r"), F.lit(0)).cast("long").alias("peak"))


class _Largest:
    """A value that sorts before all smaller ones; null sorts last."""

    __slots__ = ("value",)

    def __init__(self, value: object):
        self.value = value

    def __eq__(self, other: _Largest) -> bool:
        return self.value == other.value

    def __lt__(self, other: _Largest) -> bool:
        return self.value is not None and (other.value is None or self.value > other.value)


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cell, a, z, order..., category) sorted by the first three to (key, category, exclusive): a heap holds the spans that are open.

    Each time goes to the first of the open spans in their order; a span leaves the heap when it is first and over.
    """
    key, cell, now, held, sums = None, None, 0, [], {}

    def pass_until(end: int | None) -> None:
        nonlocal now
        while held and (end is None or now < end):
            z, category = held[0][-1], held[0][-2].value
            if z <= now:
                heappop(held)
                continue
            until = z if end is None else min(z, end)
            sums[category] = sums.get(category, 0) + until - now
            now = until

    names, types = ["key", "category", "exclusive"], None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key] * len(sums), types[0]), pa.array(list(sums), types[1]), pa.array(list(sums.values()), pa.int64())], names)

    for batch in batches:
        types = batch.schema.field(0).type, batch.schema.field(7).type
        for k, c, a, z, *order, category in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != cell or k != key:
                pass_until(None)
                if k != key and sums:
                    yield out()
                    sums.clear()
                key, cell = k, c
            pass_until(a)
            now = a
            heappush(held, (*order, _Largest(category), z))
    pass_until(None)
    if sums:
        yield out()


def exclusive(spans: DataFrame, key: str, category: str, start: str = "st", end: str = "en", depth: str = "depth", tie: str = "id") -> DataFrame:
    """key, category, exclusive: every covered instant counts for one span, the deepest, then the shortest, then the largest id.

    Depths and ids are whole numbers. A trace is cut into cells of time, each swept in one pass over the spans that start
    or end there. Of those that last through a cell only the first in that order can win in it, so one travels.
    """
    s, e, length = F.col("_s"), F.col("_e"), F.col("_e") - F.col("_s")
    of = spans.select(F.col(key).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.col(depth).cast("long").alias("_d"), F.col(tie).cast("long").alias("_i"), F.col(category).alias("_c")).where("_k IS NOT NULL AND _e > _s")
    usual, longest = of.agg(F.percentile_approx(length, 0.9), F.max(length)).first()
    width = max(usual or 1, (longest or 1) // 64, 1)  # so a span touches 66 cells at most
    first, last = s - F.pmod(s, F.lit(width)), e - 1 - F.pmod(e - 1, F.lit(width))
    at = of.withColumn("_first", first).withColumn("_last", last)
    best = F.struct("_d", (-length).alias("_short"), "_i", "_c").alias("_w")
    piece = lambda cell, a, z: F.struct(cell.alias("cell"), a.alias("a"), z.alias("z"))
    several = F.col("_last") > F.col("_first")
    ends = F.array(piece(F.col("_first"), s, F.least(e, F.col("_first") + width)), F.when(several, piece(F.col("_last"), F.col("_last"), e)))
    parts = at.select("_k", F.explode(ends).alias("_p"), best).where("_p IS NOT NULL").select("_k", "_p.cell", "_p.a", "_p.z", "_w")
    through = at.where(F.col("_last") > F.col("_first") + width).select("_k", F.explode(F.sequence(F.col("_first") + width, F.col("_last") - width, F.lit(width))).alias("cell"), best)
    through = through.groupBy("_k", "cell").agg(F.max("_w").alias("_w")).select("_k", "cell", F.col("cell").alias("a"), (F.col("cell") + width).alias("z"), "_w")
    down = lambda c: F.coalesce(F.bitwise_not(F.col(c)), F.lit((1 << 63) - 1))  # noqa: E731  larger values first, null last
    rows = parts.union(through).select("_k", "cell", "a", "z", down("_w._d").alias("d"), (-F.col("_w._short")).alias("length"), down("_w._i").alias("i"), F.col("_w._c").alias("c"))
    types = dict(rows.dtypes)
    swept = rows.repartition("_k", "cell").sortWithinPartitions("_k", "cell", "a").mapInArrow(_winners, f"key {types['_k']}, category {types['c']}, exclusive long")
    return swept.groupBy(F.col("key").alias(key), F.col("category").alias(category)).agg(F.sum("exclusive").cast("long").alias("exclusive"))


def depths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root, depth (0 for roots) of a forest, by doubling the known part of every path; rounds are log2 of the depth.

    A parent that isn't a node counts as a root's null. Nodes on a cycle never reach a root and get null root and depth.
    """
    base = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    known = base.select(F.col("n").alias("q"))
    now = cut(base.join(known, F.col("p") == F.col("q"), "left").select("n", F.col("q").alias("up"), F.when(F.col("q").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"), F.coalesce("q", "n").alias("root")))
    rounds = max(1, base.count()).bit_length() + 1
    for _ in range(rounds):
        if not now.where("up IS NOT NULL").limit(1).count():
            break
        above = now.select(F.col("n").alias("m"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        now = cut(now.join(above, F.col("up") == F.col("m"), "left").select("n", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root")))
    done = F.col("up").isNull()
    return now.select(F.col("n").alias(node), F.when(done, F.col("root")).alias("root"), F.when(done, F.col("depth")).alias("depth"))


def slowest(spans: DataFrame, keys: list[str], k: int, length: Column, tie: str = "id") -> DataFrame:
    """The k longest spans of each key with their rank; ties by the smaller id."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(length.desc(), F.col(tie)))
    return spans.withColumn("rank", rank).where(F.col("rank") <= k)


def paired(events: DataFrame, keys: list[str], kind: str = "event", at: str = "at") -> DataFrame:
    """keys, opened, closed: open and close events of a key side by side; closed is null while it is open."""
    when = lambda k: F.min(F.when(F.col(kind) == k, F.col(at)))
    return events.groupBy(*keys).agg(when("open").alias("opened"), when("close").alias("closed")).where("opened IS NOT NULL")


def batch_metrics(members: DataFrame, key: str) -> DataFrame:
    """Work and overlap of each batch from member spans (key, member, st, en, ok boolean, attempt, committed boolean)."""
    dur = F.col("en") - F.col("st")
    by_member = members.groupBy(key, "member").agg(F.bool_or("ok").alias("any_ok"), F.count(F.lit(1)).alias("n"), F.max("attempt").alias("most"), F.sum(dur).alias("work"), F.bool_or("committed").alias("done"), F.min("st").alias("st"), F.max("en").alias("en"))
    sums = by_member.groupBy(key).agg(
        F.count(F.lit(1)).alias("launched"), F.count_if("done").alias("committed"), F.count_if(~F.col("any_ok")).alias("failed"), F.count_if((F.col("n") > 1) | (F.col("most") > 1)).alias("retried"),
        F.sum("work").cast("long").alias("summed_work"), F.sum(F.when(F.col("done"), F.col("work")).otherwise(0)).cast("long").alias("committed_work"), (F.max("en") - F.min("st")).cast("long").alias("window"),
    )
    spans = members.withColumn("id", F.col("member"))
    out = sums.join(union_measure(spans, [key], "active"), key).join(peak_concurrency(members, [key]), key)
    return out.withColumn("overlap", F.col("summed_work") - F.col("active")).withColumn("wall_per_committed", F.when(F.col("committed") > 0, F.floor(F.col("window") / F.col("committed")))).withColumn(
        "reason", F.when(F.col("committed") == 0, F.lit("no committed members"))
    )
