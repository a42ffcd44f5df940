"""Connected components of a table of links: by alternating large-star and small-star steps, few links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, settle, tidy

#: links that one task takes at once: 16 MB
FEW = 1 << 20


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links of a partition, by labels that fall to the least of each link's ends."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        a, b = label[u], label[v]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v), u > v: neighbours move to the least neighbour of their node.

    A node's least neighbour is aggregated and joined back, so a hub with many links is split like any skewed join.
    """
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of links (u, v longs): the component's least node; least nodes included.

    Loops and repeated links do no harm; nulls must be left out before; no links give no rows. Up to ``few`` links meet in
    one task. Of more, each round of steps is settled in the shared folder and the files of the one before are deleted.
    """
    now = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    if before[0] <= few:
        return now.coalesce(1).mapInArrow(tidy(_least), "node long, component long")
    while True:
        after = settle(_star(_star(now, True), False))
        forget(now)
        now, again = after, print_of(after)
        if again == before:
            break
        before = again
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
