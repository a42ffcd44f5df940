"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import settle
from corpusloom.llm.shingles import Hashes, shingle_set

#: labelled documents that a classifier learns from, the ones with the smallest hashes of their ids
SAMPLE_ROWS = 20_000
#: multipliers of the orders in which a text's least shingle is taken; two texts share one as often as their sets are alike
ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y int, text) of at most ``rows`` labelled documents for which ``learn`` (over doc_id) is true.

    Ids or labels that are null are left out; of several labels of a document the largest counts, of several rows of
    a document one. The ids are chosen from the labels alone, so the broadcast side never has more than ``rows`` rows.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    chosen = settle(chosen.coalesce(1))
    return settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "y", "text"))


def without_copies(sample: DataFrame) -> DataFrame:
    """The rows of a ``labelled_sample`` but near copies of others, which would make a chance count as often as they are.

    Of the texts that share a least shingle in one of ORDERS the smallest id stays. Texts without words all stay. Three
    numbers for each row of the sample reach the driver, and the ids that go are sent back.
    """

    @F.arrow_udf("array<long>")
    def least(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()
        for batch in batches:
            sets = (shingle_set(t.as_py(), hashes) for t in batch)
            yield pa.array([(s[:, None] * ORDERS).min(0).view(np.int64).tolist() if len(s) else None for s in sets], pa.list_(pa.int64()))

    rows = sample.select("doc_id", least(F.col("text")).alias("m")).toArrow().sort_by("doc_id")
    seen: list[set] = [set() for _ in ORDERS]
    copies = set()
    for doc_id, m in zip(rows["doc_id"].to_pylist(), rows["m"].to_pylist(), strict=True):
        if m and any(x in s for x, s in zip(m, seen, strict=True)):
            copies.add(doc_id)
        for x, s in zip(m or (), seen, strict=False):
            s.add(x)

    @F.arrow_udf("boolean")
    def own(ids: pa.Array) -> pa.Array:
        return pa.array([i not in copies for i in ids.to_pylist()])

    return settle(sample.where(own(F.col("doc_id"))))
