"""Places in an order over all rows, without a task that holds all of them, and folds along one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.shared import cut


def ranked(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place from 1 in the order; rows that it doesn't tell apart stand as they come.

    One range sort; tasks number their rows, and the counts of the tasks, a row each, are added up.
    """
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_task", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy(F.col("_task").alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_own", F.coalesce(F.sum("_n").over(W.orderBy("_own").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, F.col("_task") == F.col("_own")).withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_at", "_task", "_own", "_before")


def ranked_within(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """rows with their place from 1 among rows of the same keys; a key with most of the rows is spread over tasks."""
    whole = ranked(rows, [*keys, *order], name)
    least = whole.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(name).alias("_least"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return whole.join(least, on).withColumn(name, F.col(name) - F.col("_least") + 1).drop("_least", *(f"_{k}" for k in keys))


def linked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with previous_ and next_: the name of the row before and behind in the order."""
    x = cut(ranked(rows, order, "_place"))
    other = lambda by, as_: x.select((F.col("_place") + by).alias("_p"), F.col(name).alias(as_))
    return x.join(other(1, "previous_"), F.col("_place") == F.col("_p"), "left").drop("_p").join(other(-1, "next_"), F.col("_place") == F.col("_p"), "left").drop("_p", "_place")


def folded(rows: DataFrame, key: str, order: str, value: str, start: Callable, step: Callable, name: str, kind: str) -> DataFrame:
    """key, order, name: what step(state, value) gives besides the next state, for a key's rows in order; start() is the first state.

    For rules in which each row's answer depends on all before, so that a key is one task's work; rows pass through it as
    a stream, one state is held, and time grows with the rows. Null keys are one key; a null value is passed as None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, x = step(state, v)
                out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, {"int": pa.int32(), "boolean": pa.bool_()}[kind])], [key, order, name])

    types = dict(rows.dtypes)
    sorted_ = rows.select(key, order, value).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, `{name}` {kind}")
