"""Runs, transitions, corrections, caches and keys: small relational checks on any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, run (from 1), first, n, value: maximal runs of rows with one value, in order."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.first(value).alias("value"))


def items(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """rows with ``item``: how many starts there are up to a row; 0 before the first."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("item", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def bad_transitions(events: DataFrame, keys: list[str], order: str, state: str, allowed: DataFrame) -> DataFrame:
    """Events (with ``from_state``) that no row of allowed (from_state, to_state) lets follow the one before."""
    before = F.coalesce(F.lag(state).over(W.partitionBy(*keys).orderBy(order)), F.lit("none"))
    e = events.withColumn("from_state", before)
    ok = allowed.select(F.col("from_state").alias("_f"), F.col("to_state").alias("_t"))
    return e.join(ok, (F.col("from_state") == F.col("_f")) & (F.col(state) == F.col("_t")), "left_anti")


def misuse(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Rows of an open/close ledger that break it: an open of what is open, a close of what isn't."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(kind).over(w)
    bad = ((F.col(kind) == "open") & F.coalesce(last == "open", F.lit(False))) | ((F.col(kind) == "close") & F.coalesce(last != "open", F.lit(True)))
    return events.where(F.col(kind).isin("open", "close")).withColumn("_bad", bad).where("_bad").drop("_bad")


def corrected(blocks: DataFrame, corrections: DataFrame, digest: str, anchor: str) -> DataFrame:
    """blocks with ``effective``: the anchor that the only correction (target, moved) of a block gives, if it moves it forward."""
    one = corrections.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.max("moved").alias("_m")).where("_n = 1")
    out = blocks.join(one, F.col(digest) == F.col("target"), "left")
    return out.withColumn("effective", F.when(F.col("_m") > F.col(anchor), F.col("_m")).otherwise(F.col(anchor))).drop("target", "_n", "_m")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def json_object(answer: Column) -> Column:
    """The text from the first { to the last }, if it is an object; null otherwise."""
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def exact_nanoseconds(seconds: Column) -> Column:
    """Seconds as whole nanoseconds; null if they aren't whole or don't fit a long."""
    exact = seconds.try_cast("decimal(26,12)")
    whole, part = F.floor(exact), exact - F.floor(exact)
    ns = part * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when((F.floor(ns) == ns) & (whole >= 0) & (whole < 9_223_372_036), whole.cast("long") * 1_000_000_000 + F.floor(ns).cast("long"))


def reports(runs_: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """runs with ``status``: reported if there is a report of the key, else incomplete."""
    f = found.select(F.col(key).alias("_k")).distinct()
    return runs_.join(f, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(F.col("_k").isNull(), "incomplete").otherwise("reported")).drop("_k")
