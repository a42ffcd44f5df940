"""Ledgers: event chains, closures, chronologies, matching rules and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.shared import cut


def chain_heads(events: DataFrame, key: str, node: str, previous: str) -> DataFrame:
    """key, head, n_heads, n_genesis, forks: the event that no other follows; a sound chain has 1, 1 and 0."""
    follows = events.where(F.col(previous).isNotNull()).groupBy(key, previous).agg(F.count(F.lit(1)).alias("n"))
    f = follows.select(F.col(key).alias("_k"), F.col(previous).alias("_p"), "n")
    j = events.join(f, (F.col(key) == F.col("_k")) & (F.col(node) == F.col("_p")), "left")
    return j.groupBy(key).agg(F.max(F.when(F.col("n").isNull(), F.col(node))).alias("head"), F.count_if(F.col("n").isNull()).alias("n_heads"), F.count_if(F.col(previous).isNull()).alias("n_genesis"), F.count_if(F.col("n") > 1).alias("forks"))


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src, dst: all pairs that a path connects, by squaring until nothing new comes; rounds are log2 of the longest path."""
    now = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    count = now.count()
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        now = cut(now.union(step).distinct())
        again = now.count()
        if again == count:
            return now
        count = again


def regressions(blocks: DataFrame, keys: list[str], order: str, anchor: str) -> DataFrame:
    """Rows whose anchor lies before that of the row before."""
    before = F.lag(anchor).over(W.partitionBy(*keys).orderBy(order))
    return blocks.withColumn("before", before).where(F.col(anchor) < F.col("before"))


def glob_pattern(glob: Column) -> Column:
    """Regular expression of a glob: ** crosses folders, * doesn't, ? is one character."""
    escaped = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    marked = F.replace(F.replace(escaped, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(F.replace(marked, F.lit("\x01"), F.lit(".*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))


def matches(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """path, family of each rule (family, glob) that a path matches. The rules are a small table."""
    return paths.join(rules.withColumn("re", glob_pattern(F.col("glob"))), F.regexp_like(F.col(path), F.col("re"))).select(path, "family").distinct()


def families(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """path, n, family: how many rules (family, glob) match a path and the first of them; paths without one have 0."""
    hit = paths.join(rules.withColumn("re", glob_pattern(F.col("glob"))), F.regexp_like(F.col(path), F.col("re")), "left")
    return hit.groupBy(path).agg(F.count("family").alias("n"), F.min("family").alias("family"))


def mentions(docs: DataFrame, passages: DataFrame, doc: str, text: str, item: str, passage: str, window: int = 5) -> DataFrame:
    """doc, item for each text that holds a whole passage.

    What stands between two spaces of a passage stands so in a text that holds it: the window of words behind the first
    one is looked up by hash, and what is found is compared in full. Passages of fewer words are looked for in each text.
    Null texts and passages have no row; an empty passage is in every text.
    """
    pieces = lambda c: F.split(c, " ")
    key = lambda x, at: F.xxhash64(F.array_join(F.slice(x, at, window), " "))
    p = passages.select(item, passage, pieces(F.col(passage)).alias("_p")).where(F.col(passage).isNotNull())
    long = p.where(F.size("_p") >= window + 2).withColumn("_k", key(F.col("_p"), F.lit(2)))
    x = docs.select(doc, text, pieces(F.col(text)).alias("_p"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p") - window + 1, F.lit(1))), lambda i: key(F.col("_p"), i)))
    found = x.select(doc, text, F.explode(at).alias("_k")).join(long, "_k").where(F.col(text).contains(F.col(passage)))
    short = docs.select(doc, text).join(p.where(F.size("_p") < window + 2), F.col(text).contains(F.col(passage)))
    return found.select(doc, item).union(short.select(doc, item))


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side of the rows that only one table has."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(True)), right.select(*keys).distinct().withColumn("r", F.lit(True))
    return a.join(b, keys, "full_outer").where("l IS NULL OR r IS NULL").select(*keys, F.when(F.col("l"), "left").otherwise("right").alias("side"))


def week_of_month(date: Column) -> Column:
    """yyyy-MM-Wn, weeks from the first of the month."""
    return F.concat(F.date_format(date, "yyyy-MM"), F.lit("-W"), (F.floor((F.dayofmonth(date) - 1) / 7) + 1).cast("string"))


def semantic_key(name: Column) -> Column:
    """Array by which dotted numbers sort as numbers."""
    return F.transform(F.split(name, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(1 << 30)))


def aged(occurrences: DataFrame, key: str, at: str, as_of: Column, least: int = 3, days: int = 60) -> DataFrame:
    """key, n, last: seen at least so often, and for so many days no more."""
    return occurrences.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).where((F.col("n") >= least) & (F.datediff(as_of, F.col("last")) >= days))
