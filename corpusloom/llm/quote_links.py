"""Quotation linking in conversations, with DataFrame operations only.

Lines that start with > are quotes, nested as deep as they have such marks. Runs of lines of one level are passages.
The hash of a normalised passage finds the earliest message of the conversation that says it itself, as its whole text,
as a paragraph or as a line; a passage that is found nowhere as a whole is looked up by its lines. A message answers the
latest message that it quotes at its lowest level, and messages of one thread stand together in the order of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, fresh, settle, table

#: a line's marks, one group; what follows one more space is what it says
MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def normalised(text: Column) -> Column:
    """Lower case, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t-\r]+", " "))


def passages(text: Column) -> Column:
    """array<struct<level int, text string>>: runs of lines of one level, in order; empty for null."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")
    ))
    # a run starts where the level isn't that of the line before
    marked = F.transform(lines, lambda x, i: F.struct(x.level.alias("level"), i.alias("at"), x.text.alias("text")))
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x.level))
    starts = F.transform(F.filter(F.zip_with(marked, before, lambda x, b: F.struct(x.at.alias("at"), x.level.alias("level"), b.alias("before"))), lambda x: x.at.isNotNull() & (x.level != x.before)), lambda x: x.at)
    runs = F.transform(F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(lines))).alias("b")), lambda r: F.struct(
        F.element_at(lines, r["a"] + 1).level.alias("level"), F.array_join(F.transform(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), lambda x: x.text), "\n").alias("text")
    ))
    return F.when(text.isNull(), F.array().cast("array<struct<level:int,text:string>>")).otherwise(runs)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, quotes array<struct<level, text>> and body, the text without quotes."""
    found = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", passages(F.col("text").cast("string")).alias("p"))
    own = F.array_join(F.transform(F.filter("p", lambda x: x.level == 0), lambda x: x.text), "\n")
    return found.select("conv_id", "turn", "role", F.filter("p", lambda x: x.level > 0).alias("quotes"), F.trim(F.regexp_replace(own, r"^[ \t-\r]+|[ \t-\r]+$", "")).alias("body"))


def _hashes(texts: Column) -> Column:
    """Distinct md5 of the texts that say something."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda x: x != ""), F.md5))


def links(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) of the messages of ``parsed`` that quote an earlier message of their conversation."""
    named = found.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = named.where(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("n", "q"))
    whole = quoting.select("conv_id", "turn", "n", F.col("q.level").alias("level"), F.lit(0).alias("part"), F.explode(_hashes(F.array("q.text"))).alias("h"))
    lines = quoting.select("conv_id", "turn", "n", F.col("q.level").alias("level"), F.lit(1).alias("part"), F.explode(_hashes(F.split("q.text", "\n"))).alias("h"))
    said = F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n"))
    index = named.select("conv_id", "turn", F.explode(_hashes(said)).alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    hits = whole.union(lines).join(index, ["conv_id", "h"]).where("origin < turn")
    # a passage found whole outranks its lines; a lower level outranks a higher; then the latest origin
    best = hits.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "part", (-F.col("origin")).alias("o"))).alias("b"))
    return best.select("conv_id", "turn", (-F.col("b.o")).alias("parent"))


def threads(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, thread, depth) of linked messages: the message that the thread starts with, and steps to it.

    Doubles the known part of every path in each round, so rounds are the logarithm of the longest.
    """
    now = settle(links(found).select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        step = now.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", "parent", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"))
        after = settle(step)
        forget(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``position``, the place from 0 in the order among rows of one key (null is one), and sorted by both.

    The place in the whole order comes from one range sort, as tasks number their rows and the tasks' counts add up;
    the key's first place is taken off. So a key with most of the rows is spread over tasks.
    """
    at, task, offset, first, own = (fresh(rows, x) for x in ("at", "task", "offset", "first", "own"))
    placed = settle(rows.orderBy(key, *order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(task, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    # a row for each task
    offsets = placed.groupBy(F.col(task).alias(own)).agg(F.count(F.lit(1)).alias(offset)).withColumn(offset, F.coalesce(F.sum(offset).over(W.orderBy(own).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(settle(offsets), F.col(task) == F.col(own)).withColumn(at, F.col(at) + F.col(offset)).drop(task, offset, own)
    starts = placed.groupBy(F.col(key).alias(own)).agg(F.min(at).alias(first))
    return placed.join(starts, F.col(key).eqNullSafe(F.col(own))).withColumn("position", F.col(at) - F.col(first)).drop(at, first, own).orderBy(key, "position")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, n_quotes, quote_depth, parent_turn, thread_turn, depth and body of each message.

    position, from 0, is a message's place in its conversation's reply order: threads by the message that they start
    with, a thread by turns, so that every message stands behind the one that it answers. Rows come in this order. A
    message that quotes nothing that was said before starts a thread. Null texts have empty bodies; messages without
    conv_id or turn are threads of their own, those without conv_id numbered together; repeated rows stay, each with
    the same links and a place of its own; an empty table gives no rows; other columns are ignored. A conversation of
    any size is spread over tasks, as the order is one over all rows.
    """
    found = parsed(messages)
    linked = threads(found).withColumnsRenamed({"conv_id": "c", "turn": "t", "depth": "d"})
    out = found.join(linked, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id", "turn", "role", F.size("quotes").alias("n_quotes"), F.coalesce(F.array_max(F.transform("quotes", lambda x: x.level)), F.lit(0)).alias("quote_depth"),
        F.col("parent").alias("parent_turn"), F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("d", F.lit(0).cast("long")).alias("depth"), "body",
    )
    return numbered(out, "conv_id", ["thread_turn", "turn", "role", "body"])


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reply_ordered`` of all conversations."""
    return reply_ordered(table(spark, sf_dir, "conversations"))
