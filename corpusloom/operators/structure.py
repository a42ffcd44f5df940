"""Structure: blocks over lines, the word gate, typography, tables and spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: fixed values: kinds of blocks; ratio of a heading's size to the body's; largest share of headings that is credible
KINDS = ("heading", "paragraph", "list_item", "list", "quote", "keep")
HEADING_RATIO, CREDIBLE = 1.15, 0.3


def cover_problems(blocks: DataFrame, keys: list[str], first: str, last: str, n_lines: str) -> DataFrame:
    """keys, problem of block lists that don't cover lines 1 to n in order, each once; others have no row."""
    w = W.partitionBy(*keys).orderBy(first, last)
    follows = F.coalesce(F.lag(last).over(w), F.lit(0)) + 1
    bad = blocks.withColumn("_bad", (F.col(first) != follows) | (F.col(last) < F.col(first)) | (F.col(last) > F.col(n_lines)))
    sums = bad.groupBy(*keys).agg(F.bool_or("_bad").alias("gap"), (F.max(last) != F.max(n_lines)).alias("short"))
    return sums.where("gap OR short").select(*keys, F.when(F.col("gap"), "order").otherwise("stops-early").alias("problem"))


def block_text(lines: Column, kind: Column, level: Column) -> Column:
    """Markdown of one block of lines; null if it has no text."""
    chunk = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(chunk, " ")
    hashes = F.repeat(F.lit("#"), F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(level, F.lit(1)))) + 2)
    out = (
        F.when(kind == "heading", F.concat(hashes, F.lit(" "), joined)).when(kind == "paragraph", joined).when(kind == "list_item", F.concat(F.lit("- "), joined))
        .when(kind == "list", F.array_join(F.transform(chunk, lambda x: F.concat(F.lit("- "), x)), "\n")).when(kind == "quote", F.array_join(F.transform(chunk, lambda x: F.concat(F.lit("> "), x)), "\n"))
        .otherwise(F.array_join(lines, "\n"))
    )
    return F.when(F.size(chunk) > 0, out)


def applied(texts: Column) -> Column:
    """Blocks' Markdown joined by blank lines; items that follow one another are one list."""
    return F.regexp_replace(F.array_join(F.filter(texts, lambda x: x.isNotNull()), "\n\n"), r"(?m)(^- .*)\n\n(?=- )", "$1\n")


def gated(text: Column, groomed: Column) -> Column:
    """struct<text, reason>: the groomed text if it has the same words, else the text and why."""
    same = T.words(groomed) == T.words(text)
    return F.when(F.trim(text) == "", F.struct(text.alias("text"), F.lit(None).cast("string").alias("reason"))).when(groomed.isNull(), F.struct(text.alias("text"), F.lit("unusable-annotations").alias("reason"))).when(same, F.struct(groomed.alias("text"), F.lit(None).cast("string").alias("reason"))).otherwise(F.struct(text.alias("text"), F.lit("words-changed").alias("reason")))


def first_matching(text: Column, proposals: Column) -> Column:
    """The first proposal with the same words, inline marks aside; null if none has."""
    return F.element_at(F.filter(proposals, lambda p: T.words(p, True) == T.words(text, True)), 1)


def typography(runs: DataFrame, doc: str, size: str, text: str, order: str) -> DataFrame:
    """doc, body_size (the size of most text, the first seen of equals), heading_chars, total_chars and credible."""
    n = F.length(F.trim(F.col(text)))
    by = runs.groupBy(doc, size).agg(F.sum(n).alias("weight"), F.min(order).alias("first"))
    best = by.groupBy(doc).agg(F.max(F.struct("weight", (-F.col("first")).alias("f"), F.col(size).alias("body_size"))).alias("b"), F.sum("weight").alias("total_chars"))
    heads = by.join(best, doc).where(F.col(size) >= HEADING_RATIO * F.col("b.body_size")).groupBy(doc).agg(F.sum("weight").alias("heading_chars"), F.count(F.lit(1)).alias("n_heading_sizes"))
    out = best.join(heads, doc, "left").select(doc, F.col("b.body_size").alias("body_size"), F.coalesce("heading_chars", F.lit(0)).cast("long").alias("heading_chars"), F.coalesce("n_heading_sizes", F.lit(0)).cast("long").alias("n_heading_sizes"), "total_chars")
    return out.withColumn("credible", (F.col("total_chars") > 0) & (F.col("heading_chars") <= CREDIBLE * F.col("total_chars")))


def usable_table(rows: Column) -> Column:
    """At least two rows and columns, at least half of the cells with text; rows: array<array<string>>."""
    cells = F.flatten(rows)
    return (F.size(rows) >= 2) & (F.size(rows[0]) >= 2) & (F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) * 2 >= F.size(cells))


def inside_tables(lines: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, line, x0, y0, x1, y1) with the first table (keys, tab, tx0, ty0, tx1, ty1) that holds their centre."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = lines.join(tables, keys).where((cx >= F.col("tx0")) & (cx <= F.col("tx1")) & (cy >= F.col("ty0")) & (cy <= F.col("ty1")))
    return hit.groupBy(*keys, "line").agg(F.min("tab").alias("tab"))


def sheet_extents(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, columns (over cells and merged ranges) and elided: rows without cells but the first."""
    a = cells.groupBy(*keys).agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count_distinct(F.when(F.col("row") > 1, F.col("row"))).alias("held"))
    b = merges.groupBy(*keys).agg(F.max("r2").alias("mr"), F.max("c2").alias("mc"))
    rows = F.greatest("r", F.coalesce("mr", F.lit(0)))
    return a.join(b, keys, "left").select(*keys, rows.alias("rows"), F.greatest("c", F.coalesce("mc", F.lit(0))).alias("columns"), (rows - 1 - F.col("held")).alias("elided"))


def sheet_rows(cells: DataFrame, keys: list[str], n_columns: int) -> DataFrame:
    """keys, row, line: CSV lines of n_columns fields after the row's number; row 1 has ``row`` there."""
    by = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    fields = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_columns)), lambda i: T.csv_field(F.col("m")[i])), ",")
    return by.select(*keys, "row", F.concat_ws(",", F.when(F.col("row") == 1, "row").otherwise(F.col("row").cast("string")), fields).alias("line"))


def range_name(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """A1:B2 of a merged range."""
    return F.concat(T.column_letter(c1), r1.cast("string"), F.lit(":"), T.column_letter(c2), r2.cast("string"))


def recognised(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, text of word boxes (line, seq, conf, text, width, height): letters and digits times confidence over 50.

    Boxes that stand upright (three times as high as wide) are read but not scored.
    """
    n = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    flat = F.col("height") <= 3 * F.col("width")
    lines = words.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("w"), F.sum(F.when(flat, n * F.greatest(F.lit(0), F.col("conf") - 50)).otherwise(0)).alias("s"))
    page = lines.groupBy(*keys).agg(F.sum("s").alias("score"), F.array_sort(F.collect_list(F.struct("line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("t")))).alias("l"))
    return page.select(*keys, F.col("score").cast("long").alias("score"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def best_rotation(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, angle, score: the angle of the largest score, the smaller of equals."""
    return candidates.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("b")).select(*keys, (-F.col("b.a")).alias("angle"), F.col("b.score").alias("score"))


def merged_ranges(sheets: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """key, n, ranges of every sheet: its merged ranges (r1, c1, r2, c2) as names, by row and column; empty without any."""
    name = range_name(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2"))
    by = merges.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r1", "c1", name.alias("x")))), lambda m: m["x"]), ", ").alias("ranges"))
    return sheets.join(by, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ranges", F.lit("")).alias("ranges"))
