"""Office packages as rows: what they are, their relationships and assets, and the map of a deck's slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: fixed values: the part that makes a package an Office one, and media types by the first of these parts that it has
CONTENT_TYPES = "[Content_Types].xml"
OOXML = (
    ("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("ppt/presentation.xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
)
#: fixed values: media types by the first of these streams that a compound file has
OLE = (("WordDocument", "application/msword"), ("Workbook", "application/vnd.ms-excel"), ("Book", "application/vnd.ms-excel"))
#: fixed values: schemes of external targets that are told apart, ids that a slide may have, what stands for no text
SCHEMES, FIRST_ID, LAST_ID, NO_SLIDE_TEXT = ("https", "http", "file", "mailto"), 256, (1 << 31) - 1, "[no text on this slide]"


def _first(names: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*(F.when(F.array_contains(names, name), media) for name, media in table))


def ooxml_type(parts: Column) -> Column:
    """Media type of a package by the names of its parts; null if it isn't one of Office."""
    return F.when(F.array_contains(parts, CONTENT_TYPES), _first(parts, OOXML))


def ole_type(streams: Column) -> Column:
    """Media type of a compound file by the names of its streams; null for others."""
    return _first(streams, OLE)


def resolved_target(owner: Column, target: Column) -> Column:
    """The part that a relationship of ``owner`` leads to; null if it would leave the package."""
    path = F.when(target.startswith("/"), F.regexp_replace(target, "^/+", "")).otherwise(F.concat(F.regexp_replace(owner, "[^/]*$", ""), target))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(acc: Column, x: Column) -> Column:
        up = F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["inside"] & (F.size(acc["at"]) > 0)).alias("inside"))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.struct(F.concat(acc["at"], F.array(x)).alias("at"), acc["inside"].alias("inside")))

    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(acc["inside"], F.array_join(acc["at"], "/")))


def relationships(relations: DataFrame, parts: DataFrame) -> DataFrame:
    """owner, rid, part, scheme and problem of relations (package, owner, rid, kind, mode, target) against parts (package, name).

    part is where an internal one leads, scheme what an external one has. Problems: ambiguous (something is missing, or
    the id repeats in its owner), invalid-mode, missing-internal-target.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("package", "owner", "rid"))
    vague = F.coalesce(F.col("rid"), F.lit("")).isin("") | F.coalesce(F.col("kind"), F.lit("")).isin("") | F.coalesce(F.col("target"), F.lit("")).isin("") | (n > 1)
    out = F.col("mode") == "External"
    scheme = F.lower(F.regexp_extract("target", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    r = relations.withColumn("vague", vague).withColumn("part", F.when(F.col("mode") == "Internal", resolved_target(F.col("owner"), F.col("target"))))
    held = parts.select(F.col("package").alias("p"), F.col("name").alias("held")).distinct()
    problem = F.when(F.col("vague"), "ambiguous").when(~F.coalesce(F.col("mode"), F.lit("")).isin("Internal", "External"), "invalid-mode").when(~out & F.col("held").isNull(), "missing-internal-target")
    return r.join(held, (F.col("package") == F.col("p")) & (F.col("part") == F.col("held")), "left").select("package", "owner", "rid", "part", F.when(out, F.when(scheme.isin(*SCHEMES), scheme).otherwise("other")).alias("scheme"), problem.alias("problem"))


def occurrences(found: DataFrame, asset: str, keys: list[str]) -> DataFrame:
    """asset, n, first: how many different occurrences (keys) an asset has, each once however often it was met, and the least."""
    once = found.select(asset, *keys).distinct()
    return once.groupBy(asset).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys)).alias("first"))


# -- slides -------------------------------------------------------------------------------------------------------


def _payload(text: Column) -> Column:
    mark = T.fence(text)
    return F.concat(mark, F.lit("text\n"), text, F.lit("\n"), mark)


def _prefix(number: Column, anchor: Column, hidden: Column) -> Column:
    return F.concat(F.lit('\n\n<a id="'), anchor, F.lit('"></a>\n\n## Slide '), number.cast("string"), F.lit("\n\n"), F.when(hidden, "[Hidden source slide.]\n\n").otherwise(""), F.lit("### Slide content\n\n"))


def slide_anchor(digest: Column, slide_id: Column) -> Column:
    return F.concat(F.lit("pptx-"), digest, F.lit("-slide-"), slide_id.cast("string"))


def slide_map(slides: DataFrame, deck: str, title: str) -> DataFrame:
    """slides (number, slide_id, hidden, text, digest) with section, anchor, text_free and the spans of text and section.

    The body of a deck is its title as a heading, then the sections; spans count code points of it. A text without words
    becomes a note, and a fence is longer than any run of backticks in it, so a text can't forge a heading.
    """
    shown = F.trim(T.newlines(F.coalesce("text", F.lit(""))))
    x = slides.withColumn("text_free", shown == "").withColumn("text", F.when(shown == "", NO_SLIDE_TEXT).otherwise(shown)).withColumn("anchor", slide_anchor(F.col("digest"), F.col("slide_id")))
    x = x.withColumn("_prefix", _prefix(F.col("number"), F.col("anchor"), F.col("hidden"))).withColumn("section", F.concat("_prefix", _payload(F.col("text"))))
    before = W.partitionBy(deck).orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    at = F.length(F.concat(F.lit("# "), F.col(title))) + F.coalesce(F.sum(F.length("section")).over(before), F.lit(0))
    x = x.withColumn("_at", at).withColumn("content_start", (F.col("_at") + F.length("_prefix") + F.length(T.fence(F.col("text"))) + 5).cast("long"))
    return x.withColumn("content_end", F.col("content_start") + F.length("text")).withColumn("end_", (F.col("_at") + F.length("section")).cast("long")).drop("_prefix", "_at")


def slide_problems(records: DataFrame, deck: str, body: str) -> DataFrame:
    """deck, number, problems of the records of a slide map (with the deck's body and notes policy) that aren't what the body says."""
    order, whole = W.partitionBy(deck).orderBy("number"), W.partitionBy(deck)
    again = lambda c: F.count(F.lit(1)).over(W.partitionBy(deck, c)) > 1
    cut = lambda a, b: F.substring(F.col(body), (a + 1).cast("int"), (b - a).cast("int"))
    text = cut(F.col("content_start"), F.col("content_end"))
    began = F.lag("end_").over(order)
    lead = F.concat(_prefix(F.col("number"), F.col("anchor"), F.col("hidden")), T.fence(text), F.lit("text\n"))
    began = F.coalesce(began, F.col("content_start") - F.length(lead))
    section = F.concat(_prefix(F.col("number"), F.col("anchor"), F.col("hidden")), _payload(text))
    bad = {
        "ordinal": F.row_number().over(order) != F.col("number"),
        "identity": ~F.coalesce(F.col("slide_id").between(FIRST_ID, LAST_ID), F.lit(False)) | again("slide_id"),
        "part": F.coalesce(F.col("part"), F.lit("")).rlike(r"^$|\\|(^|/)(\.{0,2})(/|$)") | again("part"),
        "notes-policy": F.col("notes_included") != (F.col("notes_policy") == "include"),
        "anchor": F.col("anchor") != slide_anchor(F.col("digest"), F.col("slide_id")),
        "features": F.col("features") != F.array_sort(F.array_distinct("features")),
        "span": ~((F.col("content_start") >= 0) & (F.col("content_start") < F.col("content_end")) & (F.col("content_end") < F.col("end_")) & (F.col("end_") <= F.length(body))),
        "text": (text != F.trim(text)) | (F.col("text_free") & (text != NO_SLIDE_TEXT)),
        "framing": cut(began, F.col("end_")) != section,
        "trailing": (F.col("number") == F.max("number").over(whole)) & ~F.substring(F.col(body), (F.col("end_") + 1).cast("int"), 1 << 30).isin("", "\n"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in bad.items())))
    return records.select(deck, "number", F.array_join(found, ",").alias("problems")).where("problems <> ''")
