"""Typography to Markdown: runs, wrapped blocks and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: lines but the last that reach this share of a block's width make it one paragraph
WRAPPED = 0.75


def link_target(uri: Column) -> Column:
    return F.replace(F.replace(F.replace(uri, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def is_wrapped(widths: Column) -> Column:
    """Whether the lines of a block are one paragraph: all but the last nearly fill its width."""
    return (F.size(widths) < 2) | F.forall(F.slice(widths, 1, F.greatest(F.size(widths) - 1, F.lit(1))), lambda w: w >= WRAPPED * F.array_max(widths))


def table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row is the head, short rows are filled up."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n")


def inline(runs: Column) -> Column:
    """array<struct<text, bold, italic, mono, link>> as Markdown; looks are those that depart from the body's.

    White space between two runs of one look belongs to them; runs of one look and link are merged; marks go inside the
    white space at the ends of a run.
    """
    look = lambda r: F.struct(r["bold"].alias("bold"), r["italic"].alias("italic"), r["mono"].alias("mono"), F.coalesce(r["link"], F.lit("")).alias("link"))
    start = F.array().cast("array<struct<text:string,look:struct<bold:boolean,italic:boolean,mono:boolean,link:string>>>")

    def step(acc: Column, at: Column) -> Column:
        r, after = F.element_at(runs, at), F.try_element_at(runs, at + 1)
        last = F.try_element_at(acc, F.lit(-1))
        bridges = (F.trim(r["text"]) == "") & after.isNotNull() & (last["look"] == look(after))
        own = F.when(F.coalesce(bridges, F.lit(False)), last["look"]).otherwise(look(r))
        joined = F.struct(F.concat(last["text"], r["text"]).alias("text"), own.alias("look"))
        alike = F.coalesce(last["look"] == own, F.lit(False))
        return F.when(alike, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(F.struct(r["text"].alias("text"), own.alias("look")))))

    def marked(x: Column) -> Column:
        core, k = F.trim(x["text"]), x["look"]
        stars = F.repeat(F.lit("*"), F.when(k["bold"], 2).otherwise(0) + F.when(k["italic"], 1).otherwise(0))
        coded = F.when(k["mono"], F.concat(F.lit("`"), core, F.lit("`"))).otherwise(core)
        strong = F.concat(stars, coded, stars)
        linked = F.when(k["link"] != "", F.concat(F.lit("["), strong, F.lit("]("), link_target(k["link"]), F.lit(")"))).otherwise(strong)
        return F.when(core == "", x["text"]).otherwise(F.concat(F.regexp_extract(x["text"], r"^\s*", 0), linked, F.regexp_extract(x["text"], r"\s*$", 0)))

    merged = F.when(F.size(runs) > 0, F.aggregate(F.sequence(F.lit(1), F.size(runs)), start, step)).otherwise(start)
    return F.trim(F.regexp_replace(F.array_join(F.transform(merged, marked), ""), r"[ \t]+", " "))
