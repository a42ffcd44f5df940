"""Mirrors: a header that binds a body to its source, sections, and exact code-point maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: fixed values of mirror headers
FORMAT, UNITS = "mirror.v1", ("page", "sheet", "message", "turn", "document")
REQUIRED = ("mirror_of", "content_hash", "media_type", "byte_size", "acquired_at", "acquisition_method", "acquired_from", "processing", "verify", "generated_by")


def text_mirror(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds header fields and body of the text mirror of each file (name, content binary).

    Bytes with NUL are deferred: no body, flag binary-content. Malformed UTF-8 is decoded with replacement and flagged
    text-decode-lossy. The body is the title as a heading, then the text with LF only and one line end last.
    """
    raw = F.col(content)
    binary = F.coalesce(F.contains(raw, F.lit(b"\x00")), F.lit(True))
    lossy = ~F.is_valid_utf8(raw.cast("string"))
    flags = F.array_sort(F.array_compact(F.array(F.when(binary, F.lit("binary-content")), F.when(~binary & lossy, F.lit("text-decode-lossy")))))
    text = F.regexp_replace(T.newlines(F.make_valid_utf8(raw.cast("string"))), "^\n+", "")
    body = F.when(~binary, F.concat(F.lit("# "), T.title_from_name(F.col(name)), F.lit("\n\n"), F.regexp_replace(text, "\\n+$", ""), F.lit("\n")))
    return files.withColumns({"content_hash": T.content_hash(raw), "byte_size": F.octet_length(raw).cast("long"), "verify": flags, "outcome": F.when(binary, "deferred").otherwise("processable"), "body": body})


def sections(body: Column) -> Column:
    """array<struct<heading, text>> of the parts that ## headings start."""
    parts = F.slice(F.split(body, "(?m)^## (?=[^\\n]+\\n)"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("heading"), F.regexp_replace(F.substring(p, F.locate("\n", p) + 1, F.length(p)), "^\\n+|\\n+$", "").alias("text")))


def page_body(pages: Column) -> Column:
    """The body of an array of page texts: ## Page N and the text, or a mark that it is empty."""
    one = lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), F.when(F.trim(p) == "", F.lit(T.EMPTY_PAGE)).otherwise(p))
    return F.array_join(F.transform(pages, one), "\n\n")


def page_map(pages: DataFrame, keys: list[str], number: str, text: str, lead: int = 0) -> DataFrame:
    """pages with start and end_ (half-open, code points) in the body that joins them with a heading before each."""
    head = F.length(F.concat(F.lit("## Page "), F.col(number).cast("string"), F.lit("\n\n")))
    gap = F.when(F.col(number) > 1, F.lit(2)).otherwise(F.lit(0))
    size = F.length(F.col(text))
    upto = F.sum(head + gap + size).over(W.partitionBy(*keys).orderBy(number).rowsBetween(W.unboundedPreceding, 0))
    return pages.withColumn("start", (upto - size + lead).cast("long")).withColumn("end_", (upto + lead).cast("long"))


def map_problems(pages: DataFrame, keys: list[str], number: str, body: str, text: str) -> DataFrame:
    """keys, number, problems: ordinals out of order, spans that overlap, texts that aren't the span's."""
    order = W.partitionBy(*keys).orderBy(number)
    cut = F.substring(F.col(body), F.col("start").cast("int") + 1, (F.col("end_") - F.col("start")).cast("int"))
    bad = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(bad(F.row_number().over(order) != F.col(number), "ordinal"), bad(F.col("start") < F.lag("end_").over(order), "overlap"), bad(F.col("end_") < F.col("start"), "negative"), bad(cut != F.col(text), "text")))
    return pages.select(*keys, number, F.array_join(found, ",").alias("problems"))


def verified(mirrors: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, problems of each mirror (content_hash, byte_size) against the source (name, content) of its key."""
    s = sources.select(F.col(key).alias("_k"), T.content_hash(F.col("content")).alias("_h"), F.octet_length("content").cast("long").alias("_n"))
    bad = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(bad(F.col("_k").isNull(), "missing-source"), bad(F.col("_h") != F.col("content_hash"), "hash"), bad(F.col("_n") != F.col("byte_size"), "size")))
    return mirrors.join(s, F.col(key) == F.col("_k"), "left").select(key, F.array_join(found, ",").alias("problems"))


def target_name(name: Column, media_type: Column) -> Column:
    """Where the mirror of a file goes: PDFs change their suffix, others keep theirs and get one more."""
    return F.when(media_type == "application/pdf", F.concat(T.stem(name), F.lit(".md"))).otherwise(F.concat(name, F.lit(".md")))


def merged_flags(*flags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*flags)))


def diff(before: DataFrame, after: DataFrame, key: str, digest: str, mode: str) -> DataFrame:
    """key, change: added, deleted, mode-changed or modified, for all entries that differ."""
    a = before.select(F.col(key).alias("ka"), F.col(digest).alias("da"), F.col(mode).alias("ma"))
    b = after.select(F.col(key).alias("kb"), F.col(digest).alias("db"), F.col(mode).alias("mb"))
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "deleted").when(F.col("da") != F.col("db"), "modified").when(F.col("ma") != F.col("mb"), "mode-changed")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), change.alias("change")).where("change IS NOT NULL")


#: fixed values: the header fields that every mirror has besides, the format of slide maps and its unit, how an anchor line looks
WRITTEN = (*REQUIRED, "format", "unit")
SLIDES, SLIDE_UNIT = "slides.v1", "slide"
ANCHOR_LINE = r'(?:^<a id="pdf-[0-9a-f]{64}-page-[0-9]+"></a>\n\n)?'


def header_problem(mirror_format: Column, unit: Column, extra: Column, extensions: Column) -> Column:
    """Why a header can't be built; null if it can. extra: array of field names; extensions: map of name to JSON text."""
    known = ((mirror_format == FORMAT) & unit.isin(*UNITS)) | ((mirror_format == SLIDES) & (unit == SLIDE_UNIT))
    taken = F.array_intersect(extra, F.array(*map(F.lit, WRITTEN)))
    odd = F.map_filter(extensions, lambda _, v: ~F.coalesce(F.get_json_object(v, "$").startswith("{"), F.lit(False)))
    return (
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown-unit"))
        .when(F.size(taken) > 0, F.concat(F.lit("collides:"), F.array_min(taken)))
        .when(F.size(odd) > 0, F.concat(F.lit("not-a-mapping:"), F.array_min(F.map_keys(odd))))
    )


def page_sections(body: Column) -> Column:
    """array of page texts in order, without anchors and headings; null if numbers aren't 1, 2, 3, ..."""
    mark = "\x01"  # no body holds it: NUL and other controls stay out of reading views
    parts = F.slice(F.split(F.regexp_replace(body, rf"(?m){ANCHOR_LINE}^## Page (\d+)\n", f"{mark}$1\n"), mark), 2, 1 << 30)
    numbers = F.transform(parts, lambda p: F.substring_index(p, "\n", 1).cast("long"))
    texts = F.transform(parts, lambda p: F.regexp_replace(F.substring(p, F.locate("\n", p) + 1, F.length(p)), r"^\n+|\n+$", ""))
    return F.when(F.forall(F.transform(numbers, lambda n, i: n == i + 1), lambda ok: ok), texts)


def deferred(name: Column, media_type: Column, reason: Column) -> Column:
    """struct<method, outcome, verify, unit, body> of the stub for a file that nothing reads: the original stays the only authority."""
    body = F.concat(F.lit("# "), T.title_from_name(name), F.lit("\n\nConversion is deferred. The original remains authoritative.\n"))
    return F.struct(F.concat(F.lit("conversion-deferred:"), reason).alias("method"), F.lit("deferred").alias("outcome"), F.array(F.lit("mirror-pending")).alias("verify"), F.lit("document").alias("unit"), media_type.alias("media_type"), body.alias("body"))


def readable(mirrors: DataFrame, mirror_format: str = "format") -> DataFrame:
    """The mirrors that operations on text and transcripts may read: all but those of slides."""
    return mirrors.where(~F.coalesce(F.col(mirror_format) == SLIDES, F.lit(False)))


def semantic(sections: DataFrame, key: str, method: str) -> DataFrame:
    """key, body, flags, steps of the mirrors that groomed sections (ordinal, heading, text, groomed, reason) make.

    Headings and their order stay; a section with a reason keeps its text and is flagged by its heading; a step with the
    method is added to those before (processing, of the first section) if any section was groomed.
    """
    shown = F.when(F.col("reason").isNull(), F.coalesce("groomed", "text")).otherwise(F.col("text"))
    one = F.struct("ordinal", F.concat(F.lit("## "), "heading", F.lit("\n\n"), shown).alias("x"))
    flag = F.when(F.col("reason").isNotNull(), F.concat(F.lit("structure-fallback:"), F.trim("heading")))
    by = sections.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("s"), F.array_sort(F.collect_set(flag)).alias("flags"), F.bool_or(F.col("groomed").isNotNull() & F.col("reason").isNull()).alias("used"), F.max("processing").alias("before"))
    step = F.struct((F.size("before") + 1).alias("seq"), F.lit(method).alias("method"))
    return by.select(key, F.array_join(F.transform("s", lambda x: x["x"]), "\n\n").alias("body"), "flags", F.when(F.col("used"), F.concat("before", F.array(step))).otherwise(F.col("before")).alias("steps"))


def summary(outcomes: DataFrame, key: str, outcome: str) -> DataFrame:
    """key, json, exit_code of a run: how many conversions ended how, as one line, and the gravest code."""
    n = lambda x: F.count_if(F.col(outcome) == x).alias(x)
    names = ("processable", "blocked", "deferred", "failed")
    by = outcomes.groupBy(key).agg(*map(n, names))
    code = F.when(F.col("failed") > 0, 5).when(F.col("blocked") > 0, 3).when(F.col("deferred") > 0, 4).otherwise(0)
    return by.select(key, F.to_json(F.struct(*names)).alias("json"), code.alias("exit_code"))


def inspection(json: Column) -> Column:
    """What a recognition run says of a document, by its schema; null where the text isn't such JSON."""
    schema = "page_count int, is_encrypted boolean, has_text_layer boolean, pages array<struct<number:int,method:string,raster_coverage:double,files:struct<native:string,text:string>>>"
    return F.when(F.try_parse_json(json).isNotNull(), F.from_json(json, schema))
