"""Queries on packages, slides, Markdown from typography, headers and records of work."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import markdown as D
from corpusloom.operators import mirror as M
from corpusloom.operators import packages as P
from corpusloom.operators import profile as C
from corpusloom.operators import records as R
from corpusloom.operators import structure as S
from corpusloom.operators import transcript as X
from corpusloom.plans.mirror_queries import _PAGES, _pages

read = lambda spark, d, t: spark.read.parquet(f"{d}/{t}.parquet")


def _parts(spark, d):
    """Orders as packages; an item's line number and part key say which part it is."""
    li = read(spark, d, "lineitem")
    name = F.when(F.col("l_linenumber") == 1, "[Content_Types].xml").when(F.col("l_linenumber") == 2, F.when(F.col("l_partkey") % 2 == 0, "word/document.xml").otherwise("xl/workbook.xml")).when(F.col("l_linenumber") == 3, "ppt/presentation.xml").otherwise("docProps/app.xml")
    return li.select(F.col("l_orderkey").alias("package"), name.alias("name"))


def flt03_ooxml_types_lineitem(spark, d):
    return _parts(spark, d).groupBy("package").agg(F.collect_set("name").alias("names")).select("package", P.ooxml_type(F.col("names")).alias("media_type"))


def flt04_ole_types_orders(spark, d):
    """Customers as compound files, their orders' states as streams."""
    o = read(spark, d, "orders")
    name = F.when(F.col("o_orderpriority").startswith("1"), "WordDocument").when(F.col("o_orderstatus") == "F", "Book").when(F.col("o_orderkey") % 5 == 0, "Workbook").otherwise("\x05SummaryInformation")
    return o.groupBy("o_custkey").agg(F.collect_set(name).alias("names")).select("o_custkey", P.ole_type(F.col("names")).alias("media_type"))


def jon06_targets_lineitem(spark, d):
    """Items as relationships of slides (orders) to media (parts), some by absolute paths, some external, some with repeated ids."""
    li = read(spark, d, "lineitem")
    file = F.concat(F.col("l_partkey").cast("string"), F.lit(".png"))
    target = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("/ppt/media/"), file)).when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("HTTPS://x/"), file)).when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("../../../"), file)).otherwise(F.concat(F.lit(".././media/"), file))
    r = li.select(F.col("l_suppkey").alias("package"), F.concat(F.lit("ppt/slides/slide"), F.col("l_orderkey").cast("string"), F.lit(".xml")).alias("owner"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rid"), F.when(F.col("l_tax") > 0.07, "").otherwise("image").alias("kind"), F.when((F.col("l_linenumber") % 4 == 0) & (F.col("l_linenumber") % 3 != 0), "External").when(F.col("l_discount") > 0.09, "Odd").otherwise("Internal").alias("mode"), target.alias("target"))
    held = li.where("l_quantity > 10").select(F.col("l_suppkey").alias("package"), F.concat(F.lit("ppt/media/"), file).alias("name"))
    return P.relationships(r, held).groupBy("package", "problem", "scheme").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first_part"))


def set05_occurrences_lineitem(spark, d):
    """Parts as assets that orders show, each way once."""
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("asset"), (F.col("l_orderkey") % 50).alias("slide"), F.col("l_linestatus").alias("scope"))
    return P.occurrences(li, "asset", ["slide", "scope"]).select("asset", "n", F.col("first.slide").alias("slide"), F.col("first.scope").alias("scope"))


def jon02_sheet_merges_orders(spark, d):
    """Customers as sheets with the merged ranges that their orders give, in order; sheets without any too."""
    o = read(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("sheet"), (F.col("o_orderkey") % 9 + 1).alias("r1"), (F.col("o_orderkey") % 30 + 1).alias("c1"))
    m = o.select("sheet", "r1", "c1", (F.col("r1") + 2).alias("r2"), (F.col("c1") + 1).alias("c2"))
    return S.merged_ranges(read(spark, d, "customer").select(F.col("c_custkey").alias("sheet")), m, "sheet")


def _deck(spark, d):
    """Documents as decks, pages as slides; every eleventh deck repeats an id, every seventh has a part outside, every fifth unsorted features."""
    p = _pages(spark, d).withColumn("digest", F.sha2(F.col("doc_id").cast("string"), 256)).withColumn("title", F.concat(F.lit("Deck "), F.col("doc_id").cast("string")))
    p = p.withColumn("slide_id", F.when(F.col("doc_id") % 11 == 0, 300 + F.col("number") % 2).otherwise(255 + F.col("number")).cast("long")).withColumn("hidden", F.col("number") % 4 == 0)
    p = p.withColumn("part", F.concat(F.when(F.col("doc_id") % 7 == 0, "ppt/../").otherwise("ppt/"), F.lit("slides/slide"), F.col("number").cast("string"), F.lit(".xml")))
    p = p.withColumn("features", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("table"), F.lit("chart"))).otherwise(F.array(F.lit("chart"), F.lit("table"))))
    return P.slide_map(p.withColumn("notes_policy", F.lit("include")).withColumn("notes_included", F.col("doc_id") % 13 != 0), "doc_id", "title")


def val04_slide_map_documents(spark, d):
    """Slide maps against bodies; in every third deck an e became an E."""
    s = _deck(spark, d)
    b = s.groupBy("doc_id").agg(F.max("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "section"))), lambda x: x["section"]), "").alias("sections"))
    b = b.select("doc_id", F.concat(F.lit("# "), "title", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("sections", "e([^e]*)$", "E$1")).otherwise(F.col("sections"))).alias("body"))
    return P.slide_problems(s.drop("section", "text", "title").join(b, "doc_id"), "doc_id", "body")


def val04_slide_spans_documents(spark, d):
    """Where slides stand in their decks' bodies."""
    return _deck(spark, d).select("doc_id", "number", "content_start", "content_end", "end_", "text_free")


def val05_headers_documents(spark, d):
    x = read(spark, d, "documents")
    unit = F.element_at(F.array(*map(F.lit, ("page", "turn", "slide", "cell"))), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 6 < 3, M.FORMAT).otherwise(M.SLIDES)
    extra = F.array(F.concat(F.col("lang"), F.lit("_note")), F.when(F.col("n_chars") % 3 == 0, "verify").otherwise("pages"), F.when(F.col("n_chars") % 5 == 0, "format").otherwise("source"))
    ext = F.create_map(F.col("source"), F.when(F.col("n_chars") % 2 == 0, '{"a": 1}').otherwise("[1]"))
    return x.select("doc_id", M.header_problem(kind, unit, extra, ext).alias("problem"))


def val09_readable_documents(spark, d):
    x = read(spark, d, "documents").withColumn("format", F.when(F.col("doc_id") % 6 < 3, M.FORMAT).when(F.col("doc_id") % 6 < 5, M.SLIDES))
    return M.readable(x).select("doc_id", "format")


def str07_page_sections_documents(spark, d):
    """Bodies with an anchor before every second page; every seventh has its pages numbered from 2, every ninth from 1 in steps of 2."""
    p = _pages(spark, d)
    shown = F.col("number") + F.when(F.col("doc_id") % 7 == 0, 1).when(F.col("doc_id") % 9 == 0, F.col("number") - 1).otherwise(0)
    link = F.when(F.col("number") % 2 == 0, F.concat(F.lit('<a id="'), T.anchor(F.sha2(F.col("doc_id").cast("string"), 256), F.col("number")), F.lit('"></a>\n\n'))).otherwise("")
    one = p.select("doc_id", "number", F.concat(link, F.lit("## Page "), shown.cast("string"), F.lit("\n\n"), "text").alias("x"))
    b = one.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "x"))), lambda s: s["x"]), "\n\n").alias("body"))
    return b.select("doc_id", F.size(M.page_sections(F.col("body"))).alias("n"), F.sha2(F.array_join(M.page_sections(F.col("body")), "|"), 256).alias("digest"))


def snk04_deferred_documents(spark, d):
    x = read(spark, d, "documents")
    s = M.deferred(F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".bin")), F.lit("application/octet-stream"), F.when(F.col("n_chars") % 2 == 0, "unsupported").otherwise("no-engine"))
    return x.select("doc_id", s["method"].alias("method"), s["outcome"].alias("outcome"), F.array_join(s["verify"], ",").alias("flags"), s["body"].alias("body"))


def str15_tables_orders(spark, d):
    o = read(spark, d, "orders")
    rows = F.array(F.array(F.lit("Key"), F.lit("State|x"), F.lit(" Priority  of\tit ")), F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(None).cast("string"), F.lit(""), F.col("o_orderpriority"))).otherwise(F.array(F.lit("z"))))
    return o.select("o_orderkey", D.table(rows).alias("markdown"))


def str15_wrapped_lineitem(spark, d):
    li = read(spark, d, "lineitem")
    b = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))).alias("a"))
    return b.select("l_orderkey", D.is_wrapped(F.transform("a", lambda x: x["l_quantity"] + 100)).alias("wrapped"))


def str15_inline_lineitem(spark, d):
    """Orders as lines of runs: every third run is a space."""
    li = read(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity")
    r = li.withColumn("i", F.row_number().over(w))
    run = F.struct(F.when(F.col("i") % 3 == 0, " ").otherwise(F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string"), F.when(F.col("i") % 2 == 0, " ").otherwise(""))).alias("text"), (F.col("l_quantity") > 25).alias("bold"), (F.col("l_tax") > 0.06).alias("italic"), F.lit(False).alias("mono"), F.when(F.col("l_discount") > 0.08, "http://x/a (b)").alias("link"))
    return r.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", run.alias("r")))), lambda x: x["r"]).alias("runs")).select("l_orderkey", D.inline(F.col("runs")).alias("markdown"))


def win14_band_cuts_embeddings(spark, d):
    """Components of a vector as the brightness ranges of an image's rows."""
    e = read(spark, d, "embeddings")
    spread = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 20).cast("int"))
    return e.select("vec_id", F.array_join(F.transform(R.band_cuts(spread, F.lit(64.0), 20.0), lambda c: c.cast("int").cast("string")), ",").alias("cuts"))


def pol12_families_pages(spark, d):
    """Twenty sets of changed paths."""
    rules = spark.createDataFrame([("a", "https://**/1*"), ("c", "http*://*/*5*"), ("d", "https://**")], "family string, glob string")
    p = read(spark, d, "pages").select((F.col("page_id") % 20).alias("set"), F.when(F.col("page_id") % 83 == 0, F.lit("tests/plan.yaml")).when(F.col("page_id") % 61 == 0, F.concat(F.lit("lib/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("path"))
    return R.selected_families(p, rules, "set", ["tests/plan.yaml"])


def src20_phases_supplier(spark, d):
    """Suppliers as phase files with faults in id, order and keys."""
    s = read(spark, d, "supplier")
    key = F.col("s_suppkey")
    name = F.when(key % 13 == 0, F.lit("same-id")).when(key % 11 == 0, F.concat(F.lit("Bad_"), key.cast("string"))).otherwise(F.concat(F.lit("phase-"), key.cast("string")))
    order = F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit("/0"))).when(key % 2 == 0, F.concat(key.cast("string"), F.lit("/3"))).otherwise(F.concat(F.lit("-1."), key.cast("string")))
    text = F.concat(F.lit("---\nid: "), name, F.lit("\ntitle: a: b\norder: "), order, F.when(key % 5 == 0, "\nstatus: open").otherwise(""), F.lit("\n---\n# Text\n"))
    return R.phase_problems(s.select(F.concat(F.when(key % 17 == 0, "other").otherwise(name), F.lit(".md")).alias("file"), R.front_matter(F.when(key % 19 == 0, F.lit("# none\n")).otherwise(text)).alias("meta")).withColumn("file", F.col("file"))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"))


def src24_junit_events(spark, d):
    """Users' events as test reports; some have a time that isn't one."""
    e = read(spark, d, "events")
    seconds = F.round(F.col("value"), 2).cast("decimal(12,2)")
    case = F.format_string('<testcase name="t%s" classname="tests.%s" file="tests/%s.py" time="%s"/>', F.col("event_id").cast("string"), F.col("event_type"), F.col("event_type"), F.when(F.col("event_id") % 997 == 0, "nan").otherwise(seconds.cast("string")))
    x = e.groupBy("user_id").agg(F.sum(seconds).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", case.alias("c")))), lambda s: s["c"]), "").alias("cases"))
    r = x.select("user_id", R.junit(F.concat(F.lit('<testsuite time="'), F.col("total").cast("string"), F.lit('">'), "cases", F.lit("</testsuite>"))).alias("r"))
    return r.select("user_id", F.round("r.total", 2).alias("total"), F.size("r.cases").alias("n"), F.round(F.aggregate("r.cases", F.lit(0.0), lambda a, c: a + c["seconds"]), 2).alias("seconds"), F.array_min(F.transform("r.cases", lambda c: c["node"])).alias("first"))


def val13_lessons_part(spark, d):
    """Parts as lessons, open and archived, with faults."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    slug = F.concat(F.lit("part-"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    base = F.concat(F.lit("---\nslug: "), F.when(k % 7 == 0, "other-slug").otherwise(slug), F.lit("\ntitle: "), F.when(k % 11 == 0, "").otherwise(F.col("p_name")), F.lit("\nstatus: "), F.when(k % 2 == 0, "codified").when(k % 13 == 0, "lost").otherwise("open"), F.lit("\nscope: x\n"), F.when(k % 17 == 0, "").otherwise("source: review\n"), F.lit("filed: "), F.when(k % 19 == 0, "2026-13-01").otherwise("2026-01-31"))
    more = F.concat(F.when(k % 4 == 0, "\nclosed: 2026-02-01").otherwise(""), F.when(k % 3 == 0, "\ngraduated_to: docs/x.md").otherwise(""), F.when(k % 23 == 0, "\nnote: y").otherwise(""))
    meta = R.front_matter(F.concat(base, more, F.lit("\n---\n")))
    return p.select(k, R.lesson_problem(meta, F.concat(slug, F.lit(".md")), k % 2 == 0).alias("problem"))


def val06_bundles_documents(spark, d):
    """Documents as recognition bundles with faults in labels, pages and files."""
    p = _pages(spark, d).withColumn("n", F.max("number").over(W.partitionBy("doc_id")))
    ocr = (F.col("number") % 3 == 0) & (F.col("doc_id") % 2 == 0)
    path = F.concat(F.when(F.col("doc_id") % 31 == 0, "../").otherwise(""), F.lit("pages/"), F.col("number").cast("string"), F.lit(".txt"))
    pages = p.select("doc_id", "number", F.when(ocr, "ocr").otherwise("native-text").alias("method"), (F.col("number") % 3 == 0).alias("ocr_candidate"), F.col("text").alias("native"), F.when((F.col("doc_id") % 17 == 0) & (F.col("number") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when((F.col("doc_id") % 19 == 0) & ocr, 45).otherwise(90).alias("rotation"), F.lit(0.5).alias("score"), path.alias("path"))
    size = F.octet_length("text").cast("long")
    files = p.select("doc_id", path.alias("path"), F.when((F.col("doc_id") % 23 == 0) & (F.col("number") == 1), F.lit(None)).otherwise(size).alias("size"), F.sha2("text", 256).alias("sha256"), F.when((F.col("doc_id") % 29 == 0) & (F.col("number") == 1), size + 1).otherwise(size).alias("found_size"), F.sha2("text", 256).alias("found_sha256"))
    b = p.where("number = 1").select("doc_id", F.when(F.col("doc_id") % 37 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("page_count"), F.when(F.col("n") < 3, "not-requested").when(F.col("doc_id") % 2 == 0, "complete").otherwise("unrecognized-candidates").alias("completeness"), (F.col("doc_id") % 41 != 0).alias("has_text_layer"), F.when((F.col("doc_id") % 2 == 0) | (F.col("n") < 3), F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.floor(F.col("n") / 3).cast("int")), lambda i: i * 3)).alias("outstanding"))
    return R.bundle_problems(b, pages, files, "doc_id")


def snk06_index_orders(spark, d):
    o = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("title"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.lit(".html")).alias("href"))
    return R.index_page(o, "day", "title", "href")


def pol01_endpoints_supplier(spark, d):
    """Suppliers as endpoints with settings that don't fit."""
    k = F.col("s_suppkey")
    kind = F.when(k % 7 == 0, "magic").when(k % 5 == 0, "command").otherwise("openai-compatible")
    settings = F.map_concat(F.create_map(F.lit("kind"), kind), F.when(k % 11 == 0, F.create_map(F.lit("egress"), F.lit("inferred"))).otherwise(F.create_map(F.lit("egress"), F.lit("local"))), F.when(k % 10 == 0, F.create_map(F.lit("command"), F.lit("run"))).otherwise(F.create_map(F.lit("timeout_seconds"), F.lit("9"))), F.when(k % 13 == 0, F.create_map(F.lit("token"), F.lit("x"))).when(k % 17 == 0, F.create_map(F.lit("colour"), F.lit("x"))).otherwise(F.create_map(F.lit("base_url"), F.lit("x"))))
    return read(spark, d, "supplier").select("s_suppkey", C.endpoint_problem(settings).alias("problem"))


def pol01_stages_customer(spark, d):
    """Customers as stages that name suppliers as endpoints."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ("ocr", "structure", "image_description", "transcription", "cleanup"))), (k % 5 + 1).cast("int"))
    end = F.when(k % 3 == 0, F.create_map(F.lit("endpoint"), F.concat(F.lit("e"), (k % 150).cast("string")))).otherwise(F.create_map(F.lit("model"), F.lit("m")))
    more = F.when(k % 7 == 0, F.create_map(F.lit("second_pass"), F.lit("always"))).when(k % 8 == 0, F.create_map(F.lit("native_pass"), F.lit("none"))).otherwise(F.create_map(F.lit("applies_to"), F.lit("x")))
    applies = F.when(k % 4 == 0, F.array(F.lit("image"), F.lit("audio"))).otherwise(F.array().cast("array<string>"))
    ends = read(spark, d, "supplier").where("s_suppkey <= 100").select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("endpoint"))
    return C.stage_problems(c.select(k.alias("id"), name.alias("name"), F.map_concat(end, more).alias("settings"), applies.alias("applies")), ends)


def pol03_reports_orders(spark, d):
    """Orders as files of three kinds under a plan of four stages."""
    o = read(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("audio/mpeg", "application/pdf", "text/plain"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    plans = spark.createDataFrame([("audio/mpeg", "transcription", True, "cloud"), ("audio/mpeg", "refinement", True, "local"), ("audio/mpeg", "cleanup", False, "cloud"), ("application/pdf", "ocr", True, "local"), ("application/pdf", "structure", True, "cloud")], "media_type string, stage string, runs boolean, egress string")
    rates = spark.createDataFrame([("transcription", 0.4), ("structure", None)], "stage string, usd_per_hour double")
    return C.reports(o.select(F.col("o_orderkey").alias("file"), kind.alias("media_type"), (F.col("o_custkey") % 90).cast("double").alias("minutes")), plans, rates)


def pol08_semantic_documents(spark, d):
    """Pages groomed by joining their lines; on every third page a word is lost, so its text stays."""
    p = _pages(spark, d)
    groomed = F.when(F.col("number") % 3 == 0, F.concat(F.lit("lost "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    g = S.gated(F.col("text"), groomed)
    s = p.select("doc_id", F.col("number").alias("ordinal"), F.concat(F.lit("Page "), F.col("number").cast("string")).alias("heading"), "text", g["text"].alias("groomed"), g["reason"].alias("reason"), F.array(F.struct(F.lit(1).alias("seq"), F.lit("text").alias("method"))).alias("processing"))
    m = M.semantic(s, "doc_id", "structure:annotate:m")
    return m.select("doc_id", F.sha2("body", 256).alias("digest"), F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("steps", lambda x: F.concat(x["seq"].cast("string"), F.lit(":"), x["method"])), ",").alias("steps"))


def agg22_refinements_conversations(spark, d):
    """Turns that paragraphs were proposed for, and proposals to move words, taken and refused."""
    c = read(spark, d, "conversations")
    n = X.neighbours(c.withColumn("n_words", F.size(T.split_words(F.col("text")))), ["conv_id"], "turn", "role")
    refused = X.boundary_refused(F.col("turn") + 4, F.col("n_words"), F.col("role"), F.col("previous"))
    return n.groupBy("conv_id").agg(F.count_if(T.is_long(F.col("text"))).alias("paragraphed_turns"), F.count_if(refused.isNull() & F.col("role").isNotNull()).alias("proposals"), F.count_if(refused.isNotNull()).alias("refused"))


def snk10_summary_documents(spark, d):
    x = read(spark, d, "documents")
    return M.summary(x.select("source", F.when(F.col("doc_id") % 97 == 0, "failed").when(F.col("n_chars") % 5 == 0, "deferred").when(F.col("n_chars") % 41 == 0, "blocked").otherwise("processable").alias("outcome")), "source", "outcome")


def src16_inspections_documents(spark, d):
    """What a recognition run says of each document, as JSON, read with a schema: pages, candidates and covered ones."""
    p = _pages(spark, d)
    one = F.to_json(F.struct(F.col("number"), (F.length("text") % 100 / 100.0).alias("raster_coverage"), F.struct(F.concat(F.lit("p"), F.col("number").cast("string"), F.lit(".txt")).alias("native")).alias("files")))
    j = p.groupBy("doc_id").agg(F.concat(F.lit('{"page_count": '), F.count(F.lit(1)).cast("string"), F.lit(', "pages": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", one.alias("x")))), lambda s: s["x"]), ","), F.lit("]}")).alias("json"))
    found = M.inspection(F.when(F.col("doc_id") % 23 == 0, F.substring("json", 1, 9)).otherwise(F.col("json")))
    return j.select("doc_id", found["page_count"].alias("page_count"), F.array_join(F.transform(F.filter(found["pages"], lambda x: x["raster_coverage"] >= 0.5), lambda x: x["files"]["native"]), ",").alias("covered"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] != "_" and callable(f) and getattr(f, "__module__", "") == __name__ and name != "read"}

_TITLE = "'Doc ' || doc_id || ' ' || upper(lang[1]) || lang[2:]"
_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all({0}, '`+'), lambda x: length(x))), 0) + 1))"
_DECK = rf"""{_PAGES}, a AS (SELECT *, sha256(doc_id::VARCHAR) AS digest, CAST(CASE WHEN doc_id % 11 = 0 THEN 300 + number % 2 ELSE 255 + number END AS BIGINT) AS slide_id, trim(text) AS raw FROM p),
b AS (SELECT *, CASE WHEN raw = '' THEN '[no text on this slide]' ELSE raw END AS t FROM a),
c AS (SELECT *, {_FENCE.format("t")} AS f, chr(10) || chr(10) || '<a id="pptx-' || digest || '-slide-' || slide_id || '"></a>' || chr(10) || chr(10) || '## Slide ' || number || chr(10) || chr(10) || CASE WHEN number % 4 = 0 THEN '[Hidden source slide.]' || chr(10) || chr(10) ELSE '' END || '### Slide content' || chr(10) || chr(10) AS lead FROM b),
e AS (SELECT *, lead || f || 'text' || chr(10) || t || chr(10) || f AS section FROM c),
g AS (SELECT *, CAST(sum(length(section)) OVER (PARTITION BY doc_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS BIGINT) + length('# Deck ' || doc_id) AS end_ FROM e),
h AS (SELECT *, end_ - length(section) + length(lead) + length(f) + 5 AS content_start, end_ - length(section) + length(lead) + length(f) + 5 + length(t) AS content_end FROM g)"""

ORACLES = {
    "flt03_ooxml_types_lineitem": """WITH x AS (SELECT l_orderkey AS package, bool_or(l_linenumber = 1) AS c, bool_or(l_linenumber = 2 AND l_partkey % 2 = 0) AS w, bool_or(l_linenumber = 2 AND l_partkey % 2 = 1) AS s, bool_or(l_linenumber = 3) AS p FROM lineitem GROUP BY 1)
      SELECT package, CASE WHEN c THEN CASE WHEN w THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN s THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN p THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' END END AS media_type FROM x""",
    "flt04_ole_types_orders": """WITH x AS (SELECT o_custkey, CASE WHEN starts_with(o_orderpriority, '1') THEN 1 WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 4 END AS k FROM orders)
      SELECT o_custkey, CASE min(k) WHEN 1 THEN 'application/msword' WHEN 4 THEN NULL ELSE 'application/vnd.ms-excel' END AS media_type FROM x GROUP BY 1""",
    "jon06_targets_lineitem": """WITH r AS (SELECT l_suppkey AS package, l_orderkey, l_linenumber AS i, l_partkey, l_tax, CASE WHEN l_linenumber % 4 = 0 AND l_linenumber % 3 <> 0 THEN 'External' WHEN l_discount > 0.09 THEN 'Odd' ELSE 'Internal' END AS mode,
        count(*) OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber) AS same FROM lineitem),
      s AS (SELECT *, CASE WHEN mode = 'Internal' AND NOT (i % 5 = 0 AND i % 3 <> 0 AND i % 4 <> 0) THEN 'ppt/media/' || l_partkey || '.png' END AS part FROM r),
      h AS (SELECT DISTINCT l_suppkey AS package, 'ppt/media/' || l_partkey || '.png' AS held FROM lineitem WHERE l_quantity > 10)
      SELECT s.package, CASE WHEN l_tax > 0.07 OR same > 1 THEN 'ambiguous' WHEN mode = 'Odd' THEN 'invalid-mode' WHEN mode = 'Internal' AND held IS NULL THEN 'missing-internal-target' END AS problem,
        CASE WHEN mode = 'External' THEN 'https' END AS scheme, count(*) AS n, min(part) AS first_part FROM s LEFT JOIN h ON s.package = h.package AND s.part = h.held GROUP BY 1, 2, 3""",
    "set05_occurrences_lineitem": """WITH x AS (SELECT DISTINCT l_partkey AS asset, l_orderkey % 50 AS slide, l_linestatus AS scope FROM lineitem), y AS (SELECT *, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY slide, scope) AS k FROM x)
      SELECT asset, n, slide, scope FROM y WHERE k = 1""",
    "jon02_sheet_merges_orders": """WITH m AS (SELECT o_custkey AS sheet, o_orderkey % 9 + 1 AS r1, o_orderkey % 30 + 1 AS c1 FROM orders WHERE o_orderkey % 4 = 0),
      l AS (SELECT *, CASE WHEN c1 <= 26 THEN chr(CAST(64 + c1 AS INTEGER)) ELSE 'A' || chr(CAST(38 + c1 AS INTEGER)) END AS a, CASE WHEN c1 + 1 <= 26 THEN chr(CAST(65 + c1 AS INTEGER)) ELSE 'A' || chr(CAST(39 + c1 AS INTEGER)) END AS b FROM m)
      SELECT c_custkey AS sheet, count(r1) AS n, coalesce(string_agg(a || r1 || ':' || b || (r1 + 2), ', ' ORDER BY r1, c1), '') AS ranges FROM customer LEFT JOIN l ON sheet = c_custkey GROUP BY 1""",
    "val04_slide_spans_documents": f"{_DECK} SELECT doc_id, number, content_start, content_end, end_, raw = '' AS text_free FROM h",
    "val04_slide_map_documents": _DECK + r""", body AS (SELECT doc_id, '# Deck ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN regexp_replace(string_agg(section, '' ORDER BY number), 'e([^e]*)$', 'E\1') ELSE string_agg(section, '' ORDER BY number) END AS body FROM h GROUP BY 1),
      k AS (SELECT h.*, body, coalesce(lag(end_) OVER (PARTITION BY h.doc_id ORDER BY number), length('# Deck ' || h.doc_id)) AS began, count(*) OVER (PARTITION BY h.doc_id, slide_id) AS same FROM h JOIN body ON body.doc_id = h.doc_id),
      m AS (SELECT *, substr(body, content_start + 1, content_end - content_start) AS found, substr(body, began + 1, end_ - began) AS cut FROM k),
      q AS (SELECT doc_id, number, concat_ws(',', CASE WHEN same > 1 OR slide_id < 256 THEN 'identity' END, CASE WHEN doc_id % 7 = 0 THEN 'part' END, CASE WHEN doc_id % 13 = 0 THEN 'notes-policy' END, CASE WHEN doc_id % 5 = 0 THEN 'features' END,
        CASE WHEN found <> trim(found) OR (raw = '' AND found <> '[no text on this slide]') THEN 'text' END, CASE WHEN cut <> lead || """ + _FENCE.format("found") + r""" || 'text' || chr(10) || found || chr(10) || """ + _FENCE.format("found") + r""" THEN 'framing' END) AS problems FROM m)
      SELECT * FROM q WHERE problems <> ''""",
    "val05_headers_documents": """WITH x AS (SELECT *, ['page', 'turn', 'slide', 'cell'][doc_id % 4 + 1] AS unit, doc_id % 6 < 3 AS plain FROM documents)
      SELECT doc_id, CASE WHEN NOT ((plain AND unit IN ('page', 'turn')) OR (NOT plain AND unit = 'slide')) THEN 'unknown-unit' WHEN n_chars % 5 = 0 THEN 'collides:format' WHEN n_chars % 3 = 0 THEN 'collides:verify' WHEN n_chars % 2 = 1 THEN 'not-a-mapping:' || source END AS problem FROM x""",
    "val09_readable_documents": "SELECT doc_id, CASE WHEN doc_id % 6 < 3 THEN 'mirror.v1' END AS format FROM documents WHERE doc_id % 6 < 3 OR doc_id % 6 = 5",
    "str07_page_sections_documents": rf"""{_PAGES}, x AS (SELECT doc_id, string_agg(CASE WHEN number % 2 = 0 THEN '<a id="pdf-' || sha256(doc_id::VARCHAR) || '-page-' || lpad(number::VARCHAR, 6, '0') || '"></a>' || chr(10) || chr(10) ELSE '' END || '## Page ' || (number + CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 9 = 0 THEN number - 1 ELSE 0 END) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY number) AS body FROM p GROUP BY 1),
      y AS (SELECT doc_id, regexp_extract_all(body, '(?m)^## Page (\d+)\n', 1) AS n, string_split_regex(regexp_replace(body, '(?m)^(<a id="pdf-[0-9a-f]{{64}}-page-[0-9]+"></a>\n\n)?## Page \d+\n', chr(1), 'g'), chr(1))[2:] AS t FROM x)
      SELECT doc_id, CASE WHEN n = list_transform(range(1, len(n) + 1), lambda i: i::VARCHAR) THEN CAST(len(n) AS INTEGER) ELSE NULL END AS n, CASE WHEN n = list_transform(range(1, len(n) + 1), lambda i: i::VARCHAR) THEN sha256(array_to_string(list_transform(t, lambda s: trim(s, chr(10))), '|')) END AS digest FROM y""",
    "snk04_deferred_documents": f"""SELECT doc_id, 'conversion-deferred:' || CASE WHEN n_chars % 2 = 0 THEN 'unsupported' ELSE 'no-engine' END AS method, 'deferred' AS outcome, 'mirror-pending' AS flags, '# ' || {_TITLE} || chr(10) || chr(10) || 'Conversion is deferred. The original remains authoritative.' || chr(10) AS body FROM documents""",
    "str15_tables_orders": r"""SELECT o_orderkey, '| Key | State\|x | Priority of it |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |  |' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '|  |  | ' || o_orderpriority || ' |' ELSE '| z |  |  |' END AS markdown FROM orders""",
    "str15_wrapped_lineitem": """WITH x AS (SELECT l_orderkey, l_quantity + 100 AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM lineitem), y AS (SELECT *, max(w) OVER (PARTITION BY l_orderkey) AS m FROM x)
      SELECT l_orderkey, bool_and(k = 1 OR w >= 0.75 * m) AS wrapped FROM y GROUP BY 1""",
    "str15_inline_lineitem": r"""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity) AS i, l_returnflag || ' ' || l_partkey AS t, l_quantity > 25 AS b, l_tax > 0.06 AS it, CASE WHEN l_discount > 0.08 THEN 'http://x/a%20%28b%29' ELSE '' END AS link FROM lineitem),
      s AS (SELECT *, CASE WHEN i % 3 = 0 THEN ' ' ELSE t || CASE WHEN i % 2 = 0 THEN ' ' ELSE '' END END AS text, b || '/' || it || '/' || link AS key FROM r),
      k AS (SELECT *, CASE WHEN i % 3 = 0 AND lag(key) OVER w = lead(key) OVER w THEN lag(key) OVER w ELSE key END AS own FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
      m AS (SELECT *, sum(CASE WHEN own = before THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(own) OVER (PARTITION BY l_orderkey ORDER BY i) AS before FROM k)),
      n AS (SELECT l_orderkey, run, min(own) AS own, string_agg(text, '' ORDER BY i) AS text FROM m GROUP BY 1, 2),
      q AS (SELECT *, trim(text) AS core, CASE WHEN starts_with(own, 'true') THEN '**' ELSE '' END || CASE WHEN contains(own, '/true/') THEN '*' ELSE '' END AS stars, split_part(own, '/', 3) <> '' AS linked FROM n),
      v AS (SELECT l_orderkey, run, CASE WHEN core = '' THEN text ELSE regexp_extract(text, '^ *') || CASE WHEN linked THEN '[' ELSE '' END || stars || core || stars || CASE WHEN linked THEN '](http://x/a%20%28b%29)' ELSE '' END || regexp_extract(text, ' *$') END AS x FROM q)
      SELECT l_orderkey, trim(regexp_replace(string_agg(x, '' ORDER BY run), '[ \t]+', ' ', 'g')) AS markdown FROM v GROUP BY 1""",
    "win14_band_cuts_embeddings": """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 20) AS INTEGER)) AS s FROM embeddings),
      r AS (SELECT vec_id, s, 0 AS top, 0 AS k FROM e UNION ALL SELECT vec_id, s, CASE WHEN cut <= top THEN top + 20 ELSE cut END, k + 1 FROM (
        SELECT vec_id, s, top, k, last - (list_position(list_reverse(s[first + 1 : last + 1]), list_min(s[first + 1 : last + 1])) - 1) AS cut FROM (SELECT *, least(63, top + 20) AS last, least(greatest(top + 1, top + 15), least(63, top + 20)) AS first FROM r WHERE 64 - top > 20)))
      SELECT vec_id, coalesce(string_agg(top::VARCHAR, ',' ORDER BY k) FILTER (k > 0), '') AS cuts FROM r GROUP BY 1""",
    "pol12_families_pages": """WITH p AS (SELECT DISTINCT page_id % 20 AS "set", CASE WHEN page_id % 83 = 0 THEN 'tests/plan.yaml' WHEN page_id % 61 = 0 THEN 'lib/' || page_id ELSE url END AS path FROM pages),
      f AS (SELECT * FROM (VALUES ('a', '^https://.*/1[^/]*$'), ('c', '^http[^/]*://[^/]*/[^/]*5[^/]*$'), ('d', '^https://.*$')) v(family, re)), h AS (SELECT "set", path, family FROM p LEFT JOIN f ON regexp_matches(path, re)),
      g AS (SELECT "set", string_agg(DISTINCT family, ',' ORDER BY family) AS found, bool_or(path = 'tests/plan.yaml') AS own, min(path) FILTER (family IS NULL) AS unknown FROM h GROUP BY 1)
      SELECT "set", CASE WHEN own THEN 'selection-inputs-changed:tests/plan.yaml' WHEN unknown IS NOT NULL THEN 'unowned-path:' || unknown END AS detail, CASE WHEN own OR unknown IS NOT NULL THEN 'a,c,d' ELSE coalesce(found, '') END AS families FROM g""",
    "src20_phases_supplier": """WITH x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 'same-id' WHEN s_suppkey % 11 = 0 THEN 'Bad_' || s_suppkey ELSE 'phase-' || s_suppkey END AS name FROM supplier), y AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'other' ELSE name END AS stem, count(*) FILTER (k % 19 <> 0) OVER (PARTITION BY name) AS same FROM x),
      z AS (SELECT stem || '.md' AS file, CASE WHEN k % 19 = 0 THEN 'no-front-matter' WHEN starts_with(name, 'Bad') THEN 'invalid-id' WHEN stem <> name OR same > 1 THEN 'duplicate-id' WHEN k % 5 = 0 THEN 'state-in-metadata' WHEN k % 7 = 0 THEN 'invalid-order' END AS problem FROM y)
      SELECT problem, count(*) AS n, min(file) AS first FROM z WHERE problem IS NOT NULL GROUP BY 1""",
    "src24_junit_events": """WITH x AS (SELECT user_id, event_id, CAST(round(value, 2) AS DECIMAL(12,2)) AS s, 'tests/' || event_type || '.py::' || event_type || '::t' || event_id AS node FROM events), y AS (SELECT user_id, sum(s) AS total, count(*) AS n, min(node) AS first, bool_or(event_id % 997 = 0) AS bad FROM x GROUP BY 1)
      SELECT user_id, CASE WHEN NOT bad THEN round(CAST(total AS DOUBLE), 2) END AS total, CASE WHEN NOT bad THEN CAST(n AS INTEGER) END AS n, CASE WHEN NOT bad THEN round(CAST(total AS DOUBLE), 2) END AS seconds, CASE WHEN NOT bad THEN first END AS first FROM y""",
    "val13_lessons_part": """SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'unknown-keys' WHEN p_partkey % 17 = 0 THEN 'missing:source' WHEN p_partkey % 7 = 0 THEN 'slug' WHEN p_partkey % 11 = 0 THEN 'title' WHEN p_partkey % 2 = 1 AND p_partkey % 13 = 0 THEN 'status' WHEN p_partkey % 19 = 0 THEN 'filed'
      WHEN p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 'closed' WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'graduated_to' WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'closed-while-open' END AS problem FROM part""",
    "val06_bundles_documents": f"""{_PAGES}, x AS (SELECT *, max(number) OVER (PARTITION BY doc_id) AS n FROM p), y AS (SELECT doc_id, max(n) AS n, bool_or(trim(text) <> '') AS says FROM x GROUP BY 1),
      z AS (SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 37 = 0 THEN 'pages' END, CASE WHEN doc_id % 19 = 0 AND doc_id % 2 = 0 AND n >= 3 THEN 'recognition' END, CASE WHEN (doc_id % 41 <> 0) <> says THEN 'text-layer' END, CASE WHEN doc_id % 17 = 0 AND n >= 2 THEN 'native-changed' END,
        CASE WHEN doc_id % 31 = 0 THEN 'unsafe-path' END, CASE WHEN doc_id % 29 = 0 AND doc_id % 23 <> 0 THEN 'size-or-digest' END, CASE WHEN doc_id % 23 = 0 THEN 'unlisted' END, CASE WHEN doc_id % 23 = 0 THEN 'missing-artifact' END) AS problems FROM y)
      SELECT * FROM z WHERE problems <> ''""",
    "snk06_index_orders": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, '<h2>' || strftime(o_orderdate, '%Y-%m-%d') || '</h2><ul>' || string_agg('<li><a href="o/' || o_orderkey || '.html">Order ' || lpad(o_orderkey::VARCHAR, 9, '0') || '</a></li>', '' ORDER BY lpad(o_orderkey::VARCHAR, 9, '0')) || '</ul>' AS html FROM orders GROUP BY 1""",
    "pol01_endpoints_supplier": """SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'secret:token' WHEN s_suppkey % 17 = 0 THEN 'unknown-key:colour' WHEN s_suppkey % 7 = 0 THEN 'kind' WHEN s_suppkey % 11 = 0 THEN 'egress' WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN 'command' END AS problem FROM supplier""",
    "pol01_stages_customer": """WITH x AS (SELECT c_custkey AS id, c_custkey % 5 AS s, c_custkey % 3 = 0 AS has, c_custkey % 4 = 0 AS applies, CASE WHEN c_custkey % 7 = 0 THEN 'second_pass' WHEN c_custkey % 8 = 0 THEN 'native_pass' ELSE 'applies_to' END AS more, c_custkey % 150 AS e FROM customer),
      y AS (SELECT *, e <= 100 AND e IN (SELECT s_suppkey FROM supplier) AS declared FROM x),
      z AS (SELECT id, CASE WHEN s = 4 THEN 'unknown-stage' WHEN (more = 'second_pass' AND s <> 3) OR (more = 'native_pass' AND s <> 1) THEN 'unknown-key:' || more WHEN applies AND s = 0 THEN 'cannot-act-on:audio' WHEN applies AND s = 1 THEN 'cannot-act-on:audio,image' WHEN applies AND s = 2 THEN 'cannot-act-on:audio' WHEN applies AND s = 3 THEN 'cannot-act-on:image'
        WHEN more = 'second_pass' THEN 'choice:second_pass' WHEN has AND NOT declared THEN 'undeclared:e' || e WHEN NOT has AND s <> 0 THEN 'needs-endpoint' END AS problem FROM y)
      SELECT * FROM z WHERE problem IS NOT NULL""",
    "pol03_reports_orders": """SELECT o_orderkey AS file, ['refinement,transcription', 'ocr,structure', ''][o_orderkey % 3 + 1] AS runs, ['transcription', 'structure', ''][o_orderkey % 3 + 1] AS sends, CASE o_orderkey % 3 WHEN 0 THEN round((o_custkey % 90)::DOUBLE * 0.4::DOUBLE / 60, 4) WHEN 2 THEN 0.0 END AS usd FROM orders""",
    "pol08_semantic_documents": rf"""{_PAGES}, s AS (SELECT doc_id, number, text, CASE WHEN trim(text) <> '' AND number % 3 = 0 THEN 'structure-fallback:Page ' || number END AS flag, replace(text, chr(10), ' ') AS one FROM p),
      w AS (SELECT *, regexp_replace(text, '(?m)^(?:#{{1,6}} |- |> )', '', 'g') AS a, regexp_replace(one, '(?m)^(?:#{{1,6}} |- |> )', '', 'g') AS b FROM s),
      g AS (SELECT doc_id, number, CASE WHEN trim(text) = '' THEN NULL WHEN number % 3 = 0 OR trim(regexp_replace(a, '[ 
]+', ' ', 'g')) <> trim(regexp_replace(b, '[ 
]+', ' ', 'g')) THEN 'structure-fallback:Page ' || number END AS flag, text, one FROM w)
      SELECT doc_id, sha256(string_agg('## Page ' || number || chr(10) || chr(10) || CASE WHEN flag IS NOT NULL OR trim(text) = '' THEN text ELSE one END, chr(10) || chr(10) ORDER BY number)) AS digest, coalesce(string_agg(flag, ',' ORDER BY flag), '') AS flags,
        CASE WHEN bool_or(flag IS NULL) THEN '1:text,2:structure:annotate:m' ELSE '1:text' END AS steps FROM g GROUP BY 1""",
    "agg22_refinements_conversations": r"""WITH tok AS (SELECT conv_id, turn, unnest(k) AS x FROM (SELECT conv_id, turn, regexp_extract_all(text, '\{(?:\\.|[^{}\\])*\}|\S+') AS k FROM conversations)),
      s AS (SELECT conv_id, turn, arg_max(NOT e, i) AS open, sum(CASE WHEN e THEN 1 ELSE 0 END) AS ends FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn) AS i, NOT starts_with(x, '{') AND regexp_matches(x, '[.?!]["”’'')\]]*$') AS e FROM tok) GROUP BY 1, 2),
      c AS (SELECT c.conv_id, c.turn, role, len(list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda w: w <> '')) AS n_words, ends + CASE WHEN open THEN 1 ELSE 0 END AS n_sent, lag(role) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS previous FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn),
      r AS (SELECT *, turn + 4 > least(12, n_words - 1) OR previous IS NULL OR previous = role AS refused FROM c)
      SELECT conv_id, count(*) FILTER (n_words >= 60 AND n_sent >= 3) AS paragraphed_turns, count(*) FILTER (NOT refused) AS proposals, count(*) FILTER (refused) AS refused FROM r GROUP BY 1""",
    "snk10_summary_documents": """WITH x AS (SELECT source, CASE WHEN doc_id % 97 = 0 THEN 'failed' WHEN n_chars % 5 = 0 THEN 'deferred' WHEN n_chars % 41 = 0 THEN 'blocked' ELSE 'processable' END AS o FROM documents),
      y AS (SELECT source, count(*) FILTER (o = 'processable') AS p, count(*) FILTER (o = 'blocked') AS b, count(*) FILTER (o = 'deferred') AS d, count(*) FILTER (o = 'failed') AS f FROM x GROUP BY 1)
      SELECT source, '{"processable":' || p || ',"blocked":' || b || ',"deferred":' || d || ',"failed":' || f || '}' AS json, CAST(CASE WHEN f > 0 THEN 5 WHEN b > 0 THEN 3 WHEN d > 0 THEN 4 ELSE 0 END AS INTEGER) AS exit_code FROM y""",
    "src16_inspections_documents": f"""{_PAGES} SELECT doc_id, CASE WHEN doc_id % 23 <> 0 THEN CAST(count(*) AS INTEGER) END AS page_count, CASE WHEN doc_id % 23 <> 0 THEN coalesce(string_agg('p' || number || '.txt', ',' ORDER BY number) FILTER (length(text) % 100 >= 50), '') END AS covered FROM p GROUP BY 1""",
}
