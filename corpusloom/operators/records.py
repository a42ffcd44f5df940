"""Records of work: phases, test runs, lessons, bundles, and what to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ledgers as L

#: fixed values: what a lesson may say
LESSON_KEYS = ("slug", "title", "status", "scope", "source", "filed")
OPEN_STATUSES, ARCHIVED_STATUSES = ("open", "accepted"), ("codified", "rejected", "stale")
#: fixed values: values of a recognised page
ROTATIONS, LARGEST_BUNDLE = (0, 90, 180, 270), 2 << 30


def front_matter(text: Column) -> Column:
    """map of the keys and values between the first two --- lines; null without such a block. The last of equal keys counts."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"), x.contains(":").alias("ok"))), lambda p: p["ok"])
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.when(block != "", last)


def phase_problems(phases: DataFrame, file: str = "file", meta: str = "meta") -> DataFrame:
    """file, problem of phase files whose front matter isn't one: id, its place, the order key, or state that events own."""
    m, stem = F.col(meta), T.stem(F.col(file))
    again = F.count(F.lit(1)).over(W.partitionBy(m["id"]))
    order = m["order"]
    rational = order.rlike(r"^-?\d+(\.\d+)?$") | (order.rlike(r"^-?\d+/\d+$") & ~order.rlike(r"/0+$"))
    problem = (
        F.when(m.isNull(), "no-front-matter").when(~F.coalesce(m["id"].rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "invalid-id").when((stem != m["id"]) | (again > 1), "duplicate-id")
        .when(m["status"].isNotNull() | m["owner"].isNotNull(), "state-in-metadata").when(~F.coalesce(rational, F.lit(False)), "invalid-order")
    )
    return phases.select(file, problem.alias("problem")).where("problem IS NOT NULL")


CASE = "_name string, _classname string, _file string, _time string"


def junit(xml: Column) -> Column:
    """struct<total, cases array<struct<node, seconds>>> of a test report; null if a time isn't one, a case repeats or there is none."""
    suite = F.from_xml(xml, f"_time string, testcase array<struct<{CASE}>>")
    cases = F.transform(suite["testcase"], lambda c: F.struct(F.concat(c["_file"], F.lit("::"), F.element_at(F.split(c["_classname"], r"\."), -1), F.lit("::"), c["_name"]).alias("node"), c["_time"].try_cast("double").alias("seconds")))
    total = suite["_time"].try_cast("double")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    ok = sound(total) & (F.size(cases) > 0) & F.forall(cases, lambda c: sound(c["seconds"]) & c["node"].isNotNull()) & (F.size(F.array_distinct(F.transform(cases, lambda c: c["node"]))) == F.size(cases))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(total.alias("total"), cases.alias("cases")))


def lesson_problem(meta: Column, file: Column, archived: Column) -> Column:
    """Why the front matter of a lesson isn't one; null if it is."""
    keys, stem = F.map_keys(meta), T.stem(file)
    allowed = F.array(*map(F.lit, (*LESSON_KEYS, "closed", "graduated_to")))
    missing = F.array_except(F.array(*map(F.lit, LESSON_KEYS)), keys)
    status = F.when(archived, meta["status"].isin(*ARCHIVED_STATUSES)).otherwise(meta["status"].isin(*OPEN_STATUSES))
    return (
        F.when(~stem.rlike("^[a-z]+-[a-z]+$"), F.lit("file-name")).when(meta.isNull(), "no-front-matter").when(F.size(F.array_except(keys, allowed)) > 0, "unknown-keys")
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_min(missing))).when(meta["slug"] != stem, "slug").when(F.trim(meta["title"]) == "", "title").when(~status, "status")
        .when(meta["filed"].try_cast("date").isNull(), "filed").when(archived & meta["closed"].try_cast("date").isNull(), "closed").when(archived & (meta["status"] == "codified") & (F.coalesce(meta["graduated_to"], F.lit("")) == ""), "graduated_to")
        .when(~archived & (meta["closed"].isNotNull() | meta["graduated_to"].isNotNull()), "closed-while-open")
    )


def bundle_problems(bundles: DataFrame, pages: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, problems of recognition bundles whose parts don't fit together.

    bundles: (key, page_count, completeness, has_text_layer, outstanding array<int>). pages: (key, number, method,
    ocr_candidate, native, text, rotation, score, path). files: (key, path, size, sha256, found_size, found_sha256), null
    where there is no file or no entry.
    """
    p = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.count_distinct("number").alias("different"),
        F.bool_or(F.trim("native") != "").alias("says"), F.array_sort(F.collect_set(F.when(F.col("method") == "ocr", F.col("number")))).alias("selected"),
        F.array_sort(F.collect_set(F.when(F.col("ocr_candidate") & (F.col("method") != "ocr"), F.col("number")))).alias("due"),
        F.bool_or((F.col("method") != "ocr") & (F.col("text") != F.col("native"))).alias("changed"), F.bool_or(~F.col("method").isin("ocr", "native-text")).alias("odd"),
        F.bool_or((F.col("method") == "ocr") & (~F.coalesce(F.col("rotation").isin(*ROTATIONS), F.lit(False)) | ~F.coalesce(F.col("score") >= 0, F.lit(False)))).alias("unrecognised"),
    )
    unsafe = F.coalesce(F.col("path"), F.lit("")).rlike(r"^$|\\|(^|/)(\.{0,2})(/|$)")
    f = files.groupBy(key).agg(
        F.bool_or(unsafe).alias("unsafe"), F.bool_or(F.col("size").isNotNull() & ((F.col("size") != F.coalesce("found_size", F.lit(-1))) | (F.col("sha256") != F.coalesce("found_sha256", F.lit(""))))).alias("differs"),
        F.bool_or(F.col("size").isNull()).alias("unlisted"), (F.sum("size") > LARGEST_BUNDLE).alias("large"), F.count_if(F.col("size").isNotNull()).alias("entries"), F.count_distinct(F.when(F.col("size").isNotNull(), F.col("path"))).alias("paths"),
    )
    lost = pages.join(files.where("size IS NOT NULL").select(key, "path").distinct(), [key, "path"], "left_anti").select(key).distinct().withColumn("lost", F.lit(True))
    x = bundles.join(p, key, "left").join(f, key, "left").join(lost, key, "left")
    outstanding = F.array_sort(F.array_distinct("outstanding"))
    label = F.when(F.size("outstanding") > 0, "unrecognized-candidates").when(F.size("selected") > 0, "complete").otherwise("not-requested")
    yes = lambda c: F.coalesce(c, F.lit(False))
    bad = {
        "pages": F.coalesce((F.col("n") != F.col("page_count")) | (F.col("lo") != 1) | (F.col("hi") != F.col("page_count")) | (F.col("different") != F.col("n")), F.lit(True)),
        "outstanding-range": F.exists("outstanding", lambda n: (n < 1) | (n > F.col("page_count"))), "method": yes(F.col("odd")), "recognition": yes(F.col("unrecognised")), "text-layer": yes(F.col("has_text_layer") != F.col("says")),
        "completeness": yes(F.col("completeness") != label), "outstanding": yes(outstanding != F.col("due")), "native-changed": yes(F.col("changed")),
        "unsafe-path": yes(F.col("unsafe")), "size-or-digest": yes(F.col("differs") | F.col("large") | (F.col("entries") != F.col("paths"))), "unlisted": yes(F.col("unlisted")), "missing-artifact": yes(F.col("lost")),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in bad.items())))
    return x.select(key, F.array_join(found, ",").alias("problems")).where("problems <> ''")


def selected_families(changes: DataFrame, rules: DataFrame, key: str, engine: list[str]) -> DataFrame:
    """key, detail, families: what to run for the paths that changed, all families where that isn't sure.

    changes: (key, path); rules: (family, glob). A path of the selection itself (engine) or one that no rule knows widens
    the selection to all families, and detail says why.
    """
    every = rules.agg(F.array_sort(F.collect_set("family"))).first()[0]  # the rules are a small table
    hits = L.matches(changes.select("path").distinct(), rules).groupBy("path").agg(F.collect_set("family").alias("of"))
    by = changes.distinct().join(hits, "path", "left").groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("of", F.array().cast("array<string>")))))).alias("found"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("path").isin(*engine), F.col("path")))), ",").alias("own"), F.min(F.when(F.col("of").isNull(), F.col("path"))).alias("unknown"),
    )
    detail = F.when(F.col("own") != "", F.concat(F.lit("selection-inputs-changed:"), F.col("own"))).when(F.col("unknown").isNotNull(), F.concat(F.lit("unowned-path:"), F.col("unknown")))
    return by.select(key, detail.alias("detail"), F.when(detail.isNotNull(), ",".join(every)).otherwise(F.array_join("found", ",")).alias("families"))


def band_cuts(spread: Column, height: Column, band: float, scale: float = 1.0) -> Column:
    """Where to cut an image of so many rows into bands: the flattest row in the last quarter of each, the lowest of equals.

    spread: array, for each row of a preview (scale times the size) the range of its brightness.
    """
    n = F.size(spread)

    def step(acc: Column, _: Column) -> Column:
        top = acc["top"]
        last = F.least(n - 1, F.floor((top + band) * scale).cast("int"))
        first = F.least(F.greatest(F.floor(top * scale).cast("int") + 1, F.floor((top + band * 0.75) * scale).cast("int")), last)
        window = F.slice(spread, first + 1, last - first + 1)
        row = last - (F.array_position(F.reverse(window), F.array_min(window)).cast("int") - 1)
        cut = F.when(row / scale <= top, top + band).otherwise(row / scale)
        return F.when(height - top > band, F.struct(cut.cast("double").alias("top"), F.concat(acc["cuts"], F.array(cut.cast("double"))).alias("cuts"))).otherwise(acc)

    most = F.ceil(height / (band * 0.25)).cast("int") + 1  # a band is three quarters of band high at least, but where rows are few
    start = F.struct(F.lit(0.0).alias("top"), F.array().cast("array<double>").alias("cuts"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["cuts"])


def index_page(days: DataFrame, day: str, title: str, href: str) -> DataFrame:
    """One row for each day, newest first by ``place``: its number of entries and their list as HTML, in order of titles."""
    item = F.concat(F.lit('<li><a href="'), F.col(href), F.lit('">'), F.col(title), F.lit("</a></li>"))
    by = days.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(title).alias("t"), item.alias("x")))), lambda s: s["x"]), "").alias("items"))
    return by.select(day, "n", F.concat(F.lit("<h2>"), F.col(day), F.lit("</h2><ul>"), F.col("items"), F.lit("</ul>")).alias("html"))
