"""Queries of the smaller relational checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import checks as K

read = lambda spark, d, t: spark.read.parquet(f"{d}/{t}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return x.withColumn("level", F.length("line") % 3)


_LINES = "WITH l AS (SELECT doc_id, i, line, length(line) % 3 AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"


def win10_line_runs_documents(spark, d):
    return K.runs(_lines(spark, d), ["doc_id"], "i", "level").select("doc_id", "run", "first", "n", "value")


def win11_list_items_documents(spark, d):
    return K.items(_lines(spark, d), ["doc_id"], "i", F.col("level") == 0).groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n"))


def win12_merged_runs_documents(spark, d):
    r = K.runs(_lines(spark, d), ["doc_id"], "i", "level")
    return r.groupBy("value").agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("longest"))


def srt01_canonical_events(spark, d):
    """Events that come before the one of the next smaller id."""
    e = read(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("w"))
    return e.withColumn("b", F.lag("w").over(W.partitionBy("event_type").orderBy("event_id"))).where("w <= b").select("event_id", "b")


def set03_missing_fields_events(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.array_join(F.array_except(F.array(F.lit("k"), F.lit("id"), F.lit("at")), F.json_object_keys("props")), ",").alias("missing"))


def set04_exact_keys_events(spark, d):
    e = read(spark, d, "events")
    keys = F.json_object_keys("props")
    want = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("k"))).otherwise(F.array(F.lit("k"), F.lit("x")))
    return e.select("event_id", ((F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)).alias("exact"))


def set08_lineage_events(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts")
    cut = e.groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 5 == 0, F.col("ts"))).alias("accepted"))
    return e.join(cut, "user_id").where("ts <= accepted").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def str12_json_object_events(spark, d):
    answer = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here: "), F.col("props"), F.lit(" ok"))).when(F.col("event_id") % 4 == 1, F.lit("none")).when(F.col("event_id") % 4 == 2, F.lit("{oops}")).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", K.json_object(answer).alias("found"))


def str14_targets_pages(spark, d):
    u = F.concat("url", F.lit(" (x)"))
    return read(spark, d, "pages").select("page_id", F.replace(F.replace(F.replace(u, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")).alias("target"))


def str18_bare_documents(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.explode(T.split_words(F.col("text"))).alias("w"))
    return x.select("doc_id", T.bare(F.col("w")).alias("b")).groupBy("doc_id").agg(F.count_distinct("b").alias("n"), F.sum(F.length("b")).alias("chars"))


def str25_links_pages(spark, d):
    """Links of pages to addresses that no page has."""
    p = read(spark, d, "pages")
    out = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("url"))
    return out.join(p.select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def mat02_dpi_lineitem(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("width"))
    dpi = F.least(F.lit(300.0), F.lit(30_000.0 * 72) / F.col("width"))
    return li.groupBy("l_orderkey").agg(F.round(F.min(dpi), 4).alias("dpi"), F.count_if(F.col("width") / 72 * 300 > 30_000).alias("banded"))


def mat03_timeouts_part(spark, d):
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size")).cast("string"), F.lit(".25"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0000000001"))).otherwise(F.lit("99999999999"))
    return read(spark, d, "part").select("p_partkey", K.exact_nanoseconds(s).alias("ns"))


def dat01_utc_events(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return read(spark, d, "events").select("event_id", text.alias("at"), (F.unix_micros(F.to_timestamp(text)) * 1000).alias("ns"))


def hsh02_derived_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", K.cache_key(F.lit("stage"), F.col("lang"), F.sha2("text", 256)).alias("key"))


def snk08_cache_misses_documents(spark, d):
    x = read(spark, d, "documents").select("doc_id", K.cache_key(F.col("lang"), F.col("text")).alias("key"))
    return K.misses(x, x.where("doc_id % 3 = 0"), "key").select("doc_id")


def jon12_reports_orders(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("run"), "c_mktsegment")
    found = read(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000").select(F.col("o_custkey").alias("run"))
    return K.reports(c, found, "run").groupBy("c_mktsegment", "status").agg(F.count(F.lit(1)).alias("n"))


def jon04_unique_links_supplier(spark, d):
    s = read(spark, d, "supplier")
    return read(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n")).where("n <> 1")


def jon20_same_body_documents(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = x.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return x.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id")


def val11_transitions_events(spark, d):
    """Steps of users that the table of steps doesn't allow."""
    allowed = spark.createDataFrame([("none", "click"), ("none", "view"), ("click", "view"), ("view", "click"), ("view", "purchase"), ("purchase", "view"), ("error", "click"), ("click", "error"), ("view", "error")], "from_state string, to_state string")
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    return K.bad_transitions(e, ["user_id"], "event_id", "event_type", allowed).select("event_id", "from_state", "event_type")


def val12_corrections_events(spark, d):
    e = read(spark, d, "events").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("digest"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    c = e.where("event_id % 10 = 0").select(F.col("digest").alias("target"), (F.col("at") + 5).alias("moved")).union(e.where("event_id % 15 = 0").select("digest", F.col("at") + 9)).union(e.where("event_id % 7 = 0 AND event_id % 10 <> 0 AND event_id % 15 <> 0").select("digest", F.col("at") - 1))
    return K.corrected(e, c, "digest", "at").where("effective <> at").select("event_id", (F.col("effective") - F.col("at")).alias("by"))


def src19_park_misuse_events(spark, d):
    e = read(spark, d, "events").where("event_type IN ('click', 'view')").select("user_id", "event_id", F.when(F.col("event_type") == "click", "open").otherwise("close").alias("kind"))
    return K.misuse(e, "user_id", "event_id", "kind").select("event_id", "kind")


def src23_harvest_documents(spark, d):
    """Hexadecimal words of the documents that hold any, once each."""
    x = read(spark, d, "documents").where(F.col("text").rlike("[0-9a-f]{16}")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{16,}"), F.lit(0))).alias("x"))
    return x.groupBy(F.sha1("x").alias("key")).agg(F.min("doc_id").alias("doc_id"))


def snk07_report_events(spark, d):
    e = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("v"))
    return e.select(F.format_string("%s: %d spans, %s", "event_type", "n", T.elapsed(F.col("v") * 1_000_000_000)).alias("line"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] != "_" and name != "read" and callable(f) and getattr(f, "__module__", "") == __name__}

_RUNS = "r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> level THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l)), g AS (SELECT doc_id, run, min(i) AS first, count(*) AS n, min(level) AS value FROM r GROUP BY 1, 2)"

ORACLES = {
    "win10_line_runs_documents": f"{_LINES}, {_RUNS} SELECT doc_id, CAST(run AS BIGINT) AS run, CAST(first AS INTEGER) AS first, n, CAST(value AS INTEGER) AS value FROM g",
    "win11_list_items_documents": f"{_LINES} SELECT doc_id, CAST(item AS BIGINT) AS item, count(*) AS n FROM (SELECT doc_id, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS item FROM l) GROUP BY 1, 2",
    "win12_merged_runs_documents": f"{_LINES}, {_RUNS} SELECT CAST(value AS INTEGER) AS value, count(*) AS n_runs, max(n) AS longest FROM g GROUP BY 1",
    "srt01_canonical_events": "SELECT event_id, b FROM (SELECT event_id, epoch_us(ts) AS w, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) WHERE w <= b",
    "set03_missing_fields_events": "SELECT event_id, 'id,at' AS missing FROM events",
    "set04_exact_keys_events": "SELECT event_id, event_id % 2 = 0 AS exact FROM events",
    "set08_lineage_events": "SELECT e.user_id, count(*) AS n FROM events e JOIN (SELECT user_id, max(ts) AS accepted FROM events WHERE event_id % 5 = 0 GROUP BY 1) c ON c.user_id = e.user_id AND e.ts <= accepted GROUP BY 1",
    "str12_json_object_events": "SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN props END AS found FROM events",
    "str14_targets_pages": "SELECT page_id, replace(replace(replace(url || ' (x)', ' ', '%20'), '(', '%28'), ')', '%29') AS target FROM pages",
    "str18_bare_documents": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda w: w <> '')) AS w FROM documents), b AS (SELECT doc_id, lower(trim(w, '.,;:?!"''“”‘’()[]')) AS b FROM w)
      SELECT doc_id, count(DISTINCT b) AS n, CAST(sum(length(b)) AS BIGINT) AS chars FROM b GROUP BY 1""",
    "str25_links_pages": """WITH o AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages) SELECT url, count(*) AS n FROM o WHERE url NOT IN (SELECT url FROM pages) GROUP BY 1""",
    "mat02_dpi_lineitem": "SELECT l_orderkey, round(min(least(300.0::DOUBLE, 2160000.0::DOUBLE / (l_extendedprice / 10))), 4) AS dpi, count(*) FILTER (l_extendedprice / 10 / 72 * 300 > 30000) AS banded FROM lineitem GROUP BY 1",
    "mat03_timeouts_part": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::BIGINT * 1000000000 + 250000000 END AS ns FROM part",
    "dat01_utc_events": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, epoch_us(ts) * 1000 AS ns FROM events",
    "hsh02_derived_documents": "SELECT doc_id, sha256('stage' || chr(31) || lang || chr(31) || sha256(text)) AS key FROM documents",
    "snk08_cache_misses_documents": "SELECT doc_id FROM documents WHERE (lang, text) NOT IN (SELECT (lang, text) FROM documents WHERE doc_id % 3 = 0)",
    "jon12_reports_orders": "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000) THEN 'reported' ELSE 'incomplete' END AS status, count(*) AS n FROM customer GROUP BY 1, 2",
    "jon04_unique_links_supplier": "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) <> 1",
    "jon20_same_body_documents": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id",
    "val11_transitions_events": """WITH s AS (SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'none') AS from_state, event_type FROM events)
      SELECT * FROM s WHERE from_state || '>' || event_type NOT IN ('none>click', 'none>view', 'click>view', 'view>click', 'view>purchase', 'purchase>view', 'error>click', 'click>error', 'view>error')""",
    "val12_corrections_events": "SELECT event_id, CAST(CASE WHEN event_id % 10 = 0 THEN 5 ELSE 9 END AS BIGINT) AS by FROM events WHERE (event_id % 10 = 0) <> (event_id % 15 = 0)",
    "src19_park_misuse_events": """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'open' ELSE 'close' END AS kind, lag(CASE event_type WHEN 'click' THEN 'open' ELSE 'close' END) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type IN ('click', 'view'))
      SELECT event_id, kind FROM e WHERE kind = 'open' AND p = 'open' OR kind = 'close' AND (p IS NULL OR p <> 'open')""",
    "src23_harvest_documents": "WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{16,}')) AS x FROM documents) SELECT sha1(x) AS key, min(doc_id) AS doc_id FROM x GROUP BY 1",
    "snk07_report_events": "SELECT event_type || ': ' || n || ' spans, ' || CASE WHEN v >= 3600 THEN (v // 3600) || 'h ' || (v % 3600 // 60) || 'm ' || (v % 60) || 's' WHEN v >= 60 THEN (v // 60) || 'm ' || (v % 60) || 's' ELSE v || '.000s' END AS line FROM (SELECT event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS v FROM events GROUP BY 1)",
}
