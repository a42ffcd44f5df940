"""Queries on conversations, structure, sheets, recognition, policy and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ledgers as L
from corpusloom.operators import policy as P
from corpusloom.operators import structure as S
from corpusloom.operators import transcript as C

read = lambda spark, d, t: spark.read.parquet(f"{d}/{t}.parquet")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return C.timed(read(spark, d, "conversations"), "conv_id", "turn", "text")


_T = r"""WITH w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) AS n_words FROM conversations),
t AS (SELECT *, CAST(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) * 400 AS BIGINT) AS end_ms FROM w), c AS (SELECT *, end_ms - n_words * 400 AS start_ms FROM t)"""
_CLOCK = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"
_SENT = r"""tok AS (SELECT conv_id, turn, unnest(k) AS x, generate_subscripts(k, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\{(?:\\.|[^{}\\])*\}|\S+') AS k FROM conversations)),
  num AS (SELECT *, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) - CASE WHEN e THEN 1 ELSE 0 END AS sn FROM (SELECT *, NOT starts_with(x, '{') AND regexp_matches(x, '[.?!]["”’'')\]]*$') AS e FROM tok)),
  sent AS (SELECT conv_id, turn, sn, string_agg(x, ' ' ORDER BY i) AS s FROM num GROUP BY 1, 2, 3)"""


def src14_transcript_conversations(spark, d):
    t = _turns(spark, d)
    return t.select("conv_id", "turn", C.heading(F.col("start_ms"), F.col("end_ms"), F.col("role")).alias("heading"), F.sha2("text", 256).alias("digest"))


def str24_clock_conversations(spark, d):
    t = _turns(spark, d)
    return t.select("conv_id", "turn", T.clock(F.col("start_ms") + F.col("turn")).alias("clock"), T.elapsed(F.col("end_ms") * 1_000_000).alias("elapsed"))


def str16_sentences_conversations(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(T.sentences(F.col("text"))).alias("n_sentences"), T.is_long(F.col("text")).alias("is_long"), F.sha2(F.array_join(T.sentences(F.col("text")), "|"), 256).alias("digest"))


def str17_paragraphs_conversations(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.sha2(C.paragraphs(F.col("text"), F.array(F.lit(2), F.lit(4))), 256).alias("digest"))


def win04_windows_conversations(spark, d):
    c = read(spark, d, "conversations").withColumn("size", F.length("text"))
    return C.windows(c, "conv_id", "turn", "size", 1500)


def win05_neighbours_conversations(spark, d):
    c = read(spark, d, "conversations")
    w = C.windows(c.withColumn("size", F.length("text")), "conv_id", "turn", "size", 1500)
    return C.neighbours(c.join(w, ["conv_id", "turn"]), ["conv_id", "window"], "turn", "role").select("conv_id", "turn", "window", "previous", "next")


def agg23_speakers_conversations(spark, d):
    return C.speakers(_turns(spark, d), ["conv_id"], "role")


def val08_proposals_conversations(spark, d):
    """Each turn proposes to move turn + 10 words to the speaker before, and its first token as a spelling."""
    c = _turns(spark, d)
    n = C.neighbours(c, ["conv_id"], "turn", "role")
    moved = C.boundary_refused(F.col("turn") + 10, F.col("n_words"), F.col("role"), F.col("previous"))
    heard = F.substring_index("text", " ", 1)
    spelling = C.spelling_refused(heard, F.concat(heard, F.lit(" x y "), F.when(F.col("turn") % 2 == 0, "z").otherwise("")), F.col("text"))
    return n.select("conv_id", "turn", moved.alias("boundary"), spelling.alias("spelling"))


def jon22_names_conversations(spark, d):
    """Turns with the name that their identity stands for."""
    names = spark.createDataFrame([("user", "Asker"), ("assistant", "Answerer"), ("system", "Asker")], "role string, name string")
    return _turns(spark, d).join(names, "role").groupBy("conv_id", "name").agg(F.count(F.lit(1)).alias("turns"), F.sum("n_words").alias("words"))


def _blocks(spark, d):
    """Lines of documents three by three as blocks of kinds by turns."""
    x = read(spark, d, "documents").select("doc_id", "text", F.split("text", "\n").alias("l"))
    b = x.select("doc_id", "text", F.size("l").alias("n_lines"), F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("l") / 3).cast("int") - 1), lambda i: F.slice("l", i * 3 + 1, 3))).alias("b", "lines"))
    kind = F.element_at(F.array(*map(F.lit, S.KINDS[:5])), (F.col("b") % 5).cast("int") + 1)
    return b.withColumn("kind", kind).withColumn("first", F.col("b") * 3 + 1).withColumn("last", F.least(F.col("b") * 3 + 3, F.col("n_lines")))


_BLOCKS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents),
k AS (SELECT doc_id, i // 3 AS b, ['heading', 'paragraph', 'list_item', 'list', 'quote'][i // 3 % 5 + 1] AS kind, string_agg(trim(x), ' ' ORDER BY i) FILTER (trim(x) <> '') AS joined,
  string_agg('- ' || trim(x), chr(10) ORDER BY i) FILTER (trim(x) <> '') AS listed, string_agg('> ' || trim(x), chr(10) ORDER BY i) FILTER (trim(x) <> '') AS quoted FROM l GROUP BY 1, 2, 3),
o AS (SELECT doc_id, b, CASE kind WHEN 'heading' THEN '### ' || joined WHEN 'paragraph' THEN joined WHEN 'list_item' THEN '- ' || joined WHEN 'list' THEN listed ELSE quoted END AS t, kind FROM k),
g AS (SELECT doc_id, string_agg(CASE WHEN pk IS NULL THEN '' WHEN pk = 'list_item' AND kind = 'list' THEN chr(10) ELSE chr(10) || chr(10) END || t, '' ORDER BY b) AS groomed FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY b) AS pk FROM o WHERE t IS NOT NULL) GROUP BY 1)"""


def str13_apply_blocks_documents(spark, d):
    b = _blocks(spark, d).withColumn("t", S.block_text(F.col("lines"), F.col("kind"), F.lit(1)))
    return b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("b", "t"))).alias("a")).select("doc_id", F.sha2(S.applied(F.transform("a", lambda x: x["t"])), 256).alias("digest"))


def val01_gate_documents(spark, d):
    """The gate over groomed documents; every sixth lost a word."""
    b = _blocks(spark, d).withColumn("t", S.block_text(F.col("lines"), F.col("kind"), F.lit(1)))
    g = b.groupBy("doc_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("b", "t"))).alias("a")).select("doc_id", "text", S.applied(F.transform("a", lambda x: x["t"])).alias("g"))
    r = S.gated(F.col("text"), F.when(F.col("doc_id") % 6 == 0, F.concat("g", F.lit(" more"))).when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise(F.col("g")))
    return g.select("doc_id", r["reason"].alias("reason"), (r["text"] == F.col("text")).alias("kept_text"))


def val02_proposals_documents(spark, d):
    x = read(spark, d, "documents")
    p = F.array(F.concat("text", F.lit(" extra")), F.concat(F.lit("**"), F.col("text"), F.lit("**")), F.col("text"))
    return x.select("doc_id", F.length(S.first_matching(F.col("text"), p)).alias("n"))


def win02_block_cover_documents(spark, d):
    """Covers of which every fourth document lost its second block and every ninth its last."""
    b = _blocks(spark, d).withColumn("lastb", F.max("b").over(W.partitionBy("doc_id")))
    return S.cover_problems(b.where("NOT (doc_id % 4 = 0 AND b = 1) AND NOT (doc_id % 9 = 0 AND b = lastb)"), ["doc_id"], "first", "last", "n_lines")


def agg01_typography_lineitem(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.floor(F.col("l_quantity") / 10) + 8).cast("double").alias("size"), F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("text"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("pos"))
    return S.typography(li, "doc", "size", "text", "pos")


def flt15_usable_tables_orders(spark, d):
    o = read(spark, d, "orders")
    rows = F.array(F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "x")), F.array(F.when(F.col("o_orderkey") % 3 == 0, "y"), F.lit(" ")))
    return o.select("o_orderkey", S.usable_table(rows).alias("usable"))


def jon08_lines_in_tables_lineitem(spark, d):
    """Items as lines of a page (an order), every third item as a table on it."""
    li = read(spark, d, "lineitem")
    line = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 4).alias("x1"), (F.col("l_discount") * 100 + 2).alias("y1"))
    tab = line.where("line % 3 = 0").select("page", F.col("line").alias("tab"), (F.col("x0") - 8).alias("tx0"), (F.col("y0") - 4).alias("ty0"), (F.col("x1") + 8).alias("tx1"), (F.col("y1") + 4).alias("ty1"))
    return S.inside_tables(line, tab, ["page"])


def _cells(spark, d):
    li = read(spark, d, "lineitem").withColumn("full", F.col("l_linenumber") != 2)  # an empty row of each sheet
    values = F.array(F.col("l_returnflag"), F.concat(F.lit("a,"), F.col("l_linestatus")), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit('q"'), F.col("l_partkey").cast("string"))))
    return li.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), F.posexplode(F.when(F.col("full"), values)).alias("c", "value")).where("value IS NOT NULL").groupBy("sheet", "row", (F.col("c") + 1).alias("col")).agg(F.min("value").alias("value"))  # the table repeats line numbers


def agg03_sheet_extents_lineitem(spark, d):
    merges = read(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("sheet"), F.lit(1).alias("r1"), F.lit(1).alias("c1"), F.lit(5).alias("r2"), F.lit(6).alias("c2"))
    return S.sheet_extents(_cells(spark, d), merges, ["sheet"])


def str23_sheet_csv_lineitem(spark, d):
    return S.sheet_rows(_cells(spark, d), ["sheet"], 3)


def str21_columns_part(spark, d):
    p = read(spark, d, "part")
    name = T.column_letter(F.col("p_partkey"))
    return p.select("p_partkey", name.alias("letters"), T.column_index(name).alias("index"), S.range_name(F.lit(1), F.lit(1), F.lit(7), F.col("p_partkey")).alias("range"))


def agg04_tsv_score_lineitem(spark, d):
    li = read(spark, d, "lineitem")
    w = li.select(F.col("l_orderkey").alias("page"), F.floor((F.col("l_linenumber") - 1) / 2).alias("line"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 100).alias("conf"), F.concat("l_returnflag", F.lit("-"), F.col("l_suppkey").cast("string")).alias("text"), F.lit(10).alias("width"), (F.col("l_linenumber") * 8).alias("height"))
    return S.recognised(w, ["page"])


def agg05_rotation_argmax_embeddings(spark, d):
    """Four angles, each scored by every fourth component of a vector: the best, or 0 without any."""
    e = read(spark, d, "embeddings")
    c = e.select("vec_id", F.posexplode("embedding").alias("i", "x")).groupBy("vec_id", (F.col("i") % 4 * 90).alias("angle")).agg(F.sum(F.floor(F.col("x").cast("double") * 4)).alias("score"))
    return S.best_rotation(c, ["vec_id"])


def hsh03_hamming_embeddings(spark, d):
    """64-bit signs of vectors: the distance of each to that of the vector before."""
    e = read(spark, d, "embeddings")
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda acc, x: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    h = e.select("vec_id", bits.alias("h"))
    b = h.select((F.col("vec_id") + 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(b, "vec_id").select("vec_id", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("distance"))


def pol02_plan_documents(spark, d):
    media = read(spark, d, "documents").select(F.concat(F.element_at(F.array(F.lit("text/"), F.lit("image/"), F.lit("audio/"), F.lit("application/")), (F.col("doc_id") % 4).cast("int") + 1), F.col("lang")).alias("media_type")).distinct()
    stages = spark.createDataFrame([("ocr", True, ["application", "image"], "local"), ("transcribe", True, ["audio", "video"], "speech"), ("structure", False, ["application", "text"], "hosted"), ("refine", True, ["audio"], "hosted"), ("describe", True, ["image"], "none")], "stage string, enabled boolean, applies array<string>, endpoint string")
    ends = spark.createDataFrame([("local", "local", True), ("speech", "hosted", True), ("hosted", "hosted", False)], "endpoint string, egress string, key_set boolean")
    return P.plan(media, stages, ends)


def pol04_decide_orders(spark, d):
    o = read(spark, d, "orders")
    mode = F.element_at(F.array(F.lit("auto"), F.lit("on"), F.lit("off")), (F.col("o_orderkey") % 3).cast("int") + 1)
    return o.select("o_orderkey", P.second_pass(mode, F.col("o_totalprice") / 10_000).alias("second_pass"))


def pol05_budget_orders(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("minutes"))
    return P.budget(o, "run", "o_orderkey", "minutes", 500.0)


def pol06_page_limit_lineitem(spark, d):
    return P.over_limit(read(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 20, 3)


def agg06_estimate_orders(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 40 != 0, F.lit(3.0)).alias("rate"), (F.col("o_orderkey") % 2 + 1).alias("passes"), F.floor(F.col("o_totalprice") / 1000).alias("minutes"))
    return P.estimates(o, ["o_custkey"])


def agg07_call_costs_events(spark, d):
    e = read(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("endpoint"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("outcome"), F.floor("value").alias("seconds"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return P.call_costs(e, ["event_type", "endpoint"])


def mat01_ocr_jobs_supplier(spark, d):
    s = read(spark, d, "supplier")
    return s.select("s_suppkey", P.ocr_jobs(F.col("s_suppkey") % 7 + 1, F.col("s_nationkey") + 1).alias("jobs"))


def _graph(spark, d):
    """Edges supplier to nation to region, and nation to nation of the next key in its region."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("dst"))
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("dst"))
    return s.union(n)


def jon07_reachability_tpch(spark, d):
    return L.closure(_graph(spark, d))


def jon18_dag_closure_tpch(spark, d):
    """How many nodes each node of the graph reaches."""
    return L.closure(_graph(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def jon05_dangling_orders(spark, d):
    """Customers without an order."""
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def jon14_symmetric_difference_events(spark, d):
    e = read(spark, d, "events")
    return L.symmetric_difference(e.where("event_id % 3 = 0"), e.where("event_type = 'purchase'"), ["event_id"])


def jon16_glob_join_pages(spark, d):
    rules = spark.createDataFrame([("a", "https://**/1*"), ("b", "https://**"), ("c", "http*://*/*5*"), ("d", "**.html")], "family string, glob string")
    return L.families(read(spark, d, "pages").select("page_id", F.col("url").alias("path")).dropDuplicates(["path"]).select("path"), rules)


def jon17_mentions_benchmark_documents(spark, d):
    """Documents that hold a benchmark item's whole text."""
    hits = L.mentions(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")), "doc_id", "text", "item_id", "passage")
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def win08_chronology_events(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return L.regressions(e, ["user_id"], "event_id", "at").select("event_id", "before")


def win09_chain_heads_events(spark, d):
    """A user's events as a chain by id; every event whose id divides by 97 names the one before its predecessor."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("p1"), F.lag("event_id", 2).over(w).alias("p2"))
    return L.chain_heads(e.select("user_id", "event_id", F.when(F.col("event_id") % 97 == 0, F.col("p2")).otherwise(F.col("p1")).alias("previous")), "user_id", "event_id", "previous")


def win13_week_of_month_events(spark, d):
    return read(spark, d, "events").groupBy(L.week_of_month(F.col("ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def agg17_summary_events(spark, d):
    """Counts by type, by user's tens and by both."""
    e = read(spark, d, "events").select("event_type", F.floor(F.col("user_id") / 10).alias("team"))
    kind, team = F.col("event_type"), F.col("team")
    return e.groupingSets([[kind], [team], [kind, team]], kind, team).agg(F.count(F.lit(1)).alias("n"))


def agg18_reaimed_events(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_distinct(F.to_date("ts")).alias("n_days")).where("n_days > 1")


def agg20_timing_events(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("total"), "event_type").limit(5)


def flt13_aged_events(spark, d):
    return L.aged(read(spark, d, "events"), "user_id", "ts", F.lit("2024-03-29").cast("date"))


def srt04_semantic_order_part(spark, d):
    p = read(spark, d, "part").select(F.concat_ws(".", (F.col("p_partkey") % 12).cast("string"), (F.col("p_size")).cast("string"), F.col("p_partkey").cast("string")).alias("phase"))
    return p.select("phase", F.row_number().over(W.partitionBy(F.substring_index("phase", ".", 1)).orderBy(L.semantic_key(F.col("phase")))).alias("place"))


def set02_first_seen_events(spark, d):
    return read(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_id"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] != "_" and name != "read" and callable(f) and getattr(f, "__module__", "") == __name__}

_CELLS = """WITH v AS (SELECT l_orderkey AS sheet, l_linenumber AS row, min(l_returnflag) AS v1, min('a,' || l_linestatus) AS v2, min(CASE WHEN l_partkey % 2 = 0 THEN 'q"' || l_partkey END) AS v3 FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2)"""
_WINDOWS = """o AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  r AS (SELECT conv_id, turn, k, s AS used, 1 AS "window" FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.turn, o.k, CASE WHEN r.used > 0 AND r.used + o.s > 1500 THEN o.s ELSE r.used + o.s END, CASE WHEN r.used > 0 AND r.used + o.s > 1500 THEN r."window" + 1 ELSE r."window" END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)"""
_LETTERS = "CASE WHEN p > 702 THEN chr(65 + CAST((p - 703) // 676 AS INTEGER)) ELSE '' END || CASE WHEN p > 26 THEN chr(65 + CAST((p - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(65 + CAST((p - 1) % 26 AS INTEGER))"
_EDGES = "e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), c AS (SELECT src, dst FROM e UNION SELECT e.src, c.dst FROM e JOIN c ON e.dst = c.src)"

ORACLES = {
    "src14_transcript_conversations": f"{_T} SELECT conv_id, turn, {_CLOCK.format('start_ms')} || ' --> ' || {_CLOCK.format('end_ms')} || ' · ' || role AS heading, sha256(text) AS digest FROM c",
    "str24_clock_conversations": f"{_T} SELECT conv_id, turn, {_CLOCK.format('(start_ms + turn)')} AS clock, CASE WHEN end_ms < 60000 THEN (end_ms // 1000) || '.' || lpad(CAST(end_ms % 1000 AS VARCHAR), 3, '0') || 's' WHEN end_ms // 3600000 > 0 THEN (end_ms // 3600000) || 'h ' || (end_ms // 60000 % 60) || 'm ' || (end_ms // 1000 % 60) || 's' ELSE (end_ms // 60000) || 'm ' || (end_ms // 1000 % 60) || 's' END AS elapsed FROM c",
    "str16_sentences_conversations": f"{_T}, {_SENT} SELECT c.conv_id, c.turn, CAST(n AS INTEGER) AS n_sentences, n_words >= 60 AND n >= 3 AS is_long, digest FROM c JOIN (SELECT conv_id, turn, count(*) AS n, sha256(string_agg(s, '|' ORDER BY sn)) AS digest FROM sent GROUP BY 1, 2) x ON x.conv_id = c.conv_id AND x.turn = c.turn",
    "str17_paragraphs_conversations": f"{_T}, {_SENT} SELECT c.conv_id, c.turn, sha256(CASE WHEN n_words >= 60 AND n >= 3 THEN p ELSE text END) AS digest FROM c JOIN (SELECT conv_id, turn, count(*) AS n, string_agg(CASE WHEN sn = 0 THEN '' WHEN sn IN (1, 3) THEN chr(10) || chr(10) ELSE ' ' END || s, '' ORDER BY sn) AS p FROM sent GROUP BY 1, 2) x ON x.conv_id = c.conv_id AND x.turn = c.turn",
    "win04_windows_conversations": f'WITH RECURSIVE {_WINDOWS} SELECT conv_id, turn, "window" FROM r',
    "win05_neighbours_conversations": f'WITH RECURSIVE {_WINDOWS} SELECT r.conv_id, r.turn, "window", lag(role) OVER w AS previous, lead(role) OVER w AS next FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn WINDOW w AS (PARTITION BY r.conv_id, "window" ORDER BY r.turn)',
    "agg23_speakers_conversations": f"{_T} SELECT conv_id, role, count(*) AS turns, CAST(sum(n_words) AS BIGINT) AS words, round(sum(end_ms - start_ms) / 1000, 3) AS seconds, min(start_ms) AS first_start FROM c GROUP BY 1, 2",
    "val08_proposals_conversations": f"""{_T}, n AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM c)
      SELECT conv_id, turn, CASE WHEN turn + 10 > least(12, n_words - 1) THEN 'too-many-words' WHEN previous IS NULL THEN 'no-neighbour' WHEN previous = role THEN 'same-speaker' END AS boundary,
      CASE WHEN len(list_filter(regexp_split_to_array(split_part(text, ' ', 1) || ' x y ' || CASE WHEN turn % 2 = 0 THEN 'z' ELSE '' END, '[ \\t\\n]+'), lambda w: w <> '')) > 3 THEN 'too-many-words' WHEN regexp_matches(split_part(text, ' ', 1), '[|`\\n{{}}]') THEN 'characters' END AS spelling FROM n""",
    "jon22_names_conversations": f"{_T} SELECT conv_id, CASE role WHEN 'assistant' THEN 'Answerer' ELSE 'Asker' END AS name, count(*) AS turns, CAST(sum(n_words) AS BIGINT) AS words FROM c GROUP BY 1, 2",
    "str13_apply_blocks_documents": f"{_BLOCKS} SELECT doc_id, sha256(groomed) AS digest FROM g",
    "val01_gate_documents": f"{_BLOCKS} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'words-changed' WHEN doc_id % 10 = 1 THEN 'unusable-annotations' END AS reason, doc_id % 6 = 0 OR doc_id % 10 = 1 OR groomed = text AS kept_text FROM g JOIN documents USING (doc_id)",
    "val02_proposals_documents": "SELECT doc_id, CAST(length(text) + 4 AS INTEGER) AS n FROM documents",
    "win02_block_cover_documents": """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), b AS (SELECT doc_id, n, unnest(range((n + 2) // 3)) AS b FROM l),
      k AS (SELECT doc_id, n, b, max(b) OVER (PARTITION BY doc_id) AS lastb FROM b), m AS (SELECT * FROM k WHERE NOT (doc_id % 4 = 0 AND b = 1) AND NOT (doc_id % 9 = 0 AND b = lastb)),
      o AS (SELECT doc_id, n, b, b * 3 + 1 <> coalesce(lag(least(b * 3 + 3, n)) OVER (PARTITION BY doc_id ORDER BY b), 0) + 1 AS bad FROM m)
      SELECT doc_id, CASE WHEN bool_or(bad) THEN 'order' ELSE 'stops-early' END AS problem FROM o GROUP BY doc_id HAVING bool_or(bad) OR max(least(b * 3 + 3, n)) <> max(n)""",
    "agg01_typography_lineitem": """WITH r AS (SELECT l_orderkey AS doc, CAST(floor(l_quantity / 10) + 8 AS DOUBLE) AS size, length(l_returnflag || ' ' || l_linestatus || ' ' || l_partkey) AS n, l_linenumber::BIGINT * 1000000000 + l_partkey AS pos FROM lineitem),
      b AS (SELECT doc, size, sum(n) AS weight, min(pos) AS first FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, first, size DESC) AS place FROM b), t AS (SELECT doc, max(CASE WHEN place = 1 THEN size END) AS body_size, CAST(sum(weight) AS BIGINT) AS total_chars FROM k GROUP BY 1),
      h AS (SELECT b.doc, CAST(sum(weight) AS BIGINT) AS heading_chars, count(*) AS n_heading_sizes FROM b JOIN t USING (doc) WHERE size >= 1.15::DOUBLE * body_size GROUP BY 1)
      SELECT doc, body_size, coalesce(heading_chars, 0) AS heading_chars, coalesce(n_heading_sizes, 0) AS n_heading_sizes, total_chars, total_chars > 0 AND coalesce(heading_chars, 0) <= 0.3::DOUBLE * total_chars AS credible FROM t LEFT JOIN h USING (doc)""",
    "flt15_usable_tables_orders": "SELECT o_orderkey, 1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END >= 2 AS usable FROM orders",
    "jon08_lines_in_tables_lineitem": """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 4 AS x1, l_discount * 100 + 2 AS y1 FROM lineitem), t AS (SELECT page, line AS tab, x0 - 8 AS tx0, y0 - 4 AS ty0, x1 + 8 AS tx1, y1 + 4 AS ty1 FROM l WHERE line % 3 = 0)
      SELECT page, line, min(tab) AS tab FROM l JOIN t USING (page) WHERE (x0 + x1) / 2 BETWEEN tx0 AND tx1 AND (y0 + y1) / 2 BETWEEN ty0 AND ty1 GROUP BY 1, 2""",
    "agg03_sheet_extents_lineitem": f"""{_CELLS} SELECT sheet, CAST(greatest(max(row), CASE WHEN sheet % 4 = 0 THEN 5 ELSE 0 END) AS INTEGER) AS rows, CAST(greatest(max(CASE WHEN v3 IS NOT NULL THEN 3 ELSE 2 END), CASE WHEN sheet % 4 = 0 THEN 6 ELSE 0 END) AS INTEGER) AS columns,
      greatest(max(row), CASE WHEN sheet % 4 = 0 THEN 5 ELSE 0 END) - 1 - count(DISTINCT row) FILTER (row > 1) AS elided FROM v GROUP BY sheet""",
    "str23_sheet_csv_lineitem": f"""{_CELLS} SELECT sheet, row, CASE WHEN row = 1 THEN 'row' ELSE CAST(row AS VARCHAR) END || ',' || v1 || ',"' || v2 || '",' || CASE WHEN v3 IS NULL THEN '' ELSE '"' || replace(v3, '"', '""') || '"' END AS line FROM v""",
    "str21_columns_part": f'WITH q AS (SELECT p_partkey, p_partkey AS p FROM part) SELECT p_partkey, CASE WHEN p < 1 THEN \'\' ELSE {_LETTERS} END AS letters, nullif(p, 0) AS "index", \'A1:\' || CASE WHEN p < 1 THEN \'\' ELSE {_LETTERS} END || \'7\' AS "range" FROM q',
    "agg04_tsv_score_lineitem": r"""WITH w AS (SELECT l_orderkey AS page, (l_linenumber - 1) // 2 AS line, l_linenumber AS seq, l_partkey % 100 AS conf, l_returnflag || '-' || l_suppkey AS text, l_linenumber * 8 <= 30 AS flat FROM lineitem),
      l AS (SELECT page, line, string_agg(text, ' ' ORDER BY seq, text) AS t, sum(CASE WHEN flat THEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) * greatest(0, conf - 50) ELSE 0 END) AS s FROM w GROUP BY 1, 2)
      SELECT page, CAST(sum(s) AS BIGINT) AS score, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1""",
    "agg05_rotation_argmax_embeddings": "WITH c AS (SELECT vec_id, (i - 1) % 4 * 90 AS angle, CAST(sum(score) AS BIGINT) AS score FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4) AS BIGINT))) AS score FROM embeddings) GROUP BY 1, 2) SELECT vec_id, angle, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, angle) AS k FROM c) WHERE k = 1",
    "hsh03_hamming_embeddings": "SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
    "pol02_plan_documents": """WITH m AS (SELECT DISTINCT ['text/', 'image/', 'audio/', 'application/'][doc_id % 4 + 1] || lang AS media_type, ['text', 'image', 'audio', 'application'][doc_id % 4 + 1] AS c FROM documents),
      s AS (SELECT * FROM (VALUES ('ocr', true, ['application', 'image'], 'local', true), ('transcribe', true, ['audio', 'video'], 'hosted', true), ('structure', false, ['application', 'text'], 'hosted', false), ('refine', true, ['audio'], 'hosted', false), ('describe', true, ['image'], NULL, NULL)) v(stage, enabled, applies, egress, key_set))
      SELECT media_type, stage, reason = 'runs' AS runs, reason FROM (SELECT media_type, stage, CASE WHEN NOT list_contains(applies, c) THEN 'not-applicable' WHEN NOT enabled THEN 'disabled' WHEN egress IS NULL THEN 'no-endpoint' WHEN egress = 'hosted' AND NOT key_set THEN 'key-missing' ELSE 'runs' END AS reason FROM m, s)""",
    "pol04_decide_orders": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN true WHEN 2 THEN false ELSE o_totalprice / 10000 >= 25 END AS second_pass FROM orders",
    "pol05_budget_orders": """WITH RECURSIVE o AS (SELECT o_custkey AS run, o_orderkey, floor(o_totalprice / 1000) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
      r AS (SELECT run, o_orderkey, k, CASE WHEN m <= 500 THEN m ELSE 0 END AS used, m <= 500 AS accepted FROM o WHERE k = 1 UNION ALL SELECT o.run, o.o_orderkey, o.k, CASE WHEN r.used + o.m <= 500 THEN r.used + o.m ELSE r.used END, r.used + o.m <= 500 FROM r JOIN o ON o.run = r.run AND o.k = r.k + 1)
      SELECT run, o_orderkey, accepted FROM r""",
    "pol06_page_limit_lineitem": "SELECT l_orderkey, count(*) AS n_pages FROM lineitem WHERE l_quantity > 20 GROUP BY 1 HAVING count(*) > 3",
    "agg06_estimate_orders": "SELECT o_custkey, CASE WHEN bool_and(o_orderkey % 40 <> 0) THEN round_even(sum(3.0::DOUBLE * (o_orderkey % 2 + 1) * floor(o_totalprice / 1000) / 60), 4) END AS usd FROM orders GROUP BY 1",
    "agg07_call_costs_events": "SELECT event_type, user_id % 5 AS endpoint, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(floor(value)) AS BIGINT) AS seconds, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2",
    "mat01_ocr_jobs_supplier": "SELECT s_suppkey, CAST(greatest(1, (s_nationkey + 1) // least(s_suppkey % 7 + 1, s_nationkey + 1)) AS INTEGER) AS jobs FROM supplier",
    "jon07_reachability_tpch": f"WITH RECURSIVE {_EDGES} SELECT src, dst FROM c",
    "jon18_dag_closure_tpch": f"WITH RECURSIVE {_EDGES} SELECT src, count(*) AS n FROM c GROUP BY 1",
    "jon05_dangling_orders": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "jon14_symmetric_difference_events": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM events WHERE (event_id % 3 = 0) <> (event_type = 'purchase')",
    "jon16_glob_join_pages": """WITH p AS (SELECT DISTINCT url AS path FROM pages), r AS (SELECT * FROM (VALUES ('a', '^https://.*/1[^/]*$'), ('b', '^https://.*$'), ('c', '^http[^/]*://[^/]*/[^/]*5[^/]*$'), ('d', '^.*\\.html$')) v(family, re))
      SELECT path, count(family) AS n, min(family) AS family FROM p LEFT JOIN r ON regexp_matches(path, re) GROUP BY 1""",
    "jon17_mentions_benchmark_documents": "SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1",
    "win08_chronology_events": "SELECT event_id, before FROM (SELECT event_id, epoch_us(ts) AS w, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE w < before",
    "win09_chain_heads_events": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN lag(event_id, 2) OVER w ELSE lag(event_id) OVER w END AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      f AS (SELECT user_id, previous, count(*) AS n FROM e WHERE previous IS NOT NULL GROUP BY 1, 2)
      SELECT e.user_id, max(CASE WHEN n IS NULL THEN event_id END) AS head, count(*) FILTER (n IS NULL) AS n_heads, count(*) FILTER (e.previous IS NULL) AS n_genesis, count(*) FILTER (n > 1) AS forks FROM e LEFT JOIN f ON e.user_id = f.user_id AND e.event_id = f.previous GROUP BY 1""",
    "win13_week_of_month_events": "SELECT strftime(ts, '%Y-%m') || '-W' || ((day(ts) - 1) // 7 + 1) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "agg17_summary_events": "SELECT event_type, user_id // 10 AS team, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id // 10), (event_type, user_id // 10))",
    "agg18_reaimed_events": "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) > 1",
    "agg20_timing_events": "SELECT event_type, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1 ORDER BY total DESC, event_type LIMIT 5",
    "flt13_aged_events": "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1 HAVING count(*) >= 3 AND date_diff('day', CAST(max(ts) AS DATE), DATE '2024-03-29') >= 60",
    "srt04_semantic_order_part": "SELECT phase, CAST(row_number() OVER (PARTITION BY a ORDER BY b, p_partkey) AS INTEGER) AS place FROM (SELECT (p_partkey % 12) || '.' || p_size || '.' || p_partkey AS phase, p_partkey % 12 AS a, p_size AS b, p_partkey FROM part)",
    "set02_first_seen_events": "SELECT event_type, user_id, min(event_id) AS first_id FROM events GROUP BY 1, 2",
}
