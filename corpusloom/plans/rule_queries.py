"""Queries on reviews, quotas, ledgers, logs and orders of work."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import order as O  # noqa: E741
from corpusloom.operators import mirror as M
from corpusloom.operators import reviews as V
from corpusloom.plans.mirror_queries import _PAGES, _pages
from corpusloom.plans.span_queries import _union_sql

read = lambda spark, d, t: spark.read.parquet(f"{d}/{t}.parquet")


def _blocks(spark, d):
    """Orders as blocks of reviews: verdicts, templates, quoted files, hits of searches and prose."""
    o = read(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    name = F.concat(F.lit("finding "), (F.col("k") % 40).cast("string"))
    body = F.concat(F.lit("## Verdict: "), F.when(F.col("k") % 2 == 0, "APPROVED").otherwise("REVISE"), F.lit("\n"), name, F.when(F.col("k") % 3 == 0, "  see\tPLAN-F").otherwise(" see"), F.when(F.col("k") % 4 == 0, " CODE-F").otherwise(""))
    body = F.when(F.col("k") % 11 == 0, F.concat(body, F.lit("\n## Rules"))).when(F.col("k") % 13 == 0, F.concat(body, F.lit("\n1\tx\n2\ty\n 3: z"))).when(F.col("k") % 17 == 0, F.concat(body, F.lit(" a.py-12-b"))).when(F.col("k") % 19 == 0, F.concat(F.lit("x "), body)).otherwise(body)
    ids = F.when(F.col("k") % 5 == 0, F.array(F.lit("X-1"), F.when(F.col("k") % 10 == 0, "CODE-F2").otherwise("PLAN-F1"))).otherwise(F.array().cast("array<string>"))
    before = F.concat(F.when(F.col("k") % 7 == 0, "PLAN-F ").otherwise("CODE-F "), F.repeat(F.lit("x"), F.when(F.col("k") % 6 == 0, 4000).otherwise(10)))
    return o.select("k", body.alias("block"), F.concat(F.lit('[{"n": '), (F.col("k") % 6).cast("string"), F.lit("}]")).alias("findings"), ids.alias("ids"), before.alias("preceding"))


def flt12_verdicts_orders(spark, d):
    x = _blocks(spark, d)
    return x.select("k", V.genuine(F.col("block")).alias("genuine"), V.verdict_kind(F.col("block"), F.col("ids"), F.col("preceding")).alias("kind"))


def set07_verdict_identities_orders(spark, d):
    return V.verdicts(_blocks(spark, d), "k")


def flt16_usage_customer(spark, d):
    """Customers as quota windows of nations: shared, of a model, inactive or broken."""
    c = read(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    name = F.element_at(F.array(*map(F.lit, ("five_hour", "seven_day", "seven_day_opus", "seven_day_sonnet", "extra"))), (F.col("k") % 5 + 1).cast("int"))
    w = c.select(F.col("c_nationkey").alias("nation"), F.when(F.col("k") % 401 == 0, "seven_day_other").otherwise(name).alias("name"), F.when(F.col("k") % 3 == 0, "primary").otherwise("reviewer").alias("role"), F.lit("opus").alias("model"), (F.col("k") % 4 != 0).alias("active"), F.when(F.col("k") % 307 == 0, -1.0).otherwise(F.greatest(F.floor(F.col("c_acctbal") / 100), F.lit(0))).cast("double").alias("utilization"), F.when(F.col("k") % 5 == 0, 18_000).otherwise(604_800).alias("seconds"))
    return V.usage_state(V.usage_windows(w, ["nation"], "model"), ["nation"], "role")


def src18_ledger_events(spark, d):
    """Users' events as ledgers: some lack the last line end, some have a broken or a repeated row."""
    e = read(spark, d, "events")
    row = F.when(F.col("event_id") % 211 == 0, F.lit('{"trace": ')).otherwise(F.format_string('{"trace": "t%s"}', F.when(F.col("event_id") % 97 == 0, F.lit("same")).otherwise(F.col("event_id").cast("string"))))
    x = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("x")))), lambda s: s["x"]), "\n").alias("t"))
    p = V.ledger_problem(F.concat("t", F.when(F.col("user_id") % 9 == 0, "").otherwise("\n")), "trace")
    return x.select("user_id", p["row"].alias("row"), p["problem"].alias("problem"))


def src21_log_blocks_events(spark, d):
    """Users' events as logs: a dated header, perhaps lines, perhaps blank ones; some dates aren't any."""
    e = read(spark, d, "events")
    header = F.concat(F.lit("## "), F.when(F.col("event_id") % 13 == 0, "2024-13-45").otherwise(F.date_format("ts", "yyyy-MM-dd")), F.when(F.col("event_id") % 3 == 0, F.date_format("ts", " HH:mm")).otherwise(""), F.lit(" - "), "event_type")
    entry = F.concat(header, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\nid "), F.col("event_id").cast("string"), F.lit("\n  \n"))).otherwise(""))
    x = e.groupBy("user_id").agg(F.concat(F.lit("preamble\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))), lambda s: s["x"]), "\n")).alias("t"))
    return x.select("user_id", F.posexplode(V.log_blocks(F.col("t"))).alias("i", "b")).select("user_id", "i", "b.header", F.length("b.body").alias("n"), F.date_format("b.anchor", "yyyy-MM-dd HH:mm").alias("anchor"), "b.sha256")


def jon13_checkpoints_orders(spark, d):
    """Orders as reports of batches (customers): checkpoints and project runs; part of the runs close a cycle."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    r = o.select(k.alias("trace"), F.when(k % 10 == 0, "checkpoint").otherwise("run").alias("run_type"), F.col("o_custkey").alias("batch"), F.when((k % 10 == 0) & (k % 20 != 0), "engine").otherwise("project").alias("scope"), F.floor("o_totalprice").cast("long").alias("makespan"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("c"), ((F.col("o_custkey") + i) % 5).cast("string"))).alias("cycles"))
    e = o.where(k % 3 == 0).select(k.alias("trace"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("cycle"))
    return V.checkpoint_links(r, e).select("checkpoint", "outer", "n_children", "work", F.array_join("missing", ",").alias("missing"))


def agg19_inventory_part(spark, d):
    """Parts as proofs: the size's kind, the brand as family; every 50th id is that of the part before."""
    p = read(spark, d, "part")
    return V.inventory(p.select((F.col("p_size") % 4).cast("string").alias("kind"), F.col("p_brand").alias("family"), F.concat(F.lit("proof-"), (F.col("p_partkey") - F.when(F.col("p_partkey") % 50 == 0, 50).otherwise(0)).cast("string")).alias("id")))


def agg21_survey_orders(spark, d):
    state = F.when(F.col("o_orderkey") % 101 == 0, F.lit(None)).when(F.col("o_orderstatus") == "F", "killed").when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 7 == 0), "survived").when(F.col("o_orderstatus") == "O", "killed").otherwise("timed_out")
    return V.survey(read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("module"), state.alias("state")), "module", "state")


def pol07_routes_documents(spark, d):
    """Pages of documents: native or scanned, some renderings fail the gate; at most four pages of a document may be sent."""
    p = _pages(spark, d).select("doc_id", "number", (F.length("text") % 3 != 0).alias("native"), (F.length("text") % 5 != 0).alias("gated"))
    return V.routes(p, "doc_id", ["scan-page"], True, 4)


def srt05_rational_order_orders(spark, d):
    """Orders by a fraction, then the key: the place of each."""
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97 + 1).alias("num"), (F.col("o_orderkey") % 23 + 1).alias("den"))
    return O.ranked(o.withColumn("by", V.rational_key(F.col("num"), F.col("den"))), ["by", "o_orderkey"]).select("o_orderkey", "place")


def srt06_verdict_order_orders(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey")
    return O.ranked_within(o, ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_custkey", "o_orderkey"]).select("o_orderkey", "place")


def win07_links_events(spark, d):
    """Hours of a type of events as phases: the one that finished before and the one behind."""
    e = read(spark, d, "events").groupBy(F.concat(F.date_format("ts", "yyyy-MM-dd HH"), F.lit(" "), "event_type").alias("phase")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("finished"))
    return O.linked(e, ["finished", "phase"], "phase").select("phase", "previous_", "next_")


def win01_ordinals_documents(spark, d):
    """Numbers of page headings in the order in which they stand: some documents lack a page, repeat one or have two in the wrong order."""
    p = _pages(spark, d).where("NOT (doc_id % 13 = 0 AND number = 1)")
    shown = F.when((F.col("doc_id") % 11 == 0) & (F.col("number") == 2), 1).when((F.col("doc_id") % 7 == 0) & F.col("number").isin(2, 3), 5 - F.col("number")).otherwise(F.col("number"))
    b = p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.concat(F.lit("## Page "), shown.cast("string"), F.lit("\n\nx")).alias("x")))), lambda s: s["x"]), "\n\n").alias("body"))
    return b.where(M.page_sections(F.col("body")).isNull()).select("doc_id")


def jsn01_strict_events(spark, d):
    """Repeated keys, numbers that are none and broken text are refused; NaN inside a string isn't."""
    k = F.col("event_id") % 6
    t = F.when(k == 0, '{"k": 1, "k": 2}').when(k == 1, '{"k": ').when(k == 2, '{"k": NaN}').when(k == 3, '{"k": "NaN \\" Infinity"}').when(k == 4, '[1, -Infinity]').otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", V.strict_json(t).alias("ok"))


def hsh03_difference_hash_embeddings(spark, d):
    """Vectors as grey images of 9 x 8, the last row from the first components again."""
    e = read(spark, d, "embeddings")
    gray = F.concat(F.transform("embedding", lambda x: F.floor(x.cast("double") * 128)), F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x.cast("double") * 128)))
    return e.select("vec_id", F.lpad(F.hex(V.difference_hash(gray)), 16, "0").alias("hash"))


def hsh02_derived_from_documents(spark, d):
    """Digests of a whole mirror and of its body, which differ by the header alone."""
    x = read(spark, d, "documents")
    whole = F.concat(F.lit("---\nmirror_of: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text")
    return x.select("doc_id", F.sha2(whole, 256).alias("derived_from"), F.sha2(F.regexp_replace(whole, r"\A---\n(?s:.*?)\n---\n", ""), 256).alias("derived_from_body"))


def agg15_park_summary_events(spark, d):
    """Users' events in pairs as parks of phases (two for each user); boots start anew every 40 events of a user in even phases, times of one boot drift a little."""
    e = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("w"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy("w", "event_id"))
    e = e.withColumn("n", n).withColumn("phase", F.col("user_id") * 2 + F.when(F.floor((F.col("n") - 1) / 2) % 2 == 0, 0).otherwise(1))
    boot = F.format_string("{ sec = %d, usec = 1 }", 1000 * F.when(F.col("phase") % 2 == 0, F.floor((F.col("n") - 1) / 40)).otherwise(F.floor(F.col("n") / 60)) + F.col("n") % 3)
    e = e.withColumn("park", F.floor((F.col("n") + 1) / 2)).withColumn("boot", boot)
    when = lambda c, k: F.max(F.when(F.col("n") % 2 == k, F.col(c)))
    p = e.groupBy("phase", "park").agg(when("w", 1).alias("opened"), when("w", 0).alias("closed"), when("boot", 1).alias("start_boot"), when("boot", 0).alias("end_boot"))
    return V.park_summary(p.withColumn("start_ns", F.col("opened") % 10_000_000_000).withColumn("end_ns", F.col("start_ns") + F.col("closed") - F.col("opened")), "phase")


QUERIES = {name: f for name, f in list(globals().items()) if name[0] != "_" and callable(f) and getattr(f, "__module__", "") == __name__ and name != "read"}

_BLOCKS = r"""WITH a AS (SELECT o_orderkey AS k, '## Verdict: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'REVISE' END || chr(10) || 'finding ' || (o_orderkey % 40) || CASE WHEN o_orderkey % 3 = 0 THEN '  see' || chr(9) || 'PLAN-F' ELSE ' see' END || CASE WHEN o_orderkey % 4 = 0 THEN ' CODE-F' ELSE '' END AS body FROM orders),
b AS (SELECT k, CASE WHEN k % 11 = 0 THEN body || chr(10) || '## Rules' WHEN k % 13 = 0 THEN body || chr(10) || '1' || chr(9) || 'x' || chr(10) || '2' || chr(9) || 'y' || chr(10) || ' 3: z' WHEN k % 17 = 0 THEN body || ' a.py-12-b' WHEN k % 19 = 0 THEN 'x ' || body ELSE body END AS block,
  '[{"n": ' || (k % 6) || '}]' AS findings, CASE WHEN k % 10 = 0 THEN 'code' WHEN k % 5 = 0 THEN 'plan' END AS told, CASE WHEN k % 7 = 0 THEN 'PLAN-F ' ELSE 'CODE-F ' END || repeat('x', CASE WHEN k % 6 = 0 THEN 4000 ELSE 10 END) AS preceding FROM a),
c AS (SELECT *, regexp_matches(block, '^## Verdict: (APPROVED|REVISE)\s*\n') AND NOT contains(block, chr(10) || '## Rules') AND len(regexp_extract_all(block, '(?m)^\s*\d+[\t:] ?')) < 3 AND NOT regexp_matches(block, '\.(md|py|toml|yaml)-\d+-') AS genuine,
  coalesce(told, CASE WHEN contains(block, 'PLAN-F') AND NOT contains(block, 'CODE-F') THEN 'plan' WHEN contains(block, 'CODE-F') AND NOT contains(block, 'PLAN-F') THEN 'code' END, CASE WHEN contains(right(preceding, 4000), 'PLAN-F') THEN 'plan' WHEN contains(right(preceding, 4000), 'CODE-F') THEN 'code' END, 'unknown') AS kind FROM b)"""

ORACLES = {
    "flt12_verdicts_orders": f"{_BLOCKS} SELECT k, genuine, kind FROM c",
    "set07_verdict_identities_orders": _BLOCKS + r""", x AS (SELECT sha1(substr(regexp_replace(findings || block, '\s+', ' ', 'g'), 1, 1500)) AS key, k, regexp_extract(block, '(APPROVED|REVISE)', 1) AS verdict, kind FROM c WHERE genuine)
      SELECT key, min(k) AS first, count(*) AS n, arg_min(verdict, k) AS verdict, arg_min(kind, k) AS kind FROM x GROUP BY 1""",
    "flt16_usage_customer": """WITH a AS (SELECT c_nationkey AS nation, c_custkey AS k, CASE WHEN c_custkey % 401 = 0 THEN 'seven_day_other' ELSE ['five_hour', 'seven_day', 'seven_day_opus', 'seven_day_sonnet', 'extra'][c_custkey % 5 + 1] END AS name, CASE WHEN c_custkey % 307 = 0 THEN -1 ELSE greatest(floor(c_acctbal / 100), 0) END AS u FROM customer),
      b AS (SELECT * FROM a WHERE (name IN ('five_hour', 'seven_day') OR (name IN ('extra', 'seven_day_opus', 'seven_day_other') AND k % 4 <> 0))),
      c AS (SELECT nation, bool_or(name = 'seven_day_other' OR u < 0) AS bad, bool_or(k % 3 = 0 AND u >= 95) AS refuse, bool_or(k % 3 <> 0 AND k % 5 <> 0 AND u > 95) AS fall FROM b GROUP BY 1)
      SELECT nation, CASE WHEN bad THEN 'invalid' WHEN refuse THEN 'refused' WHEN fall THEN 'fallback' ELSE 'clear' END AS state FROM c""",
    "src18_ledger_events": """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'same' ELSE event_id::VARCHAR END AS t FROM events),
      b AS (SELECT *, CASE WHEN t IS NULL THEN 'invalid' WHEN row_number() OVER (PARTITION BY user_id, t ORDER BY i) > 1 THEN 'duplicate' END AS p FROM a), c AS (SELECT user_id, min(i) FILTER (p IS NOT NULL) AS row, arg_min(p, i) FILTER (p IS NOT NULL) AS problem FROM b GROUP BY 1)
      SELECT user_id, CAST(CASE WHEN user_id % 9 = 0 THEN 0 ELSE row END AS INTEGER) AS row, CASE WHEN user_id % 9 = 0 THEN 'unterminated' ELSE problem END AS problem FROM c""",
    "src21_log_blocks_events": """WITH a AS (SELECT user_id, event_id, event_id % 13 <> 0 AS dated, '## ' || CASE WHEN event_id % 13 = 0 THEN '2024-13-45' ELSE strftime(ts, '%Y-%m-%d') END || CASE WHEN event_id % 3 = 0 THEN strftime(ts, ' %H:%M') ELSE '' END || ' - ' || event_type AS header, strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 3 = 0 THEN strftime(ts, ' %H:%M') ELSE ' 00:00' END AS anchor,
        CASE WHEN event_id % 2 = 0 THEN chr(10) || 'id ' || event_id || chr(10) || '  ' || chr(10) ELSE '' END AS tail FROM events),
      b AS (SELECT *, sum(CASE WHEN dated THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block FROM a),
      c AS (SELECT user_id, block, arg_min(header, event_id) AS header, arg_min(anchor, event_id) AS anchor, regexp_replace(string_agg(header || tail, chr(10) ORDER BY event_id), '[ \n]+$', '') AS whole FROM b WHERE block > 0 GROUP BY 1, 2)
      SELECT user_id, CAST(block - 1 AS INTEGER) AS i, header, CAST(length(whole) - length(header) - CASE WHEN whole <> header THEN 1 ELSE 0 END AS INTEGER) AS n, anchor, sha256(whole || chr(10)) AS sha256 FROM c""",
    "jon13_checkpoints_orders": """WITH r AS (SELECT o_orderkey AS trace, o_custkey AS batch, o_orderkey % 10 = 0 AS outer_, NOT (o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0) AS project, CAST(floor(o_totalprice) AS BIGINT) AS makespan, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || (o_orderkey % 5) END AS cycle FROM orders),
      j AS (SELECT a.batch AS checkpoint, a.trace AS "outer", b.trace, b.makespan, b.cycle FROM r a LEFT JOIN r b ON a.batch = b.batch AND b.project AND b.trace <> a.trace WHERE a.outer_),
      g AS (SELECT checkpoint, "outer", count(trace) AS n_children, CAST(coalesce(sum(makespan), 0) AS BIGINT) AS work, coalesce(list(DISTINCT cycle) FILTER (cycle IS NOT NULL), []) AS linked FROM j GROUP BY 1, 2)
      SELECT checkpoint, "outer", n_children, work, array_to_string(list_sort(list_filter(list_distinct(list_transform([0, 1, 2, 3], lambda i: 'c' || ((checkpoint + i) % 5))), lambda c: NOT list_contains(linked, c))), ',') AS missing FROM g""",
    "agg19_inventory_part": """WITH x AS (SELECT (p_size % 4)::VARCHAR AS kind, p_brand AS family, 'proof-' || (p_partkey - CASE WHEN p_partkey % 50 = 0 THEN 50 ELSE 0 END) AS id FROM part)
      SELECT kind, count(DISTINCT family) AS families, count(*) AS leaves, count(*) - count(DISTINCT id) AS duplicates, sha256(string_agg(DISTINCT id, chr(10) ORDER BY id)) AS digest FROM x GROUP BY 1""",
    "agg21_survey_orders": """WITH x AS (SELECT o_custkey % 500 AS module, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'killed' WHEN o_orderstatus = 'O' AND o_custkey % 7 = 0 THEN 'survived' WHEN o_orderstatus = 'O' THEN 'killed' ELSE 'timed_out' END AS state FROM orders)
      SELECT module, count(*) FILTER (state = 'killed') AS killed, count(*) FILTER (state = 'survived') AS survived, count(*) FILTER (state = 'timed_out') AS timed_out, count(*) FILTER (state IS NULL) AS not_run, count(*) AS total, count(*) FILTER (state = 'survived' OR state IS NULL) = 0 AS passed FROM x GROUP BY 1""",
    "pol07_routes_documents": f"""{_PAGES}, x AS (SELECT doc_id, number, length(text) % 3 <> 0 AS native, length(text) % 5 <> 0 AS gated FROM p), y AS (SELECT *, count(*) FILTER (NOT native) OVER (PARTITION BY doc_id) AS sent FROM x)
      SELECT doc_id, number, CASE WHEN sent > 4 THEN 'refused' WHEN native AND gated THEN 'typography' WHEN NOT native THEN 'model' ELSE 'fidelity' END AS route FROM y""",
    "srt05_rational_order_orders": "SELECT o_orderkey, row_number() OVER (ORDER BY (o_custkey % 97 + 1) * (5354228880 // (o_orderkey % 23 + 1)), o_orderkey) AS place FROM orders",
    "srt06_verdict_order_orders": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_custkey, o_orderkey) AS place FROM orders",
    "win07_links_events": "WITH e AS (SELECT strftime(ts, '%Y-%m-%d %H') || ' ' || event_type AS phase, max(ts) AS finished FROM events GROUP BY 1) SELECT phase, lag(phase) OVER (ORDER BY finished, phase) AS previous_, lead(phase) OVER (ORDER BY finished, phase) AS next_ FROM e",
    "win01_ordinals_documents": f"""{_PAGES}, s AS (SELECT doc_id, number, CASE WHEN doc_id % 11 = 0 AND number = 2 THEN 1 WHEN doc_id % 7 = 0 AND number IN (2, 3) THEN 5 - number ELSE number END AS shown FROM p WHERE NOT (doc_id % 13 = 0 AND number = 1)),
      r AS (SELECT doc_id, shown, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS place FROM s) SELECT doc_id FROM r GROUP BY 1 HAVING bool_or(shown <> place)""",
    "jsn01_strict_events": "SELECT event_id, event_id % 6 IN (3, 5) AS ok FROM events",
    "hsh03_difference_hash_embeddings": """WITH e AS (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:8]), lambda x: floor(CAST(x AS DOUBLE) * 128)) AS g FROM embeddings),
      b AS (SELECT vec_id, list_transform(range(64), lambda k: CASE WHEN g[(k // 8) * 9 + k % 8 + 1] > g[(k // 8) * 9 + k % 8 + 2] THEN '1' ELSE '0' END) AS bits FROM e)
      SELECT vec_id, array_to_string(list_transform(range(16), lambda h: substr('0123456789ABCDEF', CAST(8 * bits[h * 4 + 1]::INTEGER + 4 * bits[h * 4 + 2]::INTEGER + 2 * bits[h * 4 + 3]::INTEGER + bits[h * 4 + 4]::INTEGER + 1 AS INTEGER), 1)), '') AS hash FROM b""",
    "hsh02_derived_from_documents": "SELECT doc_id, sha256('---' || chr(10) || 'mirror_of: ' || doc_id || chr(10) || '---' || chr(10) || text) AS derived_from, sha256(text) AS derived_from_body FROM documents",
    "agg15_park_summary_events": f"""WITH a AS (SELECT user_id, epoch_us(ts) AS w, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events), b AS (SELECT *, user_id * 2 + ((n - 1) // 2) % 2 AS phase FROM a),
      c AS (SELECT *, CASE WHEN phase % 2 = 0 THEN (n - 1) // 40 ELSE n // 60 END AS boot FROM b),
      p AS (SELECT phase, (n + 1) // 2 AS park, max(w) FILTER (n % 2 = 1) AS opened, max(w) FILTER (n % 2 = 0) AS closed, max(boot) FILTER (n % 2 = 1) AS b1, max(boot) FILTER (n % 2 = 0) AS b2 FROM c GROUP BY 1, 2),
      g AS (SELECT phase, count(*) AS n_parks, bool_or(closed IS NULL) AS open, coalesce(bool_and(b1 = b2), false) AS one FROM p GROUP BY 1),
      s AS (SELECT p.phase, CASE WHEN one THEN b1 ELSE 0 END AS boot, park AS id, CASE WHEN one THEN opened % 10000000000 ELSE opened END AS st, CASE WHEN one THEN opened % 10000000000 + closed - opened ELSE closed END AS en FROM p JOIN g ON g.phase = p.phase WHERE NOT open),
      t AS ({_union_sql("phase, boot", name="part")}), u AS (SELECT phase, CAST(sum(part) AS BIGINT) AS total FROM t GROUP BY 1)
      SELECT g.phase, n_parks, open, CASE WHEN open THEN 'incomplete' WHEN one THEN 'monotonic-union' ELSE 'calendar-union-cross-boot' END AS method, NOT open AND one AS exact, total FROM g LEFT JOIN u ON u.phase = g.phase""",
}
