"""Queries on spans of the events table: a trace is a day, a span lasts six micro-units of its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import order as O  # noqa: E741
from corpusloom.functions.text import elapsed
from corpusloom.operators import intervals as I


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace, id, st and en (µs), category, outcome, attempt, parent and depth of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    st = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("trace"), F.col("event_id").alias("id"), st.alias("st"), (st + F.round(F.col("value") * 6_000_000).cast("long")).alias("en"), F.col("event_type").alias("category"), "user_id",
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"), (F.col("event_id") % 3 + 1).alias("attempt"), (F.col("event_id") % 4).alias("depth"),
    )


_SPANS = """WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS trace, event_id AS id, epoch_us(ts) AS st, epoch_us(ts) + CAST(round(value * 6000000) AS BIGINT) AS en,
  event_type AS category, user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome, event_id % 3 + 1 AS attempt, event_id % 4 AS depth FROM events)"""


def _union_sql(keys: str, where: str = "true", source: str = "s", name: str = "covered") -> str:
    return f"""SELECT {keys}, CAST(sum(e - b) AS BIGINT) AS {name} FROM (SELECT {keys}, isl, min(st) AS b, max(en) AS e FROM (
      SELECT *, sum(CASE WHEN pe IS NULL OR st > pe THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY st, en, id ROWS UNBOUNDED PRECEDING) AS isl FROM (
        SELECT *, max(en) OVER (PARTITION BY {keys} ORDER BY st, en, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source} WHERE {where})) GROUP BY {keys}, isl) GROUP BY {keys}"""


def _peak_sql(keys: str, source: str = "s") -> str:
    return f"""SELECT {keys}, CAST(max(r) AS BIGINT) AS peak FROM (SELECT {keys}, sum(d) OVER (PARTITION BY {keys} ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS r FROM (
      SELECT {keys}, st AS t, 1 AS d FROM {source} UNION ALL SELECT {keys}, en, -1 FROM {source})) GROUP BY {keys}"""


_EXCLUSIVE = """SELECT trace, category, CAST(sum(z - a) AS BIGINT) AS exclusive FROM (SELECT p.trace, a, z, s.category,
    row_number() OVER (PARTITION BY p.trace, a ORDER BY depth DESC, en - st, id DESC) AS k
  FROM (SELECT trace, t AS a, lead(t) OVER (PARTITION BY trace ORDER BY t) AS z FROM (SELECT trace, st AS t FROM s UNION SELECT trace, en FROM s)) p
  JOIN s ON s.trace = p.trace AND s.st <= p.a AND s.en >= p.z) WHERE k = 1 GROUP BY trace, category"""


def agg08_union_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_measure(spans(spark, sf_dir), ["trace"])


def agg09_peak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.peak_concurrency(spans(spark, sf_dir), ["trace"])


def agg11_exclusive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.exclusive(spans(spark, sf_dir), "trace", "category")


def agg16_timing_projection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not exclusive: the union of each category's spans."""
    return I.union_measure(spans(spark, sf_dir), ["trace", "category"])


def agg10_trace_report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each trace: makespan, covered, uncovered, failed and retried time, peak, and its slowest span."""
    s = spans(spark, sf_dir)
    base = s.groupBy("trace").agg((F.max("en") - F.min("st")).cast("long").alias("makespan"), F.sum(F.col("en") - F.col("st")).cast("long").alias("summed"), F.count(F.lit(1)).alias("n_spans"), F.max(F.struct((F.col("en") - F.col("st")).alias("d"), (-F.col("id")).alias("i"))).alias("w"))
    out = base
    for part in (I.union_measure(s, ["trace"]), I.union_measure(s.where("outcome <> 'success'"), ["trace"], "failed"), I.union_measure(s.where("attempt > 1"), ["trace"], "retried"), I.peak_concurrency(s, ["trace"])):
        out = out.join(part, "trace", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("trace", "makespan", "summed", "n_spans", "covered", F.greatest(F.col("makespan") - F.col("covered"), F.lit(0)).alias("unattributed"), zero("failed"), zero("retried"), "peak", (-F.col("w.i")).alias("slowest_id"), (F.col("summed") - F.col("covered")).alias("overlap"))


def agg12_batch_metrics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are traces, members are users; a member is committed if it has a purchase."""
    s = spans(spark, sf_dir).select("trace", F.col("user_id").alias("member"), "st", "en", (F.col("outcome") == "success").alias("ok"), "attempt", (F.col("category") == "purchase").alias("committed"))
    return I.batch_metrics(s, "trace")


def agg14_attempts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category and user: attempts, if there are several."""
    s = spans(spark, sf_dir)
    return s.groupBy("category", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("attempt").alias("max_attempt"), F.count_if(F.col("outcome") != "success").alias("failed"), F.sum(F.col("en") - F.col("st")).cast("long").alias("total")).where("n > 1 OR max_attempt > 1")


def _parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events of a user open a park, even ones close it; a park belongs to the user's phase."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), n.alias("n")).select("user_id", F.floor((F.col("n") + 1) / 2).alias("park"), F.when(F.col("n") % 2 == 1, "open").otherwise("close").alias("event"), "at")


_PARKS = """WITH p AS (SELECT user_id, (n + 1) // 2 AS park, min(CASE WHEN n % 2 = 1 THEN w END) AS opened, min(CASE WHEN n % 2 = 0 THEN w END) AS closed
  FROM (SELECT user_id, epoch_us(ts) AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1, 2)"""


def jon11_park_pairs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.paired(_parks(spark, sf_dir), ["user_id", "park"])


def jon10_span_depth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth in the hierarchy in which a span's parent is the one with a quarter of its id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 4)).alias("parent"))
    return I.depths(e, "id", "parent")


def srt02_slowest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    length = F.col("en") - F.col("st")
    return I.slowest(s, ["trace"], 10, length).select("trace", "rank", "id", "category", length.alias("duration"), elapsed(length * 1000).alias("elapsed"))


def srt03_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest of errors and other events, by time, id and kind."""
    s = spans(spark, sf_dir)
    both = s.where("outcome = 'error'").select("st", "id", F.lit("incomplete").alias("kind")).union(s.where("outcome <> 'error'").select("st", "id", F.lit("report").alias("kind")))
    return both.orderBy(F.desc("st"), F.desc("id"), F.desc("kind")).limit(20)


def win06_pass_number_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a trace and category numbered in order; one with most of the spans is spread over tasks."""
    s = spans(spark, sf_dir).select("trace", "category", "id", "st")
    return O.ranked_within(s, ["trace", "category"], ["st", "id"], "pass_number").select("trace", "category", "id", F.col("pass_number").cast("int").alias("pass_number"))


def val07_span_checks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each span against its parent (a quarter of its id): an array of problems as text."""
    s = spans(spark, sf_dir).withColumn("parent", F.when(F.col("id") > 0, F.floor(F.col("id") / 4)))
    p = s.select(F.col("id").alias("pid"), F.col("st").alias("pst"), F.col("en").alias("pen"), F.col("trace").alias("ptrace"))
    problem = lambda bad, name: F.when(bad, F.lit(name))
    found = F.array_compact(F.array(problem(F.col("en") < F.col("st"), "negative"), problem(F.col("parent").isNotNull() & F.col("pid").isNull(), "orphan"), problem(F.col("ptrace") != F.col("trace"), "foreign-parent"), problem((F.col("st") < F.col("pst")) | (F.col("en") > F.col("pen")), "outside-parent")))
    return s.join(p, F.col("parent") == F.col("pid"), "left").select("id", F.array_join(found, ",").alias("problems")).where("problems <> ''")


def agg13_dashboard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traces on one time line that each starts at 0: coverage, peak and ratio by category."""
    s = spans(spark, sf_dir)
    origin = s.groupBy("trace").agg(F.min("st").alias("o"))
    r = s.join(origin, "trace").select("category", "id", (F.col("st") - F.col("o")).alias("st"), (F.col("en") - F.col("o")).alias("en"))
    sums = r.groupBy("category").agg(F.sum(F.col("en") - F.col("st")).cast("long").alias("summed"), (F.max("en") - F.min("st")).cast("long").alias("window"))
    return sums.join(I.union_measure(r, ["category"]), "category").join(I.peak_concurrency(r, ["category"]), "category").select("category", "summed", "window", "covered", "peak", F.when(F.col("window") > 0, F.round(F.col("covered") / F.col("window"), 6)).otherwise(1.0).alias("ratio"))


def flt11_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that hold an error and finish after the tenth day, with their last end."""
    s = spans(spark, sf_dir)
    return s.groupBy("trace").agg(F.bool_or(F.col("outcome") == "error").alias("has"), F.max("en").alias("finished")).where("has AND trace > '2024-01-10'").select("trace", "finished")


QUERIES = {f.__name__: f for f in (
    agg08_union_events, agg09_peak_events, agg11_exclusive_events, agg16_timing_projection_events, agg10_trace_report_events, agg12_batch_metrics_events, agg14_attempts_events, jon11_park_pairs_events,
    jon10_span_depth_events, srt02_slowest_events, srt03_recent_events, win06_pass_number_events, val07_span_checks_events, agg13_dashboard_events, flt11_history_events,
)}

_ELAPSED = "CASE WHEN d // 1000 < 60000 THEN (d // 1000000) || '.' || lpad(CAST(d // 1000 % 1000 AS VARCHAR), 3, '0') || 's' WHEN d // 3600000000 > 0 THEN (d // 3600000000) || 'h ' || (d // 1000000 % 3600 // 60) || 'm ' || (d // 1000000 % 60) || 's' ELSE (d // 60000000) || 'm ' || (d // 1000000 % 60) || 's' END"

ORACLES = {
    "agg08_union_events": f"{_SPANS} {_union_sql('trace')}",
    "agg09_peak_events": f"{_SPANS} {_peak_sql('trace')}",
    "agg11_exclusive_events": f"{_SPANS} {_EXCLUSIVE}",
    "agg16_timing_projection_events": f"{_SPANS} {_union_sql('trace, category')}",
    "agg10_trace_report_events": f"""{_SPANS}, b AS (SELECT trace, max(en) - min(st) AS makespan, CAST(sum(en - st) AS BIGINT) AS summed, count(*) AS n_spans, arg_max(id, (en - st) * 1000000 - id) AS slowest_id FROM s GROUP BY trace),
      c AS ({_union_sql('trace')}), f AS ({_union_sql('trace', "outcome <> 'success'", name='failed')}), r AS ({_union_sql('trace', 'attempt > 1', name='retried')}), p AS ({_peak_sql('trace')})
      SELECT trace, makespan, summed, n_spans, covered, greatest(makespan - covered, 0) AS unattributed, coalesce(failed, 0) AS failed, coalesce(retried, 0) AS retried, peak, slowest_id, summed - covered AS overlap
      FROM b LEFT JOIN c USING (trace) LEFT JOIN f USING (trace) LEFT JOIN r USING (trace) LEFT JOIN p USING (trace)""",
    "agg12_batch_metrics_events": f"""{_SPANS}, m AS (SELECT trace, user_id, bool_or(outcome = 'success') AS ok, count(*) AS n, max(attempt) AS most, sum(en - st) AS work, bool_or(category = 'purchase') AS done, min(st) AS st, max(en) AS en FROM s GROUP BY 1, 2),
      b AS (SELECT trace, count(*) AS launched, count(*) FILTER (done) AS committed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (n > 1 OR most > 1) AS retried, CAST(sum(work) AS BIGINT) AS summed_work, CAST(sum(CASE WHEN done THEN work ELSE 0 END) AS BIGINT) AS committed_work, max(en) - min(st) AS "window" FROM m GROUP BY 1),
      a AS ({_union_sql('trace', name='active')}), p AS ({_peak_sql('trace')})
      SELECT *, summed_work - active AS overlap, CASE WHEN committed > 0 THEN "window" // committed END AS wall_per_committed, CASE WHEN committed = 0 THEN 'no committed members' END AS reason FROM b JOIN a USING (trace) JOIN p USING (trace)""",
    "agg14_attempts_events": f"{_SPANS} SELECT category, user_id, count(*) AS n, max(attempt) AS max_attempt, count(*) FILTER (outcome <> 'success') AS failed, CAST(sum(en - st) AS BIGINT) AS total FROM s GROUP BY 1, 2 HAVING count(*) > 1 OR max(attempt) > 1",
    "jon11_park_pairs_events": f"{_PARKS} SELECT * FROM p WHERE opened IS NOT NULL",
    "jon10_span_depth_events": "WITH RECURSIVE d AS (SELECT event_id AS id, event_id AS root, CAST(0 AS BIGINT) AS depth FROM events WHERE event_id = 0 UNION ALL SELECT e.event_id, d.root, d.depth + 1 FROM events e JOIN d ON e.event_id > 0 AND e.event_id // 4 = d.id) SELECT id, root, depth FROM d",
    "srt02_slowest_events": f"{_SPANS} SELECT trace, CAST(rank AS INTEGER) AS rank, id, category, d AS duration, {_ELAPSED} AS elapsed FROM (SELECT *, en - st AS d, row_number() OVER (PARTITION BY trace ORDER BY en - st DESC, id) AS rank FROM s) WHERE rank <= 10",
    "srt03_recent_events": f"{_SPANS} SELECT st, id, CASE WHEN outcome = 'error' THEN 'incomplete' ELSE 'report' END AS kind FROM s ORDER BY st DESC, id DESC, kind DESC LIMIT 20",
    "win06_pass_number_events": f"{_SPANS} SELECT trace, category, id, CAST(row_number() OVER (PARTITION BY trace, category ORDER BY st, id) AS INTEGER) AS pass_number FROM s",
    "val07_span_checks_events": f"""{_SPANS} SELECT * FROM (SELECT s.id, concat_ws(',', CASE WHEN s.en < s.st THEN 'negative' END, CASE WHEN s.id > 0 AND p.id IS NULL THEN 'orphan' END, CASE WHEN p.trace <> s.trace THEN 'foreign-parent' END, CASE WHEN s.st < p.st OR s.en > p.en THEN 'outside-parent' END) AS problems
      FROM s LEFT JOIN s p ON s.id > 0 AND s.id // 4 = p.id) WHERE problems <> ''""",
    "agg13_dashboard_events": f"""{_SPANS}, r AS (SELECT category, id, st - min(st) OVER (PARTITION BY trace) AS st, en - min(st) OVER (PARTITION BY trace) AS en FROM s), c AS ({_union_sql('category', source='r')}), p AS ({_peak_sql('category', 'r')}),
      b AS (SELECT category, CAST(sum(en - st) AS BIGINT) AS summed, max(en) - min(st) AS "window" FROM r GROUP BY 1)
      SELECT category, summed, "window", covered, peak, CASE WHEN "window" > 0 THEN round(covered / "window", 6) ELSE 1.0 END AS ratio FROM b JOIN c USING (category) JOIN p USING (category)""",
    "flt11_history_events": f"{_SPANS} SELECT trace, max(en) AS finished FROM s GROUP BY trace HAVING bool_or(outcome = 'error') AND trace > '2024-01-10'",
}
