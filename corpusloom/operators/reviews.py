"""Rules on reviews, quotas, ledgers and logs of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.intervals import union_measure

#: fixed values: how a verdict starts, what only its template says, how quoted files and searches look
VERDICT = r"\A## Verdict: (APPROVED|REVISE)\s*\n"
TEMPLATE = ("[Specific issue]", "[One or two sentences", "\n## Rules", "Followed in the `REVISE` case", "=== ")
NUMBERED_LINE, SEARCH_HIT = r"(?m)^\s*\d+[\t:] ?", r"\.(md|py|toml|yaml)-\d+-"
#: fixed values: characters of a verdict that count for its identity, and of what precedes it for its kind
IDENTITY, PRECEDING = 1500, 4000
#: fixed values: windows that all models of an account share, models that may have one of their own, limits in percent, a week
SHARED_WINDOWS = ("five_hour", "seven_day", "primary_window", "secondary_window")
SCOPED_MODELS, LIMIT, WEEK = ("opus", "fable", "sonnet", "oauth_apps", "cowork"), 95, 604_800
#: fixed value: the header of a log block, with a date and perhaps a time
BLOCK_HEADER = r"^##\s+(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}))?\b(.*)$"
#: fixed value: seconds by which two readings of one boot's time may differ
BOOT_DRIFT = 5


def normalised_verdict(block: Column) -> Column:
    """Escaped line ends and quotes resolved, white space single, cut to what counts for identity."""
    return F.substring(F.regexp_replace(F.replace(F.replace(block, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), r"\s+", " "), 1, IDENTITY)


def genuine(block: Column) -> Column:
    """Whether a block is a verdict that was given, not its template, a quoted file or a hit of a search."""
    template = F.lit(False)
    for marker in TEMPLATE:
        template |= block.contains(marker)
    return block.rlike(VERDICT) & ~template & (F.regexp_count(block, F.lit(NUMBERED_LINE)) < 3) & ~block.rlike(SEARCH_HIT)


def verdict_kind(block: Column, ids: Column, preceding: Column) -> Column:
    """plan or code by the first finding id that says so, else by the only one that the block or what precedes it mentions."""
    told = F.element_at(F.filter(F.transform(ids, lambda i: F.when(i.startswith("PLAN-F"), "plan").when(i.startswith("CODE-F"), "code")), lambda k: k.isNotNull()), 1)
    said = lambda t: F.when(t.contains("PLAN-F") & ~t.contains("CODE-F"), "plan").when(t.contains("CODE-F") & ~t.contains("PLAN-F"), "code")
    first = F.when(F.exists(ids, lambda i: i.startswith("PLAN-F") | i.startswith("CODE-F")), told)
    return F.coalesce(first, said(block), said(F.substring(preceding, F.greatest(F.length(preceding) - PRECEDING + 1, F.lit(1)), F.lit(PRECEDING))), F.lit("unknown"))


def verdicts(found: DataFrame, order: str) -> DataFrame:
    """key, first, n, verdict, kind of the genuine verdicts of (order, block, findings, ids array, preceding), one for each identity."""
    x = found.where(genuine(F.col("block"))).withColumn("key", F.sha1(normalised_verdict(F.concat("findings", "block"))))
    one = F.struct(order, F.regexp_extract("block", VERDICT, 1).alias("verdict"), verdict_kind(F.col("block"), F.col("ids"), F.col("preceding")).alias("kind"))
    return x.groupBy("key").agg(F.min(one).alias("o"), F.count(F.lit(1)).alias("n")).select("key", F.col(f"o.{order}").alias("first"), "n", "o.verdict", "o.kind")


def usage_windows(windows: DataFrame, keys: list[str], model: str) -> DataFrame:
    """The windows (name, utilization, seconds, active) that count for a model; problem says why one can't be read.

    Windows shared by an account always count. One of a model counts for that model only, and no other unless active.
    """
    shared = F.col("name").isin(*SHARED_WINDOWS)
    scope = F.when(F.col("name").startswith("seven_day_"), F.regexp_replace("name", "^seven_day_", ""))
    unknown = scope.isNotNull() & ~scope.isin(*SCOPED_MODELS)
    counts = (scope.isNull() | unknown | (scope == F.col(model))) & (shared | F.coalesce(F.col("active"), F.lit(True)))
    fit = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (c.cast("double") < float("inf"))
    bad = ~(fit(F.col("utilization")) & (F.col("utilization") >= 0) & fit(F.col("seconds")) & (F.col("seconds") > 0))
    return windows.where(counts).withColumn("problem", F.when(unknown, "unknown-scope").when(F.coalesce(bad, F.lit(True)), "invalid-values"))


def usage_state(windows: DataFrame, keys: list[str], role: str) -> DataFrame:
    """keys, state: refused (a primary window at the limit), fallback (a week of a reviewer's over it), invalid or clear."""
    w = windows.groupBy(*keys).agg(
        F.bool_or(F.col("problem").isNotNull()).alias("bad"), F.bool_or((F.col(role) == "primary") & (F.col("utilization") >= LIMIT)).alias("refuse"),
        F.bool_or((F.col(role) != "primary") & (F.col("seconds") == WEEK) & (F.col("utilization") > LIMIT)).alias("fall"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return w.select(*keys, F.when(yes("bad"), "invalid").when(yes("refuse"), "refused").when(yes("fall"), "fallback").otherwise("clear").alias("state"))


def ledger_problem(text: Column, key: str) -> Column:
    """struct<row, problem> of the first fault of a JSONL ledger, null without one: unterminated (row 0), invalid, duplicate (of the key)."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    told = F.transform(lines, lambda x, i: F.struct((i + 1).alias("row"), x.alias("x"), F.when(F.try_parse_json(x).isNotNull(), F.get_json_object(x, f"$.{key}")).alias("k")))
    full = F.filter(told, lambda r: F.trim(r["x"]) != "")
    seen = F.aggregate(full, F.struct(F.array().cast("array<string>").alias("keys"), F.lit(None).cast("struct<row:int,problem:string>").alias("first")), lambda acc, r: F.when(acc["first"].isNotNull(), acc).when(
        r["k"].isNull(), F.struct(acc["keys"].alias("keys"), F.struct(r["row"].alias("row"), F.lit("invalid").alias("problem")).alias("first"))
    ).when(F.array_contains(acc["keys"], r["k"]), F.struct(acc["keys"].alias("keys"), F.struct(r["row"].alias("row"), F.lit("duplicate").alias("problem")).alias("first"))).otherwise(
        F.struct(F.concat(acc["keys"], F.array(r["k"])).alias("keys"), acc["first"].alias("first"))
    ), lambda acc: acc["first"])
    return F.when((text != "") & ~text.endswith("\n"), F.struct(F.lit(0).alias("row"), F.lit("unterminated").alias("problem"))).otherwise(seen)


def log_blocks(text: Column) -> Column:
    """array<struct<header, body, anchor, sha256>> of a log: what stands from one dated header to the next, without blank ends."""
    lines = F.split(text, r"\r\n|\r|\n")
    stamp = lambda x: F.try_to_timestamp(F.concat(F.regexp_extract(x, BLOCK_HEADER, 1), F.lit(" "), F.coalesce(F.nullif(F.regexp_extract(x, BLOCK_HEADER, 2), F.lit("")), F.lit("00:00"))), F.lit("yyyy-MM-dd HH:mm"))
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(BLOCK_HEADER) & stamp(x).isNotNull(), i)), lambda i: i.isNotNull())
    spans = F.arrays_zip(at.alias("a"), F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.size(lines))).alias("b"))

    def block(s: Column) -> Column:
        header = F.element_at(lines, s["a"] + 1)
        body = F.regexp_replace(F.array_join(F.slice(lines, s["a"] + 2, s["b"] - s["a"] - 1), "\n"), r"(?:(?:^|\n)[ \t]*)+\z", "")
        shown = F.concat(F.regexp_replace(F.when(s["b"] - s["a"] > 1, F.concat(header, F.lit("\n"), body)).otherwise(header), r"\s+\z", ""), F.lit("\n"))
        return F.struct(header.alias("header"), body.alias("body"), stamp(header).cast("timestamp_ntz").alias("anchor"), F.sha2(shown, 256).alias("sha256"))

    return F.transform(F.filter(spans, lambda s: s["a"].isNotNull()), block)


def same_boot(left: Column, right: Column) -> Column:
    """Whether two boot identities are of one boot: equal, or times of start (sec = ...) that drift apart a little at most."""
    seconds = lambda c: F.nullif(F.regexp_extract(c, r"sec\s*=\s*(\d+)", 1), F.lit("")).cast("long")
    return F.coalesce(left == right, F.lit(False)) | F.coalesce(F.abs(seconds(left) - seconds(right)) <= BOOT_DRIFT, F.lit(False))


def park_summary(parks: DataFrame, phase: str) -> DataFrame:
    """phase, n_parks, open, method, exact, total of the parks of each phase.

    parks: (phase, park, start_ns, end_ns, start_boot, end_boot, opened, closed), the last four null while a park is
    open; opened and closed are calendar times in the same unit. With an open park there is no total. Where every park
    began and ended in one boot, the total is the union within each boot, by its monotonic clock, over groups of boots
    that are one within the drift, each led by the first that was seen; else it is the calendar union and not exact.
    """
    p = parks.withColumn("_one", same_boot(F.col("start_boot"), F.col("end_boot")))
    state = p.groupBy(phase).agg(
        F.count(F.lit(1)).alias("n_parks"), F.bool_or(F.col("closed").isNull()).alias("open"), F.bool_and("_one").alias("all_one"),
        F.transform(F.array_sort(F.collect_set(F.struct("park", "start_boot"))), lambda x: x["start_boot"]).alias("boots"),
    )
    leaders = F.aggregate(F.array_distinct("boots"), F.array().cast("array<string>"), lambda acc, b: F.when(F.exists(acc, lambda x: same_boot(x, b)), acc).otherwise(F.concat(acc, F.array(b))))
    whole = p.join(state.withColumn("leaders", leaders), phase).where("NOT open")
    led = F.element_at(F.filter("leaders", lambda x: same_boot(x, F.col("start_boot"))), 1)
    by = F.when(F.col("all_one"), F.struct(led.alias("boot"), F.col("start_ns").alias("st"), F.col("end_ns").alias("en"))).otherwise(F.struct(F.lit("").alias("boot"), F.col("opened").alias("st"), F.col("closed").alias("en")))
    spans = whole.select(phase, F.col("park").alias("id"), by.alias("_s")).select(phase, "id", "_s.*")
    total = union_measure(spans, [phase, "boot"], "part").groupBy(phase).agg(F.sum("part").alias("total"))
    method = F.when(F.col("open"), "incomplete").when(F.col("all_one"), "monotonic-union").otherwise("calendar-union-cross-boot")
    return state.join(total, phase, "left").select(phase, "n_parks", "open", method.alias("method"), (~F.col("open") & F.col("all_one")).alias("exact"), "total")


def checkpoint_links(reports: DataFrame, expectations: DataFrame) -> DataFrame:
    """checkpoint, outer, n_children, work, missing: the project runs of each checkpoint's batch and the cycles that none of them closes.

    reports: (trace, run_type, batch, scope, makespan, cycles array). expectations: (trace, cycle).
    """
    outer = reports.where((F.col("run_type") == "checkpoint") & (F.coalesce(F.col("batch").cast("string"), F.lit("")) != "")).select(F.col("trace").alias("outer"), F.col("batch").alias("checkpoint"), "cycles")
    inner = reports.where("scope = 'project'").select("trace", "batch", "makespan").join(expectations.groupBy("trace").agg(F.max("cycle").alias("cycle")), "trace", "left")
    joined = outer.join(inner, (F.col("checkpoint") == F.col("batch")) & (F.col("trace") != F.col("outer")), "left")
    by = joined.groupBy("checkpoint", "outer").agg(F.first("cycles").alias("cycles"), F.count("trace").alias("n_children"), F.coalesce(F.sum("makespan"), F.lit(0)).alias("work"), F.collect_set("cycle").alias("linked"))
    return by.select("checkpoint", "outer", "n_children", "work", F.array_sort(F.array_except("cycles", "linked")).alias("missing"))


def inventory(proofs: DataFrame) -> DataFrame:
    """kind, families, leaves, duplicates and digest (of the sorted ids) of proofs (kind, family, id)."""
    by = proofs.groupBy("kind").agg(F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("leaves"), F.count_distinct("id").alias("different"), F.array_sort(F.collect_set("id")).alias("ids"))
    return by.select("kind", "families", "leaves", (F.col("leaves") - F.col("different")).alias("duplicates"), F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def survey(mutants: DataFrame, key: str, state: str) -> DataFrame:
    """key, killed, survived, timed_out, not_run, total and passed: no mutant survived and none was left out."""
    n = lambda x: F.count_if(F.col(state) == x)
    by = mutants.groupBy(key).agg(n("killed").alias("killed"), n("survived").alias("survived"), n("timed_out").alias("timed_out"), F.count_if(~F.coalesce(F.col(state).isin("killed", "survived", "timed_out"), F.lit(False))).alias("not_run"), F.count(F.lit(1)).alias("total"))
    return by.withColumn("passed", (F.col("survived") == 0) & (F.col("not_run") == 0))


def routes(pages: DataFrame, key: str, applies: list[str], model_runs: bool, most: int) -> DataFrame:
    """key, number, route of pages (number, native, gated): typography where a native page's rendering passes the gate, the model where its
    kind is asked for, else fidelity; all pages of a document that would send more than ``most`` to the model are refused."""
    kind = F.when(F.col("native"), "native-page").otherwise("scan-page")
    settled = F.col("native") & F.col("gated")
    sent = ~settled & kind.isin(*applies) & F.lit(model_runs)
    n = F.count_if(sent).over(W.partitionBy(key))
    return pages.select(key, "number", F.when(n > most, "refused").when(settled, "typography").when(sent, "model").otherwise("fidelity").alias("route"))


def rational_key(numerator: Column, denominator: Column) -> Column:
    """A decimal that orders fractions exactly while denominators are below 10^9: two that differ do so by 10^-18 at least."""
    return (numerator.cast("decimal(19,0)") / denominator.cast("decimal(10,0)")).cast("decimal(38,19)")


def difference_hash(gray: Column, width: int = 9) -> Column:
    """64 bits of a 9 x 8 grey image, row by row: whether a pixel is brighter than the next; as a long."""
    bits = [F.when(gray[r * width + c] > gray[r * width + c + 1], F.lit(1 << (63 - (r * (width - 1) + c)) if r or c else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for r in range(8) for c in range(width - 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def strict_json(text: Column) -> Column:
    """Whether a text is JSON without repeated keys or numbers that are none (NaN, Infinity)."""
    outside = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    return F.coalesce(F.try_parse_json(text).isNotNull() & ~outside.rlike("NaN|Infinity"), F.lit(False))
