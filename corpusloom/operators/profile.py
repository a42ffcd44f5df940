"""Profiles of endpoints and stages as rows: what is wrong with them, and what a plan would run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: what an endpoint may be, where its bytes go, what it may say and what no profile may hold
KINDS, EGRESS = ("openai-compatible", "elevenlabs", "auphonic", "command"), ("cloud", "local")
ENDPOINT_KEYS = ("kind", "egress", "base_url", "api_key_env", "timeout_seconds", "max_concurrency", "command", "cost_per_audio_hour_usd")
SECRETS = ("api_key", "key", "token", "secret")
#: fixed values: for each stage what it acts on, what may be set, and whether it always needs an endpoint
STAGES = {
    "ocr": (("pdf-scan-page", "image"), ("engine", "endpoint", "model", "applies_to", "orientation", "dpi", "prompt", "fallback", "max_pages", "cache"), False),
    "structure": (("pdf-scan-page", "pdf-native-page"), ("endpoint", "model", "applies_to", "native_pass", "mode", "preservation", "elements", "render_page_image", "output", "prompt", "cache"), False),
    "image_description": (("image",), ("endpoint", "model", "applies_to", "prompt", "max_words", "cache"), True),
    "transcription": (("audio", "video"), ("provider", "endpoint", "model", "applies_to", "language", "diarization", "timestamps", "verbatim", "audio_events", "second_pass"), True),
}
#: fixed values: settings with few values
CHOICES = {("structure", "native_pass"): ("deterministic", "none"), ("transcription", "second_pass"): ("off", "auto", "on")}


def _of(name: Column, at: int) -> Column:
    """What the table of stages has for a stage; null for an unknown one."""
    out = F.lit(None).cast("array<string>")
    for stage, spec in STAGES.items():
        out = F.when(name == stage, F.array(*map(F.lit, spec[at]))).otherwise(out)
    return out


def endpoint_problem(settings: Column) -> Column:
    """Why an endpoint (map of its settings) isn't one; null if it is. A profile names secrets' variables and never holds them."""
    keys = F.map_keys(settings)
    secret = F.array_intersect(keys, F.array(*map(F.lit, SECRETS)))
    unknown = F.array_except(keys, F.array(*map(F.lit, ENDPOINT_KEYS)))
    return (
        F.when(F.size(secret) > 0, F.concat(F.lit("secret:"), F.array_min(secret))).when(F.size(unknown) > 0, F.concat(F.lit("unknown-key:"), F.array_min(unknown)))
        .when(~F.coalesce(settings["kind"].isin(*KINDS), F.lit(False)), "kind").when(~F.coalesce(settings["egress"].isin(*EGRESS), F.lit(False)), "egress")
        .when((settings["kind"] == "command") & (F.coalesce(settings["command"], F.lit("")) == ""), "command")
    )


def stage_problems(stages: DataFrame, endpoints: DataFrame) -> DataFrame:
    """stage, problem of stages (id, name, settings map, applies array) against endpoints (endpoint); applies may only narrow what a stage acts on."""
    s, keys = F.col("settings"), F.map_keys("settings")
    acts, known = _of(F.col("name"), 0), _of(F.col("name"), 1)
    unknown, wider = F.array_except(keys, known), F.array_except("applies", acts)
    choice = F.lit(None).cast("string")
    for (stage, key), allowed in CHOICES.items():
        choice = F.when((F.col("name") == stage) & s[key].isNotNull() & ~s[key].isin(*allowed), f"choice:{key}").otherwise(choice)
    needs = F.col("name").isin(*(n for n, spec in STAGES.items() if spec[2])) | ((F.col("name") == "ocr") & (F.coalesce(s["engine"], F.lit("tesseract")) != "tesseract")) | ((F.col("name") == "structure") & s["model"].isNotNull())
    x = stages.join(endpoints.select(F.col("endpoint").alias("_e")).distinct(), s["endpoint"] == F.col("_e"), "left")
    problem = (
        F.when(known.isNull(), "unknown-stage").when(F.size(unknown) > 0, F.concat(F.lit("unknown-key:"), F.array_min(unknown))).when(F.size(wider) > 0, F.concat(F.lit("cannot-act-on:"), F.array_join(F.array_sort(wider), ",")))
        .when(choice.isNotNull(), choice).when(s["endpoint"].isNotNull() & F.col("_e").isNull(), F.concat(F.lit("undeclared:"), s["endpoint"])).when(s["endpoint"].isNull() & needs, "needs-endpoint")
    )
    return x.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def reports(files: DataFrame, plans: DataFrame, rates: DataFrame) -> DataFrame:
    """file, runs, sends, usd: the stages that a file's plan runs, those that send bytes off the machine, and what they would cost.

    files: (file, media_type, minutes). plans: (media_type, stage, runs, egress). rates: (stage, usd_per_hour), null for
    a rate that isn't declared, which leaves the cost unknown.
    """
    on = plans.where("runs").select(F.col("media_type").alias("_m"), "stage", "egress").join(rates, "stage", "left")
    cost = F.when(F.col("egress") == "cloud", F.col("minutes") * F.col("usd_per_hour") / 60).when(F.col("stage").isNotNull(), 0.0)
    x = files.join(on, F.col("media_type") == F.col("_m"), "left").withColumn("_c", cost)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return x.groupBy("file").agg(names("stage").alias("runs"), names(F.when(F.col("egress") == "cloud", F.col("stage"))).alias("sends"), F.when(F.count_if(F.col("stage").isNotNull() & F.col("_c").isNull()) == 0, F.round(F.coalesce(F.sum("_c"), F.lit(0.0)), 4)).alias("usd"))
