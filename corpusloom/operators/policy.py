"""Plans, decisions, estimates and budgets before anything is sent or paid for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.order import folded

#: fixed value: decibels of spread from which a recording counts as uneven
UNEVEN_DB = 25.0
#: media classes that a stage may apply to
STAGES = {"ocr": ("application", "image"), "transcribe": ("audio", "video"), "structure": ("application", "text"), "refine": ("audio", "video"), "describe": ("image",)}


def media_class(media_type: Column) -> Column:
    return F.substring_index(media_type, "/", 1)


def plan(media: DataFrame, stages: DataFrame, endpoints: DataFrame, local_only: bool = False) -> DataFrame:
    """media_type, stage, runs, reason: the first rule that holds for each stage of each media type.

    media: (media_type). stages: (stage, enabled, applies array<string>, endpoint). endpoints: (endpoint, egress,
    key_set). All three are small tables of a profile; Spark broadcasts them below its own threshold.
    """
    pairs = media.join(stages, F.lit(True)).join(endpoints, "endpoint", "left")
    hosted = F.col("egress") == "hosted"
    reason = (
        F.when(~F.arrays_overlap("applies", F.array(media_class(F.col("media_type")))), "not-applicable").when(~F.col("enabled"), "disabled").when(F.col("egress").isNull(), "no-endpoint")
        .when(hosted & F.lit(local_only), "local-only").when(hosted & ~F.col("key_set"), "key-missing").otherwise("runs")
    )
    return pairs.select("media_type", "stage", (reason == "runs").alias("runs"), reason.alias("reason"))


def second_pass(mode: Column, spread_db: Column) -> Column:
    """Whether a recording is levelled and heard twice: on, off, or auto from a spread of UNEVEN_DB."""
    return F.when(mode == "on", True).when(mode == "off", False).otherwise(F.coalesce(spread_db >= UNEVEN_DB, F.lit(False)))


def estimates(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, usd: rate * passes * minutes / 60 to four places, half to even; null if any rate is unknown."""
    cost = F.sum(F.col("rate") * F.col("passes") * F.col("minutes") / 60)
    return jobs.groupBy(*keys).agg(F.when(F.bool_and(F.col("rate").isNotNull()), F.bround(cost, 4)).alias("usd"))


def budget(jobs: DataFrame, key: str, order: str, minutes: str, limit: float) -> DataFrame:
    """key, order, accepted: jobs reserve minutes in order; one that doesn't fit is refused and takes nothing, as is one without minutes."""

    def step(used: float, m: float | None) -> tuple[float, bool]:
        fits = m is not None and used + m <= limit
        return (used + m, True) if fits else (used, False)

    return folded(jobs.withColumn(minutes, F.col(minutes).cast("double")), key, order, minutes, float, step, "accepted", "boolean")


def call_costs(calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys: calls, failures, seconds and tokens."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("outcome") != "ok").alias("failures"), F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("tokens").alias("tokens"))


def over_limit(pages: DataFrame, doc: str, needs: Column, limit: int) -> DataFrame:
    """Documents more pages of which need a model than the limit allows: nothing of them is sent."""
    return pages.where(needs).groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") > limit)


def ocr_jobs(workers: Column, cores: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(cores / F.least(workers, cores))).cast("int")
