"""Ledgers as streams: an extension beyond batch semantics, with the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over JSONL files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: results are reused by their hash."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and sums of value by window and kind, final once the watermark passes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), by, "n", "value")


def sessions(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end_"), by, "n")


def parks(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Opens and closes of parks (park_id, event, at) joined within the watermark: opened, closed."""
    o = stream.where("event = 'open'").select(F.col("park_id").alias("o_id"), F.col("at").alias("opened")).withWatermark("opened", late)
    c = stream.where("event = 'close'").select(F.col("park_id").alias("c_id"), F.col("at").alias("closed")).withWatermark("closed", late)
    return o.join(c, (F.col("o_id") == F.col("c_id")) & (F.col("closed") >= F.col("opened")) & (F.col("closed") <= F.col("opened") + F.expr("INTERVAL 1 DAY"))).select(F.col("o_id").alias("park_id"), "opened", "closed")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to Parquet of all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
