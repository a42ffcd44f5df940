"""Scans of folders of files and of mirrors, and their sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.mirror import REQUIRED


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def render(header: Column, body: Column) -> Column:
    """A mirror as text: the header's fields as JSON values between rules, then the body with one line end last."""
    clean = F.regexp_replace(F.replace(body, F.lit("\x00"), F.lit("")), r"\n*$", "")
    pairs = F.transform(F.map_entries(header), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(pairs, "\n"), F.lit("\n---\n"), clean, F.lit("\n"))


def parse(text: Column) -> Column:
    """struct<header map, body, problems>: what ``render`` wrote; missing fields are problems."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n?", 1)
    body = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")
    header = F.map_from_entries(F.transform(F.filter(F.split(head, "\n"), lambda x: x.contains(": ")), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.regexp_replace(x, "^[^:]*: ", "").alias("v"))))
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys(header))
    problems = F.when(~text.startswith("---\n"), F.array(F.lit("no-header"))).otherwise(F.transform(lacking, lambda x: F.concat(F.lit("missing:"), x)))
    return F.struct(header.alias("header"), body.alias("body"), problems.alias("problems"))


def write_mirrors(mirrors: DataFrame, path: str, partitions: int = 0) -> None:
    """One text row for each mirror (text); the committer makes the write all or nothing."""
    out = mirrors.select(F.col("text").alias("value"))
    (out.repartition(partitions) if partitions else out).write.option("lineSep", "\x1e\n").text(path)


def read_mirrors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\x1e\n").text(path).select(F.col("value").alias("text"))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL ledger with an explicit schema; rows that don't parse are in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
