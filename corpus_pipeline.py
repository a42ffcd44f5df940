"""A corpus pipeline: toxic and poor documents go, near copies go, sources are mixed, and what stays is packed.

Every stage takes (spark, docs, sf_dir) with docs of at least doc_id, text, lang and source. Nulls in any column, empty
texts, repeated rows and empty tables go through all stages; other columns are kept up to the last one, whatever their
names, as names that a stage needs for itself give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, lp_packing, mixing, rule_classifier, toxic_segments
from corpusloom.llm.common import fresh, settle, table

#: documents with this probability of being toxic go; those with less than this one of being good go
TOXIC, GOOD = 0.7, 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that the segment search takes for toxic, learnt from the labels of documents here.

    Null and empty texts have no toxic passage; without labels of both kinds all have the share of toxic ones as score
    and stay while that is below TOXIC. Repeated rows stay or go together; an empty table stays empty.
    """
    model = toxic_segments.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity")
    return toxic_segments.score_documents(docs, model, name).where(F.col(name)["score"] < TOXIC).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble takes for good.

    Null and empty texts are judged by the statistics of an empty text, and go wherever labels call such texts poor.
    Without labels every score is 0.5, below GOOD, and no document stays. Repeated rows stay or go together.
    """
    model = rule_classifier.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_score")
    return rule_classifier.score_documents(docs, model, name).where(F.col(name) >= GOOD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the smallest id, once.

    Documents without words and rows without an id have no partner to yield to and all stay; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target marginals.

    Null sources and languages are values like others; repeated rows are drawn together, rows without an id by their
    text; an empty table stays empty.
    """
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences; a null or empty text is its end id alone."""
    return lp_packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express the classifiers, the raking or the packing; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on all that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
