"""Quality rules with thresholds from mergeable quantile sketches.

Each metric gets a KLL sketch for each language and source. Sketches merge upwards into one for each language and
one for the corpus, so that a small group takes the thresholds of its parent. The table of thresholds is joined
back and a document outside a fence is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, settle, table
from corpusloom.llm.stats import text_stats

#: items of a sketch's lowest level: below as many rows a sketch is exact, above the rank error is about 0.1 %
SKETCH_K = 2048
#: rows that a group needs for thresholds of its own
MIN_ROWS = 32
#: fences stand this many quartile distances from the quartiles
REACH = 3.0
#: metric: (numerator, denominator, least distance of the upper fence from the quartile, whether there is a lower fence)
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 0.25, False),
    "repeat_share": ("n_repeat_words", "n_words", 0.25, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.25, False),
    "word_length": ("word_chars", "n_words", 3.0, True),
}


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with struct ``quality_stats``, boolean ``base_failed`` and the metrics as doubles (null without words)."""
    stats = fresh(docs, "quality_stats")
    out = docs.withColumn(stats, text_stats(F.col(text)))
    s = F.col(stats)
    out = out.withColumn("base_failed", (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words))
    for name, (top, bottom, _, _) in METRICS.items():
        out = out.withColumn(name, F.when(s[bottom] > 0, s[top].cast("double") / s[bottom]))
    return out


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """A sketch of each metric for each group of keys, from the rows that pass the base rules."""
    return measured.where(~F.col("base_failed")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(f"k_{name}") for name in METRICS),
    )


def merged(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The same sketches for coarser groups, merged instead of built again."""
    return groups.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), *(F.kll_merge_agg_double(f"k_{name}").alias(f"k_{name}") for name in METRICS)
    ).where("n_rows > 0")  # one group of no keys exists without rows too


def fences(groups: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Lower and upper fence of each metric: quartiles widened by REACH quartile distances, at least by the metric's own."""
    out = [*keys, F.col("n_rows").alias(f"{tag}_rows")]
    for name, (_, _, least, lower) in METRICS.items():
        q1, q3 = (F.kll_sketch_get_quantile_double(f"k_{name}", F.lit(p)) for p in (0.25, 0.75))
        width = F.greatest(REACH * (q3 - q1), F.lit(least))
        out.append((q3 + width).alias(f"{tag}_{name}_hi"))
        if lower:
            out.append((q1 - width).alias(f"{tag}_{name}_lo"))
    return groups.select(*out)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds boolean ``kept``: false if base_failed, else whether every metric is inside the fences of the row's group.

    A group is a language with a source. With fewer than MIN_ROWS rows it takes its language's fences, and with
    fewer there the corpus's. Null languages and sources are groups like others. measured is read twice; settle it.
    An empty table gives an empty table; where all rows failed the base rules none is kept. Sketches of more than
    SKETCH_K rows draw at random, so a row right at a fence of such a group may be kept in one run and not in another.
    """
    fine = settle(sketches(measured.withColumnsRenamed({lang: "q_lang", source: "q_source"}), ["q_lang", "q_source"]))
    by_lang = merged(fine, ["q_lang"])
    whole = fences(merged(fine, []), [], "all").first()
    if whole is None:  # no row passes the base rules
        return measured.withColumn("kept", F.lit(False))
    limits = fences(fine, ["q_lang", "q_source"], "group").join(
        fences(by_lang, [F.col("q_lang").alias("p_lang")], "lang"), F.col("q_lang").eqNullSafe(F.col("p_lang"))
    )
    pick = lambda end: F.when(F.col("group_rows") >= MIN_ROWS, F.col(f"group_{end}")).when(F.col("lang_rows") >= MIN_ROWS, F.col(f"lang_{end}")).otherwise(F.lit(whole[f"all_{end}"]))
    ends = [f"{name}_hi" for name in METRICS] + [f"{name}_lo" for name, m in METRICS.items() if m[3]]
    limits = limits.select("q_lang", "q_source", *(pick(end).alias(f"fence_{end}") for end in ends))
    inside = F.lit(True)
    for name, (_, _, _, lower) in METRICS.items():
        inside &= F.coalesce(F.col(name) <= F.col(f"fence_{name}_hi"), F.lit(True))
        if lower:
            inside &= F.coalesce(F.col(name) >= F.col(f"fence_{name}_lo"), F.lit(True))
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("q_lang")) & F.col(source).eqNullSafe(F.col("q_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("q_lang", "q_source", *(f"fence_{end}" for end in ends))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for each row of documents (doc_id, text, lang, source).

    Every row has a row in the result: null or empty texts fail the base rules, repeated rows are judged alike, other
    columns are ignored, and an empty table gives no rows. ``judge`` says which verdicts may vary between runs.
    """
    rows = docs.select("doc_id", F.col("text"), "lang", "source")
    s = F.col("quality_stats")
    measured = settle(with_metrics(rows).select(
        "doc_id", "lang", "source", *(s[f].alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", *METRICS
    ))
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality_rules`` of all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))
